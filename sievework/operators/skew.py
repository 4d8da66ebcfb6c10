"""Joins that split a key which holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A key is hot if it holds more than this share of all rows, which at most 1 / HOT_SHARE keys do.
HOT_SHARE = 0.01
#: Rows of a hot key that stay together in a task; a key with fewer rows is never hot.
SALT_ROWS = 50_000
#: Distinct keys the sketch of frequent keys keeps; its error is about 3.5 / SKETCH_KEYS of the rows, far below HOT_SHARE.
SKETCH_KEYS = 8_192


def hot_keys(rows: DataFrame, keys: list[str], salt_rows: int = SALT_ROWS) -> dict[int, int]:
    """Hash of each hot key and the number of salts it takes.

    One pass with a mergeable sketch of frequent items: each task sends one sketch of fixed size, and
    the answer is one row with at most 1 / ``HOT_SHARE`` keys.
    """
    most = int(1 / HOT_SHARE)
    hashed = rows.select(F.xxhash64(*keys).alias("_hash"))
    found = hashed.agg(F.expr(f"approx_top_k(_hash, {most}, {SKETCH_KEYS})").alias("top"), F.count("*").alias("n")).first()
    return {r["item"]: -(-r["count"] // salt_rows) for r in found["top"] or [] if r["count"] > max(HOT_SHARE * found["n"], salt_rows)}


def salted_left_join(big: DataFrame, small: DataFrame, keys: list[str], counted: DataFrame | None = None, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Left join of ``big`` to ``small`` (unique on ``keys``) with salted hot keys.

    The rows of a key that holds a large part of ``big`` get one of as many salts as it needs
    tasks, and only the rows of ``small`` with a hot key are repeated, once per salt; all
    other rows have one salt. So neither side grows but by a bounded number of rows. Hot keys are found in
    one pass over ``counted`` (rows with the same frequent keys that are cheaper to read), else over ``big``.
    Null keys match nothing, as in SQL; many of them are salted as well.
    """
    hot = hot_keys(big if counted is None else counted, keys, salt_rows)
    if not hot:
        return big.join(small, keys, "left")
    names = [f.name for f in big.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    key, any_row = F.xxhash64(*keys), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in names])
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), key), F.lit(1))
    salted = big.withColumn("_salt", F.pmod(any_row, salts).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """``unionByName`` of all frames."""
    return reduce(DataFrame.unionByName, frames)


#: Most bytes, as rows are held in memory, of a side that is broadcast on purpose.
BROADCAST_BYTES = 16_000_000


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``most`` bytes, else as it is, for a shuffled join.

    The size is summed up in the executors over the rows themselves (eight bytes a fixed field,
    text and nested values by their length), and only the sum reaches the driver.
    """
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary") or "<" in f.dataType.simpleString()]
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`") if df.schema[c].dataType.simpleString() in ("string", "binary") else F.to_json(F.struct(f"`{c}`"))), F.lit(0)) for c in wide]
    size = df.agg(F.sum(sum(texts, F.lit(16 + 8 * len(df.columns))).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], counted: DataFrame | None = None) -> DataFrame:
    """Left join of ``big`` to a table to look up in (unique on ``keys``): broadcast if its bytes allow it, else on salted hot keys."""
    sized = small_side(small)
    return salted_left_join(big, small, keys, counted) if sized is small else big.join(sized, keys, "left")


def settled(df: DataFrame) -> DataFrame:
    """``df`` with all its columns computed at this point.

    Projections in a row are otherwise merged by the optimizer, and an expression used several
    times in the next one is then computed as many times; over a few steps that multiplies.
    A one-element explode keeps them apart and stays within code generation.
    """
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
