"""Sources mixed to target shares of the total size.

Every text of a source is expected the same number of times; the expected copies are
summed in a fixed order, a random offset is added once per source, and a text is used
once for each whole number its sum steps over. The running sums are built from counts
of small strata, so no source, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.skew import small_side
from sievework.session import materialize

#: Strata of a source: a size class (four to a doubling) times so many hash classes, or more in a
#: large source, so that a stratum has about ``STRATUM_TEXTS`` texts at most whatever the source's size.
HASH_CLASSES = 64
STRATUM_TEXTS = 20_000


def one_per_text(items: DataFrame) -> DataFrame:
    """``items`` with ``counts``: whether the row stands for its text.

    Of rows with one ``text_key`` in any source of the mix the one with the smallest
    ``item``, null before others, then the smallest ``row`` stands for the text; the others are not used.
    """
    stands = items.groupBy("text_key").agg(F.min(F.struct("item", "row"))["row"].alias("row"))
    return items.join(stands.withColumn("counts", F.lit(True)), ["text_key", "row"], "left").withColumn(
        "counts", F.coalesce("counts", F.lit(False))
    )


def plan(items: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, share, max_repeats, size, copies``: the expected copies of each text of a source.

    The total is the largest for which no source exceeds its cap. Sources of the list
    without any size are left out and the shares of the others scaled up to 1; sources with no
    or a negative share, or a cap below 1, are not used.
    """
    sizes = items.filter("counts").groupBy("source").agg(F.sum("size").alias("size"))
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("max_repeats"))
    there = wanted.join(sizes, "source").filter((F.col("size") > 0) & (F.col("share") > 0) & (F.col("max_repeats") >= 1))
    whole = Window.partitionBy(F.lit(1))  # the rows of the target list, a handful
    scaled = there.withColumn("share", F.col("share") / F.sum("share").over(whole))
    total = F.min(F.col("max_repeats") * F.col("size") / F.col("share")).over(whole)
    return scaled.withColumn("copies", F.least(F.col("share") * total / F.col("size"), F.col("max_repeats").cast("double")))


def offset(seed: int, source: Column | str) -> Column:
    """A number from 0 to 1 for a source, the same for the same seed."""
    return F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 40)) / F.lit(float(1 << 40))


def use_counts(items: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """``item, source, size, use_count`` of every row.

    ``items``: ``item, source, size, text_key``. Rows without a source of the list, copies
    of another row's text and rows of size 0 have 0. Within a source, texts are ordered by
    size class, then by hash, so the uses are spread evenly over all sizes.
    """
    mixed = targets.select("source").distinct()
    # items may be null or repeated: each row has a number of its own, written down so that it stays
    items = materialize(items.withColumn("row", F.monotonically_increasing_id()))
    in_mix = items.join(small_side(mixed), "source", "left_semi")
    marked = one_per_text(in_mix)
    marked = materialize(marked)
    texts = marked.filter(F.col("counts") & (F.col("size") > 0)).groupBy("source").agg(F.count("*").alias("n_texts"))
    classes = F.greatest(F.lit(HASH_CLASSES), F.ceil(F.col("n_texts") / STRATUM_TEXTS)).cast("int").alias("classes")
    plans = materialize(plan(marked, targets).join(texts, "source").select("source", "copies", classes))
    size_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 4)).otherwise(-1).cast("int")
    used = (
        marked.filter(F.col("counts") & (F.col("size") > 0)).join(small_side(plans), "source")
        .select("row", "item", "source", "copies", size_class.alias("size_class"), F.pmod(F.xxhash64(F.lit(seed), "item"), F.col("classes")).cast("int").alias("hash_class"))
    )
    stratum = ["source", "size_class", "hash_class"]
    before = Window.partitionBy("source").orderBy("size_class", "hash_class").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows per source and size class as it has hash classes
    bases = used.groupBy(*stratum).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = used.withColumn("rank", F.row_number().over(Window.partitionBy(*stratum).orderBy(F.xxhash64(F.lit(seed), "item"), "item", "row")))
    summed = ranked.join(bases, stratum)
    upto = F.col("base") + F.col("rank")
    counted = summed.select(
        "row",
        (F.floor(upto * F.col("copies") + offset(seed, "source")) - F.floor((upto - 1) * F.col("copies") + offset(seed, "source"))).cast("int").alias("use_count"),
    )
    return items.select("row", "item", "source", "size").join(counted, "row", "left").drop("row").withColumn("use_count", F.coalesce("use_count", F.lit(0)))


def share_report(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the list: texts, texts used, most uses, size used, target share and actual share (0 for a source without texts)."""
    used = (
        counted.groupBy("source")
        .agg(
            F.count("*").alias("n_texts"),
            F.count_if(F.col("use_count") > 0).alias("n_used"),
            F.max("use_count").alias("most_uses"),
            F.sum(F.col("size") * F.col("use_count")).alias("used_size"),
        )
    )
    rows = targets.join(used, "source", "left").na.fill(0, ["n_texts", "n_used", "most_uses", "used_size"])
    whole = Window.partitionBy(F.lit(1))  # the rows of the target list, a handful
    return rows.select(
        "source", "target_share", "max_repeats", "n_texts", "n_used", "most_uses", "used_size",
        F.round(F.try_divide(F.col("used_size"), F.sum("used_size").over(whole)), 6).alias("actual_share"),
    )
