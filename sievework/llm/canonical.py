"""Freely typed values mapped to the entries of a reference list.

The distinct tokens of all values join the tokens of the reference names over shared
deletion neighbours, which finds every pair at most one edit apart, two in long
names, by equality joins alone. The corrected tokens are then combined with weights by rarity (soft
TF-IDF), and the best complete entry is taken, or none.
"""

from __future__ import annotations


import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from sievework.llm.lookalike import look
from sievework.operators.skew import salted_left_join, small_side, union_all
from sievework.session import materialize

#: Least share of a name, weighted by rarity, that the corrected tokens must make up.
MIN_NAME_COVER = 0.6
# Endings written directly after a name that say nothing of it.
ENDINGS = ("임", "됨", "빛", "색상", "정제", "정", "알약", "형태", "모양", "추정", "계열", "코팅", "처리", "표시", "톤", "ish", "shaped", "shape", "colored", "coloured")

#: Names of at least so many characters may be typed with two edits.
LONG_NAME = 8

WORD = re.compile(r"[^\W_]+")
HANGUL_BASE, HANGUL_LAST = 0xAC00, 0xD7A3


def fold(text: str) -> str:
    """Lower-case compatibility form without anything invisible."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", look(text) or "").casefold())


def words(text: str | None) -> list[str]:
    """The words of a value: runs of letters and digits; a change of script or to digits also ends a word."""
    out = []
    for run in WORD.findall(fold(text or "")):
        out.extend(re.findall(r"\d+|[ᄀ-ᇿ㄰-㆏가-힣]+|[^\dᄀ-ᇿ㄰-㆏가-힣]+", run))
    return out


def jamo(syllable: str) -> tuple[int, int, int] | None:
    """Places of the three parts of a Hangul syllable."""
    code = ord(syllable)
    if not HANGUL_BASE <= code <= HANGUL_LAST:
        return None
    code -= HANGUL_BASE
    return code // 588, code % 588 // 28, code % 28


def letter_loss(a: str, b: str) -> float:
    """What changing one character into another costs: a third for one part of a Hangul syllable, else one."""
    x, y = jamo(a), jamo(b)
    if x and y:
        changed = sum(p != q for p, q in zip(x, y))
        return 0.4 if changed == 1 else 2.0
    return 1.0


def edits_allowed(name: str) -> int:
    """How many edits a name's token may be typed with."""
    return 2 if len(name) >= LONG_NAME else 1


def likeness(typed: str, name: str) -> float:
    """Likeness of a typed token to a name's, from 0 (more edits than ``edits_allowed``) to 1 (equal).

    Edits: one character added, missing or changed, or two neighbours swapped; of
    a Hangul syllable changing one part costs 0.4, changing more than one two edits. A doubled letter costs a little
    less than any other added one, and so do a missing one and a swap.
    """
    if typed == name:
        return 1.0
    n, m = len(typed), len(name)
    most = edits_allowed(name)
    if abs(n - m) > most:
        return 0.0
    # fewest edits, and their loss, that turn the first i of typed into the first j of name, two rows back
    plus = lambda x, edits, loss: (x[0] + edits, x[1] + loss)
    older: list[tuple[int, float]] = []
    before = [(j, 0.95 * j) for j in range(m + 1)]
    for i in range(1, n + 1):
        a, extra = typed[i - 1], 0.8 if i > 1 and typed[i - 1] == typed[i - 2] else 1.0
        now = [plus(before[0], 1, extra)]
        for j in range(1, m + 1):
            b = name[j - 1]
            changed = 0.0 if a == b else letter_loss(a, b)
            best = min(plus(before[j - 1], -int(-changed // 1), changed), plus(before[j], 1, extra), plus(now[j - 1], 1, 0.95))
            if i > 1 and j > 1 and a == name[j - 2] and typed[i - 2] == b and a != b:
                best = min(best, plus(older[j - 2], 1, 0.9))
            now.append(best)
        older, before = before, now
    edits, loss = before[m]
    return max(0.0, 1.0 - loss / max(n, m)) if edits <= most else 0.0


def neighbours(token: str, least: int = LONG_NAME) -> list[str]:
    """The token and every token with one character less, or up to two of a token of at least ``least`` characters.

    A single letter has no shorter neighbour unless it is a Hangul syllable, of which one part may be mistyped.
    """
    once = {token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) > 1 or jamo(token or "a") else set()
    twice = {x[:i] + x[i + 1 :] for x in once for i in range(len(x))} if len(token) >= least else set()
    return sorted({token} | once | twice)


@F.arrow_udf(ArrayType(StringType()))
def name_neighbours(tokens: pa.Array) -> pa.Array:
    return pa.array([neighbours(t) if t is not None else None for t in tokens.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def typed_neighbours(tokens: pa.Array) -> pa.Array:
    # a long name may lack two characters as typed
    return pa.array([neighbours(t, LONG_NAME - 2) if t is not None else None for t in tokens.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(DoubleType())
def likeness_udf(typed: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array([likeness(a, b) for a, b in zip(typed.to_pylist(), names.to_pylist())], pa.float64())


@F.arrow_udf(ArrayType(StringType()))
def words_udf(values: pa.Array) -> pa.Array:
    return pa.array([words(v) if v is not None else None for v in values.to_pylist()], pa.list_(pa.string()))


def candidates(tokens: list[str], longest: int) -> set[tuple[str, int, int]]:
    """Possible spellings of name tokens in a value: runs of neighbouring words written
    together, of at most ``longest`` characters, not counting an ending that is taken off. Each with
    its first and last word."""
    out = set()
    for first in range(len(tokens)):
        joined = ""
        for last in range(first, len(tokens)):
            joined += tokens[last]
            if len(joined) > longest + max(map(len, ENDINGS)):
                break
            if len(joined) <= longest:
                out.add((joined, first, last))
            for ending in ENDINGS:
                if joined.endswith(ending) and 0 < len(joined) - len(ending) <= longest:
                    out.add((joined[: -len(ending)], first, last))
    return out


def reference_names(reference: DataFrame) -> DataFrame:
    """``field, value_id, name, tokens`` of every label, English label and alias of the list."""
    names = F.array_compact(F.flatten(F.array(F.array("label", "label_en"), F.coalesce("aliases", F.array().cast("array<string>")))))
    each = reference.select("field", F.col("value_id").alias("value_id"), F.explode(F.array_distinct(names)).alias("name"))
    return each.withColumn("tokens", words_udf("name")).filter(F.size("tokens") > 0)


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """``field, value, n_rows, value_id, score`` for every distinct value that is no label.

    ``values``: ``field, value``; null, blank and exact label values are left out.
    ``value_id`` is 0 when the value stands for no entry. Between entries of equal
    score the one whose names are typed more often exactly wins, then the smaller id.
    """
    labels = reference.select("field", F.col("label").alias("value"), F.lit(1).alias("_label")).distinct()
    counted = (
        values.filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count("*").alias("n_rows"))
        .filter(F.col("value").rlike(r"(?U)\S"))
    )
    counted = materialize(counted)  # the distinct values, read by each of the steps below
    typed = materialize(counted.join(labels, ["field", "value"], "left_anti").withColumn("words", words_udf("value")))
    names = materialize(reference_names(reference))
    # a name counts as its words and, written together, as one token
    whole = names.withColumn("token", F.array_join("tokens", ""))
    name_tokens = names.select("field", "value_id", "name", F.explode(F.array_distinct("tokens")).alias("token"))
    rarity = (
        name_tokens.select("field", "token", "name").distinct().groupBy("field", "token").agg(F.count("*").alias("df"))
        .join(names.groupBy("field").agg(F.countDistinct("name").alias("n")), "field")
        .select("field", "token", F.log1p(F.col("n") / F.col("df")).alias("idf"))
    )
    weighed = name_tokens.join(rarity, ["field", "token"])
    weighed = weighed.withColumn("weight", F.col("idf") / F.sum("idf").over(Window.partitionBy("field", "value_id", "name")))
    parts = materialize(
        union_all(
            [
                weighed.select("field", "value_id", "name", "token", "weight"),
                whole.filter(F.size("tokens") > 1).select("field", "value_id", "name", "token", F.lit(1.0).alias("weight")),
            ]
        )
    )
    longest = (parts.agg(F.max(F.length("token"))).first()[0] or 0) + 3

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (field, value, len(tokens), *c)
                for field, value, tokens in zip(*[x.to_pylist() for x in b.columns])
                for c in sorted(candidates(tokens, longest))
            ]
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], ["field", "value", "n_words", "typed", "first", "last"]
            )

    spelled = typed.select("field", "value", "words").mapInArrow(
        spell, "field string, value string, n_words int, typed string, first int, last int"
    )
    spelled = materialize(spelled)
    near_typed = spelled.select("field", "typed").distinct().withColumn("near", F.explode(typed_neighbours("typed")))
    near_names = parts.select("field", "token").distinct().withColumn("near", F.explode(name_neighbours("token")))
    pairs = near_typed.join(small_side(near_names), ["field", "near"]).select("field", "typed", "token").distinct()
    repaired = pairs.withColumn("sim", likeness_udf("typed", "token")).filter(F.col("sim") > 0)
    # each candidate of each value with each name token it may mean; a word of very many values is spread over tasks
    means = materialize(repaired.join(small_side(parts), ["field", "token"]))
    hits = materialize(salted_left_join(spelled, means, ["field", "typed"]).filter(F.col("token").isNotNull()))

    # how much of each name is there: words together or the name in one
    per_token = hits.groupBy("field", "value", "value_id", "name", "token").agg(F.max("sim").alias("sim"), F.first("weight").alias("weight"))
    is_whole = F.col("weight") == 1.0
    covered_name = per_token.groupBy("field", "value", "value_id", "name").agg(
        F.greatest(F.coalesce(F.max(F.when(is_whole, F.col("sim"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_whole, F.col("sim") * F.col("weight"))), F.lit(0.0))).alias("cover")
    )
    best_name = covered_name.groupBy("field", "value", "value_id").agg(F.max("cover").alias("name_cover"))
    # how much of the value the entry explains, by the rarity of the value's words among all values
    word_rows = typed.select("field", "value", F.posexplode("words").alias("place", "word"))
    n_values = typed.groupBy("field").agg(F.count("*").alias("n"))
    word_idf = word_rows.groupBy("field", "word").agg(F.countDistinct("value").alias("df")).join(n_values, "field")
    word_weight = salted_left_join(word_rows, word_idf.select("field", "word", F.log1p(F.col("n") / F.col("df")).alias("idf")), ["field", "word"])
    total = word_weight.groupBy("field", "value").agg(F.sum("idf").alias("total"))
    explained = hits.select("field", "value", "value_id", "sim", F.explode(F.sequence("first", "last")).alias("place")).groupBy(
        "field", "value", "value_id", "place"
    ).agg(F.max("sim").alias("sim"))
    value_cover = (
        explained.join(word_weight, ["field", "value", "place"])
        .groupBy("field", "value", "value_id")
        .agg(F.sum(F.col("sim") * F.col("idf")).alias("got"))
        .join(total, ["field", "value"])
        .select("field", "value", "value_id", (F.col("got") / F.col("total")).alias("value_cover"))
    )
    usual = (
        counted.join(names.select("field", "value_id", F.col("name").alias("value")), ["field", "value"])
        .groupBy("field", "value_id")
        .agg(F.sum("n_rows").alias("usual"))
    )
    scored = (
        best_name.filter(F.col("name_cover") >= MIN_NAME_COVER)
        .join(value_cover, ["field", "value", "value_id"])
        .join(usual, ["field", "value_id"], "left")
        .withColumn("score", F.round(F.col("name_cover") * (0.5 + 0.5 * F.col("value_cover")), 6))
    )
    best = scored.groupBy("field", "value").agg(
        F.max_by(F.struct("value_id", "score"), F.struct("score", F.coalesce("usual", F.lit(0)), -F.col("value_id"))).alias("b")
    )
    return typed.join(best, ["field", "value"], "left").select(
        "field", "value", "n_rows", F.coalesce("b.value_id", F.lit(0)).cast("int").alias("value_id"), F.col("b.score").alias("score")
    )


def map_cells(sheet_cells: DataFrame, reference: DataFrame) -> DataFrame:
    """``row_id, field, value, value_id`` of every cell that is not blank and no label."""
    mapped = map_values(sheet_cells.select("field", "value"), reference).select("field", "value", "value_id")
    joined = salted_left_join(sheet_cells.select("row_id", "field", "value"), mapped, ["field", "value"])
    return joined.filter(F.col("value_id").isNotNull())


def unmatched_report(sheet_cells: DataFrame, reference: DataFrame) -> DataFrame:
    """The distinct values that stand for no entry, with the number of their cells."""
    return map_values(sheet_cells.select("field", "value"), reference).filter(F.col("value_id") == 0).select("field", "value", "n_rows")
