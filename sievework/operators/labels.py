"""Boxes over personal data on read pages: by the text rules, by labels beside values, by shape and place.

Every finder gives ``doc_id, page, kind, x0, y0, x1, y1`` and works on rows and parts of a page; only the
scan along the few words of one row part runs in Python, on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from sievework.functions import text as T
from sievework.operators import layout, pii
from sievework.operators.layout import PAGE

#: Pixels between words from which a row is two columns.
COLUMN_GAP = 150.0

# Labels of a person's name, longer ones before those they begin with; fields that end a value.
NAME_LABELS = ("담당의사", "처방의사", "조제약사", "담당약사", "판독의사", "판독의", "주치의", "집도의", "진료의", "검사자", "조제자", "성명", "이름")
NAME_STOPS = "성별 나이 생년월일 주민번호 주민등록번호 환자번호 검사번호 주소 연락처 전화번호 병명 진단일 판독일 처방의약품 용법 투약일수 검사항목 결과 면허번호 면허등록번호 서명 소견 확인 직인 날인 요양기관 의료기관"
VALUE_STOPS = "성명 성별 나이 생년월일 주민번호 주민등록번호 환자번호 주소 연락처 전화번호 팩스번호 면허번호 서명 날인"
# Labels of other values with the kind of these, the most words and characters, and whether it is an institution's.
VALUE_LABELS = (
    ("요양기관기호", "개인식별번호", 2, 16, False), ("주민등록번호", "주민등록번호", 2, 16, False), ("전화번호", "전화번호", 2, 18, False), ("팩스번호", "전화번호", 2, 18, False),
    ("면허번호", "개인식별번호", 3, 14, False), ("의료인의", "성명", 3, 5, False), ("조제약사", "성명", 3, 5, False), ("명칭", "기관명", 5, 12, True),
)
NAME_GAP, VALUE_GAP = 40.0, 90.0
#: Shares of a page's height: above the first an institution's name stands, above the second a person's alone.
INSTITUTION_TOP, PERSON_TOP = 0.34, 0.42
NOT_PERSONS = ("성명", "이름", "의사", "약사", "질병", "분류", "기호", "처방", "보험")
RECORD_LABEL = r"^(?:환자|병원|차트|등록|접수|처방전)(?:번[호흐로]|ID|NO)$"
#: How far right of a record label its value may begin, as a share of the page's width, and how many words it may have.
RECORD_REACH, RECORD_WORDS = 0.38, 3
# The height of a word from which it may be two lines read as one, and the share of the width it then has.
TALL_WORD, WIDE_WORD = 36.0, 0.25


class Value(NamedTuple):
    """What may follow a label: the widest gap, the most words and characters, and the fields that end it."""

    gap: float
    words: int
    chars: int
    stops: frozenset[str]
    stop_parts: tuple[str, ...] = ()


def label_end(texts: Sequence[str], label: str) -> tuple[int, bool] | None:
    """The word in which a label's last character stands, and whether the word goes on behind it; null without the label."""
    start = "".join(texts).find(label)
    if start < 0:
        return None
    end, at = start + len(label), 0
    for i, t in enumerate(texts):
        at += len(t)
        if at >= end:
            return i, end < at
    return None


def value_words(words: Sequence[dict], first: int, rule: Value) -> list[dict]:
    """The words of a value from word ``first`` on: none of a stop field, none behind a wide gap, no more than the rule allows."""
    out: list[dict] = []
    size = 0
    for w in words[first:]:
        bare = re.sub(r"[\s:：|]", "", w["text"])
        if not bare:
            continue
        if bare in rule.stops or any(p in bare for p in rule.stop_parts) or (out and w["x0"] - out[-1]["x1"] > rule.gap):
            break
        out.append(w)
        size += len(bare)
        if len(out) >= rule.words or size >= rule.chars:
            break
    return out


def around(kind: str, words: Sequence[dict]) -> dict:
    """The box around words."""
    return {"kind": kind, "x0": min(w["x0"] for w in words), "y0": min(w["y0"] for w in words), "x1": max(w["x1"] for w in words), "y1": max(w["y1"] for w in words)}


_NAME_RULE = Value(NAME_GAP, 3, 5, frozenset(NAME_STOPS.split()))


def name_boxes(words: Sequence[dict]) -> list[dict]:
    """The name behind the first label found in a row part; a word that holds the label and more is hidden itself."""
    texts = [re.sub(r"\s", "", w["text"]) for w in words]
    for label in NAME_LABELS:
        found = label_end(texts, label)
        if found is None:
            continue
        at, goes_on = found
        value = [words[at]] if goes_on else value_words(words, at + 1, _NAME_RULE)
        return [around("성명", value)] if value else []
    return []


def value_boxes(words: Sequence[dict], height: float) -> list[dict]:
    """The values behind all other labels of a row part."""
    texts = [re.sub(r"[\s:：|]", "", w["text"]) for w in words]
    middle = sum((w["y0"] + w["y1"]) / 2 for w in words) / len(words) if words else 0.0
    out = []
    for label, kind, most_words, most_chars, institution in VALUE_LABELS:
        if institution and middle > height * INSTITUTION_TOP and "조제기관" not in "".join(texts):
            continue
        found = label_end(texts, label)
        value = value_words(words, found[0] + 1, Value(VALUE_GAP, most_words, most_chars, frozenset(VALUE_STOPS.split()), ("서명", "날인"))) if found else []
        if value:
            out.append(around(kind, value))
    return out


_BOX = StructType([StructField("kind", StringType()), *[StructField(c, DoubleType()) for c in ("x0", "y0", "x1", "y1")]])
_BOX_LIST = pa.list_(pa.struct([("kind", pa.string()), *[(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")]]))


@F.arrow_udf(ArrayType(_BOX))
def _row_boxes(words: pa.Array, heights: pa.Array) -> pa.Array:
    return pa.array([name_boxes(w or []) + value_boxes(w or [], h or 0.0) for w, h in zip(words.to_pylist(), heights.to_pylist())], _BOX_LIST)


def row_parts(words: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """Row parts of pages with their ``words`` from left to right; a page's row is a bounded group."""
    split = layout.split_by_gap(layout.visual_rows(words), gap, [*PAGE, "row_no"])
    ordered = F.array_sort(F.collect_list(F.struct("x0", "word_no", F.coalesce("text", F.lit("")).alias("text"), "y0", "x1", "y1")))
    return split.groupBy(*PAGE, "row_no", "part_no").agg(ordered.alias("words"))


_OUT = [*PAGE, "kind", "x0", "y0", "x1", "y1"]


def by_label(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Names and other values beside their labels; ``pages``: ``doc_id, page, width, height``."""
    parts = row_parts(words).join(pages.select(*PAGE, "height"), PAGE)
    return parts.select(*PAGE, F.explode(_row_boxes("words", F.col("height").cast("double"))).alias("b")).select(*PAGE, "b.*")


def by_rule(words: DataFrame) -> DataFrame:
    """What the text rules find in the lines of words with a ``line_key``, as the box around the words it touches."""
    placed = layout.lines(words)
    keys = [*PAGE, "line_key"]
    spans = placed.select(*keys, "line_text").distinct().select(*keys, F.explode(pii.spans_of(F.col("line_text"))).alias("s")).select(*keys, "s.kind", "s.start", "s.end")
    numbered = spans.withColumn("span_no", F.row_number().over(Window.partitionBy(*keys).orderBy("start", F.desc("end"), "kind")))
    hit = placed.join(numbered.select(*keys, "kind", "span_no", F.col("start").alias("s"), F.col("end").alias("e")), keys).filter((F.col("end") > F.col("s")) & (F.col("start") < F.col("e")))
    return _around(hit, [*PAGE, "line_key", "kind", "span_no"])


def _around(rows: DataFrame, keys: list[str]) -> DataFrame:
    boxed = rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return boxed.select(*_OUT)


def phones(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Telephone numbers read with look-alike letters; a very tall and wide one is two lines read as one, and gets two boxes."""
    found = words.filter(T.phone_repaired("text").isNotNull()).join(pages, PAGE).withColumn("kind", F.lit("전화번호"))
    box = layout.padded_union(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")])
    tall = (F.col("y1") - F.col("y0") > TALL_WORD) & (box["x1"] - box["x0"] > F.col("width") * WIDE_WORD)
    middle = (box["y0"] + box["y1"]) / 2
    piece = lambda a, b: F.struct(box["x0"].alias("x0"), a.alias("y0"), box["x1"].alias("x1"), b.alias("y1"))
    pieces = F.when(tall, F.array(piece(box["y0"], middle), piece(middle, box["y1"]))).otherwise(F.array(piece(box["y0"], box["y1"])))
    return found.select(*PAGE, "kind", F.explode(pieces).alias("b")).select(*PAGE, "kind", "b.*")


def persons(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines high on the page that are a name alone, of two to four words and as many syllables."""
    by = F.array_sort(F.collect_list(F.struct("x0", "word_no", "text")))
    lines = words.groupBy(*PAGE, "line_key").agg(
        by.alias("w"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("middle"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    tokens = F.filter(F.split(F.array_join(F.transform("w", lambda w: w["text"]), " "), r"\s+"), lambda t: t != "")
    named = lines.withColumn("n", F.size(tokens)).withColumn("name", F.array_join(tokens, "")).join(pages.select(*PAGE, "height"), PAGE)
    fits = F.col("n").between(2, 4) & F.col("name").rlike(f"^[{pii.SURNAMES}][가-힣]{{1,3}}$") & ~F.col("name").isin(*NOT_PERSONS)
    return named.filter(fits & (F.col("middle") <= F.col("height") * PERSON_TOP)).withColumn("kind", F.lit("성명")).select(*_OUT)


def record_ids(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Labels of record numbers with up to three words right of them in the same row.

    The few labels of a page join its words; a word is in the row if it overlaps a quarter of the smaller height
    or its middle is within 0.65 of the larger one.
    """
    filled = words.filter(T.trimmed("text") != "")
    labels = filled.filter(F.upper(F.regexp_replace("text", r"[\s:：._-]", "")).rlike(RECORD_LABEL)).join(pages.select(*PAGE, "width"), PAGE)
    mine = labels.select(*PAGE, F.col("word_no").alias("label_no"), *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")], "width")
    height, own = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")), F.greatest(F.lit(1.0), F.col("ly1") - F.col("ly0"))
    shared = F.least("y1", "ly1") - F.greatest("y0", "ly0")
    same_row = (shared >= F.least(height, own) * 0.25) | (F.abs((F.col("ly0") + F.col("ly1")) / 2 - (F.col("y0") + F.col("y1")) / 2) <= F.greatest(height, own) * 0.65)
    beside = (F.col("x0") >= F.col("lx1") - 6) & (F.col("x0") <= F.col("lx1") + F.col("width") * RECORD_REACH) & (F.col("word_no") != F.col("label_no"))
    order = Window.partitionBy(*PAGE, "label_no").orderBy("x0", "word_no")
    right = filled.join(mine, PAGE).filter(same_row & beside).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= RECORD_WORDS)
    ends = right.groupBy(*PAGE, "label_no", "lx0", "ly0", "lx1", "ly1").agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    return ends.select(
        *PAGE, F.lit("개인식별번호").alias("kind"), F.least("lx0", "a").alias("x0"), F.least("ly0", "b").alias("y0"), F.greatest("lx1", "c").alias("x1"), F.greatest("ly1", "d").alias("y1")
    )


def emails(words: DataFrame) -> DataFrame:
    """Words with an @ and the neighbours they were split from."""
    rows = layout.visual_rows(words)
    found = layout.email_parts(rows)
    tops = rows.groupBy(*PAGE, "row_no").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return found.join(tops, [*PAGE, "row_no"]).withColumn("kind", F.lit("이메일")).select(*_OUT)


def boxes_from_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """All boxes of pages, padded and clipped, those that share most of their area merged.

    ``words``: ``doc_id, page, word_no, text, x0, y0, x1, y1, line_key``; ``pages``: ``doc_id, page, width, height``, one row each.
    Pages without words have no boxes.
    """
    pages = pages.select(*PAGE, F.col("width").cast("double"), F.col("height").cast("double"))
    found = [by_rule(words), emails(words), by_label(words, pages), persons(words, pages), record_ids(words, pages)]
    every = found[0].withColumn("_from", F.lit(0))
    for i, one in enumerate(found[1:], 1):
        every = every.unionByName(one.withColumn("_from", F.lit(i)))
    padded = layout.padded_union(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")])
    every = every.join(pages, PAGE).select(*PAGE, "kind", "_from", padded.alias("b")).select(*PAGE, "kind", "_from", "b.*").unionByName(phones(words, pages).withColumn("_from", F.lit(len(found))))
    order = Window.partitionBy(*PAGE).orderBy("_from", "y0", "x0", "kind", "x1")
    return layout.merge_boxes(every.withColumn("box_no", F.row_number().over(order)))


# Kinds an offline check looks for in plain text, with the weight of a hit.
RECOGNIZERS = (
    ("KR_RRN", r"\d{6}[-\s]?[1-8]\d{6}", 0.9),
    ("KR_PHONE_NUMBER", r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}", 0.85),
    ("KR_PHONE_NUMBER", r"0\d{1,2}[-\s]?\d{3,4}[-\s]?\d{4}", 0.6),
    ("EMAIL_ADDRESS", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 0.85),
)


def recognized(text: Column | str) -> Column:
    """Hits of the offline check: kind, text and weight, by kind; an empty list for none."""
    hits = lambda kind, pattern, weight: F.transform(
        F.regexp_extract_all(T.safe(text), F.lit(f"({pattern})"), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text"), F.lit(weight).alias("weight"))
    )
    return F.flatten(F.array(*[hits(*r) for r in RECOGNIZERS]))
