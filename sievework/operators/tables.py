"""Answer sheets as tables: from words on read pages, from lines of printed ones, from rows of cells."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import layout
from sievework.operators.layout import PAGE
from sievework.operators.records import SHEET_COLUMNS

#: Columns a header must name to be one, rows searched for it, and the confidence below which a value is doubtful.
LEAST_HEADERS = 3
HEADER_ROWS = 20
LOW_CONFIDENCE = 70.0
#: Pixels of height within which texts of a printed page are one line.
LINE_HEIGHT = 2.5

REQUIRED = ("case_id", "front_image", "back_image")


def header_key(text: str | None) -> str:
    """A header cell as it is compared: compatibility form, lower case, letters and digits only."""
    return re.sub(r"[^0-9a-z가-힣]", "", unicodedata.normalize("NFKC", (text or "").lstrip("﻿")).lower())


class Headers:
    """Columns by the names of their headers: an exact one, else the one column of which it is a beginning of three characters or more."""

    def __init__(self, aliases: Mapping[str, str]) -> None:
        self.exact = {header_key(name): column for name, column in aliases.items()}

    def get(self, text: str | None) -> str:
        key = header_key(text)
        if not key:
            return ""
        if key in self.exact:
            return self.exact[key]
        begun = {c for name, c in self.exact.items() if name.startswith(key)} if len(key) >= 3 else set()
        return begun.pop() if len(begun) == 1 else ""

    def parts(self, words: Sequence[dict]) -> list[dict]:
        """The headers in a cell: the whole cell if it is one, else its longest runs of words that are, and what lies between."""
        out: list[dict] = []
        loose: list[dict] = []

        def add(run: Sequence[dict], key: str) -> None:
            if run:
                out.append({"center": (run[0]["x0"] + run[-1]["x1"]) / 2, "key": key, "text": " ".join(w["text"] for w in run)})

        at = 0
        while at < len(words):
            ends = (e for e in range(len(words), at, -1) if self.get(" ".join(w["text"] for w in words[at:e])))
            end = next(ends, None)
            if end is None:
                loose.append(words[at])
                at += 1
                continue
            add(loose, "")
            loose = []
            add(words[at:end], self.get(" ".join(w["text"] for w in words[at:end])))
            at = end
        add(loose, "")
        return out


def default_headers() -> dict[str, str]:
    """Each column of an answer sheet under its own name."""
    return {c: c for c in SHEET_COLUMNS}


_PART = pa.list_(pa.struct([("center", pa.float64()), ("key", pa.string()), ("text", pa.string())]))


def _parts_of(headers: Headers, words: str) -> Column:
    @F.arrow_udf("array<struct<center:double,key:string,text:string>>")
    def run(cells: pa.Array) -> pa.Array:
        return pa.array([headers.parts(c or []) for c in cells.to_pylist()], _PART)

    return run(words)


def row_cells(words: DataFrame, ratio: float = 1.0, least: float = 8.0) -> DataFrame:
    """Cells of the rows of pages: words closer than the row's height (``least`` pixels at least) are one cell.

    Out: ``doc_id, page, row_no, cell_no, text, x0, x1, confidence`` (the least of its words, null without any) and its ``words``.
    """
    rows = layout.visual_rows(words, running=True).join(words.select(*PAGE, "word_no", "confidence"), [*PAGE, "word_no"])
    height = F.max(F.col("y1") - F.col("y0")).over(Window.partitionBy(*PAGE, "row_no"))
    split = layout.split_by_gap(rows.withColumn("_gap", F.greatest(F.lit(least), height * ratio)), F.col("_gap"), [*PAGE, "row_no"])
    inner = F.array_sort(F.collect_list(F.struct("x0", "word_no", "text", "x1", "confidence")))
    cells = split.groupBy(*PAGE, "row_no", F.col("part_no").alias("cell_no")).agg(inner.alias("words"), F.min("confidence").alias("confidence"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return cells.withColumn("text", F.trim(F.array_join(F.transform("words", lambda w: w["text"]), " ")))


def header_rows(cells: DataFrame, headers: Headers) -> DataFrame:
    """``doc_id, page, header_row, anchors`` of each page: the first row that names the most columns, null if none names ``LEAST_HEADERS``."""
    parts = cells.withColumn("parts", _parts_of(headers, "words"))
    per_row = parts.groupBy(*PAGE, "row_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "parts"))), lambda c: c["parts"])).alias("anchors"))
    counted = per_row.withColumn("n", F.size(F.filter("anchors", lambda a: a["key"] != "")))
    best = counted.groupBy(*PAGE).agg(F.max_by(F.struct("row_no", "anchors", "n"), F.struct("n", -F.col("row_no"))).alias("b"))
    usable = F.col("b.n") >= LEAST_HEADERS
    return best.select(*PAGE, F.when(usable, F.col("b.row_no")).alias("header_row"), F.when(usable, F.col("b.anchors")).alias("anchors"), F.col("b.n").alias("matches"))


def records_of_pages(words: DataFrame, headers: Headers) -> DataFrame:
    """Records of read pages: ``doc_id, page, row_no, values`` (map of columns), ``confidence`` (map), ``unmapped, min_confidence, carried``.

    Each word goes to the nearest header; a page without a header row takes the last one of the document before it
    (``carried``), and pages before any have no records. Words under a header that names no column
    count as unmapped; rows without any value are left out.
    """
    cells = row_cells(words)
    before = Window.partitionBy("doc_id").orderBy("page")
    anchors = header_rows(cells, headers).withColumn("carried", F.col("header_row").isNull()).withColumn("anchors", F.last("anchors", ignorenulls=True).over(before))
    data = cells.join(anchors, PAGE).filter(F.col("anchors").isNotNull() & (F.col("row_no") > F.coalesce("header_row", F.lit(-1))))
    each = data.select(*PAGE, "row_no", "carried", "anchors", F.explode("words").alias("w"))
    middle = (F.col("w.x0") + F.col("w.x1")) / 2
    nearest = F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(a["center"] - middle).alias("d"), i.alias("i"), a["key"].alias("key"))))["key"]
    placed = each.withColumn("key", nearest).filter(F.col("w.text") != "")
    texts = F.array_sort(F.collect_list(F.struct("w.x0", "w.word_no", "w.text")))
    per_key = placed.groupBy(*PAGE, "row_no", "carried", "key").agg(F.trim(F.array_join(F.transform(texts, lambda t: t["text"]), " ")).alias("value"), F.min("w.confidence").alias("confidence"), F.count("*").alias("n"))
    named = F.col("key") != ""
    pick = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.when(named & value.isNotNull(), F.struct("key", value.alias("value"))))))
    per_row = per_key.groupBy(*PAGE, "row_no", "carried").agg(
        pick(F.col("value")).alias("values"), pick(F.col("confidence")).alias("confidence"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unmapped"), F.min(F.when(named, F.col("confidence"))).alias("min_confidence")
    )
    return per_row.filter(F.exists(F.map_values("values"), lambda v: v != ""))


def record_warnings(records: DataFrame, least: float = LOW_CONFIDENCE) -> DataFrame:
    """``records`` with ``warnings``, structs of ``code, column``: missing_required, missing_answer, unmapped_cell, low_confidence."""
    value = lambda c: T.trimmed(F.col("values")[c])
    warn = lambda code, column: F.struct(F.lit(code).alias("code"), column.alias("column"))
    fixed = [F.when(value(c) == "", warn("missing_required", F.lit(c))) for c in REQUIRED]
    fixed.append(F.when((value("drug_name") == "") & (value("mfds_item_id") == ""), warn("missing_answer", F.lit(None).cast("string"))))
    fixed.append(F.when(F.col("unmapped") > 0, warn("unmapped_cell", F.lit(None).cast("string"))))
    doubtful = F.filter(F.map_keys("confidence"), lambda k: (F.col("confidence")[k] < least) & (T.trimmed(F.col("values")[k]) != ""))
    return records.withColumn("warnings", F.concat(F.array_compact(F.array(*fixed)), F.transform(F.array_sort(doubtful), lambda k: warn("low_confidence", k))))


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean confidence of the words of each page."""
    return words.groupBy(*PAGE).agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count("*").alias("words"))


def printed_lines(items: DataFrame, height: float = LINE_HEIGHT) -> DataFrame:
    """Texts of printed pages (``doc_id, page, item_no, text, x, y``, y upwards) with ``line_no``, from the top of a page down; blank ones are left out."""
    filled = items.filter(T.trimmed("text") != "").select(*PAGE, F.col("item_no").alias("word_no"), T.trimmed("text").alias("text"), F.col("x").alias("x0"), (-F.col("y")).alias("y0"), F.col("x").alias("x1"), (-F.col("y")).alias("y1"))
    rows = layout.visual_rows(filled, tolerance=height)
    top = F.min("y0").over(Window.partitionBy(*PAGE, "row_no"))
    placed = rows.withColumn("_top", top)
    return placed.withColumn("line_no", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("_top", "row_no"))).select(*PAGE, "line_no", F.col("word_no").alias("item_no"), "text", F.col("x0").alias("x"))


def records_of_lines(lines: DataFrame, headers: Headers) -> DataFrame:
    """Records of printed lines: ``doc_id, page, line_no, values``. A line that names ``LEAST_HEADERS`` columns is a header; the widest one so far is in force.

    Every text goes to the nearest header; lines before the first header have no record, and repeated headers are skipped.
    """
    @F.arrow_udf("string")
    def column_of(texts: pa.Array) -> pa.Array:
        return pa.array([headers.exact.get(header_key(t), "") for t in texts.to_pylist()], pa.string())

    cells = F.array_sort(F.collect_list(F.struct("x", "item_no", "text", "key")))
    per = lines.withColumn("key", column_of("text")).groupBy(*PAGE, "line_no").agg(cells.alias("cells"))
    named = F.filter("cells", lambda c: c["key"] != "")
    per = per.withColumn("named", named).withColumn("is_header", F.size(named) >= LEAST_HEADERS)
    so_far = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct(F.size("named").alias("n"), (-F.col("page")).alias("p"), (-F.col("line_no")).alias("l"))
    force = F.max_by(F.when(F.col("is_header"), F.col("named")), F.when(F.col("is_header"), order)).over(so_far)
    data = per.withColumn("force", force).filter(~F.col("is_header") & F.col("force").isNotNull())
    each = data.select(*PAGE, "line_no", "force", F.explode("cells").alias("c"))
    nearest = F.array_min(F.transform("force", lambda h, i: F.struct(F.abs(h["x"] - F.col("c.x")).alias("d"), i.alias("i"), h["key"].alias("key"))))["key"]
    texts = F.array_sort(F.collect_list(F.struct("c.x", "c.item_no", "c.text")))
    per_key = each.withColumn("key", nearest).groupBy(*PAGE, "line_no", "key").agg(F.trim(F.array_join(F.transform(texts, lambda t: t["text"]), " ")).alias("value"))
    return per_key.groupBy(*PAGE, "line_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("values"))


def normalized_table(rows: DataFrame, headers: Headers, columns: Sequence[str] = SHEET_COLUMNS) -> DataFrame:
    """Rows of cells (``file, row_no`` from 0, ``cells``) as records: ``file, source_row`` and the columns, empty where a file lacks one.

    The header is the first of the first ``HEADER_ROWS`` rows that names the most columns; of two headers for one column the
    first counts. Rows above it, files without a header and rows without any value are left out.
    """
    found = table_headers(rows, headers)
    joined = rows.join(found.filter("usable"), "file").filter(F.col("row_no") > F.col("header_row"))
    cell = lambda c: T.trimmed(F.when(F.array_position("keys", c) > 0, F.try_element_at("cells", F.array_position("keys", c).cast("int"))))
    out = joined.select("file", (F.col("row_no") + 1).alias("source_row"), *[cell(c).alias(c) for c in columns])
    return out.filter(F.concat(*[F.col(c) for c in columns]) != "")


def table_headers(rows: DataFrame, headers: Headers) -> DataFrame:
    """Per file: the header row, its columns by place (``keys``, empty for unknown), unknown and repeated headers, and whether it is ``usable``."""

    @F.arrow_udf("array<string>")
    def columns_of(cells: pa.Array) -> pa.Array:
        return pa.array([[headers.exact.get(header_key(c), "") for c in row or []] for row in cells.to_pylist()], pa.list_(pa.string()))

    first = rows.filter(F.col("row_no") < HEADER_ROWS).withColumn("keys", columns_of("cells"))
    n = F.size(F.filter("keys", lambda k: k != ""))
    best = first.groupBy("file").agg(F.max_by(F.struct("row_no", "keys", "cells", n.alias("n")), F.struct(n, -F.col("row_no"))).alias("b"))
    keys, cells = F.col("b.keys"), F.col("b.cells")
    unknown = F.filter(F.transform(cells, lambda c, i: F.when(F.element_at(keys, i + 1) == "", T.trimmed(c))), lambda c: c.isNotNull() & (c != ""))
    known = F.filter(keys, lambda k: k != "")
    repeated = F.filter(F.array_distinct(known), lambda k: F.size(F.filter(known, lambda x: x == k)) > 1)
    return best.select("file", F.col("b.row_no").alias("header_row"), keys.alias("keys"), unknown.alias("unknown"), repeated.alias("repeated"), (F.col("b.n") >= LEAST_HEADERS).alias("usable"))
