"""Words on pages: lines, rows, columns, tables and boxes.

Pages are independent, so every operator works page by page; order-dependent steps
run as grouped maps over one page each, whose size is bounded by the paper.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
WORDS = "doc_id bigint, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"


def lines(words: DataFrame) -> DataFrame:
    """``line_text`` and, per word, its character span, for words with a ``line_key``: by left edge, joined by blanks."""
    by = Window.partitionBy(*PAGE, "line_key").orderBy("x0", "word_no")
    before = F.coalesce(F.sum(F.length("text") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = words.withColumn("start", before.cast("int")).withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    whole = Window.partitionBy(*PAGE, "line_key")
    ordered = F.array_sort(F.collect_list(F.struct("start", "text")).over(whole))
    return spans.withColumn("line_text", F.array_join(F.transform(ordered, lambda s: s["text"]), " "))


def words_of_spans(line_words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words that a span of their line overlaps: join on the line, then on the interval."""
    keys = [*PAGE, "line_key"]
    hit = spans.select(*keys, "kind", F.col("start").alias("s"), F.col("end").alias("e"))
    return line_words.join(hit, keys).filter((F.col("end") > F.col("s")) & (F.col("start") < F.col("e"))).drop("s", "e")


def _center(row: pd.Series) -> float:
    return (row.y0 + row.y1) / 2


def visual_rows(words: DataFrame, running: bool = False, tolerance: float | None = None) -> DataFrame:
    """``words`` with ``row_no``: greedy rows by vertical centre.

    By default a word joins the first row whose first word's centre is within 0.6 of the smaller height, 12 at
    least; with ``running`` a row's centre is the mean of its words and the tolerance 0.6 of the larger height.
    ``tolerance``: a fixed one, in pixels, instead.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", "x0", "word_no"] if not running else ["y0", "word_no"], kind="stable").copy()
        rows: list[list[float]] = []  # centre, height, words
        numbers = []
        for word in page.itertuples():
            middle, height = (word.y0 + word.y1) / 2, word.y1 - word.y0
            for k, row in enumerate(rows):
                near = tolerance if tolerance is not None else 0.6 * max(row[1], height) if running else max(12.0, 0.6 * min(row[1], height))
                if abs(row[0] - middle) <= near:
                    if running:
                        row[0] = (row[0] * row[2] + middle) / (row[2] + 1)
                        row[1] = max(row[1], height)
                        row[2] += 1
                    numbers.append(k)
                    break
            else:
                rows.append([middle, height, 1])
                numbers.append(len(rows) - 1)
        page["row_no"] = numbers
        return page

    narrow = words.select(*[c.split()[0] for c in WORDS.split(", ")])
    return narrow.groupBy(*PAGE).applyInPandas(run, WORDS + ", row_no int")


def split_by_gap(words: DataFrame, gap: float | Column, keys: list[str]) -> DataFrame:
    """``words`` with ``part_no``: a new part starts where the gap to what came before in the row is wider than ``gap``."""
    by = Window.partitionBy(*keys).orderBy("x0", "word_no")
    reach = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = words.withColumn("_new", F.when(F.col("x0") - reach > gap, 1).otherwise(0))
    return opened.withColumn("part_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def nearest_anchor(cells: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (``cell_no, x``) with the anchor (``anchor_no, ax``) nearest to them on the same ``keys``; the first on a tie.

    A page's anchors, a header's few columns, are gathered beside its cells instead of paired with them.
    """
    header = anchors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("anchor_no", "ax"))).alias("_a"))
    joined = cells.join(header, keys)
    best = F.array_min(F.transform("_a", lambda a: F.struct(F.abs(a["ax"] - F.col("x")).alias("d"), a["anchor_no"].alias("anchor_no"))))
    return joined.withColumn("anchor_no", best["anchor_no"]).drop("_a")


def table_records(cells: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of rows (``row_no, cell_no, x, text, confidence``) as records: texts joined per row and anchor, least confidence."""
    placed = nearest_anchor(cells, anchors, keys)
    parts = F.array_sort(F.collect_list(F.struct("x", "cell_no", "text")))
    return placed.groupBy(*keys, "row_no", "anchor_no").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("value"), F.min("confidence").alias("confidence")
    )


def padded_union(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box padded by 0.4 % of the page (5 and 4 pixels at least) and clipped to it."""
    px, py = F.greatest(F.lit(5.0), width * 0.004), F.greatest(F.lit(4.0), height * 0.004)
    return F.struct(
        F.greatest(F.lit(0.0), x0 - px).alias("x0"), F.greatest(F.lit(0.0), y0 - py).alias("y0"),
        F.least(width, x1 + px).alias("x1"), F.least(height, y1 + py).alias("y1"),
    )


BOXES = "doc_id bigint, page int, box_no int, kind string, x0 double, y0 double, x1 double, y1 double"


def merge_boxes(boxes: DataFrame, least: float = 0.72, mixed: str = "개인정보") -> DataFrame:
    """Boxes of a page merged in order: each joins the first kept box that it shares more than ``least`` of the smaller area with.

    The kept box grows to hold both; boxes of different kinds become ``mixed``.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for b in page.sort_values("box_no", kind="stable").itertuples():
            for k in kept:
                w, h = min(k[4], b.x1) - max(k[2], b.x0), min(k[5], b.y1) - max(k[3], b.y0)
                small = min((k[4] - k[2]) * (k[5] - k[3]), (b.x1 - b.x0) * (b.y1 - b.y0))
                if w > 0 and h > 0 and small > 0 and w * h / small > least:
                    k[2:6] = [min(k[2], b.x0), min(k[3], b.y0), max(k[4], b.x1), max(k[5], b.y1)]
                    k[1] = k[1] if k[1] == b.kind else mixed
                    break
            else:
                kept.append([b.box_no, b.kind, b.x0, b.y0, b.x1, b.y1])
        out = pd.DataFrame(kept, columns=["box_no", "kind", "x0", "y0", "x1", "y1"])
        out.insert(0, "doc_id", page["doc_id"].iloc[0])
        out.insert(1, "page", page["page"].iloc[0])
        return out

    return boxes.select(*[c.split()[0] for c in BOXES.split(", ")]).groupBy(*PAGE).applyInPandas(run, BOXES)


def email_parts(words: DataFrame) -> DataFrame:
    """Words with an @ joined with the neighbours at most 20 pixels away in their row."""
    by = Window.partitionBy(*PAGE, "row_no").orderBy("x0", "word_no")
    near = lambda other, side: F.when(side <= 20, other)
    left, right = F.lag(F.struct("text", "x0", "x1")).over(by), F.lead(F.struct("text", "x0", "x1")).over(by)
    whole = words.withColumn("_l", left).withColumn("_r", right).filter(F.col("text").contains("@"))
    text = F.concat(F.coalesce(near(F.col("_l.text"), F.col("x0") - F.col("_l.x1")), F.lit("")), F.col("text"), F.coalesce(near(F.col("_r.text"), F.col("_r.x0") - F.col("x1")), F.lit("")))
    return whole.select(*PAGE, "row_no", text.alias("email"), F.coalesce(near(F.col("_l.x0"), F.col("x0") - F.col("_l.x1")), F.col("x0")).alias("x0"), F.coalesce(near(F.col("_r.x1"), F.col("_r.x0") - F.col("x1")), F.col("x1")).alias("x1"))
