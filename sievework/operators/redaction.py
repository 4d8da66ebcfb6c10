"""Redaction boxes scored against labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import values as V

#: The covered share from which an item counts as hidden, and the kinds whose leak does most harm.
COVERED = 0.9
HIGH_RISK = ("주민등록번호", "개인식별번호")


def covered_share(item: Column, boxes: Column) -> Column:
    """Share of ``item`` under the union of ``boxes``, exact by the grid of all edges; 0 for an item without area.

    One overlapping box is the plain intersection; the grid is built only for several.
    """
    hits = F.filter(boxes, lambda b: V.shared_area(item, b) > 0)
    inner = lambda lo, hi: F.array_sort(
        F.array_distinct(
            F.concat(F.array(item[lo], item[hi]), F.flatten(F.transform(hits, lambda b: F.filter(F.array(b[lo], b[hi]), lambda v: (v > item[lo]) & (v < item[hi])))))
        )
    )
    spans = lambda edges: F.transform(F.slice(edges, F.lit(1), F.greatest(F.size(edges) - 1, F.lit(0))), lambda v, i: F.struct(v.alias("a"), F.element_at(edges, i + 2).alias("b")))
    xs, ys = spans(inner("x0", "x1")), spans(inner("y0", "y1"))
    column = lambda x: F.aggregate(
        ys,
        F.lit(0.0),
        lambda acc, y: acc
        + F.when(F.exists(hits, lambda b: (b["x0"] <= x["a"]) & (b["x1"] >= x["b"]) & (b["y0"] <= y["a"]) & (b["y1"] >= y["b"])), (x["b"] - x["a"]) * (y["b"] - y["a"])).otherwise(0.0),
    )
    union = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + column(x))
    area = V.area(item)
    return (
        F.when(area <= 0, 0.0)
        .when(F.size(hits) == 0, 0.0)
        .when(F.size(hits) == 1, F.least(F.lit(1.0), V.shared_area(item, F.element_at(hits, 1)) / area))
        .otherwise(F.least(F.lit(1.0), union / area))
    )


def score_items(items: DataFrame, boxes: DataFrame, least: float = COVERED) -> DataFrame:
    """``items`` (``doc_id, item_no, type, box``) with ``coverage`` and ``covered``.

    A document's boxes are gathered beside each of its items; documents without boxes leave
    their items uncovered. Boxes come as ordered corners (``values.box``).
    """
    of_doc = boxes.groupBy("doc_id").agg(F.collect_list("box").alias("boxes"))
    joined = items.join(of_doc, "doc_id", "left")
    share = covered_share(F.col("box"), F.coalesce("boxes", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")))
    return joined.withColumn("coverage", share).drop("boxes").withColumn("covered", F.col("coverage") >= least)


def score_documents(docs: DataFrame, items: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per document: items, covered, missed, recall, stray boxes, over-redaction.

    Documents without items have a null recall and are not complete; failed ones (without
    boxes) keep their items in the denominator. A stray box touches no item. Overlapping
    boxes count twice in the redacted area.
    """
    scored = score_items(items, boxes)
    per_item = scored.groupBy("doc_id").agg(F.count("*").alias("items"), F.count_if("covered").alias("covered"), F.sum(V.area(F.col("box"))).alias("items_area"))
    of_items = items.groupBy("doc_id").agg(F.collect_list("box").alias("item_boxes"))
    touched = boxes.join(of_items, "doc_id", "left").withColumn(
        "stray", ~F.coalesce(F.exists("item_boxes", lambda b: V.shared_area(b, F.col("box")) > 0), F.lit(False))
    )
    per_box = touched.groupBy("doc_id").agg(
        F.count("*").alias("boxes"), F.count_if("stray").alias("stray_boxes"),
        F.sum(V.area(F.col("box"))).alias("redacted_area"), F.sum(F.when(F.col("stray"), V.area(F.col("box"))).otherwise(0.0)).alias("stray_area"),
    )
    joined = docs.select("doc_id", "condition", "width", "height").join(per_item, "doc_id", "left").join(per_box, "doc_id", "left").na.fill(0)
    page = F.col("width").cast("double") * F.col("height")
    half = lambda x, d: F.floor(x * 10.0**d + 0.5) / 10.0**d
    return joined.select(
        "doc_id", "condition", "items", "covered", (F.col("items") - F.col("covered")).alias("missed"),
        ((F.col("items") > 0) & (F.col("covered") == F.col("items"))).alias("complete"),
        F.when(F.col("items") > 0, F.round(F.col("covered") / F.col("items"), 6)).alias("recall"),
        "boxes", "stray_boxes", half(F.col("stray_area"), 0).alias("stray_area"), half(F.col("redacted_area"), 0).alias("redacted_area"),
        F.when(F.col("redacted_area") > 0, half(F.col("stray_area") / F.col("redacted_area"), 3)).alias("stray_area_ratio"),
        F.when(F.col("items_area") > 0, half(F.col("redacted_area") / F.col("items_area"), 2)).alias("over_redaction"),
        F.when(page > 0, half(F.col("redacted_area") / page, 3)).alias("page_coverage"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return V.percent(part, whole)


def summarize(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Roll-up of document scores, over all or by columns: recall over items, complete documents, how misses are spread."""
    docs, items, covered = F.count("*"), F.sum("items"), F.sum("covered")
    aggs = [
        docs.alias("docs"), F.count_if("complete").alias("complete_docs"), _ratio(F.count_if("complete"), docs).alias("complete_rate"),
        items.alias("items"), covered.alias("covered_items"), _ratio(covered, items).alias("item_recall"), F.sum("missed").alias("missed_items"),
        F.when(docs > 0, F.floor(F.sum("missed") / docs * 100 + 0.5) / 100).alias("mean_missed"),
        F.count_if(F.col("missed") == 0).alias("missed_none"), F.count_if(F.col("missed") == 1).alias("missed_one"), F.count_if(F.col("missed") >= 2).alias("missed_more"),
        (F.floor(F.avg("over_redaction") * 100 + 0.5) / 100).alias("mean_over_redaction"),
    ]
    return scores.groupBy(*by).agg(*aggs) if by else scores.agg(*aggs)


def by_type(scored_items: DataFrame) -> DataFrame:
    """Recall by kind of item, and whether the kind is of high risk."""
    return scored_items.groupBy("type").agg(F.count("*").alias("items"), F.count_if("covered").alias("covered")).select(
        "type", "items", "covered", _ratio(F.col("covered"), F.col("items")).alias("recall"), F.col("type").isin(*HIGH_RISK).alias("high_risk")
    )


def ceiling(detected: DataFrame) -> DataFrame:
    """Share of items whose text the rules can find, by kind: ``type, value, detectable`` in, percentages out."""
    return detected.groupBy("type").agg(F.count("*").alias("items"), F.count_if("detectable").alias("detectable")).withColumn("rate", _ratio(F.col("detectable"), F.col("items")))


def explain_gap(rates: DataFrame) -> DataFrame:
    """``ceiling, measured`` percentages split into what rules cannot find and what reading lost, not below 0."""
    one = lambda x: V.half_up(F.greatest(F.lit(0.0), x))
    return rates.select("*", one(100 - F.col("ceiling")).alias("rule_gap"), one(F.col("ceiling") - F.col("measured")).alias("reading_loss"))
