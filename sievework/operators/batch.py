"""Measuring a batch of documents: detection scored, what the rules could find at best, and what is lost between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators import pii, redaction
from sievework.operators.redaction import HIGH_RISK
from sievework.sources.sinks import csv_lines

Detector = Callable[[Column, Column], Column]


def run(docs: DataFrame, items: DataFrame, boxes: DataFrame, detections: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One row per document that was tried: its redaction scores and how the detection went.

    ``docs``: ``doc_id, form, condition, width, height``; ``detections``: ``doc_id, failed, error, elapsed_ms,
    mean_confidence``, at most one row each. A failed detection counts no boxes but keeps the document's items
    in every denominator. A document without a detection was not tried; ``scored`` limits the
    documents further (``doc_id``).
    """
    tried = docs.join(detections, "doc_id")
    if scored is not None:
        tried = tried.join(scored.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = tried.select("doc_id", F.coalesce("failed", F.lit(False)).alias("failed"))
    found = boxes.join(ids.filter(~F.col("failed")), "doc_id", "left_semi")
    scores = redaction.score_documents(tried, items.join(ids, "doc_id", "left_semi"), found)
    how = tried.select(
        "doc_id", "form", F.coalesce("failed", F.lit(False)).alias("detection_failed"), F.substring(T.safe("error"), 1, 160).alias("reason"),
        F.coalesce(V.not_negative("elapsed_ms"), F.lit(0.0)).alias("elapsed_ms"), V.finite("mean_confidence").alias("mean_confidence"),
    )
    return scores.join(how, "doc_id")


def header(scores: DataFrame, requested: int) -> DataFrame:
    """One row over a batch: documents asked for and scored, whether it stopped early, failed detections, mean time of those that took any."""
    return scores.agg(
        F.lit(requested).alias("requested"), F.count("*").alias("scored"), (F.count("*") < requested).alias("stopped"), F.count_if("detection_failed").alias("detection_failures"),
        F.floor(F.avg(F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms"))) + 0.5).alias("mean_detect_ms"),
    )


def detectable_items(items: DataFrame, detect: Detector = pii.detectable, scored: DataFrame | None = None) -> DataFrame:
    """``items`` with ``detectable``: whether the rules would hide the whole value, read without error behind its label.

    ``items``: ``doc_id, item_no, type, label, value``; ``detect(value, line)`` judges an item. One without
    a value has null and counts nowhere. ``scored`` (``doc_id``): only documents that were measured.
    """
    some = items if scored is None else items.join(scored.select("doc_id").distinct(), "doc_id", "left_semi")
    label, value = T.trimmed("label"), T.trimmed("value")
    line = F.when(label != "", F.concat(label, F.lit(" "), value)).otherwise(value)
    lined = some.withColumn("_value", value).withColumn("_line", line)
    return lined.withColumn("detectable", F.when(F.col("_value") != "", detect(F.col("_value"), F.col("_line")))).drop("_value", "_line")


def ceiling(detected: DataFrame) -> DataFrame:
    """One row: the share of items, of high-risk items and of whole documents that the rules could hide at best."""
    judged = F.col("detectable").isNotNull()
    per = detected.groupBy("doc_id").agg(
        F.count_if(judged).alias("items"), F.count_if("detectable").alias("found"), F.count_if(~judged).alias("skipped"),
        F.count_if(judged & F.col("type").isin(*HIGH_RISK)).alias("risky"), F.count_if(F.col("detectable") & F.col("type").isin(*HIGH_RISK)).alias("risky_found"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    docs, clean = F.count_if(F.col("items") > 0), F.count_if((F.col("items") > 0) & (F.col("found") == F.col("items")))
    return per.agg(
        docs.alias("docs"), total("skipped").alias("skipped_items"), total("items").alias("items"), total("found").alias("detectable_items"), V.percent(total("found"), total("items")).alias("item_ceiling"),
        clean.alias("clean_docs"), V.percent(clean, docs).alias("clean_doc_ceiling"),
        total("risky").alias("high_risk_items"), total("risky_found").alias("high_risk_detectable"), V.percent(total("risky_found"), total("risky")).alias("high_risk_ceiling"),
    )


def ceiling_by_type(detected: DataFrame) -> DataFrame:
    """The share that the rules could hide by kind of item, most items first."""
    return redaction.ceiling(detected.filter(F.col("detectable").isNotNull())).orderBy(F.desc("items"), "type")


def gaps(detected: DataFrame, most: int | None = None) -> DataFrame:
    """Labels whose items no rule finds: ``type, label, sample, count``, most frequent first; the sample is the first by document and item."""
    missed = detected.filter(~F.col("detectable"))
    found = missed.groupBy("type", T.safe("label").alias("label")).agg(F.min_by("value", F.struct("doc_id", "item_no")).alias("sample"), F.count("*").alias("count"))
    ordered = found.orderBy(F.desc("count"), "type", "label")
    return ordered if most is None else ordered.limit(most)


def beside_ceiling(measured: DataFrame, best: DataFrame) -> DataFrame:
    """Measured recall by kind beside what the rules could find at best, and the two losses; kinds that were not judged have null."""
    joined = measured.join(best.select("type", F.col("rate").alias("ceiling")), "type", "left").withColumn("measured", F.col("recall"))
    return redaction.explain_gap(joined).drop("measured")


CSV_COLUMNS = (
    "doc_id", "form", "condition", "items", "covered", "missed", "complete", "recall", "boxes", "stray_boxes", "over_redaction", "detection_failed", "elapsed_ms", "mean_confidence",
)


def csv(scores: DataFrame) -> DataFrame:
    """One CSV line per document."""
    return csv_lines(scores, CSV_COLUMNS)


def sentences(summary: dict, conditions: list[dict], best: dict | None, risky: dict | None = None, normal: str = "original") -> list[str]:
    """A batch for readers: recall first, always with the number of documents and items, and last what it does not show.

    ``summary`` and ``conditions`` (with ``condition``) are rows of ``redaction.summarize``, ``best`` of ``ceiling``, ``risky`` has
    ``items, covered, recall`` of the high-risk kinds.
    """
    if not summary.get("docs"):
        return ["No documents were measured."]
    out = [f"In {summary['docs']} synthetic documents {summary['covered_items']} of {summary['items']} items ({summary['item_recall']} %) were hidden."]
    if risky and risky["items"]:
        out.append(f"Of the items that do most harm, {', '.join(HIGH_RISK)}, {risky['covered']} of {risky['items']} ({risky['recall']} %) were.")
    if best and best["item_ceiling"] is not None:
        rules, reading = max(0.0, 100 - best["item_ceiling"]), max(0.0, best["item_ceiling"] - summary["item_recall"])
        out.append(f"With perfect reading the rules would hide {best['item_ceiling']} %: {rules:.1f} points are gaps of the rules, {reading:.1f} were lost in reading.")
    plain = [c for c in conditions if c["condition"] == normal]
    worse = [c for c in conditions if c["condition"] != normal]
    for c in plain:
        out.append(f"In {c['docs']} normal scans {c['covered_items']} of {c['items']} items ({c['item_recall']} %) were hidden.")
    if worse:
        docs, items, covered = (sum(c[k] for c in worse) for k in ("docs", "items", "covered_items"))
        rate = f"{int(covered / items * 1000 + 0.5) / 10} %" if items else "none to hide"
        out.append(f"In {docs} degraded ones {covered} of {items} were ({rate}).")
    out.append(f"On average {summary['mean_missed']} items a document were left; {summary['missed_none']} documents had none, {summary['missed_one']} one, {summary['missed_more']} more.")
    if summary["complete_docs"] < summary["docs"]:
        out.append("What is left can be hidden by hand before a copy is saved.")
    if summary.get("mean_over_redaction") is not None:
        out.append(f"Boxes covered {summary['mean_over_redaction']} times the area of the items.")
    return [*out, "Synthetic documents: real paper, scanners and light may give other results."]
