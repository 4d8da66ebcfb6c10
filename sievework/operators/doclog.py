"""Log of processed documents: outcomes and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import values as V
from sievework.functions.text import safe, trimmed

# The conditions a document is logged under.
CONDITIONS = ("clean", "blur", "tilt", "dark", "glare", "handwriting", "fold", "unknown")
OUTCOMES = ("auto", "manual_assisted", "manual_only", "failed")


def count_of(x: Column | str) -> Column:
    """A count: finite and at least 0, else 0."""
    return F.greatest(F.lit(0.0), F.coalesce(V.finite(x), F.lit(0.0)))


def outcome(ocr_failed: Column, auto: Column, manual: Column, erased: Column) -> Column:
    """failed without boxes, manual_only without automatic ones, manual_assisted if touched by hand, else auto."""
    a, m, e = count_of(auto), count_of(manual), count_of(erased)
    return (
        F.when(a + m == 0, "failed")
        .when(F.coalesce(ocr_failed, F.lit(False)) | (a == 0), "manual_only")
        .when((m > 0) | (e > 0), "manual_assisted")
        .otherwise("auto")
    )


def records(rows: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """Log records of raw rows: counts clamped, condition checked, only the extension of a file name, short errors."""
    failed = F.coalesce("ocr_failed", F.lit(False))
    unit = lambda c: F.when(V.finite(c).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), V.finite(c))))
    return rows.select(
        trimmed("doc_id").alias("doc_id"), "created_at",
        F.when(F.col("condition").isin(*conditions), F.col("condition")).otherwise("unknown").alias("condition"),
        F.substring(F.lower(F.regexp_replace(safe("source_ext"), r"^\.*", "")), 1, 8).alias("source_ext"),
        failed.alias("ocr_failed"), F.when(failed, F.substring(safe("ocr_error"), 1, 120)).otherwise("").alias("ocr_error"),
        unit("mean_confidence").alias("mean_confidence"), *[count_of(c).alias(c) for c in ("auto_boxes", "manual_boxes", "erased_boxes", "elapsed_ms")],
        "box_kinds", outcome(failed, F.col("auto_boxes"), F.col("manual_boxes"), F.col("erased_boxes")).alias("outcome"),
    )


def summarize(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Roll-up of log records, over all or by columns; rates in percent, null without a whole."""
    n, is_ = F.count("*"), lambda o: F.count_if(F.col("outcome") == o)
    touched, only, failed = is_("manual_assisted") + is_("manual_only"), is_("manual_only"), is_("failed")
    aggs = [
        n.alias("docs"), F.count_if(~F.col("ocr_failed")).alias("ocr_succeeded"), V.percent(F.count_if(~F.col("ocr_failed")), n).alias("ocr_success_rate"),
        *[is_(o).alias(f"n_{o}") for o in OUTCOMES], V.percent(is_("auto"), n).alias("auto_rate"), V.percent(touched, n).alias("touched_rate"),
        V.percent(only, only + failed).alias("recovery_rate"), V.percent(failed, n).alias("failed_rate"),
        V.half_up(F.avg("mean_confidence"), 3).alias("mean_confidence"), F.floor(F.avg(F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms"))) + 0.5).alias("mean_elapsed_ms"),
    ]
    return log.groupBy(*by).agg(*aggs) if by else log.agg(*aggs)


def box_kinds(log: DataFrame) -> DataFrame:
    """Boxes by kind over all records."""
    return log.select(F.explode("box_kinds").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("count"))


def sentences(summary: dict) -> list[str]:
    """The roll-up as sentences that always name the number of documents."""
    if not summary["docs"]:
        return ["No documents were measured."]
    return [
        f"{summary['docs']} documents were processed; text was read in {summary['ocr_success_rate']} %.",
        f"{summary['auto_rate']} % were redacted without a hand, {summary['touched_rate']} % with one, {summary['failed_rate']} % not at all.",
    ]


def review_outcome(reviews: DataFrame, boxes: DataFrame) -> DataFrame:
    """One raw log row per reviewed document: boxes that stayed from detection, boxes drawn by hand, detected ones that were erased, boxes by kind.

    ``reviews``: ``doc_id, found_boxes`` (detected before the review) and any telemetry; ``boxes``: ``doc_id, kind, auto``, those left after it;
    only ``auto`` false is by hand, and a box without kind is 기타.
    """
    kind = F.coalesce(F.nullif(safe("kind"), F.lit("")), F.lit("기타")).alias("kind")
    by_hand = F.coalesce(F.col("auto"), F.lit(True)) == F.lit(False)
    per_kind = boxes.select("doc_id", kind, by_hand.alias("by_hand")).groupBy("doc_id", "kind").agg(F.count("*").cast("int").alias("n"), F.count_if("by_hand").alias("manual"))
    per = per_kind.groupBy("doc_id").agg(
        F.sum("n").alias("_boxes"), F.sum("manual").alias("manual_boxes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("box_kinds")
    )
    joined = reviews.join(per, "doc_id", "left").na.fill(0, ["_boxes", "manual_boxes"]).withColumn("auto_boxes", F.col("_boxes") - F.col("manual_boxes"))
    erased = F.greatest(F.lit(0), (count_of("found_boxes") - F.col("auto_boxes")).cast("bigint"))
    return joined.withColumn("erased_boxes", erased).withColumn("box_kinds", F.coalesce("box_kinds", F.create_map().cast("map<string,int>"))).drop("_boxes")


#: Confidence in percent below which a read word counts as doubtful.
LOW_CONFIDENCE = 60


def ocr_quality(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words read, mean confidence from 0 to 1 and the share of doubtful words; null where no word has a confidence."""
    score = V.finite("confidence")
    return words.groupBy(*keys).agg(
        F.count("*").alias("words"), F.round(F.avg(score) / 100, 6).alias("mean_confidence"), F.round(F.avg(F.when(score.isNotNull(), (score < LOW_CONFIDENCE).cast("int"))), 6).alias("low_confidence_share")
    )
