"""Roll-ups of scored rows: by model, by condition, robustness, failures, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import csv_cell

#: The columns of scored rows that the roll-ups read.
SUMMARIZED = (
    "result_id", "sample_id", "provider", "model", "variant", "classification", "dangerous", "front_cer", "back_cer", "imprint_cer", "confidence", "brier",
    "latency_ms", "cost_usd", "legacy_score", "predicted_name_key",
)
CLASSES = ("correct", "partial", "unreadable", "incorrect", "error")


def r6(x: Column) -> Column:
    """Rounded to six decimals."""
    return F.round(x, 6)


def summary_columns() -> list[Column]:
    """The aggregates of a group of scored rows; means ignore nulls, rates of no rows are null."""
    n, known = F.count("*"), F.count("cost_usd")
    cls = F.col("classification")
    rate = lambda name: r6(F.try_divide(F.count_if(cls == name), n))
    return [
        n.alias("samples"),
        F.count_if(cls != "error").alias("completed"),
        F.count_if(cls == "error").alias("errors"),
        rate("correct").alias("top1_accuracy"),
        rate("partial").alias("partial_rate"),
        rate("unreadable").alias("unreadable_rate"),
        rate("error").alias("error_rate"),
        F.count_if("dangerous").alias("high_confidence_misidentification"),
        r6(F.avg("front_cer")).alias("front_imprint_cer"),
        r6(F.avg("back_cer")).alias("back_imprint_cer"),
        r6(F.avg("imprint_cer")).alias("imprint_cer"),
        r6(F.avg("confidence")).alias("average_confidence"),
        r6(F.avg("brier")).alias("brier_loss"),
        F.round(F.avg("latency_ms"), 3).alias("average_latency_ms"),
        F.round(F.sum("cost_usd"), 9).alias("total_cost_usd"),
        r6(F.when(known > 0, F.sum("cost_usd") / n)).alias("cost_per_sample_usd"),
        F.round(F.avg("legacy_score"), 4).alias("legacy_score"),
    ]


def robustness_per_sample(scored: DataFrame) -> DataFrame:
    """Per model and sample with an original and at least one variant: how answers hold up.

    The first original by ``result_id`` counts, further ones are ignored; every row of a
    variant counts. Rows without a sample are left out.
    """
    is_original = F.col("variant") == "original"
    correct = (F.col("classification") == "correct").cast("int")
    rows = scored.filter(F.coalesce(F.col("sample_id"), F.lit("")) != "")
    keys = ["provider", "model", "sample_id"]
    # names of variants are counted, so a sample with very many rows is aggregated before the shuffle
    by_name = rows.groupBy(*keys, is_original.alias("is_original"), "predicted_name_key").agg(
        F.count("*").alias("n"), F.sum(correct).alias("n_correct"), F.min(F.struct("result_id", correct.alias("c"), F.col("predicted_name_key").alias("k"))).alias("first")
    )
    original = by_name.filter("is_original").groupBy(*keys).agg(F.min("first").alias("o"))
    variants = by_name.filter(~F.col("is_original")).select(*keys, "predicted_name_key", "n", "n_correct")
    joined = variants.join(original, keys)
    per = joined.groupBy(*keys).agg(
        F.first("o.c").cast("double").alias("original_accuracy"),
        F.sum("n").alias("n_variants"),
        (F.sum("n_correct") / F.sum("n")).alias("variant_accuracy"),
        (F.sum(F.when(F.col("predicted_name_key") == F.col("o.k"), F.col("n")).otherwise(0)) / F.sum("n")).alias("consistency"),
    )
    return per.withColumns(
        {
            "accuracy_drop": F.col("original_accuracy") - F.col("variant_accuracy"),
            "robustness_score": 0.7 * F.col("variant_accuracy") + 0.3 * F.col("consistency"),
        }
    )


def robustness_by_model(scored: DataFrame) -> DataFrame:
    """Means of ``robustness_per_sample`` by model."""
    return robustness_per_sample(scored).groupBy("provider", "model").agg(
        F.count("*").alias("samples"),
        *[r6(F.avg(c)).alias(c) for c in ("original_accuracy", "variant_accuracy", "accuracy_drop", "consistency", "robustness_score")],
    )


def leaderboard(scored: DataFrame) -> DataFrame:
    """Summary per model with its robustness."""
    robust = robustness_by_model(scored).select("provider", "model", "robustness_score")
    return scored.groupBy("provider", "model").agg(*summary_columns()).join(robust, ["provider", "model"], "left")


def by_condition(scored: DataFrame) -> DataFrame:
    """Summary per value of each condition, by grouping sets; blank values are left out."""
    fields = ["variant", "light", "background", "blur", "angle"]
    sets = scored.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(F.grouping_id().alias("_g"), *summary_columns())
    field = F.coalesce(*[F.when(F.col("_g") == 31 - (1 << (4 - i)), F.lit(f)) for i, f in enumerate(fields)])
    return (
        sets.withColumn("field", field)
        .withColumn("value", F.coalesce(*fields))
        .filter(F.trim(F.coalesce("value", F.lit(""))) != "")
        .drop("_g", *fields)
    )


def dataset_summary(scored: DataFrame) -> DataFrame:
    """One row over all scored rows, with counts of classes and costs."""
    return scored.agg(
        *summary_columns(),
        *[F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in CLASSES],
        F.count("cost_usd").alias("known_cost_rows"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_rows"),
    )


def failures(scored: DataFrame) -> DataFrame:
    """Errors and dangerous answers."""
    return scored.filter((F.col("classification") == "error") | F.col("dangerous")).select(
        "result_id", "sample_id", "provider", "model", "classification", "dangerous",
        F.coalesce("prediction.drug_name", F.lit("")).alias("predicted_drug_name"), r6(F.col("confidence")).alias("confidence"), "error",
    )


def model_costs(scored: DataFrame) -> DataFrame:
    """Cost per model and where it comes from."""
    return scored.groupBy("provider", "model", "cost_source").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 9).alias("cost_usd"))


def dashboard_cards(summary: DataFrame) -> DataFrame:
    """The one-row summary as named cards; rates as percentages."""
    rates = {"top1_accuracy", "partial_rate", "unreadable_rate", "error_rate"}
    cards = [c for c in summary.columns if not c.startswith("n_")]
    pairs = F.array(*[F.struct(F.lit(c).alias("card"), (F.col(c).cast("double") * (100 if c in rates else 1)).alias("value")) for c in cards])
    return summary.select(F.explode(pairs).alias("p")).select("p.card", F.round("p.value", 4).alias("value"))


def csv_rows(scored: DataFrame) -> DataFrame:
    """One CSV line per scored row, cells quoted and disarmed."""
    cells = ["sample_id", "run_id", "provider", "model", "variant", "classification", "prediction.drug_name", "prediction.front_imprint", "prediction.back_imprint", "error"]
    return scored.select("result_id", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))


def dashboard_models(models: DataFrame) -> DataFrame:
    """The leaderboard as a dashboard shows it: rates as percentages, most accurate first."""
    pct = lambda c: F.round(F.col(c) * 100, 4)
    return models.select(
        "provider", "model", "samples", pct("top1_accuracy").alias("accuracy"), pct("partial_rate").alias("partial"), F.col("high_confidence_misidentification").alias("dangerous"),
        "front_imprint_cer", "back_imprint_cer", "average_confidence", "brier_loss", "average_latency_ms", "total_cost_usd", "cost_per_sample_usd", "robustness_score",
    ).orderBy(F.desc_nulls_last("accuracy"), "provider", "model")


def dashboard_conditions(conditions: DataFrame) -> DataFrame:
    """The roll-up by condition as a dashboard shows it."""
    pct = lambda c: F.round(F.col(c) * 100, 4)
    return conditions.select("field", "value", "samples", pct("top1_accuracy").alias("accuracy"), pct("error_rate").alias("error_rate"))


def costs_by_model(scored: DataFrame) -> DataFrame:
    """Total cost and cost per sample of each model; null where no cost is known."""
    return scored.groupBy("provider", "model").agg(
        F.round(F.sum("cost_usd"), 9).alias("total_cost_usd"), F.round(F.when(F.count("cost_usd") > 0, F.sum("cost_usd") / F.count("*")), 6).alias("cost_per_sample_usd")
    )


def sample_rows(scored: DataFrame) -> DataFrame:
    """Scored rows (with ``answer``) in the thirty columns of the per-sample table."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    pair = lambda field: [text(f"answer.{field}").alias(f"{field}_truth"), text(f"prediction.{field}").alias(f"{field}_prediction")]
    number = lambda c, name: r6(F.col(c).cast("double")).alias(name)
    return scored.select(
        "sample_id", "run_id", "provider", "model", "variant", "classification", F.col("dangerous").alias("high_confidence_misidentification"), *pair("drug_name"), *pair("front_imprint"), *pair("back_imprint"),
        "exact_match", "partial_match", number("name_similarity", "drug_name_similarity"), number("front_similarity", "front_imprint_similarity"), number("back_similarity", "back_imprint_similarity"), number("imprint_cer", "imprint_CER"),
        number("confidence", "confidence"), number("brier", "Brier_loss"), number("latency_ms", "latency_ms"), (F.col("classification") == "error").cast("int").alias("error_rate"), number("legacy_score", "legacy_score"),
        *[number(f"usage.{c}", c) for c in ("input_tokens", "output_tokens", "cached_tokens")], F.round("cost_usd", 9).alias("cost_usd"), "cost_source", "error",
    )
