"""Reports of an evaluation: the workbook of six sheets and the printable page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import values as V
from sievework.operators import rollups, sheets
from sievework.operators.records import SHEET_COLUMNS
from sievework.sources.sinks import csv_file, printable, workbook

#: Failures that a printable report shows.
SHOWN_FAILURES = 100
#: What every report says of its limits.
LIMITATIONS = (
    "Results depend on the quality of the answer keys and of the photos.",
    "Costs of models without a price are left out, not estimated.",
    "Robustness needs an original and a variant of the same sample.",
    "For research only; no single basis of a medical or legal decision.",
)


def as_rows(summary: DataFrame) -> DataFrame:
    """A one-row summary as rows of metric and value, in the order of its columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in summary.columns])
    return summary.select(F.explode(pairs).alias("p")).select("p.*")


def evaluation_workbook(scored: DataFrame) -> bytes:
    """Summary, models, samples, errors, robustness and cost of scored rows (with ``answer``), a sheet each."""
    return workbook(
        {
            "Summary": as_rows(rollups.dataset_summary(scored)), "Model Comparison": rollups.leaderboard(scored), "Per Sample": rollups.sample_rows(scored),
            "Errors": rollups.failures(scored), "Robustness": rollups.robustness_per_sample(scored), "Cost": rollups.costs_by_model(scored),
        }
    )


def evaluation_report(scored: DataFrame, title: str = "Model comparison") -> str:
    """A printable page: key figures, models, the first failures, limitations."""
    summary = rollups.dataset_summary(scored)
    figures = summary.select("samples", V.metric_text(F.col("top1_accuracy"), "ratio").alias("top1_accuracy"), "high_confidence_misidentification", V.metric_text(F.col("total_cost_usd"), "usd").alias("total_cost_usd"))
    first = rollups.failures(scored).orderBy("result_id").limit(SHOWN_FAILURES)
    limits = scored.sparkSession.createDataFrame([(x,) for x in LIMITATIONS], "limitation string")
    return printable(title, {"Key figures": as_rows(figures), "Models": rollups.dashboard_models(rollups.leaderboard(scored)), "Failures": first, "Limitations": limits})


def template_workbook(spark: SparkSession) -> bytes:
    """The answer sheet's template: its columns with an example row, and a guide that says which must be filled."""
    need = lambda c: "required" if c in sheets.REQUIRED else "one of these" if c in sheets.ANSWERS else "optional"
    guide = spark.createDataFrame([(c, need(c), example) for c, example in zip(SHEET_COLUMNS, sheets.TEMPLATE_ROW)], "column string, need string, example string")
    return workbook({"answers": sheets.template(spark), "guide": guide})


def template_csv(spark: SparkSession) -> bytes:
    """The answer sheet's template as a CSV file."""
    return csv_file(sheets.template(spark))
