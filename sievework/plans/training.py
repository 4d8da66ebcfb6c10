"""Queries of the general data-preparation operators (shredding, record loading)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import records, shred
from sievework.operators.skew import union_all
from sievework.plans import training_sql
from sievework.sources.tables import spread_table, table

SAMPLE_PATHS = ("$.samples[*]", "$.dataset.samples[*]")


def _below(paths: Sequence[str], label: str) -> tuple[str, ...]:
    """The paths of ``label`` under ``paths``, as one value or as an array of them."""
    return tuple(f"{p}.{label}{end}" for p in paths for end in ("", "[*]"))


ANSWER_PATHS = _below(SAMPLE_PATHS, "answer")
CONDITION_PATHS = _below(SAMPLE_PATHS, "condition")
NOTE_PATHS = _below(CONDITION_PATHS, "notes")
TAG_PATHS = _below(NOTE_PATHS, "tags")
PREDICTION_PATHS = _below(SAMPLE_PATHS, "prediction")
METRIC_PATHS = _below(SAMPLE_PATHS, "metrics")
ERROR_PATHS = _below(SAMPLE_PATHS, "error")
META_PATHS = tuple(f"{p}.meta" for p in SAMPLE_PATHS)
ATTEMPT_PATHS = _below(META_PATHS, "attempts")
ATTEMPT_ERROR_PATHS = _below(ATTEMPT_PATHS, "error")
ERROR_DETAIL_PATHS = _below(ATTEMPT_ERROR_PATHS, "detail")
TRUTH_ANSWER, TRUTH_CONDITION = "$.answer", "$.condition"
ANSWER_FIELDS = ("mfds_item_id", "drug_name", "front_imprint", "back_imprint", "shape", "color")
CONDITION_FIELDS = ("expected_readable", "light", "background", "blur", "angle", "variant", "notes")
NOTE_FIELDS = ("by", "tags")
SAMPLE_FIELDS = ("sample_id", "run_id", "provider", "model", "variant", "classification", "error")
PREDICTION_FIELDS = ("drug_name", "drug_code", "front_imprint", "back_imprint", "shape", "color", "confidence", "evidence", "uncertainty")
METRIC_FIELDS = (
    "exact_match", "partial_match", "drug_name_similarity", "front_imprint_similarity", "back_imprint_similarity", "imprint_CER", "front_imprint_CER",
    "back_imprint_CER", "imprint_orientation", "confidence", "Brier_loss", "latency", "error_rate", "completeness",
)
ERROR_FIELDS = ("code", "message", "detail")
META_FIELDS = ("variant", "detail", "attempts")
ATTEMPT_FIELDS = ("attempt_no", "latency_ms", "error")
DETAIL_FIELDS = ("wait_s",)
#: Which labels of the objects at which paths are columns of a flat table; ``p2_rest`` has all other scalars.
COLUMNS_OF: dict[tuple[str, ...], tuple[str, ...]] = {
    SAMPLE_PATHS: SAMPLE_FIELDS,
    (*ANSWER_PATHS, TRUTH_ANSWER): ANSWER_FIELDS,
    (*CONDITION_PATHS, TRUTH_CONDITION): CONDITION_FIELDS,
    NOTE_PATHS: NOTE_FIELDS,
    PREDICTION_PATHS: PREDICTION_FIELDS,
    METRIC_PATHS: METRIC_FIELDS,
    (*ERROR_PATHS, *ATTEMPT_ERROR_PATHS): ERROR_FIELDS,
    META_PATHS: META_FIELDS,
    ATTEMPT_PATHS: ATTEMPT_FIELDS,
    ERROR_DETAIL_PATHS: DETAIL_FIELDS,
}


def dataset_nodes(spark: SparkSession, folder: str, paths: Sequence[str] | None = None) -> DataFrame:
    """Adjacency table of the result datasets, whole or at ``paths`` and their children; ``samples`` may be text or keyed by place."""
    docs = spread_table(spark, folder, "result_dataset")
    return shred.shred(docs, "result_dataset", "dataset_id", F.col("body"), embedded=("samples",), listed=("samples",), paths=paths)


def truth_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacency table of the ground truth's answers and conditions."""
    return shred.shred_struct(table(spark, folder, "gt_record"), "gt_record", "gt_id", ["answer", "condition"])


def _positions(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.col("doc_kind").alias("parent_kind"),
        F.col("doc_id").alias("parent_id"),
        F.coalesce(F.try_element_at("places", F.lit(1)), F.lit(0)).alias("sample_pos"),
        F.coalesce(F.try_element_at("places", F.lit(2)), F.lit(0)).alias("child_pos"),
        *[c for c in entities.columns if c not in ("doc_kind", "doc_id", "node", "places")],
    )


def _place(paths: Sequence[str], label: str) -> Column:
    """The place in the array of ``label`` among the arrays of ``paths``, 0 where it is no array."""
    at: dict[int, list[str]] = {}
    for p in paths:
        if f".{label}[*]" in p:
            at.setdefault(p[: p.index(f".{label}[*]")].count("[*]") + 1, []).append(p)
    return F.coalesce(*[F.when(F.col("path").isin(*ps), F.try_element_at("places", F.lit(i))) for i, ps in at.items()], F.lit(0))


def _inner(nodes: DataFrame, paths: Sequence[str], places: Mapping[str, str], *columns: Column | str) -> DataFrame:
    """``columns`` of objects or nodes at ``paths`` behind their parent's key and their places, each named for the label of its array."""
    sample_pos = F.coalesce(F.try_element_at("places", F.lit(1)), F.lit(0)).alias("sample_pos")
    return nodes.select(
        F.col("doc_kind").alias("parent_kind"), F.col("doc_id").alias("parent_id"), sample_pos,
        *[_place(paths, label).alias(name) for name, label in places.items()], *columns,
    )


def _inner_table(spark: SparkSession, folder: str, paths: Sequence[str], fields: Sequence[str], places: Mapping[str, str]) -> DataFrame:
    return _inner(shred.entity_table(dataset_nodes(spark, folder, paths), paths, fields), paths, places, "n_values", *fields)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per non-empty child object of the truth records and the result datasets."""
    kinds = {"sample": SAMPLE_PATHS, "answer": (*ANSWER_PATHS, TRUTH_ANSWER), "condition": (*CONDITION_PATHS, TRUTH_CONDITION), "attempt": ATTEMPT_PATHS}
    child = F.coalesce(*[F.when(F.col("path").isin(*paths), F.lit(kind)) for kind, paths in kinds.items()])
    inner = [p for group in kinds.values() for p in group if p not in (TRUTH_ANSWER, TRUTH_CONDITION)]
    truth = shred.entity_table(truth_nodes(spark, folder), [TRUTH_ANSWER, TRUTH_CONDITION], [])
    rest = shred.entity_table(dataset_nodes(spark, folder, inner), inner, [])
    found = _positions(union_all([truth, rest]).filter(F.col("n_values") > 0))
    return found.select("parent_kind", "parent_id", "sample_pos", child.alias("child"), "child_pos")


def p2_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the datasets' samples."""
    return _positions(shred.entity_table(dataset_nodes(spark, folder, SAMPLE_PATHS), SAMPLE_PATHS, SAMPLE_FIELDS)).drop("path", "child_pos")


def p2_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of all answers, of the datasets and of the ground truth."""
    return _positions(
        union_all(
            [
                shred.entity_table(dataset_nodes(spark, folder, ANSWER_PATHS), ANSWER_PATHS, ANSWER_FIELDS),
                shred.entity_table(truth_nodes(spark, folder), [TRUTH_ANSWER], ANSWER_FIELDS),
            ]
        )
    ).drop("path")


def p2_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of all conditions, of the datasets and of the ground truth."""
    return _positions(
        union_all(
            [
                shred.entity_table(dataset_nodes(spark, folder, CONDITION_PATHS), CONDITION_PATHS, CONDITION_FIELDS),
                shred.entity_table(truth_nodes(spark, folder), [TRUTH_CONDITION], CONDITION_FIELDS),
            ]
        )
    ).drop("path")


def p2_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the samples' attempts."""
    return _positions(shred.entity_table(dataset_nodes(spark, folder, ATTEMPT_PATHS), ATTEMPT_PATHS, ATTEMPT_FIELDS)).drop("path")


def p2_attempt_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the attempts' errors that are objects; ``p2_attempts`` has those that are text."""
    return _inner_table(spark, folder, ATTEMPT_ERROR_PATHS, ERROR_FIELDS, {"child_pos": "attempts", "error_pos": "error"})


def p2_attempt_error_details(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the details of the attempts' errors."""
    return _inner_table(spark, folder, ERROR_DETAIL_PATHS, DETAIL_FIELDS, {"child_pos": "attempts", "error_pos": "error", "detail_pos": "detail"})


def p2_condition_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the conditions' notes that are objects; ``p2_conditions`` has those that are text."""
    return _inner_table(spark, folder, NOTE_PATHS, NOTE_FIELDS, {"child_pos": "condition", "note_pos": "notes"})


def p2_condition_tags(spark: SparkSession, folder: str) -> DataFrame:
    """One row per tag of the conditions' notes."""
    tags = dataset_nodes(spark, folder, TAG_PATHS).filter(F.col("path").isin(*[p for p in TAG_PATHS if p.endswith("[*]")]) & shred.is_scalar())
    return _inner(tags, TAG_PATHS, {"child_pos": "condition", "note_pos": "notes", "tag_pos": "tags"}, F.col("scalar").alias("tag"))


def p2_sample_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the samples' predictions."""
    return _inner_table(spark, folder, PREDICTION_PATHS, PREDICTION_FIELDS, {"child_pos": "prediction"})


def p2_sample_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the samples' metrics."""
    return _inner_table(spark, folder, METRIC_PATHS, METRIC_FIELDS, {"child_pos": "metrics"})


def p2_sample_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the samples' errors that are objects; ``p2_samples`` has those that are text."""
    return _inner_table(spark, folder, ERROR_PATHS, ERROR_FIELDS, {"child_pos": "error"})


def p2_sample_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the samples' meta objects."""
    return _inner_table(spark, folder, META_PATHS, META_FIELDS, {})


def p2_rest(spark: SparkSession, folder: str) -> DataFrame:
    """Every scalar that no flat table has a column for: of the datasets themselves, and of fields not foreseen."""
    in_a_table = [F.col("parent_path").isin(*paths) & F.col("label").isin(*fields) for paths, fields in COLUMNS_OF.items()]
    held = reduce(Column.__or__, in_a_table) | F.col("path").isin(*[p for p in TAG_PATHS if p.endswith("[*]")])
    nodes = union_all([dataset_nodes(spark, folder), truth_nodes(spark, folder)])
    rest = nodes.filter(shred.is_scalar() & ~F.coalesce(held, F.lit(False)))
    return rest.select(F.col("doc_kind").alias("parent_kind"), F.col("doc_id").alias("parent_id"), "path", "places", "label", "kind", "scalar")


def p2_broken(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies that do not parse, with the reason."""
    docs = spread_table(spark, folder, "result_dataset").withColumn("reason", shred.parse_error("body"))
    return docs.filter(F.col("reason").isNotNull()).select(F.lit("result_dataset").alias("parent_kind"), F.col("dataset_id").alias("parent_id"), "reason", "body")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that cannot be loaded."""
    loaded = records.load_records(spread_table(spark, folder, "sheet_record"))
    return loaded.filter(F.col("reason").isNotNull() & (F.col("rec_no") > 1)).select("rec_id")


def p3_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The rejected records with reason and offset."""
    loaded = records.load_records(spread_table(spark, folder, "sheet_record"))
    return loaded.filter(F.col("reason").isNotNull()).select("rec_id", "sheet_id", "rec_no", "reason", "error_offset", "n_fields", "raw")


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows, as the 19 columns of an answer sheet."""
    loaded = records.load_records(spread_table(spark, folder, "sheet_record"))
    return loaded.filter(F.col("reason").isNull()).select("rec_id", "sheet_id", "rec_no", *records.SHEET_COLUMNS, "readable")


def p3_sheet_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected records per sheet and reason."""
    return records.reject_report(records.load_records(spread_table(spark, folder, "sheet_record")))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_samples, p2_answers, p2_conditions, p2_attempts, p2_attempt_errors, p2_attempt_error_details, p2_condition_notes, p2_condition_tags,
        p2_sample_predictions, p2_sample_metrics, p2_sample_errors, p2_sample_meta, p2_rest, p2_broken, p3_found, p3_rejected, p3_loaded, p3_sheet_report,
    )
}
ORACLES = training_sql.ORACLES
