"""Answer sheets: headers, validation against images, and the step to ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators.records import SHEET_COLUMNS
from sievework.operators.skew import salted_left_join

REQUIRED = ("case_id", "front_image", "back_image")
ANSWERS = ("mfds_item_id", "drug_name")


def image_counts(images: DataFrame, name: str = "image") -> DataFrame:
    """``image_key, n_files`` of the file names; blank names are left out."""
    return images.select(T.image_key(name).alias("image_key")).filter(F.col("image_key") != "").groupBy("image_key").agg(F.count("*").alias("n_files"))


def validate_rows(rows: DataFrame, images: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, errors, warnings, valid`` of every row.

    Errors: a required cell is blank, no answer (item id or name), the case id is used again in any case of
    letters, an image is missing or there more than once, both images are the same file.
    Warning: no imprint at all. Case ids and images are counted before
    they are joined, on salted keys.
    """
    keyed = rows.select(
        key, *[T.trimmed(c).alias(c) for c in (*REQUIRED, *ANSWERS, "front_imprint", "back_imprint")],
        F.lower(T.trimmed("case_id")).alias("_case"), T.image_key("front_image").alias("_front"), T.image_key("back_image").alias("_back"),
    )
    files = image_counts(images)
    cases = keyed.filter(F.col("_case") != "").groupBy("_case").agg(F.count("*").alias("_uses"))
    joined = salted_left_join(keyed, cases, ["_case"])
    for side in ("front", "back"):
        joined = salted_left_join(joined, files.select(F.col("image_key").alias(f"_{side}"), F.col("n_files").alias(f"_{side}_files")), [f"_{side}"], counted=keyed)

    def when(cond: Column, text: str) -> Column:
        return F.when(cond, F.lit(text))

    errors = [when(F.col(c) == "", f"missing_{c}") for c in REQUIRED]
    errors += [when((F.col("mfds_item_id") == "") & (F.col("drug_name") == ""), "missing_answer"), when(F.coalesce(F.col("_uses"), F.lit(0)) > 1, "duplicate_case_id")]
    for side in ("front", "back"):
        there = F.coalesce(F.col(f"_{side}_files"), F.lit(0))
        errors += [when((F.col(f"_{side}") != "") & (there == 0), f"{side}_image_not_found"), when(there > 1, f"{side}_image_ambiguous")]
    errors += [when((F.col("_front") != "") & (F.col("_front") == F.col("_back")), "same_image")]
    warnings = [when((F.col("front_imprint") == "") & (F.col("back_imprint") == ""), "no_imprint")]
    return joined.select(key, F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings)).alias("warnings")).withColumn("valid", F.size("errors") == 0)


def orphan_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Image files that no row uses."""
    used = rows.select(F.explode(F.array(T.image_key("front_image"), T.image_key("back_image"))).alias("image_key")).distinct()
    return image_counts(images).join(used, "image_key", "left_anti")


def duplicate_images(images: DataFrame) -> DataFrame:
    """Image names there more than once."""
    return image_counts(images).filter("n_files > 1")


def match_headers(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """``header, column, how`` of each header cell: an exact alias, else the one column of which it is a beginning of 3 characters or more.

    ``aliases``: ``alias, column``. A beginning that fits several columns matches none.
    """
    cells = headers.select("header", T.header_name("header").alias("k")).distinct()
    names = aliases.select(T.header_name("alias").alias("a"), "column").distinct()
    exact = cells.join(names, F.col("k") == F.col("a")).groupBy("header").agg(F.min("column").alias("column")).withColumn("how", F.lit("exact"))
    starts = names.withColumn("k", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), lambda i: F.substring("a", F.lit(1), i))))
    begun = (
        cells.filter(F.length("k") >= 3).join(exact, "header", "left_anti").join(starts, "k")
        .groupBy("header").agg(F.countDistinct("column").alias("n"), F.min("column").alias("column")).filter("n = 1")
        .select("header", "column", F.lit("beginning").alias("how"))
    )
    return exact.unionByName(begun)


def to_truth(rows: DataFrame) -> DataFrame:
    """Ground-truth records of answer-sheet rows: sample, pill, images, answer, condition with its variant, notes."""
    t = T.trimmed
    return rows.select(
        "row_id", F.lit("1.0").alias("schema_version"), t("case_id").alias("sample_id"), t("pill_id").alias("pill_id"),
        F.struct(t("front_image").alias("front"), t("back_image").alias("back")).alias("images"),
        F.struct(*[t(c).alias(c) for c in ("mfds_item_id", "drug_name", "front_imprint", "back_imprint", "shape", "color")]).alias("answer"),
        F.struct(
            V.sheet_readable("expected_readable").alias("expected_readable"), *[t(c).alias(c) for c in ("light", "background", "blur", "angle")],
            V.variant_name(None, {c: c for c in ("blur", "angle", "light", "background")}).alias("variant"),
        ).alias("condition"),
        t("notes").alias("notes"),
    )


def truth_errors(truths: DataFrame, key: str) -> DataFrame:
    """``key, errors`` of ground-truth records against the contract: version, sample id, answer and condition there."""
    checks = [
        F.when(T.safe("schema_version") != "1.0", F.lit("schema_version")),
        F.when(T.trimmed("sample_id") == "", F.lit("sample_id")),
        F.when(F.col("answer").isNull(), F.lit("answer")),
        F.when(F.col("condition").isNull(), F.lit("condition")),
        F.when(T.trimmed("images.front") == "", F.lit("images.front")),
    ]
    return truths.select(key, F.array_compact(F.array(*checks)).alias("errors"))


def result_errors(results: DataFrame, providers: list[str], key: str = "result_id") -> DataFrame:
    """``key, errors`` of responses against the contract: version, ids, known provider, numbers in range."""
    number = lambda c, name: F.when(F.col(c).isNotNull() & (V.not_negative(c).isNull()), F.lit(name))
    checks = [
        F.when(T.safe("schema_version") != "1.0", F.lit("schema_version")),
        *[F.when(T.trimmed(c) == "", F.lit(c)) for c in ("run_id", "sample_id", "model")],
        F.when(~F.coalesce(F.col("provider").isin(*providers), F.lit(False)), F.lit("provider")),
        F.when(F.col("prediction").isNull() & (T.safe("error") == ""), F.lit("prediction")),
        F.when(F.col("prediction.confidence").isNotNull() & V.contract_confidence("prediction.confidence").isNull(), F.lit("prediction.confidence")),
        *[number(f"usage.{c}", f"usage.{c}") for c in ("input_tokens", "output_tokens", "cached_tokens", "cost_usd")],
        number("latency_ms", "latency_ms"),
    ]
    return results.select(key, F.array_compact(F.array(*checks)).alias("errors"))


# The modes of cost and of detail that an input may ask for.
COST_MODES = ("practice", "research")
DETAILS = ("low", "high", "auto")


def input_errors(inputs: DataFrame, key: str, require_images: bool = True) -> DataFrame:
    """``key, errors`` of research inputs against the contract: version, ids, both images, known options."""
    image = lambda side: F.when(T.safe(F.col("images")[side]) == "", F.lit(f"images.{side}"))
    known = lambda field, words: F.when(F.col("options").isNotNull() & ~F.coalesce(F.col("options")[field].isin(*words), F.lit(False)), F.lit(f"options.{field}"))
    checks = [
        F.when(T.safe("schema_version") != "1.0", F.lit("schema_version")), F.when(F.col("run_id").isNull(), F.lit("run_id")), F.when(T.trimmed("sample_id") == "", F.lit("sample_id")),
        F.when(F.col("images").isNull(), F.lit("images")), *([F.when(F.col("images").isNotNull(), image(side)) for side in ("front", "back")] if require_images else []),
        F.when(F.col("options").isNull(), F.lit("options")), known("cost_mode", COST_MODES), known("detail", DETAILS),
    ]
    return inputs.select(key, F.array_compact(F.array(*checks)).alias("errors"))


def needs_confirmation(source_type: Column | str, asked: Column) -> Column:
    """Whether a person must confirm a sheet before use: if it says so, or was read from a printed page."""
    return F.coalesce(asked, F.lit(False)) | F.lower(T.trimmed(source_type)).isin("pdf", "pdf_ocr")


def valid_rating(verdicts: Column, scores: Column, evidence: Column, hallucination: Column, clarity: Column) -> Column:
    """Whether a rating is complete: a verdict for every case, any scores from 0 to 40, the three components in their ranges."""
    said = F.forall(verdicts, lambda v: T.safe(v) != "")
    in_range = F.forall(F.coalesce(scores, F.array().cast("array<double>")), lambda x: x.isNull() | F.coalesce(V.finite(x).between(0, 40), F.lit(False)))
    parts = [F.coalesce(V.finite(x).between(0, most), F.lit(False)) for x, most in ((evidence, 25), (hallucination, 20), (clarity, 15))]
    return F.coalesce(said & in_range, F.lit(False)) & parts[0] & parts[1] & parts[2]


#: One filled row that shows how a sheet is meant, by column.
TEMPLATE_ROW = (
    "CASE-001", "PILL-001", "CASE-001_front.jpg", "CASE-001_back.jpg", "item number", "product name", "front", "back", "타원형", "하양", "", "음각", "있음", "TRUE",
    "normal", "plain", "none", "front", "an example, delete it",
)


def template(spark: SparkSession) -> DataFrame:
    """The columns of an answer sheet with one example row."""
    return spark.createDataFrame([TEMPLATE_ROW], ", ".join(f"{c} string" for c in SHEET_COLUMNS))
