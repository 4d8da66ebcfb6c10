"""Blind comparison runs as ground truth, responses, audit rows and leaderboards.

A run is one nested row: ``id, created_at, condition`` (sides, cost_mode), ``prompt_version``, ``cases`` (an array
of structs), ``blind_order`` (label to provider and model), ``results`` (label to usage, latency, error, parsed
answers and rating), ``vote, vote_source``. Fields that a run's schema lacks count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators import arena
from sievework.operators.skew import settled
from sievework.sources.sinks import csv_lines

USAGE = ("input_tokens", "output_tokens", "cached_tokens", "cost_usd")
ANSWER = {
    "mfds_item_id": "mfds_item_id", "drug_name": "truth_name", "front_imprint": "truth_front", "back_imprint": "truth_back", "shape": "truth_shape", "color": "truth_color",
}


def _has(kind: object, *path: str) -> bool:
    for name in path:
        kind = kind.elementType if isinstance(kind, ArrayType) else kind.valueType if isinstance(kind, MapType) else kind
        if not isinstance(kind, StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def _field(rows: DataFrame, column: str, *path: str) -> Column:
    """A nested field, null where the schema lacks it."""
    if not _has(rows.schema[column].dataType, *path):
        return F.lit(None)
    out = F.col(column)
    for name in path:
        out = out[name]
    return out


def _text(rows: DataFrame, column: str, *paths: str) -> Column:
    """The first of the fields that is filled, trimmed, else empty."""
    return T.trimmed(T.first_filled(*[_field(rows, column, p).cast("string") for p in paths]))


def cases_of(runs: DataFrame) -> DataFrame:
    """One row per case of a run: the run's columns, ``case_no`` from 0, ``case`` and its ``sample_id``; a case without id is named for its run and place."""
    each = runs.select("*", F.posexplode("cases").alias("case_no", "case"), F.size("cases").alias("n_cases")).drop("cases")
    fallback = F.concat_ws("-", F.coalesce(F.nullif(T.trimmed("id"), F.lit("")), F.lit("RUN")), F.col("case_no") + 1)
    named = F.nullif(_text(each, "case", "id", "sample_id", "case_id"), F.lit(""))
    return each.withColumn("sample_id", F.coalesce(named, fallback))


def truths_of(runs: DataFrame) -> DataFrame:
    """Ground truth of every case: answer and condition by the contract's names, original without a variant, readable unless it says no."""
    c = cases_of(runs)
    readable = F.coalesce(_field(c, "case", "expected_readable").cast("boolean"), F.lit(True))
    condition = {k: (k,) for k in ("light", "background", "angle", "variant")} | {"blur": ("blur", "clarity")}
    values = {k: _text(c, "case", *names) for k, names in condition.items()}
    values["variant"] = F.coalesce(F.nullif(values["variant"], F.lit("")), F.lit("original"))
    return c.select(
        F.col("id").alias("run_id"), "case_no", "sample_id", _text(c, "case", "pill_id").alias("pill_id"),
        F.struct(*[_text(c, "case", old, new).alias(new) for new, old in ANSWER.items()]).alias("answer"),
        F.struct(readable.alias("expected_readable"), *[v.alias(k) for k, v in values.items()]).alias("condition"),
    )


def answers_of(runs: DataFrame) -> DataFrame:
    """One row per case and blind label: ``label, model_of`` (provider, model) and the label's ``result``, null where there is none."""
    c = cases_of(runs)
    each = c.select("*", F.explode("blind_order").alias("label", "model_of"))
    return each.withColumn("result", F.try_element_at("results", F.col("label")))


def results_of(runs: DataFrame, provider: str = "openai") -> DataFrame:
    """Responses of every case and label by the contract's names.

    The usage of a batch is shared out over its cases, missing counts staying missing. A label without
    result has an empty prediction; the batch's error counts for each of its cases.
    """
    r = answers_of(runs)
    part = F.try_element_at(_field(r, "result", "parsed"), F.col("case_no") + 1) if _has(r.schema["result"].dataType, "parsed") else F.lit(None)
    r = r.withColumn("part", part)
    kind = r.schema["part"].dataType
    p = lambda *names: T.trimmed(T.first_filled(*[F.col("part")[n].cast("string") if _has(kind, n) else F.lit(None) for n in names]))
    confidence = V.finite(F.col("part")["confidence"]) if _has(kind, "confidence") else F.lit(None).cast("double")
    prediction = F.struct(
        p("drug_name").alias("drug_name"), p("drug_code", "mfds_item_id").alias("drug_code"), p("front_imprint", "imprint_front").alias("front_imprint"), p("back_imprint", "imprint_back").alias("back_imprint"),
        p("shape").alias("shape"), p("color").alias("color"), confidence.alias("confidence"), p("evidence").alias("evidence"), p("uncertainty").alias("uncertainty"),
    )
    usage = F.struct(*[(V.finite(_field(r, "result", "usage", k)) / F.greatest("n_cases", F.lit(1))).alias(k) for k in USAGE])
    verdicts = _field(r, "result", "rating", "verdicts")
    verdict = T.safe(F.try_element_at(verdicts, F.col("case_no") + 1)) if _has(r.schema["result"].dataType, "rating", "verdicts") else F.lit("")
    return r.select(
        F.col("id").alias("run_id"), "case_no", "sample_id", F.coalesce(F.nullif(T.trimmed("model_of.provider"), F.lit("")), F.lit(provider)).alias("provider"),
        F.coalesce(F.nullif(T.trimmed("model_of.model"), F.lit("")), F.lit("unknown")).alias("model"), prediction.alias("prediction"), usage.alias("usage"),
        F.coalesce(V.finite(_field(r, "result", "latency_ms")), F.lit(0.0)).alias("latency_ms"), F.nullif(T.safe(_field(r, "result", "error")), F.lit("")).alias("error"),
        "label", verdict.alias("manual_verdict"),
    )


def rubric_truth(rows: DataFrame) -> DataFrame:
    """Truths as the rubric may see them: where ``answer`` is there, only it and the condition, so that a blank name is not filled from older fields."""
    older = [c for c in rows.columns if c not in ("schema_version", "sample_id", "answer", "condition")]
    kept = [F.when(F.col("answer").isNull(), F.col(c)).alias(c) for c in older]
    version = F.when(F.col("answer").isNotNull(), F.coalesce(F.nullif(T.safe("schema_version"), F.lit("")), F.lit("1.0"))).otherwise(F.col("schema_version"))
    return rows.select(version.alias("schema_version"), "sample_id", "answer", "condition", *kept)


def with_sheet_row(cases: DataFrame, sheet: DataFrame, order: str = "row_id") -> DataFrame:
    """``cases`` (``sample_id``) with ``sheet_row``, the first row of the loaded sheet with that case id, null where there is none."""
    whole = F.struct(*sheet.columns)
    first = sheet.filter(T.trimmed("case_id") != "").groupBy(T.trimmed("case_id").alias("sample_id")).agg(F.min_by(whole, order).alias("sheet_row"))
    return cases.join(first, "sample_id", "left")


def ratings_of(runs: DataFrame) -> DataFrame:
    """One row per case and rated label: provider, model, verdict, score, ``sides``, ``clarity``, and the run's vote and label."""
    r = answers_of(runs)
    rating = lambda name: _field(r, "result", "rating", name)
    at = F.col("case_no") + 1
    scores = F.try_element_at(rating("scores"), at) if _has(r.schema["result"].dataType, "rating", "scores") else F.lit(None).cast("double")
    sides = T.trimmed(_field(r, "condition", "sides")) if "condition" in r.columns else F.lit("")
    return r.filter(_field(r, "result", "rating").isNotNull()).select(
        F.col("id").alias("run_id"), "case_no", "sample_id", "label", "model_of.provider", "model_of.model", F.try_element_at(rating("verdicts"), at).alias("verdict"), scores.alias("score"),
        F.coalesce(F.nullif(sides, F.lit("")), F.lit("앞면+뒷면")).alias("sides"), F.coalesce(F.nullif(_text(r, "case", "clarity"), F.lit("")), F.lit("미상")).alias("clarity"),
        *[V.finite(rating(c)).alias(f"{c}_score") for c in ("evidence", "hallucination", "clarity")], "vote",
    )


def batch_totals(ratings: DataFrame) -> DataFrame:
    """Total of each run and label: mean points of the rated cases and the three components; null if one is missing."""
    points = arena.accuracy_points("verdict", "score")
    parts = ("evidence_score", "hallucination_score", "clarity_score")
    per = ratings.groupBy("run_id", "label", "provider", "model", "vote").agg(F.avg(points).alias("accuracy"), *[F.first(c).alias(c) for c in parts])
    return per.withColumn("total", F.col("accuracy") + F.col("evidence_score") + F.col("hallucination_score") + F.col("clarity_score"))


def leaderboard(ratings: DataFrame) -> DataFrame:
    """Per model: batches, rated cases, accuracy, mean total, wins of its label, ties of its runs; best accuracy first."""
    totals = batch_totals(ratings)
    points = arena.accuracy_points("verdict", "score") / 40
    cases = ratings.groupBy("provider", "model").agg(F.count(points).alias("rated"), F.round(F.avg(points) * 100, 4).alias("accuracy"))
    sums = totals.groupBy("provider", "model").agg(
        F.count("*").alias("batches"), F.round(F.avg("total"), 4).alias("mean_total"), F.count_if(F.col("vote") == F.col("label")).alias("wins"), F.count_if(F.col("vote") == "tie").alias("ties")
    )
    return cases.join(sums, ["provider", "model"]).orderBy(F.desc_nulls_last("accuracy"), "provider", "model")


def by_condition(ratings: DataFrame) -> DataFrame:
    """Rated cases and accuracy per value of sides and of clarity."""
    points = arena.accuracy_points("verdict", "score") / 40
    each = ratings.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("sides", "clarity")])))
    per = each.groupBy("_b.field", "_b.value").agg(F.count(points).alias("rated"), F.round(F.avg(points) * 100, 4).alias("accuracy"))
    return per.filter("rated > 0")


AUDIT_COLUMNS = (
    "batch_id", "created_at", "case_index", "case_id", "image_sides", "image_clarity", "cost_mode", "prompt_version", "blind_label", "provider", "model", "truth_mfds_item_id", "truth_drug_name",
    "truth_imprint_front", "truth_imprint_back", "drug_name", "drug_code", "imprint_front", "imprint_back", "mfds_match", "mfds_candidate", "verdict", "accuracy_score", "evidence_score", "hallucination_score",
    "clarity_score", "total_score", "rating_source", "evaluation_version", "automatic_total_score", "rating_override_fields", "vote", "vote_source", "latency_ms", "call_error",
)
#: Audit columns that come from the case, and the fields of which the first that is filled is taken.
AUDIT_CASE = {
    "case_id": ("id", "sample_id", "case_id"), "image_clarity": ("clarity",), "truth_mfds_item_id": ("mfds_item_id",), "truth_drug_name": ("truth_name",), "truth_imprint_front": ("truth_front",), "truth_imprint_back": ("truth_back",),
}


def audit_rows(runs: DataFrame) -> DataFrame:
    """Every case under every blind label with its truth, answer, scores and vote: the columns of ``AUDIT_COLUMNS``; a missing part is null.

    What belongs to a case alone or to a label alone is computed before the two meet, and a case takes only its own
    entries of the label's arrays, so that the cost follows the rows that come out and not the square of a run's cases.
    """
    case_kind, kind = runs.schema["cases"].dataType.elementType, runs.schema["results"].dataType.valueType
    case = lambda c, *names: F.nullif(T.trimmed(T.first_filled(*[c[n] if _has(case_kind, n) else F.lit(None) for n in names])), F.lit(""))
    named = lambda c: F.struct(*[case(c, *names).alias(k) for k, names in AUDIT_CASE.items()])
    labelled = lambda e: F.struct(e["key"].alias("label"), e["value"].alias("model_of"), F.try_element_at("results", e["key"]).alias("result"))
    # a select with an explode computes its other columns after it, so what is to be computed before has a select of its own
    of_run = [c for c in runs.columns if c not in ("cases", "blind_order", "results")]
    lists = settled(runs).select(*of_run, F.transform("cases", named).alias("cases"), F.transform(F.map_entries("blind_order"), labelled).alias("_answers"))
    r = lists.select(*of_run, "cases", F.explode("_answers").alias("_a")).select(*of_run, "cases", "_a.*")
    rating = lambda name: _field(r, "result", "rating", name)
    condition = lambda name: _field(r, "condition", name) if "condition" in r.columns else F.lit(None)
    components = [V.finite(rating(c)) for c in ("evidence", "hallucination", "clarity")]
    means = F.lit(None).cast("double")
    if _has(kind, "rating", "verdicts"):
        scores = rating("scores") if _has(kind, "rating", "scores") else F.array().cast("array<double>")
        points = F.filter(F.transform(rating("verdicts"), lambda v, i: arena.accuracy_points(v, F.try_element_at(scores, i + 1))), lambda x: x.isNotNull())
        means = F.when(F.size(points) > 0, F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / F.size(points))
    override = F.array_join(rating("override_fields"), "|") if _has(kind, "rating", "override_fields") else F.lit("")
    of_label = {
        "batch_id": F.col("id"), "created_at": F.col("created_at") if "created_at" in r.columns else F.lit(None), "image_sides": condition("sides"), "cost_mode": condition("cost_mode"),
        "prompt_version": F.col("prompt_version") if "prompt_version" in r.columns else F.lit(None), "blind_label": F.col("label"), "provider": F.col("model_of.provider"), "model": F.col("model_of.model"),
        "evidence_score": components[0], "hallucination_score": components[1], "clarity_score": components[2], "total_score": means + components[0] + components[1] + components[2],
        "rating_source": T.first_filled(rating("source"), F.lit("manual")), "evaluation_version": T.first_filled(rating("evaluation_version"), F.lit("manual-v1")),
        "automatic_total_score": V.finite(rating("automatic_total")), "rating_override_fields": F.coalesce(override, F.lit("")), "vote": F.col("vote"),
        "vote_source": T.first_filled(F.col("vote_source") if "vote_source" in r.columns else F.lit(None), F.lit("manual")), "latency_ms": V.finite(_field(r, "result", "latency_ms")), "call_error": _field(r, "result", "error"),
    }

    def entries(c: Column, i: Column) -> Column:
        """A case with its own entries of the label's arrays."""
        at = i + 1
        of_case = lambda *path: F.try_element_at(_field(r, "result", *path), at) if _has(kind, *path) else F.lit(None)
        inner = lambda array, name: of_case(array)[name] if _has(kind, array, name) else F.lit(None)
        return F.struct(
            at.alias("case_index"), *[c[k].alias(k) for k in AUDIT_CASE], *[inner("parsed", k).alias(k) for k in ("drug_name", "drug_code", "imprint_front", "imprint_back")], inner("db", "matched").cast("boolean").alias("_matched"),
            inner("db", "confidence").alias("_db_confidence"), inner("db", "candidate").alias("mfds_candidate"), of_case("rating", "verdicts").cast("string").alias("_verdict"), of_case("rating", "scores").cast("double").alias("_score"),
        )

    scored_labels = r.select(*[v.alias(name) for name, v in of_label.items()], F.transform("cases", entries).alias("_cases"))
    each = scored_labels.select(*of_label, F.explode("_cases").alias("_c")).select(*of_label, "_c.*")
    matched = F.when(F.col("_matched"), F.coalesce(F.nullif(T.safe("_db_confidence"), F.lit("")), F.lit("matched"))).otherwise("not_matched")
    scored = {"mfds_match": matched, "verdict": T.safe("_verdict"), "accuracy_score": arena.accuracy_points("_verdict", "_score")}
    return each.select(*[scored.get(name, F.col(name)).alias(name) for name in AUDIT_COLUMNS])


def audit_csv(runs: DataFrame) -> DataFrame:
    """One CSV line per audit row."""
    return csv_lines(audit_rows(runs), AUDIT_COLUMNS)
