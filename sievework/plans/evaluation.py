"""Queries of scoring and its roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import rollups, scoring
from sievework.operators.rollups import r6
from sievework.session import materialize
from sievework.sources.tables import spread_table, table


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(spread_table(spark, folder, "research_result"), table(spark, folder, "gt_record"), table(spark, folder, "model_price"))


def score_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The scored rows."""
    return scored(spark, folder).select(
        "result_id", "sample_id", "provider", "model", "variant", "classification", "exact_match", "partial_match", "dangerous", "orientation",
        *[r6(F.col(c)).alias(c) for c in ("name_similarity", "front_similarity", "back_similarity", "front_cer", "back_cer", "imprint_cer", "confidence", "brier", "completeness")],
        F.round("legacy_score", 4).alias("legacy_score"), "cost_source", F.round("cost_usd", 9).alias("cost_usd"),
    )


def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """Summary per model with robustness; the scored columns are written once for the two roll-ups."""
    return rollups.leaderboard(materialize(scored(spark, folder).select(*rollups.SUMMARIZED)))


def conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Summary per value of each condition."""
    return rollups.by_condition(scored(spark, folder))


def robustness_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Robustness per model and sample."""
    per = rollups.robustness_per_sample(scored(spark, folder))
    return per.select("provider", "model", "sample_id", "n_variants", *[r6(F.col(c)).alias(c) for c in ("original_accuracy", "variant_accuracy", "consistency", "accuracy_drop", "robustness_score")])


def robustness_models(spark: SparkSession, folder: str) -> DataFrame:
    """Robustness per model."""
    return rollups.robustness_by_model(scored(spark, folder))


def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row over all results."""
    return rollups.dataset_summary(scored(spark, folder))


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """Errors and dangerous answers."""
    return rollups.failures(scored(spark, folder))


def model_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Cost per model and source."""
    return rollups.model_costs(scored(spark, folder))


def dashboard_cards(spark: SparkSession, folder: str) -> DataFrame:
    """The summary as cards."""
    return rollups.dashboard_cards(rollups.dataset_summary(scored(spark, folder)))


def sample_csv(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV line per scored row."""
    return rollups.csv_rows(scored(spark, folder))


def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The per-sample table, under its result."""
    rows = scoring.score(spread_table(spark, folder, "research_result"), table(spark, folder, "gt_record"), table(spark, folder, "model_price"), with_answer=True)
    return rollups.sample_rows(rows)


def dashboard_models(spark: SparkSession, folder: str) -> DataFrame:
    """The leaderboard as a dashboard shows it."""
    return rollups.dashboard_models(leaderboard(spark, folder))


def dashboard_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """The roll-up by condition as a dashboard shows it."""
    return rollups.dashboard_conditions(conditions(spark, folder))


def costs_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """Cost of each model."""
    return rollups.costs_by_model(scored(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (score_samples, leaderboard, conditions, robustness_samples, robustness_models, dataset_summary, failures, model_costs, dashboard_cards, sample_csv, sample_rows, dashboard_models, dashboard_conditions, costs_by_model)
}


def levenshtein_sql(a: str, b: str) -> str:
    """Edit distance by characters: the built-in one of the oracle counts bytes."""
    return (
        f"(case when {a} = {b} then 0 when {a} = '' then length({b}) when {b} = '' then length({a}) else "
        f"list_reduce(list_transform(string_split({a}, ''), lambda c: [unicode(c)::bigint]), "
        f"lambda r, ch: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: "
        f"[least(r[j + 1] + 1, r[j] + (unicode(substr({b}, j::int, 1)) <> ch[1])::int)::bigint]), "
        f"lambda acc, x: list_append(acc, least(x[1], acc[-1] + 1)), [r[1] + 1]), range(0, length({b}) + 1))[-1] end)"
    )


def similarity_sql(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) = 0 then 1.0 else greatest(0.0, 1 - {levenshtein_sql(a, b)}::double / greatest(length({a}), length({b}))) end)"


def cer_sql(t: str, a: str) -> str:
    return f"(case when length({t}) = 0 then (case when length({a}) > 0 then 1.0 else 0.0 end) else {levenshtein_sql(t, a)}::double / length({t}) end)"


def trim_sql(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def drug_name_sql(x: str) -> str:
    """Without compatibility folding: what it would change in these tables is removed anyway."""
    text = rf"regexp_replace(coalesce({x}, ''), '\([^)]*\)|\[[^\]]*\]', '', 'g')"
    text = rf"regexp_replace({text}, '\b\d+(?:\.\d+)?\s*(?:mg|mcg|g)\b', '', 'gi')"
    text = rf"regexp_replace({text}, '\d+(?:\.\d+)?\s*(?:㎎|밀리그램|그램)', '', 'g')"
    return f"lower(regexp_replace({text}, '[^0-9A-Za-z가-힣]', '', 'g'))"


def imprint_sql(x: str) -> str:
    none = "^(?:없음|무각인|빈면|확인불가|판독불가|none|blank|unreadable|unknown|[-—–])$"
    return f"(case when regexp_matches({trim_sql(x)}, '{none}', 'i') then '∅' else upper(regexp_replace({trim_sql(x)}, '[^0-9A-Za-z가-힣]', '', 'g')) end)"


SCORED_SQL = f"""
WITH t AS (SELECT *, coalesce(nullif(condition.variant, ''), 'original') AS v FROM gt_record WHERE sample_id IS NOT NULL),
te AS (SELECT sample_id, v, arg_max({{'s': sample_id, 'a': answer, 'c': condition}}, gt_id) AS t FROM t GROUP BY 1, 2),
ta AS (SELECT sample_id, arg_min({{'s': sample_id, 'a': answer, 'c': condition}}, gt_id) AS t FROM t GROUP BY 1),
j AS (
    SELECT r.*, coalesce(te.t, ta.t) AS t FROM research_result r
    LEFT JOIN te ON te.sample_id = r.sample_id AND te.v = coalesce(nullif(r.meta['variant'], ''), 'original')
    LEFT JOIN ta ON ta.sample_id = r.sample_id
),
n AS (
    SELECT result_id, coalesce(nullif(sample_id, ''), t.s, '') AS sample_id, provider, model, run_id,
        coalesce(nullif(coalesce(nullif(meta['variant'], ''), t.c.variant), ''), 'original') AS variant,
        {drug_name_sql("t.a.drug_name")} AS tn, {drug_name_sql("prediction.drug_name")} AS pn,
        {imprint_sql("t.a.front_imprint")} AS tf, {imprint_sql("t.a.back_imprint")} AS tb,
        {imprint_sql("prediction.front_imprint")} AS pf, {imprint_sql("prediction.back_imprint")} AS pb,
        prediction AS p, usage AS u, coalesce(error, '') AS error, coalesce(latency_ms, 0) AS latency_ms,
        least(1.0, greatest(0.0, case when prediction.confidence > 1 then prediction.confidence / 100 else prediction.confidence end)) AS c0,
        prediction.confidence AS raw_confidence, t.c AS cond
    FROM j
),
s AS (
    SELECT *, case when raw_confidence is null then null else c0 end AS confidence,
        case when tn = '' or pn = '' then 0.0 else {similarity_sql("tn", "pn")} end AS name_similarity,
        {similarity_sql("tf", "pf")} AS ff, {similarity_sql("tb", "pb")} AS bb, {similarity_sql("tf", "pb")} AS fb, {similarity_sql("tb", "pf")} AS bf
    FROM n
),
m AS (
    SELECT *, (fb + bf) / 2 > (ff + bb) / 2 AS swapped, tn <> '' and pn <> '' and tn = pn AS exact_match,
        tn <> '' and pn <> '' and tn <> pn and (name_similarity >= 0.72 or (least(length(tn), length(pn)) >= 4 and (contains(tn, pn) or contains(pn, tn)))) AS partial_match,
        {trim_sql("p.drug_name")} = '' AS no_name
    FROM s
),
k AS (
    SELECT *, case when error <> '' then 'error'
        when no_name and (regexp_matches(concat_ws(' ', coalesce(p.evidence, ''), coalesce(p.uncertainty, '')), '판독\\s*불가|식별\\s*불가|확인\\s*불가|unreadable|cannot\\s+(?:read|identify)|insufficient', 'i')
            or coalesce(cond.expected_readable, true) = false) then 'unreadable'
        when exact_match then 'correct' when partial_match then 'partial' else 'incorrect' end AS classification,
        case when swapped then fb else ff end AS front_similarity, case when swapped then bf else bb end AS back_similarity,
        case when swapped then {cer_sql("tf", "pb")} else {cer_sql("tf", "pf")} end AS front_cer,
        case when swapped then {cer_sql("tb", "pf")} else {cer_sql("tb", "pb")} end AS back_cer
    FROM m
),
price AS (SELECT lower(provider) AS pp, model AS pm, input, output, cached FROM model_price),
z AS (
    SELECT k.*, (front_cer + back_cer) / 2 AS imprint_cer, (front_similarity + back_similarity) / 2 AS imprint_similarity,
        power(confidence - (classification = 'correct')::int, 2) AS brier,
        ((not no_name)::int + ({trim_sql("p.front_imprint")} <> '')::int + ({trim_sql("p.back_imprint")} <> '')::int + (confidence is not null)::int
            + ({trim_sql("coalesce(nullif(p.evidence, ''), nullif(p.uncertainty, ''))")} <> '')::int)::double / 5 AS completeness,
        classification = 'incorrect' and not no_name and coalesce(confidence >= 0.8, false) AS dangerous,
        u.cost_usd AS direct, pp is not null AS priced, coalesce(u.input_tokens, u.output_tokens, u.cached_tokens) is not null AS some_tokens,
        (greatest(0, coalesce(u.input_tokens, 0) - coalesce(u.cached_tokens, 0)) * coalesce(input, 0) + coalesce(u.output_tokens, 0) * coalesce(output, 0)
            + coalesce(u.cached_tokens, 0) * coalesce(cached, input, 0)) / 1e6 AS by_price
    FROM k LEFT JOIN price ON lower(k.provider) = pp AND k.model = pm
),
scored AS (
    SELECT *, case classification when 'correct' then 40 when 'partial' then 20 else 0 end + imprint_similarity * 25
        + case when brier is null then 0 else greatest(0, 1 - brier) * 15 end + completeness * 20 AS legacy_score,
        coalesce(direct, case when priced and some_tokens then by_price end) AS cost_usd,
        case when direct is not null then 'provider' when priced and some_tokens then 'pricing_table' when priced then 'usage_missing' else 'pricing_unknown' end AS cost_source,
        case when swapped then 'swapped' else 'direct' end AS orientation
    FROM z
)
"""

SUMMARY_SQL = """count(*) AS samples, count(*) filter (classification <> 'error') AS completed, count(*) filter (classification = 'error') AS errors,
    round(count(*) filter (classification = 'correct') / count(*), 6) AS top1_accuracy, round(count(*) filter (classification = 'partial') / count(*), 6) AS partial_rate,
    round(count(*) filter (classification = 'unreadable') / count(*), 6) AS unreadable_rate, round(count(*) filter (classification = 'error') / count(*), 6) AS error_rate,
    count(*) filter (dangerous) AS high_confidence_misidentification,
    round(avg(front_cer), 6) AS front_imprint_cer, round(avg(back_cer), 6) AS back_imprint_cer, round(avg(imprint_cer), 6) AS imprint_cer,
    round(avg(confidence), 6) AS average_confidence, round(avg(brier), 6) AS brier_loss, round(avg(latency_ms), 3) AS average_latency_ms,
    round(sum(cost_usd), 9) AS total_cost_usd, round(case when count(cost_usd) > 0 then sum(cost_usd) / count(*) end, 6) AS cost_per_sample_usd,
    round(avg(legacy_score), 4) AS legacy_score"""

ROBUST_SQL = """, o AS (SELECT provider, model, sample_id, arg_min(classification = 'correct', result_id)::int AS oc, arg_min(pn, result_id) AS oname
    FROM scored WHERE variant = 'original' AND sample_id <> '' GROUP BY ALL),
per AS (SELECT provider, model, sample_id, any_value(oc)::double AS original_accuracy, count(*) AS n_variants, avg((classification = 'correct')::int) AS variant_accuracy,
    avg((pn = oname)::int) AS consistency FROM scored JOIN o USING (provider, model, sample_id) WHERE variant <> 'original' GROUP BY ALL),
rob AS (SELECT *, original_accuracy - variant_accuracy AS accuracy_drop, 0.7 * variant_accuracy + 0.3 * consistency AS robustness_score FROM per),
robm AS (SELECT provider, model, count(*) AS samples, round(avg(original_accuracy), 6) AS original_accuracy, round(avg(variant_accuracy), 6) AS variant_accuracy,
    round(avg(accuracy_drop), 6) AS accuracy_drop, round(avg(consistency), 6) AS consistency, round(avg(robustness_score), 6) AS robustness_score FROM rob GROUP BY ALL)
"""


def _csv_sql(x: str) -> str:
    text = rf"regexp_replace(coalesce({x}, ''), '\r\n|\r|\n', ' ', 'g')"
    return rf"""'"' || replace(case when regexp_matches({text}, '^[=+\-@]') then '''' || {text} else {text} end, '"', '""') || '"'"""


_CSV = " || ',' || ".join(_csv_sql(x) for x in ("sample_id", "run_id", "provider", "model", "variant", "classification", "p.drug_name", "p.front_imprint", "p.back_imprint", "error"))
_CARDS = ("samples completed errors top1_accuracy partial_rate unreadable_rate error_rate high_confidence_misidentification front_imprint_cer back_imprint_cer imprint_cer "
          "average_confidence brier_loss average_latency_ms total_cost_usd cost_per_sample_usd legacy_score known_cost_rows unknown_cost_rows").split()  # fmt: skip
_RATES = ("top1_accuracy", "partial_rate", "unreadable_rate", "error_rate")
_SUMMARY = SCORED_SQL + (
    f"SELECT {SUMMARY_SQL}, " + ", ".join(f"count(*) filter (classification = '{c}') AS n_{c}" for c in rollups.CLASSES)
    + ", count(cost_usd) AS known_cost_rows, count(*) - count(cost_usd) AS unknown_cost_rows FROM scored"
)

ORACLES = {
    "score_samples": SCORED_SQL
    + "SELECT result_id, sample_id, provider, model, variant, classification, exact_match, partial_match, dangerous, orientation, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("name_similarity", "front_similarity", "back_similarity", "front_cer", "back_cer", "imprint_cer", "confidence", "brier", "completeness"))
    + ", round(legacy_score, 4) AS legacy_score, cost_source, round(cost_usd, 9) AS cost_usd FROM scored",
    "leaderboard": SCORED_SQL + ROBUST_SQL + f"SELECT l.*, robm.robustness_score FROM (SELECT provider, model, {SUMMARY_SQL} FROM scored GROUP BY ALL) l LEFT JOIN robm USING (provider, model)",
    "conditions": SCORED_SQL
    + f""", u AS (SELECT *, unnest([{{'f': 'variant', 'v': variant}}, {{'f': 'light', 'v': cond.light}}, {{'f': 'background', 'v': cond.background}}, {{'f': 'blur', 'v': cond.blur}}, {{'f': 'angle', 'v': cond.angle}}]) AS fv FROM scored)
    SELECT fv.f AS field, fv.v AS value, {SUMMARY_SQL} FROM u WHERE trim(coalesce(fv.v, '')) <> '' GROUP BY 1, 2""",
    "robustness_samples": SCORED_SQL + ROBUST_SQL
    + "SELECT provider, model, sample_id, n_variants, round(original_accuracy, 6) AS original_accuracy, round(variant_accuracy, 6) AS variant_accuracy, round(consistency, 6) AS consistency, round(accuracy_drop, 6) AS accuracy_drop, round(robustness_score, 6) AS robustness_score FROM rob",
    "robustness_models": SCORED_SQL + ROBUST_SQL + "SELECT * FROM robm",
    "dataset_summary": _SUMMARY,
    "failures": SCORED_SQL + "SELECT result_id, sample_id, provider, model, classification, dangerous, coalesce(p.drug_name, '') AS predicted_drug_name, round(confidence, 6) AS confidence, error FROM scored WHERE classification = 'error' OR dangerous",
    "model_costs": SCORED_SQL + "SELECT provider, model, cost_source, count(*) AS n, round(sum(cost_usd), 9) AS cost_usd FROM scored GROUP BY ALL",
    "dashboard_cards": f"WITH d AS ({_SUMMARY}) SELECT c.card, round(c.value, 4) AS value FROM (SELECT unnest(["
    + ", ".join(f"{{'card': '{c}', 'value': {c}::double * {100 if c in _RATES else 1}}}" for c in _CARDS) + "]) AS c FROM d)",
    "sample_csv": SCORED_SQL + f"SELECT result_id, {_CSV} AS line FROM scored",
}

_LEADERS = ORACLES["leaderboard"]
ORACLES |= {
    "dashboard_models": f"SELECT provider, model, samples, round(top1_accuracy * 100, 4) AS accuracy, round(partial_rate * 100, 4) AS partial, high_confidence_misidentification AS dangerous, front_imprint_cer, back_imprint_cer, average_confidence, brier_loss, average_latency_ms, total_cost_usd, cost_per_sample_usd, robustness_score FROM ({_LEADERS})",
    "dashboard_conditions": f"SELECT field, value, samples, round(top1_accuracy * 100, 4) AS accuracy, round(error_rate * 100, 4) AS error_rate FROM ({ORACLES['conditions']})",
    "costs_by_model": SCORED_SQL + "SELECT provider, model, round(sum(cost_usd), 9) AS total_cost_usd, round(case when count(cost_usd) > 0 then sum(cost_usd) / count(*) end, 6) AS cost_per_sample_usd FROM scored GROUP BY ALL",
    "sample_rows": SCORED_SQL.replace("prediction AS p, usage AS u", "t.a AS a, prediction AS p, usage AS u")
    + "SELECT sample_id, run_id, provider, model, variant, classification, dangerous AS high_confidence_misidentification, "
    + ", ".join(f"coalesce(a.{c}, '') AS {c}_truth, coalesce(p.{c}, '') AS {c}_prediction" for c in ("drug_name", "front_imprint", "back_imprint"))
    + ", exact_match, partial_match, round(name_similarity, 6) AS drug_name_similarity, round(front_similarity, 6) AS front_imprint_similarity, round(back_similarity, 6) AS back_imprint_similarity, round(imprint_cer, 6) AS \"imprint_CER\", "
    + "round(confidence, 6) AS confidence, round(brier, 6) AS \"Brier_loss\", round(latency_ms, 6) AS latency_ms, (classification = 'error')::int AS error_rate, round(legacy_score, 6) AS legacy_score, "
    + "round(u.input_tokens, 6) AS input_tokens, round(u.output_tokens, 6) AS output_tokens, round(u.cached_tokens, 6) AS cached_tokens, round(cost_usd, 9) AS cost_usd, cost_source, error FROM scored",
}
