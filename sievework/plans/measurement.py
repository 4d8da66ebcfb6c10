"""Queries of batch measurement, blind comparison runs, packs, marks, quotas and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators import batch, bridge, doclog, redaction, registry, rubric, sheets, synthetic
from sievework.plans import reference, reference_sql
from sievework.plans.reference_sql import DOCS_SQL, mark_sql, percent_sql
from sievework.sources.tables import spread_table, table
from sievework.streaming import limits

# ---- batches of documents ---------------------------------------------------

FORMS = ("진단서", "처방전", "검사결과지")


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    """The measured batch: every document but each nineteenth was tried, each seventeenth could not be read."""
    docs, items, boxes = reference.document_boxes(spark, folder)
    docs = docs.withColumn("form", F.element_at(F.array(*[F.lit(x) for x in FORMS]), (F.col("doc_id") % 3 + 1).cast("int")))
    tried = docs.filter(F.col("doc_id") % 19 != 18).select(
        "doc_id", (F.col("doc_id") % 17 == 0).alias("failed"), F.lit("no text").alias("error"), (F.col("n_chars") % 997).cast("double").alias("elapsed_ms"), (F.col("doc_id") % 100 / 100).alias("mean_confidence"),
    )
    return batch.run(docs, items, boxes, tried)


def batch_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every tried document."""
    return _batch(spark, folder).select("doc_id", "form", "condition", "items", "covered", "missed", "complete", "recall", "boxes", "stray_boxes", "over_redaction", "detection_failed", "elapsed_ms", "mean_confidence")


def batch_header(spark: SparkSession, folder: str) -> DataFrame:
    """The batch as one row."""
    return batch.header(_batch(spark, folder), table(spark, folder, "documents").count())


def batch_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The batch as CSV lines, of whole numbers and texts."""
    return batch.csv_lines(_batch(spark, folder), ["doc_id", "form", "condition", "items", "covered", "missed", "complete", "boxes", "stray_boxes", "detection_failed"])


def _labelled_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose value is cut from the document's text; every second one has a label. The rules injected find digits."""
    docs, items, _ = reference.document_boxes(spark, folder)
    texts = table(spark, folder, "documents").select("doc_id", "text")
    value = F.substring("text", F.col("item_no") * 12 + 1, F.lit(12))
    labelled = items.select("doc_id", "item_no", "type").join(texts, "doc_id")
    return labelled.select("doc_id", "item_no", "type", F.when(F.col("item_no") % 2 == 0, F.col("type")).otherwise("").alias("label"), F.regexp_replace(value, r"[^0-9A-Za-z가-힣]", "").alias("value"))


def _detected(spark: SparkSession, folder: str) -> DataFrame:
    return batch.detectable_items(_labelled_items(spark, folder), lambda value, line: line.rlike("[0-9]"))


def batch_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    """What the rules could find at best."""
    return batch.ceiling(_detected(spark, folder))


def ceiling_types(spark: SparkSession, folder: str) -> DataFrame:
    """What the rules could find at best, by kind."""
    return batch.ceiling_by_type(_detected(spark, folder))


def ceiling_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of which most items are found by no rule."""
    return batch.gaps(_detected(spark, folder))


def type_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Measured recall beside the ceiling, by kind."""
    _, items, boxes = reference.document_boxes(spark, folder)
    return batch.beside_ceiling(redaction.by_type(redaction.score_items(items, boxes)), batch.ceiling_by_type(_detected(spark, folder)))


def review_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What reviews left of the boxes, with the outcome of each document."""
    docs, _, boxes = reference.document_boxes(spark, folder)
    reviews = docs.select("doc_id", (F.col("doc_id") % 7).cast("int").alias("found_boxes"))
    drawn = boxes.select("doc_id", F.when(F.col("box.x0") > 100, "right").otherwise("").alias("kind"), (F.col("box.x0") != 600).alias("auto"))
    out = doclog.review_outcome(reviews, drawn)
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("box_kinds")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return out.select("doc_id", "auto_boxes", "manual_boxes", "erased_boxes", kinds.alias("kinds"), doclog.outcome(F.lit(False), F.col("auto_boxes"), F.col("manual_boxes"), F.col("erased_boxes")).alias("outcome"))


def read_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the words read per document."""
    words = reference.page_words(spark, folder).select("doc_id", F.when(F.col("word_no") % 10 != 9, (F.col("word_no") * 37 + F.col("doc_id")) % 101).cast("double").alias("confidence"))
    return doclog.ocr_quality(words, ["doc_id"])


# ---- blind comparison runs --------------------------------------------------


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs as stored: the samples and models that the responses of each run have."""
    r = table(spark, folder, "research_result").filter(F.col("run_id").isNotNull())
    cases = F.transform(F.array_sort(F.collect_set(F.coalesce("sample_id", F.lit("")))), lambda s: F.struct(s.alias("id"), F.concat(F.lit("name "), s).alias("truth_name"), F.length(s).cast("string").alias("clarity")))
    models = F.array_sort(F.collect_set(F.struct("provider", "model")))
    per = r.groupBy("run_id").agg(cases.alias("cases"), models.alias("models"))
    label = lambda i: F.concat(F.lit("M"), (i + 1).cast("string"))
    verdicts = lambda i: F.transform("cases", lambda c, k: F.element_at(F.array(F.lit("correct"), F.lit("partial"), F.lit("wrong"), F.lit("")), ((i + k + F.length(c["id"])) % 4 + 1).cast("int")))
    rating = lambda i: F.struct(verdicts(i).alias("verdicts"), F.transform("cases", lambda c, k: F.when(k % 5 == 4, 12.0)).alias("scores"), F.lit(20.0).alias("evidence"), (F.lit(10.0) + i).alias("hallucination"), F.lit(7.5).alias("clarity"))
    result = lambda i: F.struct(F.struct(F.lit(500.0).alias("input_tokens"), F.lit(None).cast("double").alias("output_tokens")).alias("usage"), (F.lit(100.0) + i).alias("latency_ms"), rating(i).alias("rating"))
    order = F.map_from_entries(F.transform("models", lambda m, i: F.struct(label(i), m)))
    results = F.map_from_entries(F.transform("models", lambda m, i: F.struct(label(i), result(i))))
    vote = F.when(F.size("models") > 1, F.concat(F.lit("M"), (F.size("cases") % F.size("models") + 1).cast("string"))).otherwise("tie")
    return per.select(F.col("run_id").alias("id"), "cases", order.alias("blind_order"), results.alias("results"), vote.alias("vote"))


def bridge_truths(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth of every case of the runs."""
    return bridge.truths_of(_runs(spark, folder)).select("run_id", "case_no", "sample_id", "answer.drug_name", "condition.blur", "condition.variant", "condition.expected_readable")


def bridge_results(spark: SparkSession, folder: str) -> DataFrame:
    """Responses of every case and label of the runs."""
    got = bridge.results_of(_runs(spark, folder))
    return got.select("run_id", "case_no", "sample_id", "provider", "model", "label", "manual_verdict", "latency_ms", F.round("usage.input_tokens", 6).alias("input_tokens"), "usage.output_tokens")


def bridge_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """Leaderboard of the rated runs."""
    return bridge.leaderboard(bridge.ratings_of(_runs(spark, folder)))


def bridge_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the rated runs by sides and clarity."""
    return bridge.by_condition(bridge.ratings_of(_runs(spark, folder)))


def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The audit table of the runs, its filled columns."""
    rows = bridge.audit_rows(_runs(spark, folder))
    return rows.select("batch_id", "case_index", "case_id", "image_clarity", "blind_label", "provider", "model", "truth_drug_name", "mfds_match", "verdict", "accuracy_score", "evidence_score", F.round("total_score", 6).alias("total_score"), "rating_source", "vote", "vote_source", "latency_ms")


def sheet_rows_of_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of the responses with the first answer-sheet row of that case."""
    cases = table(spark, folder, "research_result").select(F.coalesce("sample_id", F.lit("")).alias("sample_id")).distinct()
    got = bridge.with_sheet_row(cases, table(spark, folder, "answer_sheet"))
    return got.select("sample_id", F.col("sheet_row.row_id").alias("row_id"))


# ---- registry, marks, checks ------------------------------------------------


def named_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items that answer sheets name, in order of their first row, and whether the registry has them."""
    wanted = table(spark, folder, "answer_sheet").filter(T.trimmed("mfds_item_id") != "").groupBy(F.col("mfds_item_id").alias("q")).agg(F.min("row_id").alias("place"))
    return registry.named_items(table(spark, folder, "pill_registry").select("q", "n"), wanted).select("place", "q", "found")


def usable_items(spark: SparkSession, folder: str) -> DataFrame:
    """Registry entries whose picture lies where it may."""
    return registry.usable(table(spark, folder, "pill_registry"), r"^https://img\.registry\.invalid/pill/[0-9]+-[0-9]+\.jpg$").select("entry_id", "q")


def imprint_free(spark: SparkSession, folder: str) -> DataFrame:
    """How many entries have no imprint."""
    return registry.without_imprint(table(spark, folder, "pill_registry"))


def sample_pack(spark: SparkSession, folder: str) -> DataFrame:
    """A pack of twenty cases from the entries with an imprint on both sides, by entry."""
    entries = table(spark, folder, "pill_registry").withColumn("usable", (T.safe("pf") != "") & (T.safe("pb") != "")).withColumn("place", F.col("entry_id"))
    return registry.sample_pack(entries, 20, "CASE")


def nested_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of the nested sample sets."""
    return registry.nested_sets(registry.first_delivered(table(spark, folder, "pill_registry"), "q", ["fetched_at", "entry_id"]).filter(T.trimmed("pf") != ""))


def registry_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The registry after a delivery of its current entries over all it ever had."""
    entries = table(spark, folder, "pill_registry").select("q", "n", "en", "pf", "pb", "x", "fetched_at", "entry_id")
    order = ["fetched_at", "entry_id"]
    before = registry.first_delivered(entries, "q", order)
    made = registry.refresh(entries.filter(F.col("x").isNull()), before, reference.listed_names(spark, folder), order, "아포모르핀|(?i)apomorphine")
    return made.select("q", "n", "nc", F.coalesce("x", F.lit(0)).alias("gone"))


def mark_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted imprints and colours against those of the truth's sample: within, alike when misread, near."""
    truth = table(spark, folder, "gt_record").filter(F.col("sample_id").isNotNull()).groupBy("sample_id").agg(F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("gt_id"))).alias("a"))
    r = table(spark, folder, "research_result").select("result_id", "sample_id", "prediction.front_imprint", "prediction.color", "prediction.confidence").join(truth, "sample_id")
    mark = lambda c: T.registry_mark(c)
    near = V.near_color(T.colors("a.color"), T.colors("color"))
    level = V.match_level(F.lit("high"), V.unit_confidence("confidence"), F.lit(0.0), F.lit(0.0), F.lit(False), ~near)
    return r.select(
        "result_id", V.mark_within(mark("a.front_imprint"), mark("front_imprint")).alias("within"), (V.mark_key(mark("a.front_imprint")) == V.mark_key(mark("front_imprint"))).alias("alike"), near.alias("near"), level.alias("level"),
    )


def call_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Responses by the kind of failure they report."""
    return table(spark, folder, "research_result").groupBy(V.call_error("error").alias("kind")).agg(F.count("*").alias("n"))


def input_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Contract errors of the inputs that the ground truth would make."""
    options = F.when(F.col("gt_id") % 11 != 0, F.struct(F.when(F.col("gt_id") % 5 == 0, "free").otherwise("practice").alias("cost_mode"), F.when(F.col("gt_id") % 7 == 0, "huge").otherwise("low").alias("detail")))
    inputs = table(spark, folder, "gt_record").select("gt_id", "schema_version", F.col("pill_id").alias("run_id"), "sample_id", "images", options.alias("options"))
    return sheets.input_errors(inputs, "gt_id").select("gt_id", F.array_join("errors", "|").alias("errors"))


def rating_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether ratings made of the events are complete."""
    e = table(spark, folder, "events")
    verdicts = F.array(F.lit("correct"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    scores = F.array(F.col("value"), F.lit(None).cast("double"))
    return e.select("event_id", sheets.valid_rating(verdicts, scores, F.col("value") / 10, F.lit(10.0), (F.col("user_id") % 17).cast("double")).alias("valid"))


def daily_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """Quotas of three calls and two refills of two a day over the events: a purchase refills, anything else calls."""
    e = table(spark, folder, "events")
    action = F.when(F.col("event_type") == "purchase", "refill").otherwise("consume")
    events = e.select("event_id", V.seoul_day("ts").alias("day"), F.col("user_id").alias("subject"), action.alias("action"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"))
    return limits.quotas(events, calls=3, refill=2, most=2).select("event_id", "day", "subject", "action", "allowed", "used", "remaining", "refills")


def imprint_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted imprints looked up in the registry."""
    return registry.imprint_lookup(table(spark, folder, "research_result"), table(spark, folder, "pill_registry"))


def rubric_database(spark: SparkSession, folder: str) -> DataFrame:
    """Rubric scores of every result with the look-up as further evidence."""
    results = spread_table(spark, folder, "research_result")
    return rubric.cases(results, table(spark, folder, "gt_record"), registry.imprint_lookup(results, table(spark, folder, "pill_registry")))


def clarity_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Answer-sheet rows by the clarity of their photo."""
    return table(spark, folder, "answer_sheet").groupBy(V.clarity("expected_readable", "blur").alias("clarity")).agg(F.count("*").alias("n"))


def synthetic_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    """What the rules find at best in 120 synthetic documents, by kind."""
    return batch.ceiling_by_type(batch.detectable_items(synthetic.items(synthetic.documents(spark, 5))))


def synthetic_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The synthetic documents with their patients' numbers."""
    docs = synthetic.documents(spark, 5)
    return docs.join(synthetic.items(docs).filter("label = '환자번호'").select("doc_id", "value"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        batch_scores, batch_header, batch_csv, batch_ceiling, ceiling_types, ceiling_gaps, type_losses, review_outcomes, read_quality, bridge_truths, bridge_results, bridge_leaderboard, bridge_conditions,
        audit_rows, sheet_rows_of_cases, named_items, usable_items, imprint_free, sample_pack, nested_sets, registry_refresh, mark_matches, call_errors, input_errors, rating_checks, daily_quotas, imprint_lookup, rubric_database, clarity_buckets, synthetic_ceiling, synthetic_documents,
    )
}

_BATCH_SQL = DOCS_SQL + f""", b AS (
    SELECT ds.doc_id, ['{"', '".join(FORMS)}'][(doc_id % 3 + 1)::int] AS form, condition, items, case when doc_id % 17 = 0 then 0 else covered end AS covered, case when doc_id % 17 = 0 then items else missed end AS missed,
        doc_id % 17 <> 0 AND complete AS complete, case when items > 0 then case when doc_id % 17 = 0 then 0.0 else recall end end AS recall, case when doc_id % 17 = 0 then 0 else boxes end AS boxes, case when doc_id % 17 = 0 then 0 else stray_boxes end AS stray_boxes,
        case when items > 0 then case when doc_id % 17 = 0 then 0.0 else over_redaction end end AS over_redaction, doc_id % 17 = 0 AS detection_failed, (n_chars % 997)::double AS elapsed_ms, (doc_id % 100) / 100 AS mean_confidence
    FROM ds JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) WHERE doc_id % 19 <> 18)
"""
_ITEMS_SQL = DOCS_SQL + """, li AS (SELECT doc_id, item_no, type, case when item_no % 2 = 0 then type else '' end AS label, regexp_replace(substr(text, item_no::int * 12 + 1, 12), '[^0-9A-Za-z가-힣]', '', 'g') AS value FROM it JOIN documents USING (doc_id)),
de AS (SELECT *, case when value <> '' then regexp_matches(value, '[0-9]') end AS ok, type in ('주민등록번호', '개인식별번호') AS risky FROM li),
ty AS (SELECT type, count(*) AS items, count(*) filter (ok) AS detectable FROM de WHERE ok IS NOT NULL GROUP BY 1)
"""
_RUNS_SQL = """WITH s AS (SELECT DISTINCT run_id, coalesce(sample_id, '') AS s FROM research_result WHERE run_id IS NOT NULL), m AS (SELECT DISTINCT run_id, provider, model FROM research_result WHERE run_id IS NOT NULL),
sn AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s) - 1 AS case_no, count(*) OVER (PARTITION BY run_id) AS n_cases FROM s),
mn AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY provider NULLS FIRST, model NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n_models FROM m),
x AS (SELECT *, case when s = '' then run_id || '-' || (case_no + 1) else s end AS sample_id, 'M' || (i + 1) AS label, ['correct', 'partial', 'wrong', ''][((i + case_no + length(s)) % 4 + 1)::int] AS verdict,
    case when n_models > 1 then 'M' || (n_cases % n_models + 1) else 'tie' end AS vote FROM sn JOIN mn USING (run_id)),
p AS (SELECT *, case when case_no % 5 = 4 then 12.0 when verdict = 'correct' then 40.0 when verdict = 'partial' then 20.0 when verdict = 'wrong' then 0.0 end AS points FROM x),
t AS (SELECT run_id, label, provider, model, any_value(vote) AS vote, avg(points) + 20 + 10 + any_value(i) + 7.5 AS total FROM p GROUP BY ALL)
"""
_IN = lambda c: f"lower(trim(coalesce({c}, '')))"
_CALL = "case when e = '' then 'unknown' " + " ".join(
    f"when regexp_matches(e, '{words}', 'i') then '{kind}'"
    for kind, words in (
        ("daily_limit", "daily api limit|일일.*(?:한도|제한)"), ("signed_out", r"\b401\b|unauthori[sz]ed|access[_ -]?token|인증"), ("refused", r"\b403\b|forbidden"),
        ("model", "model.*(?:not found|does not exist|access|unsupported|not allowed)|unsupported.*model|invalid.*model"), ("limit", r"\b429\b|rate.?limit|quota|billing|insufficient_quota"),
        ("connection", "failed to fetch|network|load failed|cors"), ("answer_format", "json|cases 배열|응답 본문|unexpected end|empty response"), ("server", r"\b5\d\d\b|internal server|bad gateway|service unavailable"),
    )
) + " else 'other' end"
_COLOR_LIST = lambda x: reference_sql.colors_sql(x)
_NEAR = lambda a, b: " or ".join(f"(list_contains({a}, '{x}') and list_contains({b}, '{y}')) or (list_contains({a}, '{y}') and list_contains({b}, '{x}'))" for x, y in V.NEAR_COLORS)

ORACLES = {
    "batch_scores": _BATCH_SQL + "SELECT * FROM b",
    "batch_header": _BATCH_SQL + "SELECT (SELECT count(*) FROM documents) AS requested, count(*) AS scored, count(*) < (SELECT count(*) FROM documents) AS stopped, count(*) filter (detection_failed) AS detection_failures, floor(avg(elapsed_ms) filter (elapsed_ms > 0) + 0.5) AS mean_detect_ms FROM b",
    "batch_csv": _BATCH_SQL + "SELECT concat_ws(',', " + ", ".join(f"""'"' || {c}::varchar || '"'""" for c in ("doc_id", "form", "condition", "items", "covered", "missed", "complete", "boxes", "stray_boxes", "detection_failed")) + ") AS line FROM b",
    "batch_ceiling": _ITEMS_SQL + f""", dd AS (SELECT doc_id, count(*) filter (ok IS NOT NULL) AS items, count(*) filter (ok) AS found, count(*) filter (ok IS NULL) AS skipped, count(*) filter (ok IS NOT NULL AND risky) AS risky, count(*) filter (ok AND risky) AS risky_found FROM de GROUP BY 1)
    SELECT count(*) filter (items > 0) AS docs, sum(skipped) AS skipped_items, sum(items) AS items, sum(found) AS detectable_items, {percent_sql("sum(found)", "sum(items)")} AS item_ceiling, count(*) filter (items > 0 AND found = items) AS clean_docs,
    {percent_sql("count(*) filter (items > 0 AND found = items)", "count(*) filter (items > 0)")} AS clean_doc_ceiling, sum(risky) AS high_risk_items, sum(risky_found) AS high_risk_detectable, {percent_sql("sum(risky_found)", "sum(risky)")} AS high_risk_ceiling FROM dd""",
    "ceiling_types": _ITEMS_SQL + f"SELECT *, {percent_sql('detectable', 'items')} AS rate FROM ty",
    "ceiling_gaps": _ITEMS_SQL + "SELECT type, label, arg_min(value, doc_id * 10 + item_no) AS sample, count(*) AS count FROM de WHERE NOT ok GROUP BY ALL",
    "type_losses": _ITEMS_SQL + f""", ms AS (SELECT type, count(*) AS items, count(*) filter (covered) AS covered, {percent_sql("count(*) filter (covered)", "count(*)")} AS recall, type in ('주민등록번호', '개인식별번호') AS high_risk FROM sc GROUP BY 1),
    mc AS (SELECT ms.*, {percent_sql("ty.detectable", "ty.items")} AS ceiling FROM ms LEFT JOIN ty USING (type))
    SELECT *, floor((greatest(0.0, 100 - ceiling) + 2.220446049250313e-16) * 10 + 0.5) / 10 AS rule_gap, floor((greatest(0.0, ceiling - recall) + 2.220446049250313e-16) * 10 + 0.5) / 10 AS reading_loss FROM mc""",
    "review_outcomes": DOCS_SQL + """, k AS (SELECT doc_id, case when x0 > 100 then 'right' else '기타' end AS kind, count(*) AS n, count(*) filter (x0 = 600) AS manual FROM bb GROUP BY ALL),
    a AS (SELECT doc_id, sum(n) AS n, sum(manual) AS manual, string_agg(kind || '=' || n, '|' ORDER BY kind) AS kinds FROM k GROUP BY 1),
    o AS (SELECT doc_id, coalesce(n - manual, 0) AS auto_boxes, coalesce(manual, 0) AS manual_boxes, coalesce(kinds, '') AS kinds, greatest(0, doc_id % 7 - coalesce(n - manual, 0)) AS erased_boxes FROM d LEFT JOIN a USING (doc_id))
    SELECT *, case when auto_boxes + manual_boxes = 0 then 'failed' when auto_boxes = 0 then 'manual_only' when manual_boxes > 0 or erased_boxes > 0 then 'manual_assisted' else 'auto' end AS outcome FROM o""",
    "read_quality": reference_sql.WORDS_SQL + """, c AS (SELECT doc_id, case when word_no % 10 <> 9 then (word_no * 37 + doc_id) % 101 end AS c FROM p)
    SELECT doc_id, count(*) AS words, round(avg(c) / 100, 6) AS mean_confidence, round(avg((c < 60)::int), 6) AS low_confidence_share FROM c GROUP BY 1""",
    "bridge_truths": _RUNS_SQL + "SELECT DISTINCT run_id, case_no, sample_id, 'name ' || s AS drug_name, length(s)::varchar AS blur, 'original' AS variant, true AS expected_readable FROM x".replace("'name ' || s AS", "trim('name ' || s) AS"),
    "bridge_results": _RUNS_SQL + "SELECT run_id, case_no, sample_id, provider, model, label, verdict AS manual_verdict, 100.0 + i AS latency_ms, round(500.0 / n_cases, 6) AS input_tokens, null::double AS output_tokens FROM x",
    "bridge_leaderboard": _RUNS_SQL + """, c AS (SELECT provider, model, count(points) AS rated, round(avg(points / 40) * 100, 4) AS accuracy FROM p GROUP BY ALL),
    z AS (SELECT provider, model, count(*) AS batches, round(avg(total), 4) AS mean_total, count(*) filter (vote = label) AS wins, count(*) filter (vote = 'tie') AS ties FROM t GROUP BY ALL) SELECT * FROM c JOIN z USING (provider, model)""",
    "bridge_conditions": _RUNS_SQL + "SELECT * FROM (SELECT 'sides' AS field, '앞면+뒷면' AS value, count(points) AS rated, round(avg(points / 40) * 100, 4) AS accuracy FROM p UNION ALL SELECT 'clarity', length(s)::varchar, count(points), round(avg(points / 40) * 100, 4) FROM p GROUP BY ALL) WHERE rated > 0",
    "audit_rows": _RUNS_SQL + """SELECT run_id AS batch_id, case_no + 1 AS case_index, nullif(s, '') AS case_id, length(s)::varchar AS image_clarity, label AS blind_label, provider, model, trim('name ' || s) AS truth_drug_name, 'not_matched' AS mfds_match, verdict, points AS accuracy_score, 20.0 AS evidence_score,
    round(total, 6) AS total_score, 'manual' AS rating_source, p.vote, 'manual' AS vote_source, 100.0 + i AS latency_ms FROM p JOIN t USING (run_id, label, provider, model)""",
    "sheet_rows_of_cases": "WITH f AS (SELECT trim(case_id) AS sample_id, min(row_id) AS row_id FROM answer_sheet WHERE trim(coalesce(case_id, '')) <> '' GROUP BY 1) SELECT c.sample_id, row_id FROM (SELECT DISTINCT coalesce(sample_id, '') AS sample_id FROM research_result) c LEFT JOIN f USING (sample_id)",
    "named_items": "SELECT min(row_id) AS place, mfds_item_id AS q, mfds_item_id IN (SELECT q FROM pill_registry WHERE q IS NOT NULL) AS found FROM answer_sheet WHERE trim(coalesce(mfds_item_id, '')) <> '' GROUP BY 2",
    "usable_items": r"SELECT entry_id, q FROM pill_registry WHERE trim(coalesce(q, '')) <> '' AND trim(coalesce(n, '')) <> '' AND regexp_full_match(coalesce(img, ''), 'https://img\.registry\.invalid/pill/[0-9]+-[0-9]+\.jpg')",
    "imprint_free": f"SELECT count(*) AS entries, count(*) filter ({mark_sql('pf')} = '' AND {mark_sql('pb')} = '') AS without_imprint FROM pill_registry",
    "sample_pack": """WITH f AS (SELECT entry_id, q, n FROM pill_registry WHERE coalesce(pf, '') <> '' AND coalesce(pb, '') <> '' ORDER BY entry_id LIMIT 20), k AS (SELECT *, 'CASE-' || lpad((row_number() OVER (ORDER BY entry_id))::varchar, 3, '0') AS case_id FROM f)
    SELECT case_id, case_id || '_front.jpg' AS front_image, case_id || '_back.jpg' AS back_image, q, n, sha256(concat_ws('|', case_id, q, coalesce(n, ''))) AS sha256 FROM k""",
    "nested_sets": """WITH f AS (SELECT q, arg_min({'pf': pf, 'pb': pb}, (fetched_at, entry_id)) AS r FROM pill_registry WHERE trim(coalesce(q, '')) <> '' GROUP BY 1),
    o AS (SELECT q, row_number() OVER (ORDER BY coalesce(r.pb, '') = '', sha256('sample:' || q)) AS place FROM f WHERE trim(coalesce(r.pf, '')) <> ''), s AS (SELECT * FROM (VALUES (20, 20), (120, 150), (240, 300)) v(target, n)) SELECT target, place, q FROM o JOIN s ON place <= n""",
    "registry_refresh": f"""WITH a AS (SELECT q, arg_min({{'n': n, 'pf': pf, 'pb': pb}}, (fetched_at, entry_id)) AS r FROM pill_registry WHERE x IS NULL AND trim(coalesce(q, '')) <> '' GROUP BY 1),
    f AS (SELECT q, r.n AS n FROM a WHERE {mark_sql("r.pf")} <> '' OR {mark_sql("r.pb")} <> ''), l AS (SELECT DISTINCT regexp_extract(n, '\\(([가-힣]{{2,}})', 1) AS kr FROM pill_registry), k AS (SELECT kr, ['마약', '향정신성의약품', '기타'][length(kr) % 3 + 1] AS type FROM l WHERE kr <> ''),
    h AS (SELECT q, arg_max(type, length(kr)) AS nc FROM f JOIN k ON contains(regexp_replace(f.n, '\\s+', '', 'g'), kr) WHERE NOT contains(f.n, '아포모르핀') GROUP BY 1),
    b AS (SELECT q, arg_min(n, (fetched_at, entry_id)) AS n FROM pill_registry WHERE trim(coalesce(q, '')) <> '' GROUP BY 1)
    SELECT q, n, case when nc <> '기타' then nc end AS nc, 0 AS gone FROM f LEFT JOIN h USING (q) UNION ALL SELECT q, n, null, 1 FROM b WHERE q NOT IN (SELECT q FROM f)""",
    "mark_matches": f"""WITH t AS (SELECT sample_id, arg_min(answer, gt_id) AS a FROM gt_record WHERE sample_id IS NOT NULL GROUP BY 1),
    j AS (SELECT result_id, {mark_sql("t.a.front_imprint")} AS m, {mark_sql("prediction.front_imprint")} AS s, {_COLOR_LIST("t.a.color")} AS ca, {_COLOR_LIST("prediction.color")} AS cb, prediction.confidence AS c FROM research_result JOIN t USING (sample_id)),
    n AS (SELECT *, len(list_intersect(ca, cb)) > 0 OR {_NEAR("ca", "cb")} AS near FROM j)
    SELECT result_id, (length(m) >= 2 AND (starts_with(s, m) OR ends_with(s, m))) OR (length(m) >= 3 AND contains(s, m)) AS within, translate(m, 'OILTSB', '011158') = translate(s, 'OILTSB', '011158') AS alike, near,
    case when coalesce(case when c > 1 then c / 100 else c end < 0.7, false) OR NOT near then 'mid' else 'high' end AS level FROM n""",
    "call_errors": f"SELECT {_CALL} AS kind, count(*) AS n FROM (SELECT trim(coalesce(error, '')) AS e FROM research_result) GROUP BY 1",
    "input_errors": """SELECT gt_id, concat_ws('|', case when coalesce(schema_version, '') <> '1.0' then 'schema_version' end, case when pill_id IS NULL then 'run_id' end, case when trim(coalesce(sample_id, '')) = '' then 'sample_id' end,
    case when images IS NULL then 'images' end, case when images IS NOT NULL and coalesce(images.front, '') = '' then 'images.front' end, case when images IS NOT NULL and coalesce(images.back, '') = '' then 'images.back' end,
    case when gt_id % 11 = 0 then 'options' end, case when gt_id % 11 <> 0 and gt_id % 5 = 0 then 'options.cost_mode' end, case when gt_id % 11 <> 0 and gt_id % 7 = 0 then 'options.detail' end) AS errors FROM gt_record""",
    "rating_checks": "SELECT event_id, coalesce(event_id % 7 <> 0 AND coalesce(event_type, '') <> '' AND (value IS NULL OR value BETWEEN 0 AND 40), false) AND coalesce(value / 10 BETWEEN 0 AND 25, false) AND coalesce(user_id % 17 <= 15, false) AS valid FROM events",
    "imprint_lookup": f"""WITH e AS (SELECT {mark_sql("pf")} AS cf, {mark_sql("pb")} AS cb, arg_min(coalesce(n, ''), entry_id) AS n FROM pill_registry GROUP BY ALL), f AS (SELECT * FROM e WHERE cf <> '' OR cb <> ''),
    a AS (SELECT result_id, {mark_sql("prediction.front_imprint")} AS cf, {mark_sql("prediction.back_imprint")} AS cb FROM research_result)
    SELECT result_id, f.n IS NOT NULL AS matched, coalesce(f.n, '') AS candidate FROM a LEFT JOIN f USING (cf, cb) WHERE cf <> '' OR cb <> ''""",
    "clarity_buckets": """WITH c AS (SELECT lower(trim(coalesce(expected_readable, ''))) AS s, lower(trim(coalesce(blur, ''))) AS b FROM answer_sheet)
    SELECT case when regexp_matches(s, '^(?:false|0|no)$|불가|unreadable') then '각인 불명확' when regexp_matches(s || ' ' || b, '혼합|곤란|partial|uncertain') then '혼합·판단곤란'
    when not regexp_matches(b, '없음|선명|정상|clear') and regexp_matches(b, '심한|흐림|blur') then '각인 불명확' else '각인 명확' end AS clarity, count(*) AS n FROM c GROUP BY 1""",
    "synthetic_documents": """WITH d AS (SELECT id AS doc_id, id // 5 AS k, (id // 5) * 13 + id % 5 AS seed FROM range(120) r(id)) SELECT doc_id, ['진단서', '처방전', '검사결과지'][k // 8 + 1] AS form,
    ['original', 'blur', 'tilt', 'dark', 'glare', 'handwriting', 'fold', 'crumple'][k % 8 + 1] AS condition, seed, 'PT-' || lpad(((seed * 613 + 613) % 1000000)::varchar, 6, '0') AS value FROM d""",
    "daily_quotas": """WITH e AS (SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Seoul')::date::varchar AS day, user_id::varchar AS subject, case when event_type = 'purchase' then 'refill' else 'consume' end AS action, epoch_ms(ts) AS ms FROM events),
    l AS (SELECT day, subject, list({'id': event_id, 'act': action, 'ok': false, 'u': 0, 'r': 0} ORDER BY ms, event_id) AS es FROM e GROUP BY ALL),
    f AS (SELECT day, subject, list_reduce(list_transform(es, lambda e: [e]), lambda acc, x: list_append(acc, {'id': x[1].id, 'act': x[1].act,
        'ok': case when x[1].act = 'refill' then acc[-1].r < 2 else acc[-1].u < 3 + acc[-1].r * 2 end,
        'u': acc[-1].u + (x[1].act = 'consume' and acc[-1].u < 3 + acc[-1].r * 2)::int, 'r': acc[-1].r + (x[1].act = 'refill' and acc[-1].r < 2)::int}), [{'id': -1::bigint, 'act': '', 'ok': false, 'u': 0, 'r': 0}]) AS s FROM l),
    u AS (SELECT day, subject, unnest(s) AS s FROM f) SELECT s.id AS event_id, day, subject, s.act AS action, s.ok AS allowed, s.u AS used, greatest(0, 3 + s.r * 2 - s.u) AS remaining, s.r AS refills FROM u WHERE s.id >= 0""",
}
