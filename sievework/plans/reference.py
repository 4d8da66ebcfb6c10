"""Queries of rubric, sheets, registry, redaction, logs, text spans and limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators import arena, doclog, draws, layout, pii, redaction, registry, rubric, sheets
from sievework.plans import reference_sql
from sievework.session import materialize
from sievework.sources.tables import spread_table, table
from sievework.streaming import limits

# ---- rubric -----------------------------------------------------------------


def rubric_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Rubric scores of every result."""
    return rubric.cases(spread_table(spark, folder, "research_result"), table(spark, folder, "gt_record"))


def rubric_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Rubric totals per run and model."""
    return rubric.batches(rubric_cases(spark, folder), ["run_id", "provider", "model"])


def rubric_winners(spark: SparkSession, folder: str) -> DataFrame:
    """The winner of each run."""
    totals = rubric_batches(spark, folder).withColumn("label", F.concat_ws(":", "provider", "model"))
    return rubric.winners(totals, "run_id", "label")


def rubric_assertions(spark: SparkSession, folder: str) -> DataFrame:
    """External checks of the rubric cases."""
    return rubric.passes_assertion(rubric_cases(spark, folder))


def arena_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """Leaderboard over the rubric's verdicts, with each run's winner as its vote."""
    cases = materialize(rubric_cases(spark, folder)).withColumn("score", F.lit(None).cast("double"))
    totals = rubric.batches(cases, ["run_id", "provider", "model"]).select("run_id", "provider", "model", "total")
    votes = rubric.winners(totals, "run_id", "model")
    return arena.leaderboard(cases, totals, votes)


# ---- answer sheets ----------------------------------------------------------


def _images(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered images: those of rows with a product name."""
    named = table(spark, folder, "answer_sheet").filter(F.col("drug_name").isNotNull())
    return named.select(F.explode(F.array("front_image", "back_image")).alias("image"))


def sheet_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Errors and warnings of every answer-sheet row."""
    checked = sheets.validate_rows(table(spark, folder, "answer_sheet"), _images(spark, folder))
    return checked.select("row_id", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "valid")


def orphan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of the sheets that no valid ground truth names."""
    truth = table(spark, folder, "gt_record").select(F.col("images.front").alias("front_image"), F.col("images.back").alias("back_image"))
    return sheets.orphan_images(truth, _images(spark, folder))


def duplicate_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images delivered more than once."""
    return sheets.duplicate_images(_images(spark, folder))


def sheet_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth made of answer-sheet rows."""
    made = sheets.to_truth(table(spark, folder, "answer_sheet"))
    return made.select("row_id", "sample_id", "condition.expected_readable", "condition.variant")


def truth_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Contract errors of the ground truth."""
    return sheets.truth_errors(table(spark, folder, "gt_record"), "gt_id").select("gt_id", F.array_join("errors", "|").alias("errors"))


def result_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Contract errors of the responses."""
    found = sheets.result_errors(table(spark, folder, "research_result"), ["northlight", "deltaforge", "lumenworks", "mock"])
    return found.select("result_id", F.array_join("errors", "|").alias("errors"))


def error_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Responses by class of error."""
    kind = V.error_class("error")
    return table(spark, folder, "research_result").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.bool_or(V.retryable(kind)).alias("retryable"))


def confidence_scales(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence under each reading."""
    c = F.col("prediction.confidence")
    return table(spark, folder, "research_result").select(
        "result_id", F.round(V.unit_confidence(c), 6).alias("unit"), F.round(V.unit_confidence_rubric(c), 6).alias("rubric"),
        F.round(V.contract_confidence(c), 6).alias("contract"), F.round(V.clamped_confidence(c), 6).alias("clamped"),
    )


# ---- registry ---------------------------------------------------------------


def registry_first(spark: SparkSession, folder: str) -> DataFrame:
    """One entry per item, the first delivered, with its canonical imprints."""
    first = registry.first_delivered(table(spark, folder, "pill_registry"), "q", ["fetched_at", "entry_id"])
    return first.select("entry_id", "q", "n", T.registry_mark("pf").alias("front"), T.registry_mark("pb").alias("back"), T.colors("k1").alias("colors"))


def registry_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Items by whether the current state has them or only an older one."""
    entries = table(spark, folder, "pill_registry")
    fresh = entries.filter(F.col("x").isNull()).select("q", "n").distinct()
    before = entries.select("q", "n").distinct()
    return registry.cumulative(fresh, before).select("q", "n", "x")


def registry_history(spark: SparkSession, folder: str) -> DataFrame:
    """Items that are only in older snapshots, with the last day they were there."""
    entries = table(spark, folder, "pill_registry").withColumn("day", F.to_date("fetched_at"))
    current = entries.filter(F.col("x").isNull())
    return registry.recovered(entries.select("q", "day"), current, "day").select("q", F.col("last_seen").cast("string").alias("last_seen"))


def listed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Substances named in the registry, as a list with a type each."""
    inner = F.regexp_extract("n", r"\(([가-힣]{2,})", 1)
    names = table(spark, folder, "pill_registry").select(inner.alias("kr")).filter("kr <> ''").distinct()
    kind = F.element_at(F.array(F.lit("마약"), F.lit("향정신성의약품"), F.lit("기타")), (F.length("kr") % 3 + 1).cast("int"))
    return names.select("kr", F.lit("").alias("eng"), kind.alias("type"), F.lit(0).alias("ord"))


def registry_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Items tagged by the longest listed name in theirs."""
    entries = table(spark, folder, "pill_registry").select("q", "n", "en").distinct()
    return registry.tag_by_longest_name(entries, listed_names(spark, folder), "아포모르핀|(?i)apomorphine").select("q", "nc").filter("nc is not null")


def registry_efficacy(spark: SparkSession, folder: str) -> DataFrame:
    """Efficacy and precautions per item by source."""
    return registry.efficacy_of(table(spark, folder, "pill_registry"), table(spark, folder, "efficacy"))


def registry_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A stratified selection of 120 items."""
    pool = registry.first_delivered(table(spark, folder, "pill_registry"), "q", ["fetched_at", "entry_id"]).filter(T.safe("pf") != "")
    return registry.stratified(pool, 120, {"원형": 0.35, "타원형": 0.2, "장방형": 0.2, "": 0.1})


# ---- redaction and logs -----------------------------------------------------

KINDS = ("주민등록번호", "전화번호", "이메일", "개인식별번호", "성명")


def document_boxes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled items and redaction boxes laid out by integer arithmetic on every document's id and length."""
    docs = table(spark, folder, "documents").select("doc_id", F.element_at(F.array(*[F.lit(c) for c in doclog.CONDITIONS]), (F.col("doc_id") % 8 + 1).cast("int")).alias("condition"), F.lit(1000).alias("width"), F.lit(1400).alias("height"), "n_chars")
    k = F.col("item_no")
    items = docs.filter(F.col("n_chars") > 60).withColumn("item_no", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "doc_id", "item_no", F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1).alias("type"),
        V.box(F.lit(100), 100 + k * 200, F.lit(300), 140 + k * 200).alias("box"), "n_chars",
    )
    way = (F.col("doc_id") + k * 3 + F.col("n_chars")) % 5
    two = F.array(
        F.when(way == 0, V.box(F.lit(90), 90 + k * 200, F.lit(310), 150 + k * 200)).when(way == 1, V.box(F.lit(100), 100 + k * 200, F.lit(210), 140 + k * 200)).when(way == 2, V.box(F.lit(290), 120 + k * 200, F.lit(500), 160 + k * 200)),
        F.when(way == 1, V.box(F.lit(190), 95 + k * 200, F.lit(320), 145 + k * 200)).when(way == 3, V.box(F.lit(600), 100 + k * 200, F.lit(700), 150 + k * 200)),
    )
    boxes = items.select("doc_id", F.explode(F.array_compact(two)).alias("box"))
    return docs, items.drop("n_chars"), boxes


def doc_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Redaction scores per document."""
    return redaction.score_documents(*document_boxes(spark, folder))


def doc_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Redaction scores per condition."""
    return redaction.summarize(doc_scores(spark, folder), ["condition"])


def doc_types(spark: SparkSession, folder: str) -> DataFrame:
    """Redaction recall per kind of item."""
    _, items, boxes = document_boxes(spark, folder)
    return redaction.by_type(redaction.score_items(items, boxes))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return doclog.records(
        e.select(
            F.col("event_id").cast("string").alias("doc_id"), F.col("ts").alias("created_at"), F.element_at(F.array(*[F.lit(c) for c in doclog.CONDITIONS]), (F.col("user_id") % 8 + 1).cast("int")).alias("condition"),
            F.lit(".JPG").alias("source_ext"), (F.col("event_type") == "error").alias("ocr_failed"), F.lit("no text").alias("ocr_error"), (F.col("value") / 100).alias("mean_confidence"),
            (F.col("event_id") % 4).alias("auto_boxes"), (F.col("user_id") % 3).alias("manual_boxes"), (F.col("event_id") % 5 % 2).alias("erased_boxes"), (F.col("event_id") % 1000).alias("elapsed_ms"),
            F.create_map(F.lit("a"), (F.col("event_id") % 4).cast("int"), F.lit("b"), (F.col("user_id") % 3).cast("int")).alias("box_kinds"),
        )
    )


def doclog_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Roll-up of the document log per condition."""
    return doclog.summarize(_log(spark, folder), ["condition"])


def doclog_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of the document log by kind."""
    return doclog.box_kinds(_log(spark, folder))


# ---- text, layout, limits, draws --------------------------------------------


def pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return pii.find(spread_table(spark, folder, "documents"), "doc_id", "text")


def pii_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with personal data replaced, as length and hash."""
    out = pii.redacted(F.col("text"))
    return spread_table(spark, folder, "documents").select("doc_id", out.alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def page_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, placed on pages by their place in the text."""
    words = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("word_no", "text"))
    x0, y0 = (F.col("word_no") % 8 * 120).cast("double"), (F.floor(F.col("word_no") % 400 / 8) * 28 + F.col("word_no") % 3).cast("double")
    return words.select("doc_id", (F.col("word_no") / 400).cast("int").alias("page"), "word_no", "text", x0.alias("x0"), y0.alias("y0"), (x0 + 9 * F.length("text")).alias("x1"), (y0 + 20).alias("y1"))


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and column parts of the pages' words."""
    rows = layout.visual_rows(page_words(spark, folder))
    return layout.split_by_gap(rows, 60, [*layout.PAGE, "row_no"]).select("doc_id", "page", "word_no", "row_no", "part_no")


def column_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Column parts of all documents' words, with rows by their place."""
    words = page_words(spark, folder).withColumn("row_no", F.floor(F.col("word_no") % 400 / 8).cast("int"))
    return layout.split_by_gap(words, 60, [*layout.PAGE, "row_no"]).select("doc_id", "page", "word_no", "row_no", "part_no")


def nearest_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of six header anchors of each word of all documents."""
    words = page_words(spark, folder)
    cells = words.select("doc_id", "page", F.col("word_no").alias("cell_no"), ((F.col("x0") + F.col("x1")) / 2).alias("x"))
    anchors = words.select("doc_id", "page").distinct().withColumn("anchor_no", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("ax", (F.col("anchor_no") * 170).cast("double"))
    return layout.nearest_anchor(cells, anchors, ["doc_id", "page"]).select("doc_id", "page", "cell_no", "anchor_no")


def login_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions on attempts per user, a second of the events standing for a millisecond."""
    now = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = table(spark, folder, "events").select("event_id", F.col("user_id").cast("string").alias("limit_key"), now.alias("now_ms"))
    return limits.decide(events, limits.ACTOR_LIMIT).select("event_id", "limit_key", "count", "allowed", "retry_after_ms")


def runs_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Results stored and delivered again, merged without repeats."""
    r = table(spark, folder, "research_result").select("result_id", "run_id", "sample_id", "provider", "model", "created_at", "received_at", "latency_ms")
    on_time = r.filter(F.col("received_at") <= F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    return arena.merge_runs(on_time, r, ["run_id", "sample_id", "provider", "model", "created_at"], "result_id").select("result_id", "run_id")


def runs_new(spark: SparkSession, folder: str) -> DataFrame:
    """Late results whose run was not stored yet."""
    r = table(spark, folder, "research_result").select("result_id", "run_id", "provider", "created_at", "received_at")
    late = F.col("received_at") > F.col("created_at") + F.expr("INTERVAL 1 HOUR")
    return arena.new_runs(r.filter(~late), r.filter(late), ["run_id", "provider"]).select("result_id", "run_id")


def runs_retained(spark: SparkSession, folder: str) -> DataFrame:
    """The latest hundred results."""
    return arena.retained(table(spark, folder, "research_result"), "created_at", "result_id", 100).select("result_id")


def seeded_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Draws of five from 120 places under a seed."""
    return draws.draw_table(spark, 120, "SIEVE7", 5, 48)


def markup_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Efficacy texts as a source would wrap them, cleaned again."""
    wrapped = F.concat(F.lit("<p><![CDATA["), T.safe("at"), F.lit("]]></p>&nbsp;<br/>"), T.safe("ef"))
    clean = T.markup_free(wrapped)
    return table(spark, folder, "efficacy").select("eff_id", F.length(clean).alias("n"), F.md5(clean).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        rubric_cases, rubric_batches, rubric_winners, rubric_assertions, arena_leaderboard, sheet_validation, orphan_images, duplicate_images,
        sheet_truth, truth_errors, result_errors, error_classes, confidence_scales, registry_first, registry_merge, registry_history,
        registry_tags, registry_efficacy, registry_sample, doc_scores, doc_summary, doc_types, doclog_summary, doclog_kinds, pii_spans,
        pii_redacted, page_rows, column_parts, nearest_columns, login_limits, runs_merged, runs_new, runs_retained,
        seeded_draws, markup_texts,
    )
}

ORACLES = reference_sql.ORACLES
