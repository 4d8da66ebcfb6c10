import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import values as V
from sievework.operators import batch, doclog, providers, redaction, registry, sheets
from sievework.streaming import limits

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.fixture(scope="module")
def measured(spark):
    docs = spark.createDataFrame([(i, "form", "original" if i < 2 else "blur", 1000, 1400) for i in range(4)], "doc_id bigint, form string, condition string, width int, height int")
    items = spark.createDataFrame([(i, k, "전화번호" if k else "주민등록번호", (100.0, 100.0 * k, 200.0, 100.0 * k + 20)) for i in range(4) for k in range(3)], f"doc_id bigint, item_no int, type string, box {BOX}")
    boxes = spark.createDataFrame([(i, (90.0, 100.0 * k - 5, 210.0, 100.0 * k + 25)) for i in range(4) for k in range(3) if not (i == 1 and k == 2)], f"doc_id bigint, box {BOX}")
    tried = spark.createDataFrame([(0, False, None, 30.0, 0.9), (1, None, "", 50.0, None), (2, True, "no text" * 40, 0.0, None)], "doc_id bigint, failed boolean, error string, elapsed_ms double, mean_confidence double")
    return docs, items, boxes, tried


def test_a_failed_document_stays_in_the_denominator(measured):
    scores = batch.run(*measured)
    got = {r.doc_id: r for r in scores.collect()}
    assert set(got) == {0, 1, 2} and got[0].complete and got[1].missed == 1
    assert (got[2].items, got[2].covered, got[2].boxes, got[2].detection_failed, len(got[2].reason)) == (3, 0, 0, True, 160)
    head = batch.header(scores, 4).first()
    assert (head.requested, head.scored, head.stopped, head.detection_failures, head.mean_detect_ms) == (4, 3, True, 1, 40)
    assert batch.run(*measured, scored=measured[0].filter("doc_id = 1")).count() == 1
    assert len(batch.csv(scores).first().line.split('","')) == len(batch.CSV_COLUMNS)
    summary = redaction.summarize(scores).first().asDict()
    by = [r.asDict() for r in redaction.summarize(scores, ["condition"]).collect()]
    said = " ".join(batch.sentences(summary, by, {"item_ceiling": 88.2}))
    assert "3 synthetic documents" in said and "11.8 points" in said and "5 of 9" in said and batch.sentences({"docs": 0}, [], None) == ["No documents were measured."]


def test_ceiling_gaps_and_losses(spark):
    rows = [(1, 0, "전화번호", "전화", "010-1234-5678"), (1, 1, "성명", "담당의사", "김가나"), (2, 0, "성명", "비고", "김가나"), (2, 1, "주민등록번호", "", "900101-1234567"), (2, 2, "성명", "비고", " "), (3, 0, "성명", "비고", "박다라"), (3, 1, "성명", None, None)]
    detected = batch.detectable_items(spark.createDataFrame(rows, "doc_id bigint, item_no int, type string, label string, value string"))
    best = batch.ceiling(detected).first()
    assert (best.docs, best.skipped_items, best.items, best.detectable_items, best.item_ceiling, best.clean_docs) == (3, 2, 5, 3, 60.0, 1) and best.high_risk_ceiling == 100
    assert [tuple(r) for r in batch.gaps(detected, 5).collect()] == [("성명", "비고", "김가나", 2)]
    measured = spark.createDataFrame([("성명", 3, 1, 30.0), ("주소", 1, 1, 100.0)], "type string, items int, covered int, recall double")
    got = {r.type: (r.ceiling, r.rule_gap, r.reading_loss) for r in batch.beside_ceiling(measured, batch.ceiling_by_type(detected)).collect()}
    assert got["성명"] == (33.3, 66.7, 3.3) and got["주소"][0] is None
    assert batch.ceiling(detected.limit(0)).first().item_ceiling is None
    assert batch.detectable_items(detected.drop("detectable"), lambda value, line: F.lit(True), detected.filter("doc_id = 3")).filter("detectable").count() == 1


def test_call_and_storage_errors(spark):
    said = ["일일 한도 초과", "HTTP 401", "code 4012", "Forbidden", "model gpt not found", "429 Too Many", "Failed to fetch", "Unexpected end of JSON", "502 bad", "weird", "", None]
    want = ["daily_limit", "signed_out", "other", "refused", "model", "limit", "connection", "answer_format", "server", "other", "unknown", "unknown"]
    df = spark.createDataFrame([(x,) for x in said], "m string")
    assert [r[0] for r in df.select(V.call_error("m")).collect()] == want
    assert df.select(V.call_error_text(F.lit("weird" * 60))).first()[0].endswith("d") and df.filter("m = '502 bad'").select(V.call_error_text("m")).first()[0].startswith("The provider's server")
    got = spark.createDataFrame([("QuotaExceededError", ""), ("SecurityError", ""), (None, "boom")], "n string, m string").select(V.storage_error("n", "m")).collect()
    assert [r[0] for r in got] == ["quota", "blocked", "unknown"]
    texts = ['{"message":" hi "}', '{"code":1}', '{"error":"", "detail":"d"}', "plain", " ", None]
    got = spark.createDataFrame([(x,) for x in texts], "e string").select(V.error_text("e")).collect()
    assert [r[0] for r in got] == ["hi", '{"code":1}', "d", "plain", None, None]


def test_times(spark):
    got = spark.createDataFrame([("2026-08-01T00:00:01Z",), ("never",), (None,)], "t string").select(V.epoch_ms("t")).collect()
    assert [r[0] for r in got] == [1785542401000, 0, 0]
    assert spark.createDataFrame([(datetime.datetime(2026, 8, 1, 2, 3, 4),)], "t timestamp").select(F.length(V.time_stamp("t"))).first()[0] == 14


def test_marks_and_colours(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(V.mark_within(lit(a), lit(b))) for a, b in (("IH", "IHAC50"), ("AC50", "IHAC50"), ("IH", "XIHYZ"), ("I", "IHAC50"), ("HAC", "IHAC50"))] == [True, True, False, False, True]
    assert one(V.mark_key(lit("DT20")) == V.mark_key(lit("D120")))
    pairs = (("분홍", "주황"), ("분홍", "초록"), ("하양", "회색"), ("노랑|투명", "주황"), ("분홍", "분홍|하양"))
    assert [one(V.near_color(lit(a), lit(b))) for a, b in pairs] == [True, False, True, True, True] and not one(V.same_color(lit("분홍"), lit("주황")))
    level = lambda *x: one(V.match_level(lit(x[0]), *[lit(v) for v in x[1:]]))
    assert [level("high", 0.9, 0.1, 0.1, False, False), level("high", 0.6, 0.1, 0.1, False, False), level("high", 0.9, 0.7, 0.1, False, False), level("high", 0.9, 0.1, 0.1, False, True), level("low", 0.1, 0.9, 0.9, True, True)] == ["high", "mid", "mid", "mid", "low"]
    box = one(V.rotated_box(V.box(lit(0), lit(0), lit(10), lit(20)), lit(90), lit(100), lit(200), lit(200), lit(100)))
    assert [round(x, 6) for x in box] == [180, 0, 200, 10]


def test_inputs_ratings_and_templates(spark):
    schema = "k int, schema_version string, run_id string, sample_id string, images struct<front:string,back:string>, options struct<cost_mode:string,detail:string>"
    df = spark.createDataFrame([(1, "1.0", "r", "s", ("a", "b"), ("practice", "low")), (2, None, None, " ", ("a", ""), ("x", None)), (3, "1.0", "", "s", None, None)], schema)
    got = {r.k: r.errors for r in sheets.input_errors(df, "k").collect()}
    assert got == {1: [], 2: ["schema_version", "run_id", "sample_id", "images.back", "options.cost_mode", "options.detail"], 3: ["images", "options"]}
    assert sheets.input_errors(df, "k", False).filter("k = 2").first().errors[-3:] == ["sample_id", "options.cost_mode", "options.detail"]
    rows = [(["c", "w"], [None, 40.0], 25.0, 20.0, 15.0), (["c", ""], None, 1.0, 1.0, 1.0), (["c"], [41.0], 1.0, 1.0, 1.0), (["c"], None, None, 1.0, 1.0), (None, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "v array<string>, s array<double>, e double, h double, c double")
    assert [r[0] for r in df.select(sheets.valid_rating(*[F.col(x) for x in "vsehc"])).collect()] == [True, False, False, False, False]
    asked = spark.createDataFrame([(" PDF ", None), ("csv", True), ("csv", None), (None, False)], "t string, a boolean")
    assert [r[0] for r in asked.select(sheets.needs_confirmation("t", F.col("a"))).collect()] == [True, True, False, False]
    assert sheets.template(spark).first().case_id == "CASE-001"


def test_packs_and_sets(spark):
    rows = [(i, f"q{i}", f"name {i}", i % 3 != 0, "b" if i % 2 else "") for i in range(40)]
    df = spark.createDataFrame(rows, "place int, q string, n string, usable boolean, pb string")
    pack = registry.sample_pack(df, 5, "SET").collect()
    assert [(r.case_id, r.q) for r in pack][:3] == [("SET-001", "q1"), ("SET-002", "q2"), ("SET-003", "q4")] and len(pack) == 5 and pack[0].front_image == "SET-001_front.jpg" and len(pack[0].sha256) == 64
    with pytest.raises(Exception, match="fewer than 30"):
        registry.sample_pack(df, 30, "SET").collect()
    sets = {}
    for r in registry.nested_sets(df, ((5, 5), (10, 15))).collect():
        sets.setdefault(r.target, []).append((r.place, r.q))
    assert len(sets[5]) == 5 and len(sets[10]) == 15 and set(sets[5]) <= set(sets[10])
    wanted = spark.createDataFrame([(1, "q3"), (2, "gone")], "place int, q string")
    assert [(r.q, r.found) for r in registry.named_items(df.withColumn("img", F.lit("u/1")), wanted).collect()] == [("q3", True), ("gone", False)]
    assert registry.usable(df.withColumn("img", F.when(F.col("place") < 3, "u/1")), "^u/[0-9]+$").count() == 3


def test_refresh_keeps_the_old_state_when_too_much_is_gone(spark):
    schema = "q string, n string, en string, pf string, pb string, x int, k int"
    old = spark.createDataFrame([(f"q{i}", f"코데인{i}", None, "A", "", None, i) for i in range(10)], schema)
    new = spark.createDataFrame([(f"q{i}", f"코데인{i}", None, "A", "", None, i) for i in range(1, 10)] + [("q3", "late", None, "B", "", None, 99), ("q77", "none", None, "없음", "", None, 5)], schema)
    names = spark.createDataFrame([(" 코데인 ", "", "마약", 0), ("", "", "마약", 1), ("가나", "", "", 2)], "kr string, eng string, type string, ord int")
    got = {r.q: (r.n, r.nc, r.x) for r in registry.refresh(new, old, names, ["k"]).collect()}
    assert got["q3"] == ("코데인3", "마약", None) and got["q0"][2] == 1 and "q77" not in got and len(got) == 10
    assert registry.refresh(new.limit(2), old, names, ["k"]).filter("x = 1").count() == 0
    assert registry.substances(names).count() == 1 and registry.without_imprint(new).first().without_imprint == 1


def test_review_outcome_and_ocr_quality(spark):
    reviews = spark.createDataFrame([(1, 3), (2, 0), (3, None)], "doc_id bigint, found_boxes int")
    boxes = spark.createDataFrame([(1, "전화번호", True), (1, None, False), (1, "전화번호", None)], "doc_id bigint, kind string, auto boolean")
    got = {r.doc_id: (r.auto_boxes, r.manual_boxes, r.erased_boxes, r.box_kinds) for r in doclog.review_outcome(reviews, boxes).collect()}
    assert got == {1: (2, 1, 1, {"전화번호": 2, "기타": 1}), 2: (0, 0, 0, {}), 3: (0, 0, 0, {})}
    words = spark.createDataFrame([(1, 90.0), (1, 50.0), (1, None), (2, None)], "doc_id bigint, confidence double")
    assert {r.doc_id: tuple(r)[1:] for r in doclog.ocr_quality(words, ["doc_id"]).collect()} == {1: (3, 0.7, 0.5), 2: (1, None, None)}


def test_mock_provider(spark):
    known = providers.Registry()
    for name in ("correct", "partial", "error", "slow", "nothing"):
        known.register(name, providers.mock(name))
    tasks = spark.createDataFrame([(i, p, "x") for i, p in enumerate(("correct", "partial", "error", "slow", "nothing"))], "task_id bigint, provider string, input string")
    got = {r.provider: (r.answer, r.error) for r in providers.run(tasks, known).collect()}
    assert '"confidence": 95' in got["correct"][0] and got["slow"][0] == got["correct"][0] and "mock failure" in got["error"][1] and "unknown scenario" in got["nothing"][1]


def test_daily_quotas(spark):
    acts = ["consume"] * 3 + ["refill"] + ["consume"] * 3 + ["refill", "refill", "stats"]
    rows = [(i, "2026-08-01", "a", act, i) for i, act in enumerate(acts)] + [(100, "2026-08-02", "a", "consume", 50), (101, "2026-08-01", "b", "consume", 1), (102, None, "a", "consume", 1)]
    events = spark.createDataFrame(rows, "event_id bigint, day string, subject string, action string, now_ms bigint")
    got = {r.event_id: (r.allowed, r.used, r.call_limit, r.remaining, r.refills) for r in limits.quotas(events, calls=2, refill=2, most=2).collect()}
    assert got[1] == (True, 2, 2, 0, 0) and got[2] == (False, 2, 2, 0, 0) and got[3] == (True, 2, 4, 2, 1) and got[6] == (False, 4, 4, 0, 1)
    assert got[7] == (True, 4, 6, 2, 2) and got[8][0] is False and got[9] == (None, 4, 6, 2, 2) and got[100][0] and got[101][0] and 102 not in got
    assert limits.quotas(events.limit(0)).count() == 0


def test_success_ends_the_window(spark):
    rows = [(i, "a", i * 10, i == 3) for i in range(6)]
    events = spark.createDataFrame(rows, "event_id bigint, limit_key string, now_ms bigint, success boolean")
    got = {r.event_id: (r["count"], r.allowed) for r in limits.decide(events, 2).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 4: (1, True), 5: (2, True)}


def test_metrics_for_readers(spark):
    df = spark.createDataFrame([(0.5432, 1234567.0), (None, float("nan"))], "a double, b double")
    shown = [V.metric_text(F.col("a"), k) for k in ("ratio", "usd", "ms", "other")] + [V.metric_text(F.col("b"), "count")]
    assert [tuple(r) for r in df.select(*[c.alias(str(i)) for i, c in enumerate(shown)]).collect()] == [("54.3%", "$0.543200", "1 ms", "0.543", "1,234,567"), ("—",) * 5]
