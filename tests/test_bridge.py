import threading

import pytest
from pyspark.sql import functions as F

from sievework.operators import bridge

RATING = "struct<verdicts:array<string>,scores:array<double>,evidence:double,hallucination:double,clarity:double,override_fields:array<string>>"
RESULT = f"struct<usage:struct<input_tokens:double,output_tokens:double,cached_tokens:double,cost_usd:double>,latency_ms:double,error:string,parsed:array<struct<drug_name:string,drug_code:string,imprint_front:string,confidence:double>>,rating:{RATING}>"
SCHEMA = (
    "id string, created_at string, condition struct<sides:string,cost_mode:string>, prompt_version string, cases array<struct<id:string,truth_name:string,mfds_item_id:string,clarity:string,expected_readable:boolean>>, "
    f"blind_order map<string,struct<provider:string,model:string>>, results map<string,{RESULT}>, vote string, vote_source string"
)


def result(verdicts, scores=None, usage=None, error=None):
    parsed = [("가나정", f"C{i}", "AB", 90.0) for i in range(3)]
    return (usage, 120.0, error, parsed, (verdicts, scores, 20.0, 15.0, 10.0, ["case_1"]))


@pytest.fixture(scope="module")
def runs(spark):
    cases = [(f"C-{i}" if i else None, "가나정", f"20000{i}", "각인 명확" if i < 2 else "", None if i else False) for i in range(5)]
    order = {k: ("p", f"m{k}") for k in "ABCD"}
    results = {
        "A": result(["correct"] * 5, usage=(500.0, None, 0.0, 1.0)), "B": result(["wrong"] * 5), "C": result(["partial"] * 5, scores=[None, 99.0, None, None, None]), "D": result(["correct"] * 5, error="timeout"),
    }
    rows = [("R1", "2026-08-01", (None, "practice"), "v1", cases, order, results, "A", None), ("R2", None, None, None, cases[:1], {"A": ("p", "mA")}, {}, "tie", "manual"), ("R3", None, None, None, [], {}, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_truths(runs):
    got = bridge.truths_of(runs).collect()
    assert [(r.run_id, r.sample_id) for r in got][:2] == [("R1", "R1-1"), ("R1", "C-1")] and len(got) == 6
    assert got[0].answer.drug_name == "가나정" and got[0].condition.expected_readable is False and got[1].condition.expected_readable is True
    assert got[0].condition.variant == "original" and got[0].condition.blur == "각인 명확" and got[0].answer.shape == ""


def test_results_share_out_the_usage(runs):
    got = {(r.run_id, r.label, r.case_no): r for r in bridge.results_of(runs).collect()}
    assert len(got) == 21
    a = got["R1", "A", 0]
    assert a.usage.input_tokens == 100 and a.usage.output_tokens is None and a.usage.cost_usd == pytest.approx(0.2) and a.prediction.front_imprint == "AB" and a.manual_verdict == "correct"
    assert got["R1", "A", 4].prediction.drug_name == "" and got["R1", "D", 1].error == "timeout" and got["R1", "B", 0].error is None
    assert got["R2", "A", 0].prediction.confidence is None and got["R2", "A", 0].latency_ms == 0 and got["R2", "A", 0].manual_verdict == ""


def test_leaderboard_and_conditions(runs):
    ratings = bridge.ratings_of(runs)
    rows = bridge.leaderboard(ratings).collect()
    assert [r.model for r in rows] == ["mA", "mD", "mC", "mB"] and [r.accuracy for r in rows] == [100, 100, 50, 0]
    assert sum(r.rated for r in rows) == 20 and sum(r.accuracy * r.rated for r in rows) / 20 == 62.5
    assert {r.model: (r.wins, r.ties, r.mean_total) for r in rows}["mA"] == (1, 0, 85.0)
    buckets = {(r.field, r.value): (r.rated, r.accuracy) for r in bridge.by_condition(ratings).collect()}
    assert buckets[("sides", "앞면+뒷면")] == (20, 62.5) and buckets[("clarity", "각인 명확")][0] == 8 and buckets[("clarity", "미상")][0] == 12


def test_audit_rows_and_csv(runs):
    rows = bridge.audit_rows(runs.filter("id = 'R1'"))
    assert rows.count() == 20 and tuple(rows.columns) == bridge.AUDIT_COLUMNS
    first = rows.filter("blind_label = 'C' and case_index = 2").first()
    assert (first.verdict, first.accuracy_score, first.total_score, first.mfds_match, first.vote_source, first.rating_source, first.rating_override_fields) == ("partial", 20, 65, "not_matched", "manual", "manual", "case_1")
    lines = [r.line for r in bridge.audit_csv(runs).collect()]
    assert len(lines) == 21 and all(x.count('","') == len(bridge.AUDIT_COLUMNS) - 1 for x in lines)
    assert bridge.audit_rows(runs.limit(0)).count() == 0


def test_audit_of_a_run_of_many_cases(spark):
    n, labels = 6000, 6
    verdict = "element_at(array('correct', 'partial', 'wrong', ''), cast((i + l) % 4 + 1 as int))"
    result = f"named_struct('latency_ms', 100D + l, 'rating', named_struct('verdicts', transform(sequence(0, {n - 1}), i -> {verdict}), 'scores', transform(sequence(0, {n - 1}), i -> if(i % 5 = 4, 12D, null)), 'evidence', 20D, 'hallucination', 10D + l, 'clarity', 7.5D))"
    one = spark.range(1).selectExpr(
        "'R' AS id", f"transform(sequence(0, {n - 1}), i -> named_struct('id', concat(' C-', i), 'truth_name', 'x')) AS cases", f"map_from_entries(transform(sequence(0, {labels - 1}), l -> struct(concat('M', l), named_struct('provider', 'p', 'model', concat('m', l))))) AS blind_order",
        f"map_from_entries(transform(sequence(0, {labels - 1}), l -> struct(concat('M', l), {result}))) AS results", "'tie' AS vote",
    )
    late = threading.Timer(30, spark.sparkContext.cancelAllJobs)  # entries of all cases for each case are 216 million
    late.start()
    try:
        rows = bridge.audit_rows(one).select("case_index", "case_id", "blind_label", "verdict", "accuracy_score", "total_score", "latency_ms").collect()
    finally:
        late.cancel()
    points = lambda i, k: 12.0 if i % 5 == 4 else (40.0, 20.0, 0.0, None)[(i + k) % 4]
    rated = {k: [p for i in range(n) if (p := points(i, k)) is not None] for k in range(labels)}
    want = {(i + 1, f"C-{i}", f"M{k}", ("correct", "partial", "wrong", "")[(i + k) % 4], points(i, k), sum(rated[k]) / len(rated[k]) + 37.5 + k, 100.0 + k) for i in range(n) for k in range(labels)}
    assert len(rows) == n * labels and {tuple(r) for r in rows} == want


def test_rubric_truth_drops_older_fields(spark):
    df = spark.createDataFrame([("1.0", "a", ("",), ("original",), "가나정"), (None, "b", None, None, "다라정"), (None, "c", ("x",), None, "y")], "schema_version string, sample_id string, answer struct<drug_name:string>, condition struct<variant:string>, truth_name string")
    got = {r.sample_id: (r.schema_version, r.truth_name) for r in bridge.rubric_truth(df).collect()}
    assert got == {"a": ("1.0", None), "b": (None, "다라정"), "c": ("1.0", None)}


def test_first_sheet_row_of_a_case(spark):
    cases = spark.createDataFrame([("a",), ("b",), (None,)], "sample_id string")
    sheet = spark.createDataFrame([(2, " a ", "x"), (1, "a", "y"), (3, "", "z"), (4, None, "w")], "row_id int, case_id string, v string")
    got = {r.sample_id: r.sheet_row and r.sheet_row.v for r in bridge.with_sheet_row(cases, sheet).collect()}
    assert got == {"a": "y", "b": None, None: None}
