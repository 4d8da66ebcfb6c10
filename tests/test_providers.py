import pytest
from pyspark.sql import functions as F

from sievework.operators import providers


def test_aliases(spark):
    answers = ['```json\n{"item_name": " 가나정 ", "confidence": "85", "basis": "b"}\n```', 'so: {"name": "x", "drug_name": "", "confidence": 150} end', "no json", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = [r.p for r in df.select("i", providers.prediction_of("a").alias("p")).orderBy("i").collect()]
    assert (got[0].drug_name, got[0].confidence, got[0].evidence) == ("가나정", 85.0, "b")
    assert (got[1].drug_name, got[1].confidence) == ("", None) and got[2].drug_name == got[3].drug_name == ""


def test_usage(spark):
    df = spark.createDataFrame([('{"prompt_tokens": 5, "completion_tokens": -1, "cost": "0.5"}',), (None,)], "u string")
    got = [tuple(r.u) for r in df.select(providers.usage_of("u").alias("u")).collect()]
    assert got == [(5.0, None, None, 0.5), (None, None, None, None)]


def test_batch_by_id_then_place(spark):
    answers = spark.createDataFrame([("r", '[{"n": 0}, {"case_id": "C1", "n": 1}]')], "run_id string, answer string")
    cases = spark.createDataFrame([("r", "C1", 0), ("r", "C2", 0), ("r", "C3", 9)], "run_id string, case_id string, place int")
    got = {r.case_id: r.n for r in providers.batch_predictions(answers, cases).select("case_id", F.get_json_object("part", "$.n").alias("n")).collect()}
    assert got == {"C1": "1", "C2": "0", "C3": None}


def test_failures_become_rows(spark):
    reg = providers.Registry()
    reg.register("ok", lambda rows: [f"<{x}>" for x in rows["input"]])
    reg.register("bad", lambda rows: 1 / 0)
    with pytest.raises(ValueError):
        reg.register("ok", lambda rows: [])
    with pytest.raises(KeyError):
        reg.get("none")
    tasks = spark.createDataFrame([(1, "ok", "a"), (2, "bad", "b"), (3, "none", "c"), (4, None, "d")], "task_id bigint, provider string, input string")
    got = {r.task_id: (r.answer, (r.error or "").split(":")[0]) for r in providers.run(tasks, reg).collect()}
    assert got[1] == ("<a>", "") and got[2] == (None, "ZeroDivisionError") and got[3][1] == got[4][1] == "KeyError"
    assert providers.fan_out(tasks, [("p", "m"), ("p", "n")]).count() == 8
