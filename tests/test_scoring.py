import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators import rollups, rubric, scoring

PRED = "struct<drug_name:string,drug_code:string,front_imprint:string,back_imprint:string,shape:string,color:string,confidence:double,evidence:string,uncertainty:string>"
RESULT = f"result_id bigint, schema_version string, run_id string, sample_id string, provider string, model string, prediction {PRED}, usage struct<input_tokens:double,output_tokens:double,cached_tokens:double,cost_usd:double>, latency_ms double, error string, meta map<string,string>, created_at timestamp, received_at timestamp"
TRUTH = "gt_id bigint, schema_version string, sample_id string, pill_id string, images struct<front:string,back:string>, answer struct<mfds_item_id:string,drug_name:string,front_imprint:string,back_imprint:string,shape:string,color:string>, condition struct<expected_readable:boolean,light:string,background:string,blur:string,angle:string,variant:string>, notes string"
PERFECT = ("가나정 10mg", "200", "AB", "12", "원형", "하양", 0.9, "앞면 각인 AB와 모양을 관찰", "조명 반사")


def result(i=0, pred=PERFECT, sample="s1", variant="original", error=None, usage=(1000.0, 100.0, None, None), model="m", latency=10.0, run="r"):
    return (i, "1.0", run, sample, "p", model, pred, usage, latency, error, {"variant": variant} if variant else None, None, None)


def truth(i=0, sample="s1", answer=("200", "가나정", "AB", "12", "원형", "하양"), readable=True, variant="original", condition=True):
    return (i, "1.0", sample, "P", ("f", "b"), answer, (readable, "dark", "", None, "front", variant) if condition else None, "")


def scored(spark, results, truths=None, prices=None):
    price = spark.createDataFrame(prices or [("P", "m", 2.0, 10.0, 1.0)], "provider string, model string, input double, output double, cached double")
    return scoring.score(spark.createDataFrame(results, RESULT), spark.createDataFrame(truths if truths is not None else [truth()], TRUTH), price)


def test_golden_case(spark):
    r = scored(spark, [result()]).first()
    assert r.classification == "correct" and r.brier == pytest.approx(0.01) and r.legacy_score > 95
    assert r.cost_source == "pricing_table" and r.cost_usd == pytest.approx(0.003)


def test_classes_costs_and_nulls(spark):
    swap = ("가나정", "200", "12", "AB", None, None, 90.0, None, None)
    wrong = ("전혀다른약", None, "ZZ", None, None, None, 85.0, None, None)
    blank = ("", None, None, None, None, None, None, "판독 불가", None)
    rows = [
        result(0, swap), result(1, wrong), result(2, blank), result(3, None), result(4, error="timeout"), result(5, ("가나정정", *PERFECT[1:])),
        result(6, usage=None), result(7, usage=(None, None, None, 0.5)), result(8, model="other"), result(9, sample=None), result(10, latency=None),
    ]
    got = {r.result_id: r for r in scored(spark, rows).collect()}
    assert len(got) == len(rows)
    assert got[0].orientation == "swapped" and got[0].imprint_cer == 0
    assert got[1].classification == "incorrect" and got[1].dangerous and not got[0].dangerous
    assert got[2].classification == "unreadable" and got[3].classification == "incorrect" and got[4].classification == "error"
    assert got[5].classification == "partial" and got[6].cost_source == "usage_missing" and got[7].cost_source == "provider"
    assert got[8].cost_source == "pricing_unknown" and got[8].cost_usd is None and got[9].name_similarity == 0 and got[10].latency_ms == 0


def test_truth_lookup_first_and_last(spark):
    truths = [truth(1, variant="blur:x", answer=("1", "첫째", "", "", "", "")), truth(2, answer=("2", "둘째", "", "", "", "")), truth(3, variant="", answer=("3", "셋째", "", "", "", ""))]
    got = scoring.with_truth(spark.createDataFrame([result(0), result(1, variant="new"), result(2, sample="gone")], RESULT), spark.createDataFrame(truths, TRUTH))
    names = {r.result_id: r.truth and r.truth.answer.drug_name for r in got.collect()}
    assert names == {0: "셋째", 1: "첫째", 2: None}


def test_robustness_golden(spark):
    wrong = ("다른이름", *PERFECT[1:])
    rows = [result(0)] + [result(i, variant=f"v{i}") for i in range(1, 5)] + [result(5, wrong, variant="v5")] + [result(6, wrong)]
    r = rollups.robustness_per_sample(scored(spark, rows)).first()
    assert r.variant_accuracy == pytest.approx(0.8) and r.accuracy_drop == pytest.approx(0.2) and r.n_variants == 5


def test_summary_counts(spark):
    df = scored(spark, [result(0), result(1, error="x"), result(2, variant="v", error="")])
    s = rollups.dataset_summary(df).first()
    assert s.completed + s.errors == s.samples == sum(s[f"n_{c}"] for c in rollups.CLASSES) == s.known_cost_rows + s.unknown_cost_rows
    fields = {(r.field, r.value) for r in rollups.by_condition(df).collect()}
    assert ("light", "dark") in fields and not any(f == "background" for f, _ in fields)


def test_empty_tables(spark):
    df = scored(spark, [], [])
    assert df.count() == 0 and rollups.leaderboard(df).count() == 0 and rollups.dataset_summary(df).first().top1_accuracy is None


def cases(spark, results, truths=None):
    return rubric.cases(spark.createDataFrame(results, RESULT), spark.createDataFrame(truths if truths is not None else [truth()], TRUTH))


def test_rubric_goldens(spark):
    full = cases(spark, [result()])
    c = full.first()
    assert (c.accuracy, c.evidence, c.hallucination, c.clarity) == (40, 25, 20, 15)
    assert rubric.batches(full, ["run_id"]).first().total == 100
    partial = cases(spark, [result(0, ("가나정골드", None, *PERFECT[2:]))], [truth(answer=("900", "가나정골드플러스", "AB", "12", "원형", "하양"))]).first()
    assert partial.verdict == "partial" and partial.accuracy == 20
    held = ("", None, None, None, None, None, 0.2, "", "판독 불가")
    assert cases(spark, [result(0, held)]).first().verdict == "wrong"
    assert cases(spark, [result(0, held)]).first().hallucination == 20
    assert cases(spark, [result(0, held)], [truth(readable=False)]).first().verdict == "correct"
    lie = ("다른약", "999", "QQ", "WW", "각형", "검정", 0.99, "식약처 확정", "없음")
    assert cases(spark, [result(0, lie)]).first().hallucination == 0
    missing = cases(spark, [result()], [truth(answer=("", "", "", "", "", ""))])
    assert missing.first().ready is False and rubric.batches(missing, ["run_id"]).first().total is None


def test_winner_tolerance(spark):
    rows = [("a", "A", 91.0), ("a", "B", 90.2), ("b", "A", 91.0), ("b", "B", 89.0), ("c", "A", 91.0), ("d", "A", None)]
    got = {r.run: r.vote for r in rubric.winners(spark.createDataFrame(rows, "run string, label string, total double"), "run", "label").collect()}
    assert got == {"a": "tie", "b": "A", "c": "", "d": ""}


@pytest.mark.parametrize(
    "name, expected",
    [("자이로릭정100mg", "자이로릭정"), ("Ａbc(x) 5 MG정", "abc정"), ("가나 12.5밀리그램 [주]", "가나"), (None, ""), ("㎎5", "mg5")],
)
def test_drug_name(spark, name, expected):
    assert spark.createDataFrame([(name,)], "n string").select(T.drug_name("n")).first()[0] == expected


def test_text_functions(spark):
    df = spark.createDataFrame([("=1+1", '<p>a<br/>b</p>&lt;<![CDATA[<i>c]]>', "흰/노란 blue 흰", "O1O-1234-S678", '```json\n{"a":1} x```', "D:\\x\\Ａ.JPG")], "f string, m string, c string, p string, j string, i string")
    r = df.select(T.csv_cell("f"), T.markup_free("m"), T.colors("c"), T.phone_repaired("p"), T.json_part("j"), T.image_key("i")).first()
    assert tuple(r) == ("\"'=1+1\"", "a\nb\n<c", "하양|노랑|blue", "010-1234-5678", '{"a":1}', "a.jpg")


def test_confidence_and_overlap(spark):
    df = spark.createDataFrame([(None,), (0.5,), (50.0,), (150.0,), (-3.0,), (float("nan"),)], "c double")
    assert [r[0] for r in df.select(V.unit_confidence("c")).collect()] == [None, 0.5, 0.5, 1.0, 0.0, None]
    assert [r[0] for r in df.select(V.contract_confidence("c")).collect()] == [None, 0.5, 50.0, None, None, None]
    assert [r[0] for r in df.select(V.clamped_confidence("c")).collect()] == [None, 0.5, 50.0, 100.0, 0.0, None]
    assert spark.range(1).select(V.percent(F.lit(1), F.lit(0))).first()[0] is None


def test_large_batches_are_exact_and_small_ones_in_order(spark):
    import random

    rng = random.Random(3)
    rows = [(i, "big" if i % 3 else None, i % 20 != 0 or i % 3 > 0, 40.0, rng.randrange(250) / 10, 20.0, rng.randrange(150) / 10) for i in range(600)]
    rows += [(1000 + i, "small", True, 40.0, x, 20.0, 13.0) for i, x in enumerate((9.0, 14.1, 2.4, 8.7, 14.4))] + [(2000, "one", False, None, None, None, None)]
    df = spark.createDataFrame(rows, "result_id bigint, run string, ready boolean, accuracy double, evidence double, hallucination double, clarity double")
    got = {r.run: r for r in rubric.batches(df, ["run"]).collect()}
    tenths = sum(round(r[4] * 10) for r in rows if r[1] == "big")
    assert len(got) == 4 and got["big"].n_cases == 400 and got["big"].evidence == (2 * tenths + 400) // 800 / 10
    total = 0.0
    for x in (9.0, 14.1, 2.4, 8.7, 14.4):
        total += x
    assert got["small"].evidence == int((total / 5 + 2.220446049250313e-16) * 10 + 0.5) / 10 and got["small"].total == 40 + got["small"].evidence + 33
    assert got["one"].total is None and got[None].ready is False and got[None].evidence is None and rubric.batches(df.limit(0), ["run"]).count() == 0
