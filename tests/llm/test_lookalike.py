import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import lookalike


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("ＯＸ　１５０", "OX 150", True), ("МD​ 109", "MD 109", True), ("É", "É", True), ("10㎎", "10mg", True), ("가가", "가가", True), ("A‑B", "A-B", True), ("A・B", "A·B", True),
        ("µB", "μB", True), ("Ⅴ", "V", True), ("2О", "20", False), ("Ñ", "N", False), ("a", "A", False), ("x²", "x2", False), ("①", "1", False), ("AB", "A B", False),
    ],
)
def test_look(a, b, same):
    assert (lookalike.look(a) == lookalike.look(b)) is same


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_look_is_stable(text):
    once = lookalike.look(text)
    assert lookalike.look(once) == once


def test_classes_and_canonical_member(spark):
    rows = [("f", "Е́1", False), ("f", "É1", False), ("f", "É1", True), ("f", "E1", False), ("f", "e1", False), ("g", "Е́1", False), ("f", None, False), ("f", "", False), ("f", "​", False)]
    df = spark.createDataFrame(rows, "field string, value string, is_reference boolean")
    got = {(r.field, r.value): r.canonical for r in lookalike.lookalike_classes(df).collect()}
    assert got[("f", "Е́1")] == "É1" and got[("f", "E1")] == "E1" and got[("f", "e1")] == "e1" and got[("g", "Е́1")] == "Е́1"
    assert got[("f", "​")] == "" and ("f", None) not in got


def test_found_cells(spark):
    cells = spark.createDataFrame(
        [(1, "q1", "n", "ＡＢ"), (2, "q1", "n", "AB"), (3, "q1", "n", "AВ"), (4, "q1", "n", "A8"), (5, None, "n", "ＡＢ"), (6, "zz", "n", "ＡＢ"), (7, "q1", "n", None), (8, "q2", "n", "Δ­1"), (8, "q2", "n", "Δ­1")],
        "row_id bigint, item string, field string, value string",
    )
    refs = spark.createDataFrame([("q1", "n", "AB"), ("q1", "n", "AB"), ("q2", "n", "Δ1"), ("q3", "n", None), (None, "n", "AB")], "item string, field string, value string")
    assert sorted(tuple(r) for r in lookalike.same_look_cells(cells, refs).collect()) == [(1, "n"), (3, "n"), (8, "n")]
    assert lookalike.same_look_cells(cells.limit(0), refs).count() == 0


def test_letters_of_the_confusables_data(spark):
    seen = lookalike.Seen(lookalike.confusables(spark))
    pairs = {"α": "a", "ρ": "p", "к": "k", "ɡ": "g", "ɑ": "a", "ı": "i", "З": "3", "А": "A", "І": "I", "ꓐ": "B", "ꓳ": "O"}
    assert {x: lookalike.look(x, seen) for x in pairs} == pairs
    apart = "0OolI1|ΔΩλβœÆé²①가힣일二ア"
    assert lookalike.look(apart, seen) == apart
    df = spark.createDataFrame([("ραɡе",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(lookalike.look_of(spark, "t")).collect()] == ["page", None, ""]


def test_one_hot_item_and_long_texts(spark):
    rows = [(i, "hot", "n", "ＡＢ" if i % 2 else "AB") for i in range(300)] + [(1000, "q", "n", "가" * 50_000 + "А"), (1001, "q", "n", "가" * 50_000)]
    cells = spark.createDataFrame(rows, "row_id bigint, item string, field string, value string")
    refs = spark.createDataFrame([("hot", "n", "AB"), ("q", "n", "가" * 50_000 + "A")], "item string, field string, value string")
    assert sorted(r.row_id for r in lookalike.same_look_cells(cells, refs).collect()) == [*range(1, 300, 2), 1000]
