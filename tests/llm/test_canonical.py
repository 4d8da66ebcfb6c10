import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import canonical

LIST = [
    (1, "shape", "원형", "round", ["동그라미", "circle"]), (2, "shape", "타원형", "oval", ["ellipse"]), (3, "shape", "장방형", "oblong", ["capsule-shaped"]), (4, "shape", "반원형", "semicircle", ["half moon"]),
    (5, "color", "하양", "white", ["흰색"]), (6, "color", "빨강", "red", None), (7, "kind", "음각", "debossed", ["engraved"]), (8, "kind", "양각", "embossed", []), (9, "kind", "인쇄", "printed", ["ink print"]),
]
CASES = [
    ("shape", "ｃｉｒｃｌｅ", 1), ("shape", "Ruond tablet", 1), ("shape", "원형정제", 1), ("shape", "o v a l", 2), ("shape", "타 원-형", 2), ("shape", "oblong/장방형", 3), ("shape", "Capsule-sgaped", 3), ("shape", "half moob", 4),
    ("shape", "반 원형", 4), ("shape", "별", 0), ("shape", "하양", 0), ("shape", "???", 0), ("color", "whte", 5), ("color", "(하양?", 5), ("color", "흰섹", 5), ("color", "완두콩", 0), ("kind", "쟝각", 8), ("kind", "으각", 7), ("kind", "pink", 0),
    ("kind", "음각 표시", 7), ("kind", "1.인쇄", 9),
]


@pytest.fixture
def reference(spark):
    return spark.createDataFrame(LIST, "value_id int, field string, label string, label_en string, aliases array<string>")


def test_mapping(spark, reference):
    rows = [(f, v) for f, v, _ in CASES] + [("kind", "음각")] * 9 + [("kind", "debossed")] * 3 + [("shape", None), ("shape", " 　"), ("shape", "원형")]
    got = {(r.field, r.value): r.value_id for r in canonical.map_values(spark.createDataFrame(rows, "field string, value string"), reference).collect()}
    assert got == {(f, v): i for f, v, i in CASES} | {("kind", "debossed"): 7}


def test_cells_and_report(spark, reference):
    cells = spark.createDataFrame([(1, "shape", "circel"), (2, "shape", "circel"), (3, "shape", "???"), (4, "shape", None)], "row_id bigint, field string, value string")
    assert sorted((r.row_id, r.value_id) for r in canonical.map_cells(cells, reference).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert [tuple(r) for r in canonical.unmatched_report(cells, reference).collect()] == [("shape", "???", 1)]
    assert canonical.map_cells(cells.limit(0), reference).count() == 0


def test_deletion_neighbours_reach_every_single_edit():
    import itertools

    letters = "abc"
    words = ["".join(w) for n in range(1, 5) for w in itertools.product(letters, repeat=n)]
    for a in words[::7]:
        for b in words[::5]:
            if canonical.likeness(a, b) > 0:
                assert set(canonical.neighbours(a)) & set(canonical.neighbours(b))


def test_very_long_value(spark, reference):
    long = spark.createDataFrame([("shape", "x " * 5000 + "round")], "field string, value string")
    assert canonical.map_values(long, reference).first().value_id in (0, 1)


def test_long_ending_does_not_count():
    assert canonical.candidates(["transparentcoloured"], 16) == {("transparent", 0, 0)}
    assert canonical.candidates(["x" * 17 + "coloured"], 16) == set()


def test_likeness_of_known_pairs():
    like = canonical.likeness
    assert like("circle", "circle") == 1 and like("cirlce", "circle") == pytest.approx(1 - 0.9 / 6) and like("circcle", "circle") == pytest.approx(1 - 0.8 / 7)
    assert like("", "abc") == 0 == like("abc", "") and like("crcel", "circle") == 0  # two edits in a short name
    assert like("transprent", "transparent") > like("trensprent", "transparent") > 0 == like("trenspront", "transparent")
    assert like("흰섹", "흰색") == pytest.approx(1 - 0.4 / 2) and like("힌섹", "흰색") == 0 and like("흰별", "흰색") == 0
    assert like("a", "b") == 0 and not set(canonical.neighbours("a")) & set(canonical.neighbours("b"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", min_size=1, max_size=11), st.text(alphabet="abcd", min_size=1, max_size=11))
def test_deletion_neighbours_reach_every_pair_within_the_edits(typed, name):
    if canonical.likeness(typed, name) > 0:
        assert set(canonical.neighbours(typed, canonical.LONG_NAME - 2)) & set(canonical.neighbours(name))


def test_planted_edits_are_found(spark):
    """Recall on planted typing errors: every one with one edit, and with two in long names, comes back to its entry."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(rng.choices(letters, k=k)) for k in (5, 6, 7, 8, 9, 10, 12, 14) for _ in range(6)]
    reference = spark.createDataFrame([(i + 1, "f", name, None, None) for i, name in enumerate(names)], "value_id int, field string, label string, label_en string, aliases array<string>")

    def edit(word):
        i, kind = rng.randrange(len(word) - 1), rng.randrange(4)
        new = rng.choice(letters)
        return (word[:i] + new + word[i:], word[:i] + word[i + 1 :], word[:i] + new + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :])[kind]

    planted = {}
    for i, name in enumerate(names):
        for _ in range(6):
            typed = edit(name) if len(name) < canonical.LONG_NAME else edit(edit(name))
            if canonical.likeness(typed, name) > 0 and typed != name:  # two swaps of one place may be more than two edits
                planted[typed] = i + 1
    assert len(planted) > 200
    got = {r.value: r.value_id for r in canonical.map_values(spark.createDataFrame([("f", v) for v in planted], "field string, value string"), reference).collect()}
    best = {v: max(range(len(names)), key=lambda i: canonical.likeness(v, names[i])) + 1 for v in planted}  # brute force over all names
    assert got == best and sum(got[v] == i for v, i in planted.items()) / len(planted) >= 0.99


def test_one_hot_word(spark, reference):
    rows = [("shape", f"tablet round no{'x' * (i % 7)}{i}") for i in range(300)]
    got = canonical.map_values(spark.createDataFrame(rows, "field string, value string"), reference).collect()
    assert len(got) == 300 and {r.value_id for r in got} == {1}
