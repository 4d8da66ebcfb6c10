import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import quality, tokens
from sievework.llm.examples import EXAMPLES


def test_statistics_of_known_texts():
    s = dict(zip(quality.STATISTICS, quality.measure("The cat sat on the mat. It was warm.")))
    assert s["n_words"] == 9 and s["stop_line_share"] == 1 and s["prose_share"] == 1 and s["sentence_rate"] == pytest.approx(2 / 9)
    assert dict(zip(quality.STATISTICS, quality.measure("a\tb\tc\n1\t2\t3")))["column_share"] == 1
    assert dict(zip(quality.STATISTICS, quality.measure("- 앞면 확인\n- 초록 원형")))["list_share"] == 1
    assert dict(zip(quality.STATISTICS, quality.measure("또 왔다. " * 5)))["repeat_share"] == pytest.approx(0.8)
    assert quality.measure(None) == quality.measure("  \n ") == (0, *[0.0] * 12)


def test_mean_word_length_counts_words_alone():
    assert quality.measure("a b c")[1] == 1 and quality.measure("가나  다\n\n라마바 ")[1] == 2


def test_a_wrapped_sentence_is_prose_from_its_first_line():
    share = lambda t: dict(zip(quality.STATISTICS, quality.measure(t)))["prose_share"]
    assert share("Patients on dialysis showed levels about 19.4\npercent and it was kept for the trial.") == 1
    assert share("one two\nthree four\nThis is the end of it.") < 1


def test_the_fit_ends_when_it_converges(spark):
    x, groups, kinds = quality.example_features(spark)
    rows = [(row.tolist(),) for row in x for _ in range(5)]
    featured = spark.createDataFrame(rows, "x array<double>")
    short, long = quality.fit_mixture(featured, x, groups, kinds, rounds=60), quality.fit_mixture(featured, x, groups, kinds, rounds=120)
    assert (short.means == long.means).all() and set(short.kinds) == set(quality.KINDS)


DECIMAL = "The average latency of the model dropped to 9.11 seconds"
IN_TURN = "The bag was left near the door. The front of it had been opened again.\n"


def test_repeats_with_decimals_and_in_turn():
    share = lambda t: dict(zip(quality.STATISTICS, quality.measure(t)))["repeat_share"]
    assert share(f"{DECIMAL}. " * 13) == pytest.approx(12 / 13) and share(f"{DECIMAL}.\n" * 13) == pytest.approx(12 / 13)
    assert share(IN_TURN * 8) == pytest.approx(14 / 16) and share("Gone.Gone.Gone.Gone.") == pytest.approx(0.75)
    assert share("It rose by 9.11 seconds. It fell by 8.11 seconds.") == 0


def test_repeated_prose_is_junk(spark):
    rows = [(i, text) for i, (_, _, text) in enumerate(EXAMPLES * 3)]
    rows += [(1000, f"{DECIMAL}. " * 13), (1001, f"{DECIMAL}.\n" * 13), (1002, IN_TURN * 8)]
    got = {r.id: r.kind for r in quality.kinds_of_texts(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert [got[i] for i in (1000, 1001, 1002)] == ["junk"] * 3


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_statistics_are_finite(text):
    assert all(0 <= x < 10_000 for x in quality.measure(text))


def test_held_out_kinds(spark):
    # each example with other words, so the fit has not seen the text
    swap = str.maketrans("가나다AB12", "라마바CD34")
    rows = [(i, text.translate(swap) + (" 그리고 다시 확인하였다." if kind == "prose" else "")) for i, (kind, _, text) in enumerate(EXAMPLES * 3)]
    df = spark.createDataFrame(rows + [(10_000, None), (10_001, "")], "id bigint, text string")
    got = {r.id: r.kind for r in quality.kinds_of_texts(df, "id", "text").collect()}
    kinds = [k for k, _, _ in EXAMPLES] * 3
    hits = sum((got[i] == "prose") == (k == "prose") for i, k in enumerate(kinds))
    assert hits / len(kinds) >= 0.97 and got[10_000] == got[10_001] == "junk" and len(got) == len(rows) + 2


def test_null_and_repeated_keys_keep_their_rows(spark):
    rows = [(i, text) for i, (_, _, text) in enumerate(EXAMPLES)] + [(None, EXAMPLES[0][2]), (None, "a\tb\tc\n1\t2\t3"), (0, EXAMPLES[0][2]), (0, None)]
    got = quality.kinds_of_texts(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()
    assert len(got) == len(rows) and sum(r.id is None for r in got) == 2
    assert sorted(r.kind for r in got if r.id == 0) == ["junk", "prose", "prose"]


def test_empty_table(spark):
    assert quality.kinds_of_texts(spark.createDataFrame([], "id bigint, text string, kind string"), "id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files")
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 9.\n\r\t'가나　\x1c\xa0sé", max_size=60))
def test_run_sizes_equal_whole_encoding(text):
    sizes = tokens.run_sizes(tokens.TOKENIZER)
    assert sizes.of(text) == len(sizes.encode(text))


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files")
def test_token_count_column(spark):
    df = spark.createDataFrame([("안녕하세요 world",), ("",), (None,)], "t string")
    sizes = tokens.run_sizes(tokens.TOKENIZER)
    assert [r[0] for r in df.select(tokens.token_count("t")).collect()] == [len(sizes.encode("안녕하세요 world")), 0, 0]
