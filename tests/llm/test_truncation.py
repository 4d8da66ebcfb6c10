import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import truncation

WHOLE = ["이 약은 물과 함께 삼키십시오. 어린이의 손이 닿지 않는 곳에 보관하십시오.", "- 임부 사용 주의\n- 소아 용량 확인\n- 고령자 신중 투여", "졸음이 올 수 있으므로 운전을 피하십시오.\n의사와 상담해야 합니다."]


@pytest.mark.parametrize(
    "text, verdict",
    [(None, "blank"), ("  ", "blank"), ("가나…", "mark"), ("가나다�", "mark"), ("가나 [더보기]", "mark"), ("다만,", "dangling"), ("가.\n- ", "dangling"), ("가.\n12)", "dangling"), ("두고 사용</PARAG", "dangling"),
     ("합니다.", "closed"), ("(문의: 약국)", "closed"), ("- 끝 -", "closed"), ("약 41.", "number_stop"), ("용량 확인", "open")],
)
def test_ending(text, verdict):
    assert truncation.ending(text)[0] == verdict


def test_count_words_skips_a_bare_last_word():
    assert truncation.count_words(["가 나..."]) == {("", "가"): [1, 0, 0]}
    assert truncation.count_words(["가 나."]) == {("", "가"): [1, 0, 0], ("가", "나"): [1, 1, 1]}
    assert truncation.count_words(["가 나. 다\n라 9마"]) == {("", "가"): [1, 0, 0], ("가", "나"): [1, 1, 1], ("나", "다"): [1, 1, 0], ("", "라"): [1, 0, 0]}
    assert truncation.count_words([None, "", " \n", "(문의: 약국)"]) == {("", "(문의:"): [1, 0, 0]}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab1. \n…)", max_size=40), max_size=5))
def test_count_words_equals_brute_force(texts):
    want = {}
    for text in texts:
        lines = [x.split() for x in text.split("\n") if x.split()]
        for i, line in enumerate(lines):
            for k, word in enumerate(line):
                bare, stop = truncation.core(word)
                last = k == len(line) - 1
                if last and i == len(lines) - 1 and not (stop and truncation.ending(text)[0] == "closed"):
                    continue
                key = (truncation.folded(truncation.core(line[k - 1])[0]) if k else "", truncation.folded(bare))
                n, end, stops = want.get(key, (0, 0, 0))
                want[key] = [n + 1, end + (last or stop), stops + stop]
    assert truncation.count_words(texts) == want


def test_trie_equals_all_prefixes(spark):
    rows = [("", "abc", 2), ("", "abd", 1), ("x", "ab", 4), ("", "a", 1), ("", "b" * 3000, 1)]
    words = spark.createDataFrame(rows, "before string, word string, n bigint")
    asked = spark.createDataFrame([(b, w[:i]) for b, w, _ in rows[:4] for i in range(1, len(w) + 1)] + [("", "b" * 2000), ("y", "ab"), ("", None)], "before string, word string")
    got = {(r.before, r.word): (r.n_below, r.n) for r in truncation.trie(words, asked).collect() if len(r.word) < 2000}
    assert got == {("", "a"): (2, 3), ("", "ab"): (2, 3), ("x", "a"): (1, 4)}
    deep = [r for r in truncation.trie(words, asked).collect() if len(r.word) >= 2000]
    assert [(r.word, r.n) for r in deep] == [("b" * 2000, 1)]


def test_signs_within_words_are_no_broken_markup(spark):
    assert all(truncation.markup_start(w) < 0 for w in ("R&D", "AT&T", "A&B", "Q&a", "p&gx", "5<b>"))
    assert [truncation.markup_start(w) for w in ("환자&l", "sm&nbs", "끝&", "가&#12", "사용</PARA", "문\\u00")] == [2, 2, 1, 1, 2, 1]
    rows = [(i, "f", t) for i, t in enumerate(WHOLE * 8)] + [(100, "f", "이 약은 R&D"), (101, "f", "문의는 AT&T")]
    got = {r.id: r.reason for r in truncation.judge(spark.createDataFrame(rows, "id bigint, feed string, at string"), "id", "feed", "at").collect()}
    assert got[100] not in ("dangling", "cut_word") and got[101] not in ("dangling", "cut_word")


def test_a_word_of_no_branch_is_no_cut_word(spark):
    rows = [(i, "f", t) for i, t in enumerate(WHOLE * 8)] + [(100, "f", "이 약은 쿠쿠쿠쿠쿠")]
    got = {r.id: r.reason for r in truncation.judge(spark.createDataFrame(rows, "id bigint, feed string, at string"), "id", "feed", "at").collect()}
    assert got[100] is None


def test_judge(spark):
    rows = [(i, "f", t) for i, t in enumerate(WHOLE * 12)]
    cut = ["이 약은 물과 함께 삼키십", "졸음이 올 수", "이 약은 물과 함께 삼키십시오. 어린이의 손이", "- 임부 사용 주의\n- 소아 용"]
    fine = ["의사와 상담해야 합니다", "- 고령자 신중 투여\n- 소아 용량 확인", None, "", "끝."]
    rows += [(100 + i, "f", t) for i, t in enumerate(cut)] + [(200 + i, None, t) for i, t in enumerate(fine)]
    df = spark.createDataFrame(rows, "id bigint, feed string, at string")
    judged = truncation.judge(df, "id", "feed", "at")
    got = {r.id: r.truncated for r in judged.collect()}
    assert len(got) == len(rows) and {k for k, v in got.items() if v} == set(range(100, 104))
    report = {r.feed: (r.n_texts, r.n_truncated) for r in truncation.truncation_report(judged, "feed").collect()}
    assert report == {"f": (40, 4), None: (3, 0)}


def test_limit_where_a_full_stop_belongs(spark):
    body = "의사와 상담해야 합니다. " * 20
    rows = [(i, "f", body[: 60 + i % 2 * 0] + "함께 삼키십") for i in range(8)] + [(20 + i, "g", "물과 함께 삼키십시오. 의사와 상담해야 합니다.\n또한 함께 삼키십시오.") for i in range(5)]
    exact = (body[:100] + "의사와 상담해야 합니다")[-66:]
    df = spark.createDataFrame([*rows, (50, "f", exact), (51, "g", exact)], "id bigint, feed string, at string")
    got = {r.id: r.reason for r in truncation.judge(df, "id", "feed", "at").collect()}
    assert len(exact) == 66 and len(rows[0][2]) == 66
    assert got[50] == "at_limit" and got[51] is None


def test_limit_behind_a_stripped_blank(spark):
    body = "의사와 상담해야 합니다. " * 20
    rows = [(i, "f", body[:60] + "함께 삼키십") for i in range(8)] + [(20 + i, "g", "물과 함께 삼키십시오. 의사와 상담해야 합니다.\n또한 함께 삼키십시오.") for i in range(5)]
    exact = (body[:100] + "의사와 상담해야 합니다")[-66:]
    rows += [(50, "f", exact[1:]), (51, "f", exact[1:] + " "), (52, "f", exact[2:]), (53, "g", exact[1:]), (54, "f", rows[0][2][1:])]
    judged = truncation.judge(spark.createDataFrame(rows, "id bigint, feed string, at string"), "id", "feed", "at")
    got = {r.id: (r.reason, r.at_limit) for r in judged.collect()}
    assert got[50] == got[51] == ("at_limit", True) and got[52] == got[53] == (None, False)
    assert got[0] == ("cut_word", True) and got[54] == ("cut_word", False)  # cut inside a word: no blank was stripped
    assert {r.feed: r.n_at_limit for r in truncation.truncation_report(judged, "feed").collect()} == {"f": 10, "g": 0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, feed string, at string, reason string")
    assert truncation.judge(df, "id", "feed", "at").count() == 0
