import pytest
from pyspark.sql import functions as F

from sievework.operators import labels, tables

WORD = "doc_id bigint, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, line_key string, confidence double"


def page(spark, *rows, pages=((1, 0),)):
    """Words as (text, x, row[, width[, confidence]]); each row is 30 pixels high."""
    out = []
    for doc, no in pages:
        for i, r in enumerate(rows):
            text, x, row = r[:3]
            width = r[3] if len(r) > 3 else 12 * len(text)
            out.append((doc, no, i, text, float(x), row * 40.0, float(x + width), row * 40.0 + 24, f"l{row}", r[4] if len(r) > 4 else 90.0))
    return spark.createDataFrame(out, WORD)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, 0, 1000, 1000)], "doc_id bigint, page int, width int, height int")


def test_label_end_and_value_words():
    assert labels.label_end(["담당", "의사", "김"], "담당의사") == (1, False) and labels.label_end(["성명:김가나"], "성명") == (0, True) and labels.label_end(["나이"], "성명") is None
    words = [{"text": t, "x0": x, "x1": x + 10} for t, x in (("김", 0), (":", 12), ("가나", 30), ("성별", 50), ("남", 70))]
    rule = labels.Value(40, 3, 5, frozenset({"성별"}))
    assert [w["text"] for w in labels.value_words(words, 0, rule)] == ["김", "가나"]
    assert [w["text"] for w in labels.value_words(words, 0, labels.Value(5, 3, 5, frozenset()))] == ["김"] and labels.value_words([], 0, rule) == []


def test_names_and_values_beside_labels(spark, pages):
    words = page(spark, ("성명", 10, 0), ("김", 50, 0), ("가나", 70, 0), ("성별", 110, 0), ("판독의사", 10, 1), ("조은결", 80, 1), ("전화번호", 10, 2), ("02-123", 90, 2), ("4567", 170, 2), ("멀리", 700, 2), ("명칭", 10, 20), ("아래병원", 60, 20), ("명칭", 10, 3), ("가나병원", 60, 3), ("성명:", 10, 5))
    got = sorted((r.kind, r.x0, r.y0, r.x1) for r in labels.by_label(words, pages).collect())
    assert got == sorted([("성명", 50, 0, 94), ("성명", 80, 40, 116), ("전화번호", 90, 80, 218), ("기관명", 60, 120, 108), ("성명", 10, 200, 46)])


def test_persons_records_phones_and_rules(spark, pages):
    words = page(spark, ("김", 10, 0), ("가나", 40, 0), ("성", 10, 1), ("명", 40, 1), ("김", 10, 20), ("다라", 40, 20), ("환자번호:", 10, 3), ("A-12", 150, 3), ("b", 220, 3), ("c", 240, 3), ("d", 260, 3), ("02-12O4-567B", 10, 5), ("a@b.co", 300, 6), ("900101-1234567", 10, 7, 170))
    assert [(r.kind, r.x0, r.x1) for r in labels.persons(words, pages).collect()] == [("성명", 10, 64)]
    assert [(r.x0, r.x1) for r in labels.record_ids(words, pages).collect()] == [(10, 252)]
    assert [(r.kind, r.x0) for r in labels.phones(words, pages).collect()] == [("전화번호", 5)]
    assert {r.kind for r in labels.by_rule(words).collect()} >= {"주민등록번호", "이메일"} and [r.x0 for r in labels.emails(words).collect()] == [300]
    tall = spark.createDataFrame([(1, 0, 0, "02-123-4567", 0.0, 0.0, 400.0, 50.0, "l", 9.0)], WORD)
    assert sorted((r.y0, r.y1) for r in labels.phones(tall, pages).collect()) == [(0, 27), (27, 54)]
    every = labels.boxes_from_words(words, pages).collect()
    assert {r.kind for r in every} >= {"주민등록번호", "이메일", "성명", "개인식별번호", "전화번호"} and all(0 <= r.x0 < r.x1 <= 1000 for r in every)
    assert labels.boxes_from_words(words.limit(0), pages).count() == 0


def test_offline_recognizers(spark):
    got = spark.createDataFrame([("900101-1234567 a@B.co 010 1234 5678",), (None,)], "t string").select(labels.recognized("t").alias("h")).collect()
    assert {h.kind for h in got[0].h} == {"KR_RRN", "EMAIL_ADDRESS", "KR_PHONE_NUMBER"} and got[1].h == []


HEADERS = tables.Headers({"case id": "case_id", "front image": "front_image", "back image": "back_image", "drug name": "drug_name", "shape": "shape"})


def test_headers_of_a_cell():
    words = [{"text": t, "x0": float(x), "x1": float(x + 10)} for t, x in (("case", 0), ("id", 12), ("zz", 30), ("Shape", 50), ("front", 70), ("image", 90))]
    assert [(p["key"], p["text"]) for p in HEADERS.parts(words)] == [("case_id", "case id"), ("", "zz"), ("shape", "Shape"), ("front_image", "front image")]
    assert HEADERS.get("cas") == "case_id" and HEADERS.get("ca") == "" and HEADERS.get("") == "" and HEADERS.get("ＳＨＡＰＥ") == "shape" and HEADERS.parts([]) == []


def test_records_of_pages_carry_the_header(spark):
    first = page(spark, ("case", 10, 0), ("id", 62, 0), ("shape", 200, 0), ("front", 400, 0), ("image", 464, 0), ("zzz", 700, 0), ("KC-1", 10, 1), ("round", 200, 1, 60, 50.0), ("a.jpg", 400, 1), ("x", 700, 1), ("", 10, 2))
    second = page(spark, ("KC-2", 10, 0), ("oval", 210, 0), pages=((1, 1),))
    other = page(spark, ("KC-3", 10, 0), pages=((2, 0),))
    got = {(r.doc_id, r.page): r for r in tables.record_warnings(tables.records_of_pages(first.unionByName(second).unionByName(other), HEADERS)).collect()}
    assert set(got) == {(1, 0), (1, 1)}
    a, b = got[1, 0], got[1, 1]
    assert a["values"] == {"case_id": "KC-1", "shape": "round", "front_image": "a.jpg"} and a.unmapped == 1 and a.min_confidence == 50 and not a.carried
    assert [(w.code, w.column) for w in a.warnings] == [("missing_required", "back_image"), ("missing_answer", None), ("unmapped_cell", None), ("low_confidence", "shape")]
    assert b["values"] == {"case_id": "KC-2", "shape": "oval"} and b.carried and b.unmapped == 0
    assert tables.page_confidence(second).first().mean_confidence == 90


def test_printed_lines_and_their_records(spark):
    rows = [(1, 0, 0, "junk", 0, 900), (1, 0, 1, "case id", 10, 800), (1, 0, 2, "shape", 200, 801), (1, 0, 3, "front image", 400, 799), (1, 0, 4, "KC-1", 12, 700), (1, 0, 5, "round", 190, 702), (1, 0, 6, "red", 230, 701), (1, 1, 0, "case id", 10, 800), (1, 1, 1, "shape", 200, 800), (1, 1, 2, "front image", 400, 800), (1, 1, 3, "drug name", 600, 800), (1, 1, 4, "KC-2", 10, 600), (1, 1, 5, "p", 610, 600), (1, 1, 6, " ", 10, 500)]
    items = spark.createDataFrame([(*r[:4], float(r[4]), float(r[5])) for r in rows], "doc_id bigint, page int, item_no int, text string, x double, y double")
    lines = tables.printed_lines(items)
    assert lines.filter("page = 0").agg(F.max("line_no")).first()[0] == 3
    got = {r.page: r["values"] for r in tables.records_of_lines(lines, HEADERS).collect()}
    assert got == {0: {"case_id": "KC-1", "shape": "round red"}, 1: {"case_id": "KC-2", "drug_name": "p"}}


def test_normalized_table(spark):
    rows = [("f", 0, ["a title"]), ("f", 1, ["Case ID", "shape", "front_image", "zz", "Shape"]), ("f", 2, [" KC-1 ", "round", "a", "q", "oval"]), ("f", 3, ["", None]), ("f", 4, ["KC-2"]), ("g", 0, ["case id", "shape"])]
    df = spark.createDataFrame(rows, "file string, row_no int, cells array<string>")
    head = {r.file: r for r in tables.table_headers(df, HEADERS).collect()}
    assert head["f"].header_row == 1 and head["f"].unknown == ["zz"] and head["f"].repeated == ["shape"] and not head["g"].usable
    got = [(r.file, r.source_row, r.case_id, r["shape"], r.front_image, r.notes) for r in tables.normalized_table(df, HEADERS).orderBy("source_row").collect()]
    assert got == [("f", 3, "KC-1", "round", "a", ""), ("f", 5, "KC-2", "", "", "")]
