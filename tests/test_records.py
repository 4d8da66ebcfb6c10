import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.operators import records as R


def walk(text, sep):
    """Character by character: fields, first error and its offset."""
    state, fields, start = "start", [], 0
    for i, ch in enumerate(text):
        if state == "quoted":
            state = "closed" if ch == '"' else "quoted"
        elif ch == sep:
            fields.append(R.field_value(text[start:i]))
            start, state = i + 1, "start"
        elif ch == '"':
            if state == "plain":
                return None, "quote_in_plain_field", i
            state = "quoted"
        elif state == "closed":
            return None, "text_after_quote", i
        else:
            state = "plain"
    if state == "quoted":
        return None, "quote_not_closed", len(text)
    return [*fields, R.field_value(text[start:])], None, -1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='a,;"\n가 ', max_size=40), st.sampled_from(",;\t")), min_size=1, max_size=8))
def test_tokenizer_equals_walk(items):
    texts, seps = [t for t, _ in items], [s for _, s in items]
    tokens = R.tokenize(texts, seps)
    for k, (text, sep) in enumerate(items):
        fields, error, offset = walk(text, sep)
        assert (tokens.error[k], int(tokens.offset[k])) == (error, offset)
        if error is None:
            assert R.record_fields(text, tokens, k) == fields


def test_records_longer_than_chunks():
    rng = random.Random(5)
    texts = ["".join(rng.choice('ab,"\n') for _ in range(n)) for n in (3000, 0, 700, 5000)] + ['"' + "x" * 9000 + '",b']
    tokens = R.tokenize(texts, [","] * len(texts))
    for k, text in enumerate(texts):
        assert (tokens.error[k], int(tokens.offset[k])) == walk(text, ",")[1:]


HEADER = ",".join(R.SHEET_COLUMNS)


def row(case="KC-01", front="a/x_f.jpg", back="x_b.PNG", rest="1"):
    return ",".join([case, "p", front, back, *[rest] * 15])


@pytest.fixture
def loaded(spark):
    raws = [
        ("s", 1, "﻿" + HEADER + "\r"), ("s", 2, row() + "\r"), ("s", 3, row(case=" kc_7 ")), ("s", 4, row(case="K7")), ("s", 5, row(front=".jpg")),
        ("s", 6, row(back="D:\\X_F.JPG")), ("s", 7, row() + ",x"), ("s", 8, row(rest='a"b')), ("s", 9, ""), ("s", 10, None), ("s", 11, row(case='"KC-2')),
        ("t", 2, row()), (None, 2, row()), ("u", 1, HEADER.upper().replace("_", " ").replace(",", ";")), ("u", 2, row().replace(",", ";")), ("u", 3, row(rest='"a;""b"').replace(",", ";")),
    ]
    df = spark.createDataFrame([(i, *r, "extra") for i, r in enumerate(raws)], "rec_id bigint, sheet_id string, rec_no int, raw string, reason string")
    return {r.rec_id: r for r in R.load_records(df).collect()}


def test_reasons(loaded):
    reasons = {k: r.reason for k, r in loaded.items()}
    assert reasons == {
        1: None, 2: None, 3: "bad_case_id", 4: "bad_front_image", 5: "same_image", 6: "field_count", 7: "quote_in_plain_field", 8: "field_count", 9: "null_record",
        10: "quote_not_closed", 11: "no_header", 12: "no_header", 14: None, 15: None,
    }


def test_values(loaded):
    assert loaded[1].notes == "1" and loaded[1].readable is True and loaded[2].case_id == " kc_7 "
    assert loaded[15].notes == 'a;"b' and loaded[3].case_id is None and loaded[3].raw.startswith("K7")


def test_empty_and_report(spark):
    empty = spark.createDataFrame([], "rec_id bigint, sheet_id string, rec_no int, raw string")
    assert R.load_records(empty).count() == 0
    assert R.reject_report(R.load_records(empty)).count() == 0


def test_very_long_record(spark):
    long = row(rest="x" * 300_000)
    df = spark.createDataFrame([(1, "s", 1, HEADER), (2, "s", 2, long), (3, "s", 2, long)], "rec_id bigint, sheet_id string, rec_no int, raw string")
    assert [len(r.notes) for r in R.load_records(df).collect()] == [300_000, 300_000]


def test_broken_headers_are_rejected_too(spark):
    head = ",".join(R.SHEET_COLUMNS)
    row = "KC-1,p,a.jpg,b.jpg" + "," * 15
    rows = [(1, "s", 1, head), (2, "s", 2, row), (3, "t", 1, head.replace("case_id", 'case"id')), (4, "t", 2, row), (5, "u", 1, None), (6, "u", 2, row), (7, "s", 1, '"' + head), (8, "s", None, row)]
    df = spark.createDataFrame(rows, "rec_id bigint, sheet_id string, rec_no int, raw string")
    got = {r.rec_id: (r.reason, r.error_offset) for r in R.load_records(df).collect()}
    assert got == {
        2: (None, -1), 3: ("quote_in_plain_field", 4), 4: ("no_header", -1), 5: ("null_record", -1), 6: ("no_header", -1), 7: ("quote_not_closed", len(head) + 1), 8: (None, -1),
    }


def test_headers_together_equal_one_by_one():
    raws = ["a,b,c", "a;b;c\r", "a\tb", '"a,b";c', None, "", "\ufeffcase_id;Front Image", 'a"b,c', "x" * 300 + ",case-id"]
    for raw, got in zip(raws, R.read_headers(raws)):
        alone = R.read_headers([raw])[0]
        assert got == alone
    assert R.read_header("\ufeffcase_id;Front Image")[:2] == (";", 2) and R.read_header('a"b,c') is None
