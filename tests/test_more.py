import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators import arena, batch, providers, synthetic
from sievework.sources import readers, reports, sinks


@pytest.mark.parametrize("limit", [0, 7, 25, 26, 60, 10_000])
def test_eviction_equals_brute_force(spark, limit):
    rows = [(i, datetime(2026, 1, 1) + timedelta(minutes=13 * i) if i % 9 else None, i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, at timestamp, size int")
    left, want = limit, set()
    for i, at, size in sorted(rows, key=lambda r: (r[1] or datetime(1, 1, 1), r[0]), reverse=True):
        left -= size
        if left < 0:
            break
        want.add(i)
    assert {r.id for r in arena.evicted_to_fit(df, "at", "id", "size", limit).collect()} == want


def test_rating_source(spark):
    rows = [(["correct", "wrong"], [None, None], ["correct", "wrong"], 20.0, True), (["partial", "wrong"], [None, 12.0], ["correct", "wrong"], 20.2, True), (["correct"], None, None, 1.0, False)]
    df = spark.createDataFrame(rows, "v array<string>, s array<double>, a array<string>, e double, auto boolean")
    got = [r[0] for r in df.select(arena.rating_source(F.col("auto"), F.col("v"), F.col("s"), F.col("a"), {"evidence": (F.col("e"), F.lit(20.0))})).collect()]
    assert [(g.source, g.changed) for g in got] == [("automatic", []), ("manual_override", ["case_1", "case_2", "evidence"]), ("manual", [])]


def test_document_text_and_sized_boxes(spark):
    doc = '{"sections":[{"p":"second","title":"First"},{"p":["third",null,true]}]}'
    got = spark.createDataFrame([(doc,), ('<ARTICLE title="A">b</ARTICLE>',), ("{bad",), (None,)], "t string").select(T.document_text("t")).collect()
    assert [r[0] for r in got] == ["First\nsecond\nthird", "A\nb", "{bad", ""]
    assert tuple(spark.range(1).select(V.sized_box(F.lit(10), F.lit(5), F.lit(-4), F.lit(None))).first()[0]) == (6, 5, 10, 5)


def test_answers_by_case_number(spark):
    answers = spark.createDataFrame([("r", '[{"case_id":"CASE-02","n":1},{"case_id":"x","n":2},{"n":3}]')], "run_id string, answer string")
    cases = spark.createDataFrame([("r", "a", 0), ("r", "x", 1), ("r", "c", 2), ("r", "d", 9)], "run_id string, case_id string, place int")
    got = {r.place: r.part for r in providers.batch_predictions(answers, cases).collect()}
    assert '"n":2' in got[1] and '"n":3' in got[2] and '"n":1' in got[0] and got[9] is None
    other = spark.createDataFrame([("r", "a", 0), ("r", "b", 1)], "run_id string, case_id string, place int")
    assert '"n":1' in {r.place: r.part for r in providers.batch_predictions(answers, other).collect()}[1]


def test_backups(spark):
    stores = spark.createDataFrame([('[{"id":"a","results":"r"},{"id":"b"},null]',), ('{"kind":"runs","runs":[{"id":"c","results":"r"}]}',), ('{"kind":"other","runs":[{"id":"d","results":"r"}]}',), ("{bad",), (None,)], "j string")
    entries = readers.backup_runs(stores, "j", "struct<id:string,results:string>", "runs")
    assert sorted(r.run.id for r in entries.filter("kept").collect()) == ["a", "c"] and tuple(readers.backup_report(entries).first()) == (2, 2, 3)


def test_words_of_blocks(spark):
    nested = '[{"paragraphs":[{"lines":[{"words":[{"text":"a","confidence":9,"bbox":{"x0":1,"y0":2,"x1":3,"y1":4}},{"text":" "}]},{"words":[{"text":"b"}]}]}]}]'
    pages = spark.createDataFrame([(1, 0, nested), (2, 0, '[{"text":"c","confidence":5}]'), (3, 0, None), (4, 0, "bad")], "doc_id int, page int, j string")
    got = sorted((r.doc_id, r.line_key, r.text, r.x0) for r in readers.words_of_blocks(pages, "j").collect())
    assert got == [(1, "0-0-0", "a", 1.0), (1, "0-0-1", "b", None), (2, "flat", "c", None)]


def test_packs_and_templates(spark, tmp_path):
    (tmp_path / "p.zip").write_bytes(sinks.archive({"set/key.csv": "case_id,front\nC-1,A_front.JPG\nC-2,none.jpg".encode(), "set/images/a_front.jpg": b"x"}))
    (tmp_path / "q.zip").write_bytes(sinks.archive({"key.csv": b"a,b"}))
    got = {(r.archive[-5:], r.row_no): (r.cells, r.images) for r in readers.pack_rows(readers.archive_members(spark, f"{tmp_path}/*.zip")).collect()}
    assert got["p.zip", 1] == (["C-1", "A_front.JPG"], ["A_front.JPG"]) and got["p.zip", 2][1] == [] and got["q.zip", 0] == (["a", "b"], [])
    book = reports.template_workbook(spark)
    assert readers.rows_of_workbook(book)[0][:3] == ["case_id", "pill_id", "front_image"] and len(zipfile.ZipFile(io.BytesIO(book)).namelist()) == 6
    assert reports.template_csv(spark).decode("utf-8-sig").count("\r\n") == 1


def test_synthetic_documents(spark):
    docs = synthetic.documents(spark, 5)
    assert docs.count() == 120 and docs.select("form", "condition").distinct().count() == 24 and docs.groupBy("form", "condition").count().filter("count <> 5").count() == 0
    found = synthetic.items(docs)
    assert found.count() == 720 and found.filter(F.col("value").isNull() | (F.length("value") < 3)).count() == 0
    best = batch.ceiling(batch.detectable_items(found)).first()
    assert best.items == 720 and best.item_ceiling == 100 and best.clean_docs == 120
