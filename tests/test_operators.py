from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.functions import values as V
from sievework.operators import arena, doclog, draws, layout, pii, redaction, registry, sheets, skew
from sievework.plans import reference
from sievework.sources import readers, sinks
from sievework.streaming import limits


def test_salted_join_keeps_rows(spark):
    big = spark.createDataFrame([(None, 1), ("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    small = spark.createDataFrame([("a", 10)], "k string, w int")
    assert sorted((r.k or "", r.w or 0) for r in skew.salted_left_join(big, small, ["k"]).collect()) == [("", 0), ("a", 10), ("a", 10), ("b", 0)]


def test_only_hot_keys_are_salted(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("1", 2), ("4", 3), ("none", 4), (None, 5)], "k string, w int")
    hot = skew.hot_keys(big, ["k"], salt_rows=100)
    assert sorted(hot.values()) == [10, 10]  # the hot key and the nulls
    joined = skew.salted_left_join(big, small, ["k"], salt_rows=100)
    got = {r.id: r.w for r in joined.collect()}
    assert len(got) == 3000 == joined.count() and all(got[i] == 1 for i in range(0, 3000, 3)) and got[1] == 2 and got[4] == 3 and got[2] is None and got[7] is None
    assert skew.hot_keys(big.limit(0), ["k"]) == {}


def test_small_side_is_measured_in_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1], None)] * 10, "a string, b array<int>, c string")
    hinted = lambda most: "ResolvedHint" in skew.small_side(df, most)._jdf.queryExecution().analyzed().toString()
    assert hinted(20_000) and not hinted(5_000) and skew.small_side(df.limit(0)).count() == 0


def boxes(spark, rows):
    df = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "doc_id bigint, a double, b double, c double, d double")
    return df.select("doc_id", V.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))


def test_redaction_geometry(spark):
    docs = spark.createDataFrame([(1, "clean", 100, 100), (2, "clean", 100, 100), (3, "blur", 100, 100), (4, "blur", None, None)], "doc_id bigint, condition string, width int, height int")
    items = boxes(spark, [(1, 0, 0, 10, 10), (2, 0, 0, 10, 10), (3, 0, 0, 10, 10), (3, 50, 50, 50, 60)]).withColumn("type", F.lit("이메일")).withColumn("item_no", F.lit(0))
    drawn = boxes(spark, [(1, 0, 0, 6, 10), (1, 5, 0, 11, 10), (2, 9, 9, 30, 30), (3, 100, 100, 0, 0), (2, 70, 70, 80, 80)])
    got = {r.doc_id: r for r in redaction.score_documents(docs, items, drawn).collect()}
    assert got[1].complete and got[1].recall == 1  # two boxes together
    assert not got[2].complete and got[2].stray_boxes == 1  # grazing, and one elsewhere
    assert got[3].covered == 1 and got[3].over_redaction == 100  # the whole page; an item without area is not covered
    assert got[4].recall is None and not got[4].complete
    s = redaction.summarize(redaction.score_documents(docs, items, drawn)).first()
    assert s.items == 4 and s.covered_items == 2 and s.item_recall == 50.0


def test_gap_golden(spark):
    r = redaction.explain_gap(spark.createDataFrame([(88.2, 61.2)], "ceiling double, measured double")).first()
    assert (r.rule_gap, r.reading_loss) == (11.8, 27.0)


def test_doclog(spark):
    rows = [("a", False, 2, 0, 0), ("b", False, 2, 1, 0), ("c", True, 2, 0, 0), ("d", False, 0, 0, 0), ("e", None, None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id string, ocr_failed boolean, auto_boxes int, manual_boxes int, erased_boxes int")
    out = df.select("doc_id", doclog.outcome(F.col("ocr_failed"), F.col("auto_boxes"), F.col("manual_boxes"), F.col("erased_boxes")).alias("o"))
    assert {r.doc_id: r.o for r in out.collect()} == {"a": "auto", "b": "manual_assisted", "c": "manual_only", "d": "failed", "e": "manual_only"}


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("주민번호 900101-1234567", {"주민등록번호"}), ("연락처 010-1234-5678", {"전화번호"}), ("메일 a.b@c.co", {"이메일"}), ("담당의사 김철수", {"성명"}), ("담당의사 소견", set()),
        ("환자번호: A-1234", {"개인식별번호"}), ("아스피린 100mg 1일 3회", set()), ("", set()), (None, set()),
    ],
)
def test_pii_kinds(text, kinds):
    assert {k for k, *_ in pii.spans(text)} == kinds


def test_redact_merges_overlaps():
    out = pii.redact("환자번호: AB-12345 끝")
    assert out.count("[비식별:") == 1 and "12345" not in out


def test_pii_udf(spark):
    df = spark.createDataFrame([(1, "010-1234-5678"), (2, None)], "id bigint, t string")
    assert [(r.id, r.start, r.end) for r in pii.find(df, "id", "t").collect()] == [(1, 0, 13)]
    assert {r[0] for r in df.select(pii.redacted("t")).collect()} == {"[비식별:전화번호]", ""}
    assert df.select(pii.detectable(F.lit("010-1234-5678"), F.lit("전화 010-1234-5678"))).first()[0]


def test_draws_repeat_and_traverse():
    queue, seen = draws.Queue(23, "SEED"), []
    for _ in range(4):
        seen += queue.draw(5)
    assert len(set(seen)) == 20 and queue.round == 1
    queue.draw(5)
    assert queue.round == 2
    again = draws.Queue(23, "SEED")
    assert [i for _ in range(4) for i in again.draw(5)] == seen
    assert draws.Queue(3, "x").draw(5) is None and set(draws.blind_order(["a", "b", "c", "d"], "s")) == set("ABCD")


def test_limits_batch_and_stream(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", 1000 * i + (700_000 if i > 20 else 0)) for i in range(30)] + [(99, None, 5)]
    df = spark.createDataFrame(rows, "event_id bigint, limit_key string, now_ms bigint")
    got = {r.event_id: (r["count"], r.allowed) for r in limits.decide(df, 5).collect()}
    state, expected = {}, {}
    for i, k, t in rows[:-1]:
        state[k], allowed, _ = limits.step(state.get(k), t, limits.WINDOW_MS, 5)
        expected[i] = (state[k][1], allowed)
    assert got == expected
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df.filter("limit_key is not null and event_id < 15").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    df.filter("limit_key is not null and event_id >= 15").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    import os
    import shutil
    import time

    os.makedirs(f"{tmp_path}/s")
    for n in ("1", "2"):
        for f in os.listdir(f"{tmp_path}/in/{n}"):
            if f.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/in/{n}/{f}", f"{tmp_path}/s/{n}.parquet")
                time.sleep(0.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    q = limits.decide_stream(stream, 5).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: (r["count"], r.allowed) for r in spark.table("decided").collect()} == expected


def test_stratified_equals_plain_greedy(spark):
    rows = [(f"q{i}", ["원형", "타원형", "기타"][i % 3], ["하양", "노랑"][i % 2], f"c{i % 4}", "x" if i % 5 else "", "f") for i in range(60)]
    df = spark.createDataFrame(rows, "q string, sh string, k1 string, cl string, pb string, pf string")
    got = [r.q for r in registry.stratified(df, 12, {"원형": 0.3, "": 0.2}).orderBy("place").collect()]
    import hashlib

    pool = sorted(rows, key=lambda r: (r[4] == "", hashlib.sha256(f"sample:{r[0]}".encode()).hexdigest()))
    taken, n = [], {}
    for r in pool:
        caps = [(("s", r[1]), round({"원형": 0.3}.get(r[1], 0.2) * 12)), (("k", r[2]), round(0.3 * 12)), (("c", r[3]), 4)]
        if len(taken) < 12 and all(n.get(k, 0) < cap for k, cap in caps):
            taken.append(r[0])
            for k, _ in caps:
                n[k] = n.get(k, 0) + 1
    taken += [r[0] for r in pool if r[0] not in taken][: 12 - len(taken)]
    assert got == taken


def test_registry(spark):
    names = spark.createDataFrame([("모르핀", "morphine", "마약", 0), ("아포모르", "", "기타", 1), ("대", "", "대마", 2)], "kr string, eng string, type string, ord int")
    e = spark.createDataFrame([("1", "염산 모르핀정", None), ("2", "아포모르핀정", None), ("3", None, "Morphine tab"), ("4", "대", None), ("5", "", "")], "q string, n string, en string")
    assert {r.q: r.nc for r in registry.tag_by_longest_name(e, names).collect()} == {"1": "마약", "2": None, "3": "마약", "4": None, "5": None}
    merged = registry.cumulative(e.filter("q < '3'"), e).collect()
    assert {r.q: r.x for r in merged} == {"1": None, "2": None, "3": 1, "4": 1, "5": 1}
    assert registry.shrunk(89, 100) and not registry.shrunk(90, 100) and not registry.shrunk(0, 0)


def test_sheets(spark):
    cols = ["case_id", "front_image", "back_image", "mfds_item_id", "drug_name", "front_imprint", "back_imprint"]
    rows = [(1, "A-1", "a.jpg", "b.jpg", "1", "", "x", ""), (2, "a-1", "c.jpg", "C.JPG", "", "", "", ""), (3, None, None, None, None, None, None, None)]
    images = spark.createDataFrame([("A.jpg",), ("x/b.jpg",), ("b.JPG",), ("z.png",), (None,)], "image string")
    df = spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"{c} string" for c in cols))
    got = {r.row_id: (set(r.errors), set(r.warnings)) for r in sheets.validate_rows(df, images).collect()}
    assert got[1] == ({"duplicate_case_id", "back_image_ambiguous"}, set())
    assert got[2] == ({"missing_answer", "duplicate_case_id", "front_image_not_found", "back_image_not_found", "same_image"}, {"no_imprint"})
    assert got[3][0] == {"missing_case_id", "missing_front_image", "missing_back_image", "missing_answer"}
    assert [r.image_key for r in sheets.orphan_images(df, images).collect()] == ["z.png"]
    aliases = spark.createDataFrame([("시험번호", "case_id"), ("case id", "case_id"), ("front image", "front_image"), ("front mark", "front_imprint")], "alias string, column string")
    found = {r.header: r.column for r in sheets.match_headers(spark.createDataFrame([("Case-ID",), ("front im",), ("front",), ("zz",)], "header string"), aliases).collect()}
    assert found == {"Case-ID": "case_id", "front im": "front_image"}


def test_arena(spark):
    df = spark.createDataFrame([("correct", None), ("wrong", 30.0), ("partial", 99.0), ("x", None)], "verdict string, score double")
    assert [r[0] for r in df.select(arena.accuracy_points("verdict", "score")).collect()] == [40.0, 30.0, 20.0, None]
    runs = spark.createDataFrame([("a", 1, 5), ("b", 2, 5)], "id string, at int, size int")
    both = arena.merge_runs(runs, runs.filter("id = 'b'").withColumn("size", F.lit(9)), ["id"], "at")
    assert {(r.id, r.size) for r in both.collect()} == {("a", 5), ("b", 9)}
    assert arena.new_runs(runs, runs, ["id"]).count() == 0 and arena.retained(runs, "at", "id", 1).first().id == "b"
    assert [r.id for r in arena.evicted_to_fit(runs, "at", "id", "size", 7).collect()] == ["b"]


def test_layout(spark):
    words = [(1, 0, 0, "성명", 0.0, 0.0, 20.0, 10.0), (1, 0, 1, "홍길동", 25.0, 3.0, 60.0, 13.0), (1, 0, 2, "값", 300.0, 40.0, 320.0, 50.0)]
    df = spark.createDataFrame(words, layout.WORDS)
    assert {r.word_no: r.row_no for r in layout.visual_rows(df).collect()} == {0: 0, 1: 0, 2: 1}
    keyed = df.withColumn("line_key", F.lit("l"))
    assert {(r.word_no, r.start, r.end, r.line_text) for r in layout.lines(keyed).collect()} == {(0, 0, 2, "성명 홍길동 값"), (1, 3, 6, "성명 홍길동 값"), (2, 7, 8, "성명 홍길동 값")}
    rows = [(1, 0, 0, "a", 0.0, 0.0, 10.0, 10.0), (1, 0, 1, "b", 1.0, 0.0, 11.0, 10.0), (1, 0, 2, "a", 50.0, 0.0, 60.0, 10.0)]
    merged = layout.merge_boxes(spark.createDataFrame(rows, layout.BOXES)).collect()
    assert [(b.kind, b.x0, b.x1) for b in sorted(merged, key=lambda b: b.x0)] == [("개인정보", 0.0, 11.0), ("a", 50.0, 60.0)]


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿a;b\r\n"x;1";"y\nz"\r\n;\r\n1;2;3\r\n', encoding="utf-8", newline="")
    assert sorted(tuple(r)[:2] for r in readers.read_delimited(spark, str(path)).collect()) == [("1", "2"), ("a", "b"), ("x;1", "y\nz")]
    zipped = sinks.archive({"in.txt": b"hello"})
    assert zipped == sinks.archive({"in.txt": b"hello"})
    (tmp_path / "z.zip").write_bytes(zipped)
    (tmp_path / "bad.zip").write_bytes(b"no")
    assert [(r.name, bytes(r.content)) for r in readers.archive_members(spark, f"{tmp_path}/*.zip").collect()] == [("in.txt", b"hello")]
    df = spark.createDataFrame([("=x", 1, True, None)], "a string, b int, c boolean, d string")
    assert sinks.csv_lines(df).first().line == '"\'=x","1","true",""'
    book = sinks.workbook({"One": df})
    import io
    import zipfile

    assert 't="inlineStr"' in zipfile.ZipFile(io.BytesIO(book)).read("xl/worksheets/sheet1.xml").decode()
    assert "<td>=x</td>" in sinks.printable("T", {"One": df})
    stores = spark.createDataFrame([('[{"id":"a"},null]',), ('{"kind":"k","runs":[{"id":"b"}]}',), ("{bad",), (None,)], "j string")
    assert sorted(r.id for r in readers.runs_of(stores, "j", "struct<id:string>").collect()) == ["a", "b"]


def test_windowed_stream(spark, tmp_path):
    from sievework.streaming import rollups

    rows = [(i, datetime(2026, 1, 1) + timedelta(minutes=20 * i)) for i in range(6)]
    spark.createDataFrame(rows, "id bigint, ts timestamp_ntz").write.parquet(f"{tmp_path}/ev.parquet")
    counts = rollups.windowed_counts(rollups.stream_of(spark, str(tmp_path), "ev"), "ts", [])
    rollups.run_to_table(counts, "counted", "complete", f"{tmp_path}/c")
    assert sorted(r.n for r in spark.table("counted").collect()) == [3, 3]


def test_pages_of_all_documents(spark, tmp_path):
    texts = {0: ("sheet_note", "ab " * 20), 1: ("leaflet", "각인 비교 abcdefghijkl x " * 105), 2: (None, "one two three")}
    spark.createDataFrame([(i, t, s) for i, (s, t) in texts.items()], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows, nearest = set(), set()
    for i, (_, text) in texts.items():
        reach, part = 0, 0
        for n, word in enumerate(text.split()):
            x0, x1 = n % 8 * 120, n % 8 * 120 + 9 * len(word)
            reach, part = (x1, 0) if n % 8 == 0 else (max(reach, x1), part + (x0 - reach > 60))
            rows.add((i, n // 400, n, n % 400 // 8, part))
            nearest.add((i, n // 400, n, min(range(6), key=lambda a: abs(a * 170 - (x0 + x1) / 2))))
    got = lambda name: [tuple(r) for r in reference.QUERIES[name](spark, str(tmp_path)).collect()]
    for name, want in (("page_rows", rows), ("column_parts", rows), ("nearest_columns", nearest)):
        assert len(found := got(name)) == len(want) and set(found) == want, name


def test_no_cell_of_a_long_row_is_lost(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('"h\n;1";b\n1;2;3\n"q""x"\n', encoding="utf-8", newline="")
    assert readers.sniff_delimiter(path.read_text()) == ";" and readers.sniff_delimiter('"a\nb,c,d";e') == ";" and readers.sniff_delimiter("") == ","
    assert [tuple(r) for r in readers.read_delimited(spark, str(path)).collect()] == [("h\n;1", "b", None), ("1", "2", "3"), ('q"x', None, None)]
    (tmp_path / "e.csv").write_text("")
    assert readers.read_delimited(spark, f"{tmp_path}/e.csv").columns == [] and readers.rows_of_text(None) == []


def test_answer_keys_by_extension(spark, tmp_path):
    df = spark.createDataFrame([("KC-1", 1.5, True, None), ("=x", 2.0, None, "가")], "case_id string, b double, c boolean, d string")
    (tmp_path / "k.xlsx").write_bytes(sinks.workbook({"One": df, "Two": df.limit(0)}))
    (tmp_path / "k.tsv").write_text("case_id\tb;c\n1\t2\n")
    (tmp_path / "k.csv").write_bytes(sinks.csv_file(df))
    got = {}
    for r in readers.answer_key_rows(spark, str(tmp_path)).orderBy("file", "row_no").collect():
        got.setdefault(r.file[-4:], []).append(r.cells)
    assert got["xlsx"] == [["case_id", "b", "c", "d"], ["KC-1", "1.5", "TRUE"], ["=x", "2.0", "", "가"]]
    assert got[".tsv"] == [["case_id", "b;c"], ["1", "2"]] and got[".csv"] == [["case_id", "b", "c", "d"], ["KC-1", "1.5", "true", ""], ["'=x", "2.0", "", "가"]]
    assert (tmp_path / "k.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    (tmp_path / "k.pdf").write_text("x")
    with pytest.raises(Exception, match="no reader for .pdf"):
        readers.answer_key_rows(spark, f"{tmp_path}/k.pdf").collect()


def test_reports_have_their_parts(spark):
    import io
    import zipfile

    from sievework.operators import scoring
    from sievework.sources import reports

    truth = spark.createDataFrame([(1, "a", ("가나정", "AB", ""), (True, "original"))], "gt_id bigint, sample_id string, answer struct<drug_name:string,front_imprint:string,back_imprint:string>, condition struct<expected_readable:boolean,variant:string>")
    for f in ("light", "background", "blur", "angle"):
        truth = truth.withColumn("condition", F.col("condition").withField(f, F.lit("x")))
    fields = "drug_name:string,drug_code:string,front_imprint:string,back_imprint:string,shape:string,color:string,confidence:double,evidence:string,uncertainty:string"
    rows = [(i, "R", "a", "p", "m", ("다른정" if i % 2 else "가나정", "", "AB", "", "", "", 0.9, "", ""), (1.0, 1.0, None, 0.5), 10.0, "", {}) for i in range(6)]
    results = spark.createDataFrame(rows, f"result_id bigint, run_id string, sample_id string, provider string, model string, prediction struct<{fields}>, usage struct<input_tokens:double,output_tokens:double,cached_tokens:double,cost_usd:double>, latency_ms double, error string, meta map<string,string>").withColumn("created_at", F.lit("2026-08-01").cast("timestamp"))
    prices = spark.createDataFrame([("p", "m", 1.0, 1.0, 1.0)], "provider string, model string, input double, output double, cached double")
    scored = scoring.score(results, truth, prices, with_answer=True).cache()
    book = zipfile.ZipFile(io.BytesIO(reports.evaluation_workbook(scored)))
    assert sum(n.startswith("xl/worksheets/") for n in book.namelist()) == 6 and 'name="Robustness"' in book.read("xl/workbook.xml").decode()
    page = reports.evaluation_report(scored, "T")
    assert all(x in page for x in ("Key figures", "50.0%", "Failures", "Limitations", "다른정"))
