"""Readers: delimited text, JSON stores and backups, pages of an interface, archives, OCR words."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.records import DELIMITERS, passes, record_fields, tokenize, without_file_marks


def record_ends(text: str) -> list[tuple[int, int]]:
    """Start and end of every record of a file: lines, but for line breaks inside quotes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    quoted = np.cumsum(codes == 34) % 2 == 1
    feeds = np.flatnonzero(((codes == 10) | ((codes == 13) & (np.append(codes[1:], 0) != 10))) & ~quoted)
    ends = [*feeds.tolist(), len(codes)]
    return [(a, b) for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends) if a < len(codes)]


def sniff_delimiter(text: str) -> str:
    """The delimiter that occurs most outside quotes in the first record of a text; the first of comma, tab, semicolon on a tie."""
    ends = record_ends(text)
    record = without_file_marks(text[ends[0][0] : ends[0][1]]) if ends else ""
    counts = tokenize([record] * len(DELIMITERS), DELIMITERS).fields
    return DELIMITERS[int(counts.argmax())]


def rows_of_text(text: str | None, delimiter: str | None = None) -> list[list[str]]:
    """The cells of every row of a delimited text; rows may differ in length, blank ones are left out."""
    body = (text or "").removeprefix("\ufeff")
    sep = delimiter or sniff_delimiter(body)
    records = [body[a:b].rstrip("\r") for a, b in record_ends(body)]
    out: list[list[str]] = []
    for some in passes(records):
        part = records[some.start : some.stop]
        tokens = tokenize(part, [sep] * len(part))
        out += [cells for cells in (record_fields(r, tokens, k) for k, r in enumerate(part)) if any(c.strip() for c in cells)]
    return out


def delimited_rows(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """``file, row_no, cells`` of delimited files: doubled quotes, line breaks in quotes, no cell of a long row lost, blank rows left out.

    The delimiter of each file is found in its first record unless it is given. A file is read by one task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = rows_of_text(text, delimiter)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["file", "row_no", "cells"]
                )

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInArrow(run, "file string, row_no int, cells array<string>")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All-string rows of delimited files, as many columns as the longest row has; shorter rows end in nulls."""
    rows = delimited_rows(spark, path, delimiter)
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    return rows.select(*[F.try_element_at("cells", F.lit(i + 1)).alias(f"_c{i}") for i in range(width)])


def rows_of_workbook(content: bytes) -> list[list[str]]:
    """The cells of the first sheet of an XLSX workbook as text, at their places; blank rows are left out."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{main}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        sheet = ElementTree.fromstring(book.read(first))
    out = []
    for row in sheet.iter(f"{main}row"):
        cells: dict[int, str] = {}
        for place, cell in enumerate(row.iter(f"{main}c")):
            letters = re.match(r"[A-Z]+", cell.get("r") or "")
            at = column_number(letters[0]) if letters else place
            kind, value = cell.get("t"), cell.find(f"{main}v")
            text = "".join(t.text or "" for t in cell.iter(f"{main}t")) if kind == "inlineStr" else (value.text or "") if value is not None else ""
            cells[at] = shared[int(text)] if kind == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
        listed = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
        if any(c.strip() for c in listed):
            out.append(listed)
    return out


def column_number(letters: str) -> int:
    """Place of a sheet's column from its letters: A is 0, AA is 26."""
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def answer_key_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_no, cells`` of answer keys by their extension: csv and txt with the delimiter found, tsv with tabs, xlsx the first sheet.

    Any other extension is an error. A null byte or bad encoding does not stop the reading: undecodable bytes become U+FFFD.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind = file.rsplit(".", 1)[-1].lower()
                if kind == "xlsx":
                    rows = rows_of_workbook(content)
                elif kind in ("csv", "txt", "tsv"):
                    rows = rows_of_text(content.decode("utf-8", "replace"), "\t" if kind == "tsv" else None)
                else:
                    raise ValueError(f"no reader for .{kind} files: {file}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["file", "row_no", "cells"]
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row_no int, cells array<string>")


def runs_of(stores: DataFrame, column: str, schema: str) -> DataFrame:
    """Runs in JSON stores: a bare list or an object with ``runs``; broken JSON and entries that are no objects give none."""
    listed = F.from_json(column, f"array<{schema}>")
    wrapped = F.from_json(column, f"struct<kind:string,version:string,runs:array<{schema}>>")
    runs = F.when(F.trim(column).startswith("["), listed).otherwise(wrapped["runs"])
    return stores.select(F.explode(runs).alias("run")).filter(F.col("run").isNotNull()).select("run.*")


def pages_of(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of an interface's saved pages, whichever way they are wrapped (``body`` or ``response.body``)."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    schema = f"struct<body:struct<items:array<{item}>>,response:struct<body:struct<items:array<{item}>>>>"
    page = F.from_json("value", schema)
    return raw.select("file", F.posexplode(F.coalesce(page["body"]["items"], page["response"]["body"]["items"])).alias("ord", "item")).select("file", "ord", "item.*")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, name, size, content`` of every file in ZIP archives; a broken archive gives none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "name", "size", "content"]
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [(archive, i.filename, i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    continue
                columns = list(zip(*members)) or [[], [], [], []]
                types = [pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, size bigint, content binary")


def words_of_tsv(rows: DataFrame) -> DataFrame:
    """OCR words of TSV rows (``value``): lines of 12 columns at level 5, with box and confidence."""
    cell = F.split("value", "\t")
    number = lambda i: cell[i].try_cast("double")
    words = rows.filter((F.size(cell) == 12) & (F.try_element_at(cell, F.lit(1)) == "5"))
    return words.select(
        cell[1].try_cast("int").alias("page"), F.concat_ws("-", cell[2], cell[3], cell[4]).alias("line_key"), cell[11].alias("text"),
        number(6).alias("x0"), number(7).alias("y0"), (number(6) + number(8)).alias("x1"), (number(7) + number(9)).alias("y1"), number(10).alias("confidence"),
    ).filter(F.trim("text") != "")


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of dated snapshot files, with ``snapshot``, the date in the file's name; unreadable files are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("snapshot", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1))


def backup_runs(stores: DataFrame, column: str, schema: str, kind: str) -> DataFrame:
    """``file_ok, run, kept`` of every entry of backups: a bare list, or an object of this ``kind`` with ``runs``.

    An entry is kept if it has an ``id`` and ``results``; a store of another kind or broken JSON gives one row with ``file_ok`` false.
    """
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    wrapped = F.from_json(column, f"struct<kind:string,runs:array<{schema}>>")
    listed = F.when(text.startswith("["), F.from_json(column, f"array<{schema}>")).when(wrapped["kind"] == kind, wrapped["runs"])
    each = stores.select(listed.isNotNull().alias("file_ok"), F.explode_outer(listed).alias("run"))
    kept = F.col("run").isNotNull() & (F.trim(F.coalesce(F.col("run.id").cast("string"), F.lit(""))) != "") & F.col("run.results").isNotNull()
    return each.withColumn("kept", F.coalesce(kept, F.lit(False)))


def backup_report(entries: DataFrame) -> DataFrame:
    """Runs kept and entries skipped over all backups, and stores that were refused."""
    return entries.agg(F.count_if("kept").alias("kept"), F.count_if(F.col("file_ok") & ~F.col("kept")).alias("skipped"), F.count_if(~F.col("file_ok")).alias("refused"))


WORD = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
BLOCKS = f"array<struct<paragraphs:array<struct<lines:array<struct<words:array<{WORD}>>>>>>>"


def words_of_blocks(pages: DataFrame, column: str) -> DataFrame:
    """Words of read pages (``doc_id, page`` and JSON of nested blocks) with their ``line_key``; a flat list of words is one line."""
    raw = pages.withColumn("_json", F.col(column))
    nested = raw.select("doc_id", "page", F.posexplode(F.from_json("_json", BLOCKS)).alias("b", "block"))
    nested = nested.select("doc_id", "page", "b", F.posexplode("block.paragraphs").alias("p", "par")).select("doc_id", "page", "b", "p", F.posexplode("par.lines").alias("l", "line"))
    nested = nested.select("doc_id", "page", F.concat_ws("-", "b", "p", "l").alias("line_key"), F.posexplode("line.words").alias("w", "word"))
    flat = raw.select("doc_id", "page", F.lit("flat").alias("line_key"), F.posexplode(F.from_json("_json", f"array<{WORD}>")).alias("w", "word"))
    words = nested.unionByName(flat).filter(F.trim(F.coalesce("word.text", F.lit(""))) != "")
    return words.select("doc_id", "page", "line_key", "w", F.col("word.text").alias("text"), "word.bbox.*", F.col("word.confidence").alias("confidence"))


def pack_rows(members: DataFrame) -> DataFrame:
    """Rows of the answer key of each archive (its one csv member) beside its images: ``archive, row_no, cells, images``.

    ``members``: ``archive, name, content`` as of ``archive_members``. ``images`` are the cells that name an image of the archive, folders and case ignored.
    """
    base = F.lower(F.element_at(F.split("name", "/"), -1))
    images = members.filter(base.rlike(r"\.(?:jpe?g|png|webp|heic)$")).groupBy("archive").agg(F.collect_set(base).alias("there"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = rows_of_text(content.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["archive", "row_no", "cells"])

    keys = members.filter(base.endswith(".csv")).select("archive", "content").mapInArrow(run, "archive string, row_no int, cells array<string>")
    named = F.filter("cells", lambda c: F.array_contains(F.coalesce("there", F.array().cast("array<string>")), F.lower(F.element_at(F.split(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "/"), -1))))
    return keys.join(images, "archive", "left").select("archive", "row_no", "cells", named.alias("images"))
