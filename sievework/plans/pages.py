"""Queries of read and printed pages, labels and plain-text checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import labels, tables
from sievework.sources.tables import spread_table, table

COLUMNS = ("case_id", "front_image", "back_image", "shape", "color")
HEADERS = tables.Headers({c: c for c in COLUMNS})


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Answer-sheet cells as words on pages of forty rows; only the first page of five has the header row."""
    rows = table(spark, folder, "answer_sheet").select("row_id", *COLUMNS)
    doc, page, row = F.floor(F.col("row_id") / 200), F.floor(F.col("row_id") % 200 / 40).cast("int"), (F.col("row_id") % 40 + 1).cast("int")
    cells = rows.select(doc.alias("doc_id"), page.alias("page"), row.alias("row"), F.posexplode(F.array(*[T.safe(c) for c in COLUMNS])).alias("column", "value"))
    head = rows.select(doc.alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("row"), F.posexplode(F.array(*[F.lit(c) for c in COLUMNS])).alias("column", "value"))
    words = cells.unionByName(head).select("doc_id", "page", "row", "column", F.posexplode(F.split("value", r"\s+")).alias("k", "text")).filter("text <> ''")
    x0 = (F.col("column") * 4000 + F.col("k") * 12).cast("double")
    return words.select(
        "doc_id", "page", (F.col("row") * 10_000 + F.col("column") * 1000 + F.col("k")).cast("int").alias("word_no"), "text", x0.alias("x0"), (F.col("row") * 40.0).alias("y0"), (x0 + 10).alias("x1"),
        (F.col("row") * 40.0 + 24).alias("y1"), ((F.col("column") * 7 + F.col("row") * 3 + F.col("k")) % 50 + 50).cast("double").alias("confidence"),
    )


def sheet_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Answer sheets read back from words on pages, with their warnings."""
    found = tables.record_warnings(tables.records_of_pages(_placed(spark, folder), HEADERS))
    codes = F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["code"], w["column"])), "|")
    value = lambda c: F.coalesce(F.col("values")[c], F.lit("")).alias(c)
    return found.select("doc_id", "page", "row_no", "carried", *[value(c) for c in COLUMNS], "unmapped", "min_confidence", codes.alias("warnings"))


def printed_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Answer sheets read back from the lines of printed pages."""
    items = _placed(spark, folder).select("doc_id", "page", F.col("word_no").alias("item_no"), "text", F.col("x0").alias("x"), (10_000 - F.col("y0")).alias("y"))
    found = tables.records_of_lines(tables.printed_lines(items), HEADERS)
    return found.select("doc_id", "page", "line_no", *[F.coalesce(F.col("values")[c], F.lit("")).alias(c) for c in COLUMNS])


def sheet_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Answer sheets read back from rows of cells, a hundred to a file, with a title above the header, one column unknown and one there twice."""
    rows = table(spark, folder, "answer_sheet").select("row_id", *COLUMNS)
    file = F.floor(F.col("row_id") / 100).cast("string").alias("file")
    data = rows.select(file, (F.col("row_id") % 100 + 2).cast("int").alias("row_no"), F.array(*[F.concat(F.lit(" "), T.safe(c)) for c in COLUMNS], F.lit("note"), F.lit("again")).alias("cells"))
    files = rows.select(file).distinct()
    title = files.select("file", F.lit(0).alias("row_no"), F.array(F.lit("title")).alias("cells"))
    head = files.select("file", F.lit(1).alias("row_no"), F.array(*[F.lit(c.upper().replace("_", " ")) for c in COLUMNS], F.lit("remarks"), F.lit("shape")).alias("cells"))
    return tables.normalized_table(data.unionByName(title).unionByName(head), HEADERS, COLUMNS)


def label_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of the values behind a label, one page for each answer-sheet row."""
    texts = F.filter(F.split(F.concat(F.lit("면허번호 "), T.safe("drug_name")), r"\s+"), lambda t: t != "")
    words = table(spark, folder, "answer_sheet").select(F.col("row_id").alias("doc_id"), F.posexplode(texts).alias("word_no", "text"))
    x0 = (F.col("word_no") * 30).cast("double")
    placed = words.select("doc_id", F.lit(0).alias("page"), "word_no", "text", x0.alias("x0"), F.lit(10.0).alias("y0"), (x0 + 20).alias("x1"), F.lit(30.0).alias("y1"))
    pages = placed.select("doc_id", "page").distinct().withColumn("width", F.lit(1000)).withColumn("height", F.lit(1000))
    return labels.by_label(placed, pages)


def offline_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the offline check in all documents, by kind."""
    hits = spread_table(spark, folder, "documents").select("doc_id", F.explode(labels.recognized("text")).alias("h"))
    return hits.groupBy("doc_id", "h.kind").agg(F.count("*").alias("n"), F.round(F.sum("h.weight"), 4).alias("weight"))


QUERIES = {f.__name__: f for f in (sheet_pages, printed_sheets, sheet_tables, label_boxes, offline_hits)}

_CELL = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), ' ')"
_CELLS = f"""WITH r AS (SELECT row_id, row_id // 200 AS doc_id, row_id % 200 // 40 AS page, row_id % 40 + 1 AS row, {", ".join(f"{_CELL(c)} AS {c}" for c in COLUMNS)},
    {", ".join(f"list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda t: t <> '') AS t_{c}, regexp_matches(coalesce({c}, ''), '^\\s') AS b_{c}" for c in COLUMNS)} FROM answer_sheet),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY row) AS n FROM r WHERE {" || ".join(COLUMNS)} <> '')
"""
# the confidence of a word follows from its place: its column, its row and its place in the cell, where a leading blank takes the first
_CONF = lambda c, i: f"list_min(list_transform(range(len(t_{c})), lambda k: ({i} * 7 + row * 3 + k + b_{c}::int) % 50 + 50))::double"
_LOW = " ".join(f"|| case when {c} <> '' and {_CONF(c, i)} < 70 then '|low_confidence:{c}' else '' end" for c, i in sorted((c, i) for i, c in enumerate(COLUMNS)))

ORACLES = {
    "sheet_pages": _CELLS + f"""SELECT doc_id, page, n - 1 + (page = 0)::int AS row_no, page > 0 AS carried, {", ".join(COLUMNS)}, 0 AS unmapped, least({", ".join(_CONF(c, i) for i, c in enumerate(COLUMNS))}) AS min_confidence,
    ltrim(case when case_id = '' then '|missing_required:case_id' else '' end || case when front_image = '' then '|missing_required:front_image' else '' end || case when back_image = '' then '|missing_required:back_image' else '' end || '|missing_answer' {_LOW}, '|') AS warnings FROM k""",
    "printed_sheets": _CELLS + f"SELECT doc_id, page, n + (page = 0)::int AS line_no, {', '.join(COLUMNS)} FROM k",
    "sheet_tables": f"SELECT (row_id // 100)::varchar AS file, row_id % 100 + 3 AS source_row, {', '.join(f'trim(coalesce({c}, chr(32))) AS {c}' for c in COLUMNS)} FROM answer_sheet WHERE {' || '.join(f'trim(coalesce({c}, chr(32)))' for c in COLUMNS)} <> ''",
    "label_boxes": r"""WITH w AS (SELECT row_id, list_filter(regexp_split_to_array(coalesce(drug_name, ''), '\s+'), lambda t: t <> '') AS t FROM answer_sheet),
    b AS (SELECT row_id, list_transform(t, lambda x: length(regexp_replace(x, '[\s:：|]', '', 'g'))) AS n FROM w WHERE len(t) > 0),
    s AS (SELECT row_id, case when len(n) > 1 and n[1] < 14 then case when len(n) > 2 and n[1] + n[2] < 14 then 3 else 2 end else 1 end AS k FROM b)
    SELECT row_id AS doc_id, 0 AS page, '개인식별번호' AS kind, 30.0 AS x0, 10.0 AS y0, 30.0 * k + 20 AS x1, 30.0 AS y1 FROM s""",
    "offline_hits": r"""WITH h AS (SELECT doc_id, unnest(['KR_RRN', 'KR_PHONE_NUMBER', 'KR_PHONE_NUMBER', 'EMAIL_ADDRESS']) AS kind, unnest([0.9, 0.85, 0.6, 0.85]) AS w,
    unnest([len(regexp_extract_all(text, '\d{6}[-\s]?[1-8]\d{6}')), len(regexp_extract_all(text, '01[016789][-\s]?\d{3,4}[-\s]?\d{4}')), len(regexp_extract_all(text, '0\d{1,2}[-\s]?\d{3,4}[-\s]?\d{4}')), len(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'))]) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, kind, sum(n) AS n, round(sum(n * w), 4) AS weight FROM h WHERE n > 0 GROUP BY ALL""",
}
