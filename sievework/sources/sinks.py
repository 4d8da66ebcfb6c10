"""Writers: CSV, workbooks, printable reports, archives, backups. Tables for readers are small and made on the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import column_letters, csv_cell, xml_escaped

#: Most rows that a workbook or report takes from a table; a longer one is refused, not cut.
MOST_ROWS = 1_000_000
FIXED_TIME = (2020, 1, 1, 0, 0, 0)


def csv_lines(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One quoted and disarmed CSV line per row."""
    names = list(columns or df.columns)
    return df.select(F.concat_ws(",", *[csv_cell(c) for c in names]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder for spreadsheets: all cells quoted, CRLF line ends, header in every part, disarmed formulas."""
    safe = df.select(*[F.when(F.col(c).cast("string").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns])
    safe.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', lineSep="\r\n")


def csv_file(df: DataFrame) -> bytes:
    """A table for readers as one CSV file: byte-order mark, header, all cells quoted and disarmed, CRLF between lines; refused above ``MOST_ROWS``."""
    head, *rows = _rows(df)
    quoted = lambda v: '"' + ("" if v is None else str(v).lower() if isinstance(v, bool) else str(v)).replace('"', '""') + '"'
    lines = [",".join(map(quoted, head)), *(r[0] for r in csv_lines(df).take(len(rows)))]
    return ("\ufeff" + "\r\n".join(lines)).encode()


def _rows(df: DataFrame) -> list[list]:
    rows = df.take(MOST_ROWS + 1)
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows for a report")
    return [list(df.columns), *[list(r) for r in rows]]


def sheet_xml(rows: Sequence[Sequence[object]]) -> str:
    """A worksheet: numbers and booleans typed, the rest inline text."""

    def cell(value: object, at: str) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{xml_escaped(value)}</t></is></c>'

    body = "".join(
        f'<row r="{r}">' + "".join(cell(v, f"{column_letters(c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)
    )
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def archive(files: dict[str, bytes]) -> bytes:
    """ZIP of the files with fixed times, so equal content gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            info = zipfile.ZipInfo(name, FIXED_TIME)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """An XLSX workbook with one sheet per table."""
    names = list(sheets)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    listed = "".join(f'<sheet name="{xml_escaped(n)[:31]}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    files = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{relation}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}">{links}</Relationships>',
    }
    files |= {f"xl/worksheets/sheet{i}.xml": sheet_xml(_rows(sheets[n])) for i, n in enumerate(names, 1)}
    return archive({k: v.encode() for k, v in files.items()})


def printable(title: str, tables: dict[str, DataFrame]) -> str:
    """A printable HTML page of small tables."""

    def table(df: DataFrame) -> str:
        head, *rows = _rows(df)
        line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{xml_escaped(c)}</{tag}>" for c in cells) + "</tr>"
        return "<table>" + line(head, "th") + "".join(line(r, "td") for r in rows) + "</table>"

    body = "".join(f"<h2>{xml_escaped(n)}</h2>{table(df)}" for n, df in tables.items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{xml_escaped(title)}</title></head><body><h1>{xml_escaped(title)}</h1>{body}</body></html>'


def backup_lines(runs: DataFrame) -> DataFrame:
    """Each run as a JSON line for a backup."""
    return runs.select(F.to_json(F.struct(*runs.columns)).alias("value"))
