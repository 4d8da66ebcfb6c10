"""Raw delimited records: a quote-aware tokenizer that loads the good and explains the bad.

All records of a batch lie in one buffer that is cut into chunks of equal length.
For each chunk the tokenizer's transition function is computed at once for every
state it may be entered in; composing these functions across the chunks gives the
state each chunk is really entered in, and a second pass then marks the field ends
and the errors. Both passes step through all chunks together, so no record, however
long, is walked character by character in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.skew import salted_left_join

#: The 19 columns of an answer sheet, in their order.
SHEET_COLUMNS = (
    "case_id", "pill_id", "front_image", "back_image", "mfds_item_id", "drug_name", "front_imprint",
    "back_imprint", "shape", "color", "mark_id", "imprint_type", "score_line", "expected_readable",
    "light", "background", "blur", "angle", "notes",
)
DELIMITERS = (",", "\t", ";")

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
OTHER, DELIM, QUOTE, END = range(4)
#: The next state by state and class of character.
STEP = np.array(
    [
        [PLAIN, START, QUOTED, START],
        [PLAIN, START, BROKEN, START],
        [QUOTED, QUOTED, CLOSED, START],
        [BROKEN, START, QUOTED, START],
        [BROKEN, BROKEN, BROKEN, START],
    ],
    dtype=np.uint8,
)
STEP_FLAT = STEP.reshape(-1)
CHUNK = 256
#: Characters that are tokenized in one pass; a longer single record is a pass of its own.
PASS_CHARS = 4_000_000

CASE_ID = re.compile(r"[A-Za-z]+[-_][0-9]+")
IMAGE = re.compile(r"(?:.*[/\\])?(?P<stem>[^/\\]*[^/\\\s][^/\\]*)\.(?:jpe?g|png|webp|heic)", re.I | re.S)

ERRORS = {
    "quote_in_plain_field": "a double quote inside a field that is not quoted",
    "text_after_quote": "text after a closing quote",
    "quote_not_closed": "the record ends inside quotes",
    "field_count": "not as many fields as the sheet's header",
    "bad_case_id": "case_id is not letters, one - or _, digits",
    "bad_front_image": "front_image is not an image file name",
    "bad_back_image": "back_image is not an image file name",
    "same_image": "both images are the same file",
    "no_header": "the record's sheet has no usable header",
    "null_record": "the record is null",
}


def entry_states(classes: np.ndarray) -> np.ndarray:
    """The state in which each row of ``classes`` (chunks × CHUNK) is entered."""
    chunks = len(classes)
    through = np.tile(np.arange(5, dtype=np.uint8), (chunks, 1))
    for j in range(classes.shape[1]):
        through = STEP_FLAT[through * 4 + classes[:, j : j + 1]]
    reach = 1
    while reach < chunks:  # composes with the function of all chunks before, twice as many each time
        through[reach:] = np.take_along_axis(through[reach:], through[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return np.concatenate([[START], through[:-1, START]]).astype(np.uint8)


@dataclass
class Tokens:
    """Of each record: the number of fields, the first error and its offset (-1: none), the field ends."""

    fields: np.ndarray
    error: list[str | None]
    offset: np.ndarray
    ends: np.ndarray
    first_end: np.ndarray
    starts: np.ndarray


def tokenize(texts: Sequence[str], delimiters: Sequence[str]) -> Tokens:
    """Tokenize records that each have their own delimiter."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.cumsum(lengths) - 1
    starts = stops - lengths + 1
    record = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    separator = np.fromiter((ord(d) for d in delimiters), dtype=np.uint32, count=len(texts))
    classes = np.zeros(len(codes), dtype=np.uint8)
    classes[codes == 34] = QUOTE
    classes[codes == separator[record]] = DELIM
    classes[stops] = END
    padded = np.full(-(-len(codes) // CHUNK) * CHUNK, OTHER, dtype=np.uint8)
    padded[: len(codes)] = classes
    grid = padded.reshape(-1, CHUNK)
    state = entry_states(grid)
    states = np.empty_like(grid)
    for j in range(CHUNK):
        states[:, j] = state
        state = STEP_FLAT[state * 4 + grid[:, j]]
    states = states.reshape(-1)[: len(codes)]

    field_end = (classes == END) | ((classes == DELIM) & ((states == START) | (states == PLAIN) | (states == CLOSED)))
    ends = np.flatnonzero(field_end)
    fields = np.bincount(record[ends], minlength=len(texts))
    wrong = ((classes == QUOTE) & (states == PLAIN)) | ((classes == OTHER) & (states == CLOSED)) | ((classes == END) & (states == QUOTED))
    at = np.flatnonzero(wrong)
    owners, first = np.unique(record[at], return_index=True)
    error: list[str | None] = [None] * len(texts)
    offset = np.full(len(texts), -1, dtype=np.int64)
    for owner, position in zip(owners, at[first]):
        kind = (classes[position], states[position])
        error[owner] = "quote_not_closed" if kind[0] == END else "quote_in_plain_field" if kind[0] == QUOTE else "text_after_quote"
        offset[owner] = position - starts[owner]
    return Tokens(fields, error, offset, ends, np.cumsum(fields) - fields, starts)


def field_value(raw: str) -> str:
    """A field's text without its quotes."""
    return raw[1:-1].replace('""', '"') if raw[:1] == '"' else raw


def record_fields(text: str, tokens: Tokens, k: int) -> list[str]:
    """The field texts of record ``k``."""
    cut = tokens.ends[tokens.first_end[k] : tokens.first_end[k] + tokens.fields[k]] - tokens.starts[k]
    out, left = [], 0
    for right in cut.tolist():
        out.append(field_value(text[left:right]))
        left = right + 1
    return out


def without_file_marks(raw: str) -> str:
    """A record without the byte-order mark and carriage return of its file."""
    return raw.removeprefix("﻿").rstrip("\r\n") if raw else raw


def passes(texts: Sequence[str]) -> Iterator[range]:
    """Ranges of records whose characters fit one pass."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size + len(t) > PASS_CHARS and i > begin:
            yield range(begin, i)
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield range(begin, len(texts))


def column_name(header: str) -> str:
    """A header cell as a column name: letters of any case, blanks or hyphens for underscores."""
    return re.sub(r"[\s\-_]+", "_", header.strip().lower())


Header = tuple[str, int, list[int], str | None, int]


def read_headers(raws: Sequence[str | None]) -> list[Header | None]:
    """Of each header record: delimiter, number of fields, place of each sheet column (-1: missing), error and its offset; null of a null one.

    The delimiter is the candidate that occurs most often outside quotes, the
    first listed on a tie. All headers are tokenized together, under each candidate.
    """
    texts = [without_file_marks(r or "") for r in raws]
    out: list[Header | None] = [None] * len(raws)
    for some in passes(texts):
        given = texts[some.start : some.stop]
        tokens = tokenize(given * len(DELIMITERS), [d for d in DELIMITERS for _ in given])
        counts = tokens.fields.reshape(len(DELIMITERS), -1)
        for i, best in enumerate(counts.argmax(axis=0)):
            if raws[some.start + i] is None:
                continue
            k = int(best) * len(given) + i
            error, names = tokens.error[k], []
            if error is None:
                names = [column_name(x) for x in record_fields(given[i], tokens, k)]
            places = [names.index(c) if c in names else -1 for c in SHEET_COLUMNS]
            out[some.start + i] = (DELIMITERS[best], len(names), places, error, int(tokens.offset[k]))
    return out


def read_header(raw: str | None) -> tuple[str, int, list[int]] | None:
    """Delimiter, number of fields and places of one header record; null if it is not usable."""
    header = read_headers([raw])[0]
    return header[:3] if header and header[3] is None else None


def reject_reason(case_id: str, front: str, back: str) -> str | None:
    """Why a record with these values cannot be used, if so."""
    if not CASE_ID.fullmatch(case_id.strip()):
        return "bad_case_id"
    front, back = front.strip(), back.strip()
    if not IMAGE.fullmatch(front):
        return "bad_front_image"
    if not IMAGE.fullmatch(back):
        return "bad_back_image"
    if re.split(r"[/\\]", front)[-1].lower() == re.split(r"[/\\]", back)[-1].lower():
        return "same_image"
    return None


def sheet_headers(records: DataFrame) -> DataFrame:
    """One row per sheet: ``sheet_id, delimiter, n_columns, places``, from its first header record.

    Of several records with ``rec_no`` 1 the one with the smallest ``rec_id`` counts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, h) for s, h in zip(b.column(0).to_pylist(), read_headers(b.column(1).to_pylist())) if h and h[3] is None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _ in rows], pa.string()),
                    pa.array([h[0] for _, h in rows], pa.string()),
                    pa.array([h[1] for _, h in rows], pa.int32()),
                    pa.array([h[2] for _, h in rows], pa.list_(pa.int32())),
                ],
                ["sheet_id", "delimiter", "n_columns", "places"],
            )

    first = (
        records.filter((F.col("rec_no") == 1) & F.col("sheet_id").isNotNull())
        .groupBy("sheet_id")
        .agg(F.min_by("raw", "rec_id").alias("raw"))
    )
    return first.mapInArrow(run, "sheet_id string, delimiter string, n_columns int, places array<int>")


LOADED_SCHEMA = (
    "rec_id bigint, sheet_id string, rec_no int, reason string, error_offset int, n_fields int, raw string, "
    + ", ".join(f"{c} string" for c in SHEET_COLUMNS)
    + ", readable boolean"
)


def _typed_readable(value: str | None) -> bool | None:
    word = (value or "").strip().lower()
    if word in ("true", "1", "y", "yes"):
        return True
    if word in ("false", "0", "n", "no"):
        return False
    return None


def rejected_headers(records: DataFrame) -> DataFrame:
    """The header records (``rec_no`` 1) that are null or break the quoting rule, as ``load_records`` gives rejected rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec_ids, sheets, numbers, raws = (c.to_pylist() for c in b.columns)
            found = [
                (i, s, n, "null_record" if h is None else h[3], -1 if h is None else h[4], r)
                for i, s, n, r, h in zip(rec_ids, sheets, numbers, raws, read_headers(raws))
                if h is None or h[3]
            ]
            columns = list(zip(*found)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["rec_id", "sheet_id", "rec_no", "reason", "error_offset", "raw"])

    headers = records.filter(F.col("rec_no") == 1).select(F.col("rec_id").cast("bigint"), F.col("sheet_id").cast("string"), F.col("rec_no").cast("int"), F.col("raw").cast("string"))
    return headers.mapInArrow(run, "rec_id bigint, sheet_id string, rec_no int, reason string, error_offset int, raw string")


def load_records(records: DataFrame) -> DataFrame:
    """Every data record (``rec_no`` other than 1), loaded or with the reason why not, and every header record that is broken.

    Valid rows have a null ``reason``, the 19 columns and ``expected_readable`` also
    as boolean ``readable``. Rejected rows keep ``raw``, a ``reason`` of ``ERRORS``
    and, for broken quoting, the ``error_offset`` in the record (otherwise -1). A null
    record is ``null_record``, one of a sheet without header ``no_header``; an empty
    record has one field. Repeated records are loaded each time. A null ``rec_no``
    is a data record. The header of each sheet joins on salted keys, so one large
    sheet does not meet in one task. Extra columns are ignored.
    """
    data = records.filter(F.coalesce(F.col("rec_no"), F.lit(0)) != 1).select("rec_id", "sheet_id", "rec_no", "raw")
    joined = salted_left_join(data, sheet_headers(records), ["sheet_id"])
    names = [x.split()[0] for x in LOADED_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.string()] * len(SHEET_COLUMNS), pa.bool_()]

    def part(rec_ids: list, sheets: list, numbers: list, raws: list, seps: list, widths: list, places: list) -> pa.RecordBatch:
        usable = [i for i, (r, s) in enumerate(zip(raws, seps)) if r is not None and s is not None]
        reason: list[str | None] = ["null_record" if r is None else "no_header" for r in raws]
        offset, found = [-1] * len(raws), [0] * len(raws)
        values: list[list[str | None]] = [[None] * len(raws) for _ in SHEET_COLUMNS]
        texts = [without_file_marks(raws[i]) for i in usable]
        if texts:
            tokens = tokenize(texts, [seps[i] for i in usable])
            for k, i in enumerate(usable):
                found[i], offset[i] = int(tokens.fields[k]), int(tokens.offset[k])
                if tokens.error[k]:
                    reason[i] = tokens.error[k]
                elif tokens.fields[k] != widths[i]:
                    reason[i] = "field_count"
                else:
                    cells = record_fields(texts[k], tokens, k)
                    row = [cells[p] if p >= 0 else "" for p in places[i]]
                    reason[i] = reject_reason(row[0], row[2], row[3])
                    if reason[i] is None:
                        for column, cell in zip(values, row):
                            column[i] = cell
        kept = [r if why else None for r, why in zip(raws, reason)]
        readable = [_typed_readable(x) for x in values[SHEET_COLUMNS.index("expected_readable")]]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip([rec_ids, sheets, numbers, reason, offset, found, kept, *values, readable], types)], names
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for r in passes([x or "" for x in columns[3]]):
                yield part(*[c[r.start : r.stop] for c in columns])

    loaded = joined.select("rec_id", "sheet_id", "rec_no", "raw", "delimiter", "n_columns", "places").mapInArrow(run, LOADED_SCHEMA)
    return loaded.unionByName(rejected_headers(records).withColumn("n_fields", F.lit(0)), allowMissingColumns=True)


def reject_report(loaded: DataFrame) -> DataFrame:
    """Per sheet and reason: records rejected, and their share of the sheet's records."""
    per = loaded.groupBy("sheet_id", "reason").agg(F.count("*").alias("n_records"))
    whole = Window.partitionBy("sheet_id")
    return (
        per.withColumn("sheet_records", F.sum("n_records").over(whole))
        .filter(F.col("reason").isNotNull())
        .withColumn("share", F.round(F.col("n_records") / F.col("sheet_records"), 6))
    )
