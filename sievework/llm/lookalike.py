"""One consistent form for text that looks the same but differs in its characters.

Each value is mapped to what a reader sees; values whose mapped forms are equal under
an accent- and case-sensitive Unicode collation are one class. A class has one
canonical member, and joining it back to the values gives the consistent form.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievework.operators.skew import salted_left_join, union_all
from sievework.session import materialize

#: Kinds of compatibility characters that look like their plain form. Superscripts,
#: circled signs, fractions and vertical forms can be told apart and are kept.
PLAIN_LOOKING = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<square>", "<small>"}

# Common letters of other scripts and the Latin letters they look like; the public
# confusables data, see ``confusables``, has the others.
LOOKALIKE_LETTERS = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ӏ": "I",
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "х": "x", "у": "y", "ү": "y",
    "к": "k", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "Ս": "U", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Signs that look like a hyphen or like a middle dot.
LOOKALIKE_SIGNS = {
    "-": "‐‑‒–−˗⁃",
    "·": "·•‧⋅・ᆞ∙･",
    "'": "‘’ʼ′",
}
#: Invisible characters besides those of category Cf.
INVISIBLE = {"͏", "ᅟ", "ᅠ", "឴", "឵", "᠋", "᠌", "᠍", "᠎", "ㅤ", "ﾠ"}


#: Scripts whose letters are never taken for Latin ones: syllables are spelled with them.
OTHER_SCRIPTS = ("HANGUL", "CJK", "KATAKANA", "HIRAGANA", "BOPOMOFO", "YI", "TANGUT", "HALFWIDTH", "FULLWIDTH")


@lru_cache(maxsize=1)
def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of all scripts and the Latin letter or digit they look like, by the public Unicode confusables data.

    The data come with the ICU library that Spark's collations use; the driver asks it once, for all
    letters in one call. Its prototype of capital I and small l is one, so a capital letter is
    taken for I and any other for l. Letters with a decomposition are left to ``look``.
    """
    letters = [
        ch for ch in map(chr, range(128, sys.maxunicode + 1))
        if unicodedata.category(ch)[0] == "L" and not unicodedata.decomposition(ch) and not unicodedata.name(ch, "CJK").startswith(OTHER_SCRIPTS)
    ]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    forms = checker.getSkeleton("\n".join(letters)).split("\n")
    found = {ch: form for ch, form in zip(letters, forms) if len(form) == 1 and form.isascii() and form.isalnum()}
    return {ch: "I" if form == "l" and unicodedata.category(ch) == "Lu" else form for ch, form in found.items()}


def _lookalikes() -> dict[str, str]:
    return LOOKALIKE_LETTERS | {x: sign for sign, same in LOOKALIKE_SIGNS.items() for x in same}


class Seen(dict):
    """What a reader sees of each character, filled as characters occur (one entry per character).

    ``more``: look-alike letters besides the fixed ones, which come first.
    """

    def __init__(self, more: dict[str, str] | None = None) -> None:
        super().__init__()
        self.table = (more or {}) | _lookalikes()

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" or ch in INVISIBLE or "︀" <= ch <= "️":
            out = ""
        elif kind == "Zs":
            out = " "
        else:
            tag = unicodedata.decomposition(ch).split(" ")[0]
            plain = unicodedata.normalize("NFKD", ch) if tag in PLAIN_LOOKING else ch
            out = "".join(self.table.get(x, x) for x in plain)
        self[code] = out
        return out


_SEEN = Seen()


def look(text: str | None, seen: Seen = _SEEN) -> str | None:
    """What a reader sees of ``text``: plain-looking letters, plain blanks, nothing invisible.

    Accents, case, digits and blanks between words stay as they are; null stays null.
    """
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(seen))


def look_of(spark: SparkSession, value: str) -> Column:
    """``look`` of a column, with all letters of the confusables data."""
    seen = Seen(confusables(spark))

    @F.arrow_udf(StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([look(v, seen) for v in values.to_pylist()], pa.string())

    return run(value)


def lookalike_classes(values: DataFrame) -> DataFrame:
    """``field, value, canonical`` for every distinct value of ``values`` (``field, value, is_reference``).

    Values of one field whose looks are equal under the collation UNICODE (accents and
    case count, canonically equivalent sequences are equal) form a class. Its
    canonical member is a reference value if there is one, then the shortest, then
    the first in binary order. Null values have no class; an empty value is a class
    with whatever is invisible. Repeated rows count once.
    """
    spark = values.sparkSession
    members = (
        values.filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.max(F.col("is_reference").cast("int")).alias("is_reference"))
        .withColumn("look", look_of(spark, "value"))
    )
    return spark.sql(
        """
        WITH mapped AS (SELECT field, value, is_reference, look COLLATE UNICODE AS look FROM {members}),
        classes AS (
            SELECT field, look, min(struct(-is_reference AS a, length(value) AS b, value AS c)).c AS canonical
            FROM mapped GROUP BY field, look
        )
        SELECT m.field, m.value, c.canonical
        FROM mapped m JOIN classes c ON m.field = c.field AND m.look = c.look
        """,
        members=members,
    )


def cells(rows: DataFrame, key: str, fields: list[str], keep: list[str]) -> DataFrame:
    """``rows`` unpivoted: one row per key and field, with ``value`` and the columns ``keep``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return rows.select(key, *keep, F.explode(pairs).alias("_cell")).select(key, *keep, "_cell.field", "_cell.value")


def consistent_cells(sheet_cells: DataFrame, reference: DataFrame) -> DataFrame:
    """``sheet_cells`` (with ``field, value``) with ``canonical``, the consistent form of each value.

    ``reference`` (``field, value``) are the values preferred as canonical. Only values
    that are not themselves canonical are joined back, on salted keys.
    """
    every = union_all(
        [
            sheet_cells.select("field", "value", F.lit(False).alias("is_reference")),
            reference.select("field", "value", F.lit(True).alias("is_reference")),
        ]
    )
    changed = lookalike_classes(every).filter(F.col("canonical") != F.col("value"))
    joined = salted_left_join(sheet_cells, changed, ["field", "value"])
    return joined.withColumn("canonical", F.coalesce("canonical", "value"))


def same_look_cells(sheet_cells: DataFrame, reference: DataFrame) -> DataFrame:
    """The cells that look like their reference value but are not equal to it.

    ``sheet_cells``: ``row_id, item, field, value``; ``reference``: ``item, field, value``,
    possibly repeated. A cell without item, of an unknown item or null is no case. A cell is
    compared once per distinct item and text, however many rows have it: the texts that differ
    from their item's are classed, and the cases joined back to the rows.
    """
    known = reference.filter(F.col("item").isNotNull() & F.col("value").isNotNull()).select("item", "field", F.col("value").alias("other")).distinct()
    texts = sheet_cells.filter(F.col("item").isNotNull() & F.col("value").isNotNull()).select("item", "field", "value").distinct()
    differing = materialize(texts.join(known, ["item", "field"]).filter(F.col("other") != F.col("value")))
    members = union_all(
        [
            differing.select("field", "value", F.lit(False).alias("is_reference")),
            differing.select("field", F.col("other").alias("value"), F.lit(True).alias("is_reference")),
        ]
    )
    classes = lookalike_classes(members)
    other_classes = classes.select("field", F.col("value").alias("other"), F.col("canonical").alias("other_canonical"))
    same = differing.join(classes, ["field", "value"]).join(other_classes, ["field", "other"]).filter(F.col("canonical") == F.col("other_canonical"))
    cases = same.select("item", "field", "value").distinct().withColumn("_case", F.lit(True))
    return salted_left_join(sheet_cells, cases, ["item", "field", "value"]).filter("_case").select("row_id", "field").distinct()
