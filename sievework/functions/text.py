"""Text normalisers as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Blanks that trimming removes, beyond ASCII.
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe(x: Column | str) -> Column:
    """Null as empty text."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def trimmed(x: Column | str) -> Column:
    """Text without blanks of any kind at its ends; null as empty."""
    return F.regexp_replace(safe(x), f"^{BLANK}+|{BLANK}+$", "")


def first_filled(*xs: Column | str) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(safe(x), F.lit("")) for x in xs], F.lit(""))


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array([unicodedata.normalize("NFKC", v) if v is not None and not v.isascii() else v for v in values.to_pylist()], pa.string())


def nfkc(x: Column | str) -> Column:
    """Compatibility composition; null as empty. Spark has no built-in for it, so this is an Arrow function."""
    return _nfkc(safe(x))


def word_bounded(inner: str) -> str:
    """A pattern between ASCII word boundaries, which Java's \\b are not."""
    return rf"(?<![0-9A-Za-z_])(?:{inner})(?![0-9A-Za-z_])"


ALNUM = "[^0-9A-Za-z가-힣]"
BRACKETED = r"\([^)]*\)|\[[^\]]*\]"


def drug_name(x: Column | str) -> Column:
    """Product name for scoring: no bracketed parts, doses or signs, lower case."""
    text = F.regexp_replace(nfkc(x), BRACKETED, "")
    text = F.regexp_replace(text, "(?i)" + word_bounded(r"\d+(?:\.\d+)?\s*(?:mg|mcg|g)"), "")
    text = F.regexp_replace(text, r"\d+(?:\.\d+)?\s*(?:㎎|밀리그램|그램)", "")
    return F.lower(F.regexp_replace(text, ALNUM, ""))


def drug_name_rubric(x: Column | str) -> Column:
    """Product name for the rubric: more units are doses than in scoring."""
    text = F.regexp_replace(F.lower(nfkc(x)), BRACKETED, "")
    text = F.regexp_replace(text, word_bounded(r"\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)"), "")
    text = F.regexp_replace(text, r"\d+(?:\.\d+)?\s*(?:㎎|㎍|㎖|밀리그램|마이크로그램|그램|밀리리터)", "")
    return F.regexp_replace(text, "[^0-9a-z가-힣]", "")


def drug_name_suggested(x: Column | str) -> Column:
    """Product name for verdict suggestions: a unit counts only where an ASCII word ends."""
    text = F.regexp_replace(nfkc(x), BRACKETED, "")
    text = F.regexp_replace(text, r"(?i)(?<![0-9A-Za-z_])\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)(?![0-9A-Za-z_])", "")
    return F.lower(F.regexp_replace(text, ALNUM, ""))


def imprint(x: Column | str) -> Column:
    """Imprint for scoring; words for nothing or nothing readable become ∅."""
    text = trimmed(nfkc(x))
    none = r"(?i)^(?:없음|무각인|빈면|확인불가|판독불가|none|blank|unreadable|unknown|[-—–])$"
    return F.when(text.rlike(none), F.lit("∅")).otherwise(F.upper(F.regexp_replace(text, ALNUM, "")))


def imprint_rubric(x: Column | str) -> Column:
    """Imprint for the rubric: nothing there is ∅, nothing readable is ?."""
    text = trimmed(nfkc(x))
    return (
        F.when(text.rlike(r"(?i)^(?:없음|무각인|빈면|blank|none|[-—–])$"), F.lit("∅"))
        .when(text.rlike(r"(?i)^(?:확인불가|판독불가|식별불가|unreadable|unknown)$"), F.lit("?"))
        .otherwise(F.regexp_replace(F.upper(text), "[^0-9A-Z가-힣]", ""))
    )


def identifier(x: Column | str) -> Column:
    """Identifier: upper case, letters and digits only."""
    return F.regexp_replace(F.upper(trimmed(nfkc(x))), "[^0-9A-Z가-힣]", "")


def category(x: Column | str) -> Column:
    """Category: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(trimmed(nfkc(x))), "[^0-9a-z가-힣]", "")


def header_name(x: Column | str) -> Column:
    """Header cell: a category without byte-order mark."""
    return category(F.regexp_replace(safe(x), "^\\x{FEFF}", ""))


def image_key(x: Column | str) -> Column:
    """File name without folders, lower case."""
    return F.lower(F.element_at(F.split(F.replace(trimmed(nfkc(x)), F.lit("\\"), F.lit("/")), "/"), -1))


def similarity(a: Column, b: Column) -> Column:
    """One less the share of edits; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))


def character_error_rate(truth: Column, answer: Column) -> Column:
    """Edits by length of the truth; without truth 1 for any answer, else 0. May exceed 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(answer) > 0, 1.0).otherwise(0.0)).otherwise(F.levenshtein(truth, answer) / F.length(truth))


def registry_mark(x: Column | str) -> Column:
    """Imprint of the registry: nothing for the words that say so, marker words and signs go, upper case; no compatibility folding."""
    text = safe(x)
    bare = F.regexp_replace(F.regexp_replace(text, "분할선|마크|식별", ""), ALNUM, "")
    return F.when(text.isin("", "없음", "확인불가"), F.lit("")).otherwise(F.upper(bare))


def markup_free(x: Column | str, limit: int | None = None) -> Column:
    """Readable text of markup: CDATA opened before tags go, breaks and block ends as lines, entities decoded, blanks collapsed.

    Texts longer than ``limit`` characters are cut there and end in …
    """
    text = F.regexp_replace(safe(x), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|PARAGRAPH|ARTICLE|SECTION)>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, r"[ \x{3000}\t]+", " ")
    text = trimmed(F.regexp_replace(text, r"\n{2,}", "\n"))
    return text if limit is None else F.when(F.length(text) > limit, F.concat(trimmed(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def titled_markup_free(x: Column | str, limit: int | None = None) -> Column:
    """``markup_free`` of a document whose articles carry their title as an attribute; the title becomes a line."""
    return markup_free(F.regexp_replace(safe(x), r"(?i)<ARTICLE[^>]*title=\"([^\"]*)\"[^>]*>", "\n$1\n"), limit)


def json_part(x: Column | str) -> Column:
    """The JSON in a model's answer: without code fences, from the first opening to the last matching bracket."""
    text = trimmed(F.regexp_replace(F.regexp_replace(trimmed(x), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    brace, bracket = F.locate("{", text), F.locate("[", text)
    is_list = (bracket > 0) & ((brace == 0) | (bracket < brace))
    part = F.when(is_list, F.regexp_extract(text, r"(?s)(\[.*\])", 1)).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.when(part == "", text).otherwise(part)


def csv_cell(x: Column | str) -> Column:
    """One quoted cell: line breaks as blanks, formula starts disarmed."""
    text = F.regexp_replace(safe(x), r"\r\n|\r|\n", " ")
    text = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def spreadsheet_text(x: Column | str) -> Column:
    """Cell text of a workbook: formula starts and tabs disarmed, any line break as line feed."""
    text = F.regexp_replace(safe(x), r"\r\n?", "\n")
    return F.when(text.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), text)).otherwise(text)


def phone_repaired(x: Column | str) -> Column:
    """A telephone number as read by OCR with its look-alike letters as digits; null if it has no number's shape."""
    text = safe(x)
    digits = F.regexp_replace(F.translate(F.upper(text), "OQDIL|ZSB", "000111258"), "[^0-9-]", "")
    hyphens = F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit("")))
    return F.when((hyphens >= 2) & digits.rlike(r"^\d{1,3}-\d{3,4}-\d{4,5}$"), digits)


def text_width(x: Column | str, size: float) -> Column:
    """Estimated width in pixels: Hangul a full em, letters and digits 0.56, the rest 0.4."""
    text = safe(x)
    hangul = F.length(text) - F.length(F.regexp_replace(text, "[가-힣]", ""))
    alnum = F.length(text) - F.length(F.regexp_replace(text, "[0-9A-Za-z]", ""))
    return F.ceil((hangul + alnum * 0.56 + (F.length(text) - hangul - alnum) * 0.4) * size)


# The standard colours in order, with the words that stand for each.
COLORS = (
    ("하양", "하양|흰|백색|화이트|아이보리|미백|유백"),
    ("노랑", "노랑|노란|황색|담황|미황|연노랑|황갈"),
    ("주황", "주황|오렌지|살구|귤"),
    ("분홍", "분홍|핑크|연분홍|살색"),
    ("빨강", "빨강|빨간|적색|레드|자적|진홍"),
    ("갈색", "갈색|브라운|밤색|적갈|황토|커피"),
    ("파랑", "파랑|파란|청색|블루|하늘"),
    ("남색", "남색|네이비|짙은파랑|어두운파랑"),
    ("청록", "청록|틸|민트"),
    ("초록", "초록|녹색|그린|진녹"),
    ("연두", "연두|연녹|라임|연초록"),
    ("보라", "보라|자주|퍼플|바이올렛|라벤더"),
    ("회색", "회색|그레이|은색|회백"),
    ("검정", "검정|검은|흑색|블랙"),
    ("투명", "투명|무색"),
)


def colors(x: Column | str) -> Column:
    """The colours of a value, in order and without repeats, joined by |; words of no colour stay."""
    tokens = F.filter(F.split(safe(x), r"[|,/·+\s]+"), lambda t: t != "")

    def one(token: Column) -> Column:
        chain = F.when(token.rlike(COLORS[0][1]), F.lit(COLORS[0][0]))
        for name, pattern in COLORS[1:]:
            chain = chain.when(token.rlike(pattern), F.lit(name))
        return chain.otherwise(token)

    return F.array_join(F.array_distinct(F.transform(tokens, one)), "|")


def xml_escaped(text: object) -> str:
    """Text for an XML or HTML document."""
    out = "" if text is None else str(text)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = out.replace(plain, entity)
    return out


def column_letters(index: int) -> str:
    """Letters of a sheet's column: 0 is A, 26 is AA."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def spaced_label(label: str) -> str:
    """Pattern of a label whose characters may have been split apart."""
    import re

    return r"\s*".join(re.escape(ch) for ch in label)


def leaves(value: object, label: str | None = None) -> list[tuple[str | None, str]]:
    """The texts within a nested value with their labels: an object's title first, then the rest in order."""
    if isinstance(value, dict):
        order = sorted(value.items(), key=lambda kv: kv[0].lower() != "title")
        return [x for k, v in order for x in leaves(v, k)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v, label)]
    return [] if value is None or isinstance(value, bool) or not str(value).strip() else [(label, str(value))]


@F.arrow_udf(StringType())
def _flattened(values: pa.Array) -> pa.Array:
    import json

    def one(text: str | None) -> str | None:
        if text is None or text.lstrip()[:1] not in ("{", "["):
            return text
        try:
            return "\n".join(t for _, t in leaves(json.loads(text)))
        except (ValueError, RecursionError):
            return text

    return pa.array([one(v) for v in values.to_pylist()], pa.string())


def document_text(x: Column | str, limit: int | None = None) -> Column:
    """Readable text of a document given as markup or as a JSON object of nested parts; texts longer than ``limit`` end in …"""
    return titled_markup_free(_flattened(safe(x)), limit)
