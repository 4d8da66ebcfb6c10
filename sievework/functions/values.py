"""Numbers, booleans, boxes and named classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import BLANK, col, nfkc, safe, trimmed


def finite(x: Column | str) -> Column:
    """A number, or null for NaN and infinities."""
    n = col(x).cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def number_of(x: Column | str) -> Column:
    """Number written in a text, null for anything else."""
    text = trimmed(x)
    return F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), finite(text.try_cast("double")))


def not_negative(x: Column | str) -> Column:
    """A finite number of at least 0, else null."""
    return F.when(finite(x) >= 0, finite(x))


def unit_confidence(x: Column | str) -> Column:
    """Confidence from 0 to 1: above 1 it is a percentage; clamped; null stays null."""
    n = finite(x)
    return F.when(n.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(n > 1, n / 100).otherwise(n))))


def unit_confidence_rubric(x: Column | str) -> Column:
    """As ``unit_confidence``, by dividing only what lies above 1 and up to 100."""
    n = finite(x)
    return F.when(n.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when((n > 1) & (n <= 100), n / 100).otherwise(n))))


def contract_confidence(x: Column | str) -> Column:
    """Confidence from 0 to 100 as agreed; anything outside is null."""
    n = finite(x)
    return F.when(n.between(0, 100), n)


def clamped_confidence(x: Column | str) -> Column:
    """Confidence clamped to 0 to 100; null stays null."""
    n = finite(x)
    return F.when(n.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), n)))


def half_up(x: Column, digits: int = 1) -> Column:
    """Rounded half up, as ``floor(x + 1/2)`` does."""
    factor = 10.0**digits
    return F.floor((x + 2.220446049250313e-16) * factor + 0.5) / factor


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; null without a whole."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10)


def mean_of(*xs: Column) -> Column:
    """Mean of the values that are there; null if none is."""
    n = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


# Words for true and for false, in the contract and in the rubric.
TRUE_WORDS = {"contract": ("true", "1", "yes", "y"), "rubric": ("true", "1", "yes", "y", "가능", "판독가능", "readable")}
FALSE_WORDS = {"contract": ("false", "0", "no", "n"), "rubric": ("false", "0", "no", "n", "불가", "판독불가", "읽기불가", "unreadable")}


def boolean_of(x: Column | str, words: str = "contract", fallback: bool | None = True) -> Column:
    """Boolean written in a text, ``fallback`` for anything else."""
    text = F.lower(trimmed(nfkc(x)))
    return F.when(text.isin(*TRUE_WORDS[words]), True).when(text.isin(*FALSE_WORDS[words]), False).otherwise(F.lit(fallback).cast("boolean"))


def sheet_readable(x: Column | str) -> Column:
    """Whether an answer sheet's row is expected to be readable: unless it says no."""
    return ~F.lower(trimmed(nfkc(x))).rlike("^(?:false|0|no|n)$|불가|unreadable")


def says_unreadable(name: Column, evidence: Column, uncertainty: Column) -> Column:
    """Whether an answer names nothing and says that nothing can be read."""
    text = F.concat_ws(" ", safe(evidence), safe(uncertainty))
    return (trimmed(name) == "") & text.rlike(rf"(?i)판독{BLANK}*불가|식별{BLANK}*불가|확인{BLANK}*불가|unreadable|cannot\s+(?:read|identify)|insufficient")


def abstains(name: Column, code: Column, evidence: Column, uncertainty: Column) -> Column:
    """Rubric: whether an answer with neither name nor code (both normalized) holds back for a stated reason."""
    text = F.concat_ws(" ", safe(uncertainty), safe(evidence))
    said = text.rlike(rf"(?i)판독{BLANK}*불가|식별{BLANK}*불가|확인{BLANK}*불가|근거{BLANK}*부족|불확실|unreadable|unknown|cannot\s+(?:read|identify)|insufficient")
    return (name == "") & (code == "") & said


def honest_uncertainty(x: Column | str) -> Column:
    """Whether an uncertainty is stated that is more than none."""
    text = trimmed(nfkc(x))
    return (text != "") & ~text.rlike(r"(?i)^(?:없음|없다|none|no|확실|확정)$")


# Buckets of photos, in order: the bucket, the words of its readability, of readability or blur together,
# of the blur, and the words of the blur that rule it out.
CLARITY = (
    ("각인 불명확", r"^(?:false|0|no)$|불가|unreadable", None, None, None),
    ("혼합·판단곤란", None, r"혼합|곤란|partial|uncertain", None, None),
    ("각인 불명확", None, None, r"심한|흐림|blur", r"없음|선명|정상|clear"),
)
CLEAR = "각인 명확"


def clarity(readable: Column | str, blur: Column | str) -> Column:
    """Bucket of a photo by its expected readability and blur, the first of ``CLARITY`` that fits, else ``CLEAR``."""
    said, blurred = F.lower(trimmed(nfkc(readable))), F.lower(trimmed(nfkc(blur)))
    both = F.concat_ws(" ", said, blurred)
    out = F.when(F.lit(False), F.lit(""))
    for bucket, said_words, words, blur_words, unless in CLARITY:
        tests = [x.rlike(w) for x, w in ((said, said_words), (both, words), (blurred, blur_words)) if w]
        out = out.when(tests[0] & ~blurred.rlike(unless) if unless else tests[0], bucket)
    return out.otherwise(CLEAR)


# The conditions that make a variant, in order, with the words of the normal case.
NORMAL_CONDITIONS = (
    ("blur", ("없음", "선명", "정상", "none", "clear", "original")),
    ("angle", ("정면", "정상", "0", "front", "original")),
    ("light", ("정상", "일반", "공식", "공식등록", "normal", "standard", "original")),
    ("background", ("단순", "흰색", "백색", "plain", "white", "standard", "original")),
)


def variant_name(explicit: Column | str | None, conditions: dict[str, Column | str]) -> Column:
    """Variant of a photo: as given, else ``field:value`` of the first condition that is not normal, else original."""
    out = F.when(F.lit(False), F.lit("")) if explicit is None else F.when(trimmed(explicit) != "", trimmed(explicit))
    for field, normal in NORMAL_CONDITIONS:
        value = F.lower(trimmed(nfkc(conditions[field])))
        out = out.when((value != "") & ~value.isin(*normal), F.concat(F.lit(f"{field}:"), value))
    return out.otherwise("original")


# Classes of a provider's errors, in order: the class, the HTTP statuses that make it by themselves,
# a status with the words it needs beside it, and the words that make it alone.
ERROR_CLASSES = (
    ("authentication", (401, 403), None, r"auth|unauthor|forbidden|api.?key|permission"),
    ("quota", (), (429, r"quota|billing|credit|insufficient"), r"quota|billing|credit|insufficient_quota"),
    ("rate_limit", (429,), None, r"rate.?limit|too many requests"),
    ("invalid_model", (), None, r"model.*(?:not found|invalid|unsupported|not allowed|access)|invalid_model"),
    ("timeout", (), None, r"timeout|timed out|aborterror"),
    ("invalid_request", (400, 404, 413, 422), None, r"invalid.?request|bad.?request"),
)


def error_class(message: Column | str, status: Column | None = None) -> Column:
    """Class of a provider's error by its text and HTTP status, the first of ``ERROR_CLASSES`` that fits, else upstream; null without either."""
    text, code = F.lower(trimmed(message)), F.coalesce(status, F.lit(0)) if status is not None else F.lit(0)
    out = F.when((text == "") & (code == 0), F.lit(None).cast("string"))
    for name, statuses, with_words, words in ERROR_CLASSES:
        fits = text.rlike(words)
        fits = code.isin(*statuses) | fits if statuses else fits
        out = out.when(((code == with_words[0]) & text.rlike(with_words[1])) | fits if with_words else fits, name)
    return out.otherwise("upstream")


# What a failed call is reported as, in order, with the words that say so.
CALL_ERRORS = (
    ("daily_limit", r"daily api limit|일일.*(?:한도|제한)"),
    ("signed_out", r"(?<![0-9A-Za-z_])401(?![0-9A-Za-z_])|unauthori[sz]ed|access[_ -]?token|인증"),
    ("refused", r"(?<![0-9A-Za-z_])403(?![0-9A-Za-z_])|forbidden"),
    ("model", r"model.*(?:not found|does not exist|access|unsupported|not allowed)|unsupported.*model|invalid.*model"),
    ("limit", r"(?<![0-9A-Za-z_])429(?![0-9A-Za-z_])|rate.?limit|quota|billing|insufficient_quota"),
    ("connection", r"failed to fetch|network|load failed|cors"),
    ("answer_format", r"json|cases 배열|응답 본문|unexpected end|empty response"),
    ("server", r"(?<![0-9A-Za-z_])5[0-9][0-9](?![0-9A-Za-z_])|internal server|bad gateway|service unavailable"),
)
#: What a reader is told of each.
CALL_ERROR_TEXTS = {
    "daily_limit": "The calls of the day are used up; they start anew at midnight in Seoul.", "signed_out": "The session has ended; sign in again.", "refused": "Access was refused.",
    "model": "The account may not use this model.", "limit": "The provider's limit is reached.", "connection": "No connection.", "answer_format": "The model's answer has the wrong form.",
    "server": "The provider's server failed for now.", "other": "The call failed", "unknown": "The call failed for no stated reason.",
}


def call_error(message: Column | str) -> Column:
    """Kind of a failed call by its message: the first of ``CALL_ERRORS`` that fits, other for any other text, unknown without one."""
    text = trimmed(message)
    out = F.when(text == "", "unknown")
    for kind, words in CALL_ERRORS:
        out = out.when(text.rlike(f"(?i){words}"), kind)
    return out.otherwise("other")


def call_error_text(message: Column | str) -> Column:
    """A failed call for readers; of another error the first 180 characters of its message."""
    kind = call_error(message)
    told = F.element_at(F.create_map(*[F.lit(x) for pair in CALL_ERROR_TEXTS.items() for x in pair]), kind)
    return F.when(kind == "other", F.concat(told, F.lit(": "), F.substring(trimmed(message), 1, 180))).otherwise(told)


def storage_error(name: Column | str, message: Column | str) -> Column:
    """Why storing failed, by the error's name and message: quota, blocked or unknown."""
    text = F.concat(safe(name), F.lit(" "), safe(message))
    return F.when(text.rlike("(?i)quota|exceeded"), "quota").when(text.rlike("(?i)security|denied|access"), "blocked").otherwise("unknown")


def error_text(x: Column | str) -> Column:
    """Text of an error given as text or as a JSON object: its message, error or detail, else the object itself; null for nothing."""
    raw = trimmed(x)
    parts = [F.nullif(trimmed(F.get_json_object(raw, f"$.{k}")), F.lit("")) for k in ("message", "error", "detail")]
    return F.when(raw == "", F.lit(None).cast("string")).when(raw.startswith("{"), F.coalesce(*parts, raw)).otherwise(raw)


def epoch_ms(x: Column | str) -> Column:
    """Milliseconds since 1970 of a time written as text, 0 where it is none; for ordering."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(trimmed(x))), F.lit(0).cast("bigint"))


def time_stamp(ts: Column | str) -> Column:
    """A time as digits, for file names."""
    return F.date_format(ts, "yyyyMMddHHmmss")


# Characters taken for each other on a pill, by what they are read as.
CONFUSED_MARKS = (("O", "0"), ("ILT", "1"), ("S", "5"), ("B", "8"))
# Colours that pass for each other on photos.
NEAR_COLORS = (("분홍", "주황"), ("하양", "회색"), ("노랑", "주황"))


def mark_key(x: Column | str) -> Column:
    """An imprint with characters that are taken for each other as one."""
    letters, digits = "".join(a for a, _ in CONFUSED_MARKS), "".join(d * len(a) for a, d in CONFUSED_MARKS)
    return F.translate(F.upper(safe(x)), letters, digits)


def mark_within(mark: Column | str, seen: Column | str) -> Column:
    """Whether a registered imprint is part of a read one: a beginning or end of two characters or more, any part of three or more."""
    m, s = safe(mark), safe(seen)
    return ((F.length(m) >= 2) & (s.startswith(m) | s.endswith(m))) | ((F.length(m) >= 3) & s.contains(m))


def same_color(a: Column, b: Column) -> Column:
    """Whether two values of colours joined by | share one."""
    split = lambda x: F.filter(F.split(safe(x), r"\|"), lambda t: t != "")
    return F.arrays_overlap(split(a), split(b))


def near_color(a: Column, b: Column) -> Column:
    """Whether two values of colours share one or have two that pass for each other on photos."""
    has = lambda x, name: F.array_contains(F.split(safe(x), r"\|"), name)
    near = F.lit(False)
    for x, y in NEAR_COLORS:
        near = near | (has(a, x) & has(b, y)) | (has(a, y) & has(b, x))
    return same_color(a, b) | near


def match_level(level: Column | str, confidence: Column, blur: Column, glare: Column, cropped: Column, conflict: Column) -> Column:
    """A match's level: high becomes mid below 70 % confidence, above 0.6 blur or glare, on a cropped pill, or if shape or colour disagree."""
    doubt = F.coalesce(confidence < 0.7, F.lit(False)) | F.coalesce(blur > 0.6, F.lit(False)) | F.coalesce(glare > 0.6, F.lit(False))
    doubt = doubt | F.coalesce(cropped, F.lit(False)) | F.coalesce(conflict, F.lit(False))
    return F.when((col(level) == "high") & doubt, "mid").otherwise(col(level))


def rotated_box(b: Column, degrees: Column, width: Column, height: Column, out_width: Column, out_height: Column) -> Column:
    """The upright box around ``b`` once its page is turned about its centre and laid on the centre of another page."""
    angle = F.radians(degrees)
    corners = F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")])
    turned = F.transform(
        corners,
        lambda c: F.struct(
            ((c["x"] - width / 2) * F.cos(angle) - (c["y"] - height / 2) * F.sin(angle) + out_width / 2).alias("x"),
            ((c["x"] - width / 2) * F.sin(angle) + (c["y"] - height / 2) * F.cos(angle) + out_height / 2).alias("y"),
        ),
    )
    xs, ys = F.transform(turned, lambda c: c["x"]), F.transform(turned, lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def retryable(kind: Column) -> Column:
    """Whether a call with this class of error may be tried again."""
    return F.coalesce(kind.isin("timeout", "rate_limit", "upstream"), F.lit(False))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Box with ordered corners; what is not finite is 0."""
    a, b, c, d = (F.coalesce(finite(v), F.lit(0.0)) for v in (x0, y0, x1, y1))
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def sized_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Box from its corner and its size; a negative size turns it over."""
    n = lambda v: F.coalesce(finite(v), F.lit(0.0))
    return box(n(x), n(y), n(x) + n(w), n(y) + n(h))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def shared_area(a: Column, b: Column) -> Column:
    """Area of two boxes' intersection."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def overlap(a: Column, b: Column) -> Column:
    """Intersection by the smaller area; 0 for an empty box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, shared_area(a, b) / least).otherwise(0.0)


def seoul_day(ts: Column | str) -> Column:
    """Calendar day in Seoul of a UTC time."""
    return F.to_date(F.from_utc_timestamp(col(ts), "Asia/Seoul"))


def metric_text(x: Column, kind: str) -> Column:
    """A metric for readers: ratio, usd, ms, count, else three decimals; a dash for null."""
    shown = {
        "ratio": F.format_string("%.1f%%", x.cast("double") * 100), "usd": F.format_string("$%.6f", x.cast("double")), "ms": F.format_string("%.0f ms", x.cast("double")), "count": F.format_number(x, 0),
    }.get(kind, F.format_string("%.3f", x.cast("double")))
    return F.when(finite(x).isNull(), "—").otherwise(shown)
