"""Personal data in text: spans, islands of overlapping spans, replacement."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sievework.functions.text import spaced_label

# Surnames, words of forms that are no names, and titles that a name follows.
SURNAMES = "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반라왕금옥육인맹제모탁국어은편용"
FORM_WORDS = "소견 소속 서명 성명 확인 면허 직인 날인 없음 미상 기재 해당"
STAFF_TITLES = "담당의사 처방의사 주치의 집도의 판독의사 판독의 진료의 검사자 조제자 조제약사 담당약사 의사명 약사명"

_NAME = rf"(?!(?:{'|'.join(FORM_WORDS.split())})(?![가-힣]))[{SURNAMES}][가-힣]{{1,3}}(?![가-힣])"
_TITLES = "|".join(spaced_label(t) for t in STAFF_TITLES.split())
_RECORD = r"(?:환\s*자|병\s*원|차\s*트|등\s*록|접\s*수|처\s*방\s*전)\s*"

# The kinds of personal data with their patterns, in order.
RULES = (
    ("주민등록번호", r"\b\d{6}\s*[-–]?\s*[1-8]\d{6}\b", 0),
    ("전화번호", r"\b(?:01[016789]|02|0[3-6][1-5])\s*[-.)]?\s*\d{3,4}\s*[-.]?\s*\d{4}\b", 0),
    ("이메일", r"\b[A-Z0-9._%+-]+\s*@\s*[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I),
    ("생년월일", r"\b(?:19|20)\d{2}\s*[./년-]\s*(?:0?[1-9]|1[0-2])\s*[./월-]\s*(?:0?[1-9]|[12]\d|3[01])\s*일?\b", 0),
    ("생년월일", r"\b\d{2}\s*[./-]\s*(?:0?[1-9]|1[0-2])\s*[./-]\s*(?:0?[1-9]|[12]\d|3[01])\b", 0),
    ("개인식별번호", _RECORD + r"(?:번\s*[호흐로]|I\s*D|N\s*[O0]\.?)\s*[:：]?\s*[^\r\n]{2,40}", re.I),
    ("개인식별번호", _RECORD + r"(?:번\s*[호흐]|I\s*D|N\s*[O0]\.?)\s*[:：]?\s*[A-Z0-9-]{3,}", re.I),
    ("개인식별번호", r"\b(?:P\s*[T7]|P\s*I\s*D|M\s*R\s*N|C\s*H\s*A\s*R\s*T|R\s*X\s*N?)\s*[-:：]\s*[A-Z0-9-]{4,}\b", re.I),
    ("개인식별번호", r"\b[A-Z]{1,4}\s*[-:：]\s*\d{5,}\b", re.I),
    ("개인식별번호", r"제\s*\d{4,}\s*호", 0),
    ("성명", r"(?:성\s*명|환\s*자\s*명|수\s*진\s*자|이\s*름|처방\s*받는\s*분)\s*[:：]?\s*[가-힣]{2,5}", 0),
    ("성명", rf"(?:{_TITLES})\s*[:：]?\s*{_NAME}", 0),
    ("성명", rf"(?:{spaced_label('의사')}|{spaced_label('약사')})\s*[:：]\s*{_NAME}", 0),
    ("주소", r"(?:주\s*소|거\s*주\s*지|소\s*재\s*지)\s*[:：]?\s*[^\r\n]{2,80}", 0),
    ("주소", r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충[청북남]*|전[라북남]*|경[상북남]*|제주)[가-힣0-9\s-]{2,45}(?:로|길|동|읍|면|리|번지|아파트)\s*\d*[가-힣0-9-]*", 0),
)


def _compiled() -> list[tuple[str, re.Pattern[str]]]:
    # word boundaries between ASCII word characters only, as the patterns are meant
    word = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    return [(kind, re.compile(pattern.replace(r"\b", word).replace(r"\d", "[0-9]"), flags)) for kind, pattern, flags in RULES]


COMPILED = _compiled()


def spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """All matches of all rules as (kind, start, end, text), by start, longer first; overlaps are kept."""
    hits = [(kind, m.start(), m.end(), m.group()) for kind, rule in COMPILED for m in rule.finditer(text or "") if m.group()]
    return sorted(hits, key=lambda h: (h[1], -h[2]))


def islands(hits: Iterable[tuple[str, int, int, str]]) -> list[tuple[str, int, int]]:
    """Overlapping spans merged; each island has the kind of its longest span, the first on a tie."""
    out: list[list] = []
    for kind, start, end, _ in hits:
        if out and start < out[-1][2]:
            if end - start > out[-1][3]:
                out[-1][0], out[-1][3] = kind, end - start
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([kind, start, end, end - start])
    return [(k, s, e) for k, s, e, _ in out]


def redact(text: str | None) -> str:
    """Text with every island replaced by a tag of its kind; null as empty."""
    source, out, at = text or "", [], 0
    for kind, start, end in islands(spans(source)):
        out += [source[at:start], f"[비식별:{kind}]"]
        at = end
    return "".join([*out, source[at:]])


SPAN_TYPE = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())]))


@F.arrow_udf(SPAN_TYPE)
def spans_of(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    return pa.array([[{"kind": k, "start": s, "end": e, "text": t} for k, s, e, t in spans(x)] for x in texts.to_pylist()], kind)


@F.arrow_udf(StringType())
def redacted(texts: pa.Array) -> pa.Array:
    return pa.array([redact(x) for x in texts.to_pylist()], pa.string())


def find(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per span: ``key, kind, start, end, text``; offsets in characters, end exclusive."""
    return texts.select(key, F.explode(spans_of(F.col(text))).alias("s")).select(key, "s.*")


def detectable(value: Column, line: Column) -> Column:
    """Whether some span of ``line`` reaches over all of ``value``, its last part."""
    start = F.length(line) - F.length(value)
    return F.exists(spans_of(line), lambda s: (s["start"] <= start) & (s["end"] >= F.length(line)))
