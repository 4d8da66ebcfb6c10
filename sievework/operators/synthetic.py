"""Synthetic documents with known personal data, for measuring redaction: every value follows from the document's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS = ("진단서", "처방전", "검사결과지")
CONDITIONS = ("original", "blur", "tilt", "dark", "glare", "handwriting", "fold", "crumple")
#: Seeds of neighbouring documents differ by this.
SEED_STEP = 13
_SURNAMES = "김이박최정강조윤장임"
_SYLLABLES = "가나다라마바사아자차"


def _digits(seed: Column, factor: int, length: int) -> Column:
    """A number of so many digits that follows from a seed."""
    return F.lpad(F.pmod(seed * factor + factor, F.lit(10**length)).cast("string"), length, "0")


def _letter(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(at, F.lit(len(letters))).cast("int") + 1, F.lit(1))


def documents(spark: SparkSession, repeats: int) -> DataFrame:
    """``doc_id, form, condition, seed``: each form under each condition ``repeats`` times."""
    n = len(FORMS) * len(CONDITIONS) * repeats
    i = F.col("id")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))
    kind = F.floor(i / repeats)
    return spark.range(n).select(
        i.alias("doc_id"), pick(FORMS, F.floor(kind / len(CONDITIONS))).alias("form"), pick(CONDITIONS, kind % len(CONDITIONS)).alias("condition"), (kind * SEED_STEP + i % repeats).cast("bigint").alias("seed")
    )


def items(docs: DataFrame) -> DataFrame:
    """``doc_id, item_no, type, label, value`` of the personal data in each document; numbers are invented and fail any check digit."""
    s = F.col("seed")
    birth = F.concat(F.lpad((s % 60 + 40).cast("string"), 2, "0"), F.lpad((s % 12 + 1).cast("string"), 2, "0"), F.lpad((s % 28 + 1).cast("string"), 2, "0"))
    name = F.concat(_letter(_SURNAMES, s), _letter(_SYLLABLES, s * 3), _letter(_SYLLABLES, s * 7))
    each = [
        ("성명", "성명", name), ("주민등록번호", "주민등록번호", F.concat(birth, F.lit("-"), (s % 4 + 1).cast("string"), _digits(s, 7919, 6))),
        ("전화번호", "전화번호", F.concat(F.lit("010-"), _digits(s, 101, 4), F.lit("-"), _digits(s, 997, 4))), ("이메일", "이메일", F.concat(F.lit("p"), _digits(s, 31, 5), F.lit("@example.invalid"))),
        ("개인식별번호", "환자번호", F.concat(F.lit("PT-"), _digits(s, 613, 6))), ("성명", "담당의사", F.concat(_letter(_SURNAMES, s * 11 + 3), _letter(_SYLLABLES, s + 5), _letter(_SYLLABLES, s * 13))),
    ]
    structs = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(label).alias("label"), v.alias("value")) for k, label, v in each])
    return docs.select("doc_id", F.posexplode(structs).alias("item_no", "i")).select("doc_id", "item_no", "i.*")
