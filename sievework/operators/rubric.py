"""The component rubric: accuracy 40, evidence 25, no invention 20, clarity 15; batches and winners."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators.scoring import with_truth
from sievework.operators.skew import settled, small_side
from sievework.session import materialize

#: The similarity from which a name is partly right here, and the confidence that counts as sure.
PARTIAL_SIMILARITY = 0.82
SURE = 0.85
TIE = 1.0
# Words that tell how an answer was found, words of certainty (and those that only look like it), and claims of a look-up.
METHOD_WORDS = r"(?i)각인|모양|형태|색|분할|식약처|mfds|품목|등록|사진|관찰|대조|일치"
CERTAIN_WORDS = r"(?i)확정|확실|틀림없|명백|100\s*%|단정"
NOT_CERTAIN = "불확실(?:성)?"
CLAIM_WORDS = r"(?i)식약처|mfds|품목\s*(?:id|번호)|(?<![0-9A-Za-z_])db(?![0-9A-Za-z_])"


def _name_parts(tn: Column, tc: Column, pn: Column, pc: Column) -> tuple[Column, Column, Column, Column]:
    """Whether the code is exact, whether the name is, whether it is partly right, and its similarity."""
    code = (tc != "") & (tc == pc)
    name = (tn != "") & (tn == pn)
    similarity = F.when((tn != "") & (pn != ""), T.similarity(tn, pn)).otherwise(0.0)
    contained = (F.least(F.length(tn), F.length(pn)) >= 4) & (tn.contains(pn) | pn.contains(tn))
    partial = ~code & ~name & (tn != "") & (pn != "") & (contained | (similarity >= PARTIAL_SIMILARITY))
    return code, name, partial, similarity


def _category_similarity(a: Column, b: Column) -> Column:
    contained = (F.least(F.length(a), F.length(b)) >= 2) & (a.contains(b) | b.contains(a))
    near = T.similarity(a, b)
    return F.when(a == "", F.lit(None).cast("double")).when(b == "", 0.0).when(a == b, 1.0).when(contained, 0.75).when(near >= 0.75, near).otherwise(0.0)


def cases(results: DataFrame, truths: DataFrame, database: DataFrame | None = None) -> DataFrame:
    """One rubric row per result.

    ``ready`` is false without a truth that names a product or code, or with an error;
    then verdict and scores are null. ``database``: ``result_id, matched, candidate`` of a
    lookup; results without a row have no database evidence. Missing fields count as empty.
    """
    joined = with_truth(results, truths)
    p, a = F.col("prediction"), F.col("truth.answer")
    if database is not None:
        joined = joined.join(database.select("result_id", F.struct("matched", "candidate").alias("db")), "result_id", "left")
    else:
        joined = joined.withColumn("db", F.lit(None).cast("struct<matched:boolean,candidate:string>"))
    base = joined.select(
        "result_id", "run_id", "sample_id", "provider", "model", "db", T.safe("error").alias("error"),
        T.drug_name_rubric(a["drug_name"]).alias("tn"), T.identifier(a["mfds_item_id"]).alias("tc"),
        T.drug_name_rubric(p["drug_name"]).alias("pn"), T.identifier(p["drug_code"]).alias("pc"),
        (T.trimmed(a["front_imprint"]) != "").alias("kf"), (T.trimmed(a["back_imprint"]) != "").alias("kb"),
        T.imprint_rubric(a["front_imprint"]).alias("tf"), T.imprint_rubric(a["back_imprint"]).alias("tb"),
        T.imprint_rubric(p["front_imprint"]).alias("pf"), T.imprint_rubric(p["back_imprint"]).alias("pb"),
        T.category(a["shape"]).alias("ts"), T.category(a["color"]).alias("tcol"), T.category(p["shape"]).alias("ps"), T.category(p["color"]).alias("pcol"),
        T.category(p["front_imprint"]).alias("cf"), T.category(p["back_imprint"]).alias("cb"),
        T.trimmed(T.nfkc(p["evidence"])).alias("evidence"), T.category(p["evidence"]).alias("ce"), T.trimmed(p["uncertainty"]).alias("uncertainty"),
        V.unit_confidence_rubric(p["confidence"]).alias("confidence"), F.coalesce(F.col("truth.condition.expected_readable"), F.lit(True)).alias("readable"),
        *[(T.trimmed(p[c]) != "").alias(f"has_{c}") for c in ("front_imprint", "back_imprint", "shape", "color", "evidence", "uncertainty")],
        T.drug_name_rubric(F.col("db.candidate")).alias("dn"),
    )
    tn, tc, pn, pc = (F.col(x) for x in ("tn", "tc", "pn", "pc"))
    code, name, partial, similarity = _name_parts(tn, tc, pn, pc)
    holds_back = V.abstains(pn, pc, F.col("evidence"), F.col("uncertainty"))
    direct = V.mean_of(F.when(F.col("kf"), T.similarity(F.col("tf"), F.col("pf"))), F.when(F.col("kb"), T.similarity(F.col("tb"), F.col("pb"))))
    swapped = V.mean_of(F.when(F.col("kf"), T.similarity(F.col("tf"), F.col("pb"))), F.when(F.col("kb"), T.similarity(F.col("tb"), F.col("pf"))))
    seen = settled(base).withColumns(
        {
            "ready": ((tn != "") | (tc != "")) & (F.col("error") == ""),
            "similarity": similarity, "exact": code | name, "partial": partial, "abstains": holds_back, "named": (pn != "") | (pc != ""),
            "direct": direct, "swapped": swapped, "shape_similarity": _category_similarity(F.col("ts"), F.col("ps")), "color_similarity": _category_similarity(F.col("tcol"), F.col("pcol")),
        }
    )
    verdict = F.when(F.col("exact"), "correct").when(F.col("partial"), "partial").when(~F.col("readable") & F.col("abstains"), "correct").otherwise("wrong")
    _, db_name, db_partial, _ = _name_parts(tn, tc, F.col("dn"), F.lit(""))
    db_ratio = (
        F.when(F.col("db").isNull(), F.lit(None).cast("double"))
        .when(~F.coalesce(F.col("db.matched"), F.lit(False)), 0.0)
        .when(T.trimmed(F.col("db.candidate")) == "", 0.5)
        .when(db_name, 1.0).when(db_partial, 0.5).otherwise(0.0)
    )
    judged = settled(seen).withColumns(
        {
            "verdict": verdict,
            "orientation": F.when(F.col("swapped") > F.col("direct"), "swapped").otherwise("direct"),
            "imprint_similarity": F.greatest("direct", "swapped"),
            "appearance": V.mean_of(F.col("shape_similarity"), F.col("color_similarity")),
            "db_ratio": db_ratio,
        }
    )
    v, ratio = F.col("verdict"), F.coalesce(F.col("imprint_similarity"), F.lit(0.0))
    cites = F.exists(F.array("cf", "cb", "ps", "pcol"), lambda x: (F.length(x) >= 2) & F.col("ce").contains(x))
    method = F.col("evidence").rlike(METHOD_WORDS)
    stated = F.when(F.col("evidence") == "", 0.0).when(cites | method, 1.0).when(F.length("evidence") >= 12, 0.6).otherwise(0.3)
    stated = stated * F.when((v == "wrong") & (pn != ""), 0.25).otherwise(1.0)
    parts = [
        (F.lit(8.0), F.when(v == "correct", 1.0).when(v == "partial", 0.5).otherwise(0.0), F.lit(True)),
        (F.lit(7.0), ratio, F.col("kf") | F.col("kb")),
        (F.lit(4.0), F.coalesce(F.col("appearance"), F.lit(0.0)), F.col("appearance").isNotNull()),
        (F.lit(3.0), stated, F.lit(True)),
        (F.lit(3.0), F.coalesce(F.col("db_ratio"), F.lit(0.0)), F.col("db_ratio").isNotNull()),
    ]
    earned = sum((F.when(there, w * r).otherwise(0.0) for w, r, there in parts[1:]), parts[0][0] * parts[0][1])
    possible = sum((F.when(there, w).otherwise(0.0) for w, _, there in parts[1:]), parts[0][0])
    honest = V.honest_uncertainty("uncertainty")
    sure = F.coalesce(F.col("confidence") >= SURE, F.lit(False))
    definite = F.regexp_replace(F.concat_ws(" ", "evidence", "uncertainty"), NOT_CERTAIN, "").rlike(CERTAIN_WORDS)
    claims = F.col("evidence").rlike(CLAIM_WORDS)
    named, wrong_side = F.col("named"), v != "correct"
    minus = lambda cond, points: F.when(F.coalesce(cond, F.lit(False)), F.lit(float(points))).otherwise(0.0)
    start = F.when(v == "correct", 20.0).when(~named & honest, 20.0).when(~named, 15.0).when(v == "partial", 14.0).otherwise(6.0)
    invention = (
        start
        - minus(wrong_side & named & sure & (v == "wrong"), 4) - minus(wrong_side & named & sure & (v == "partial"), 3)
        - minus(wrong_side & named & ~honest, 2) - minus(wrong_side & definite, 2)
        - minus(claims & (F.col("db_ratio") < 0.5), 3)
        - minus(named & sure & (F.col("kf") | F.col("kb")) & (ratio < 0.25), 2)
    )
    points = lambda cond, n: F.when(cond, F.lit(float(n))).otherwise(0.0)
    clear = (
        points(named | F.col("abstains"), 4) + points(F.col("has_front_imprint"), 2) + points(F.col("has_back_imprint"), 2) + points(F.col("has_shape"), 1)
        + points(F.col("has_color"), 1) + points(F.col("confidence").isNotNull(), 2) + points(F.col("has_evidence"), 1.5) + points(F.col("has_uncertainty"), 1.5)
    )
    only = lambda c: F.when(F.col("ready"), c)
    return settled(judged).select(
        "result_id", "run_id", "sample_id", "provider", "model", "ready",
        only(v).alias("verdict"),
        only(F.when(v == "correct", 40.0).when(v == "partial", 20.0).otherwise(0.0)).alias("accuracy"),
        only(V.half_up(earned / possible * 25)).alias("evidence"),
        only(F.least(F.lit(20.0), F.greatest(F.lit(0.0), invention))).alias("hallucination"),
        only(V.half_up(clear)).alias("clarity"),
        only(F.round("similarity", 4)).alias("name_similarity"), only(F.round("imprint_similarity", 4)).alias("imprint_similarity"),
        only(F.col("orientation")).alias("orientation"), only(F.round("appearance", 4)).alias("appearance_similarity"),
    )


COMPONENTS = ("accuracy", "evidence", "hallucination", "clarity")
#: Cases of a batch up to which they are added one by one in their order.
ORDERED_CASES = 100


def batches(rows: DataFrame, keys: list[str], order: str = "result_id") -> DataFrame:
    """Scores per batch: means of the components, each rounded half up to a tenth, and their sum; null unless every case is ready.

    Floating sums of tenths depend on the order of addition, and so does what is rounded half up. So a batch
    of at most ``ORDERED_CASES`` cases is added in the order of ``order``; a larger one,
    which no task could hold in order, in whole tenths, exactly. Null keys are a batch as others.
    """
    rows = materialize(rows.select(*keys, F.col(order).alias("_order"), "ready", *COMPONENTS))
    exact = [F.sum(F.round(F.col(c) * 10).cast("bigint")).alias(f"_{c}") for c in COMPONENTS]
    per = rows.groupBy(*keys).agg(F.count("*").alias("n_cases"), F.bool_and("ready").alias("ready"), *exact)
    whole = [F.floor((2 * F.col(f"_{c}") + F.col("n_cases")) / (2 * F.col("n_cases"))) / 10 for c in COMPONENTS]
    large = per.filter(F.col("n_cases") > ORDERED_CASES).select(*keys, "n_cases", "ready", *[F.when(F.col("ready"), w).alias(c) for w, c in zip(whole, COMPONENTS)])
    theirs = small_side(large.select(*[F.col(k).alias(f"_{k}") for k in keys]))
    small = rows.join(theirs, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
    cases = F.array_sort(F.collect_list(F.struct("_order", *COMPONENTS)))
    mean = lambda c: F.aggregate("_cases", F.lit(0.0), lambda total, x: total + F.coalesce(x[c], F.lit(0.0))) / F.col("n_cases")
    folded = small.groupBy(*keys).agg(F.count("*").alias("n_cases"), F.bool_and("ready").alias("ready"), cases.alias("_cases"))
    folded = folded.select(*keys, "n_cases", "ready", *[F.when(F.col("ready"), V.half_up(mean(c))).alias(c) for c in COMPONENTS])
    done = folded.unionByName(large)
    return done.withColumn("total", V.half_up(F.col("accuracy") + F.col("evidence") + F.col("hallucination") + F.col("clarity")))


def winners(totals: DataFrame, batch: str, label: str, tie: float = TIE) -> DataFrame:
    """``batch, vote, difference, n_ranked``: the label with the most points, ``tie`` if the second is within the tolerance.

    Labels without a total are left out; fewer than two give an empty vote. Equal totals rank by label.
    """
    order = Window.partitionBy(batch).orderBy(F.desc("total"), F.col(label))
    ranked = totals.filter(F.col("total").isNotNull()).withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    counts = totals.groupBy(batch).agg(F.count("total").alias("n_ranked"))
    top = ranked.groupBy(batch).agg(F.max(F.when(F.col("rank") == 1, F.col(label))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("total"))).alias("t1"), F.max(F.when(F.col("rank") == 2, F.col("total"))).alias("t2"))
    gap = F.col("t1") - F.col("t2")
    return counts.join(top, batch, "left").select(
        batch, "n_ranked",
        F.when(F.col("n_ranked") < 2, "").when(gap <= tie, "tie").otherwise(F.col("first")).alias("vote"),
        F.when(F.col("n_ranked") >= 2, V.half_up(gap)).alias("difference"),
    )


def passes_assertion(rows: DataFrame) -> DataFrame:
    """External check of a case: correct with imprint of at least 0.8, and each component above its threshold."""
    return rows.select(
        "result_id",
        F.coalesce((F.col("verdict") == "correct") & (F.coalesce("imprint_similarity", F.lit(0.0)) >= 0.8), F.lit(False)).alias("passes"),
        *[F.coalesce(F.col(c) >= least, F.lit(False)).alias(f"{c}_passes") for c, least in (("evidence", 18), ("hallucination", 15), ("clarity", 12))],
    )
