"""Responses scored against the ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V
from sievework.operators.skew import lookup_join, settled

#: The similarity from which a name is partly right, and the confidence from which a wrong one is dangerous.
PARTIAL_SIMILARITY = 0.72
DANGEROUS_CONFIDENCE = 0.8

ANSWER_FIELDS = ("mfds_item_id", "drug_name", "front_imprint", "back_imprint", "shape", "color")
CONDITION_FIELDS = ("expected_readable", "light", "background", "blur", "angle", "variant")


def variant_or_original(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("original"))


def with_truth(results: DataFrame, truths: DataFrame, order: str = "gt_id") -> DataFrame:
    """Every result with ``truth``: the record of its sample and variant, else the sample's first, else null.

    Of several records for one sample and variant the last by ``order`` counts, of a
    sample the first; results keep their number of rows. Both sides of the lookup are
    aggregated before they are shuffled, and results join on salted keys, as one
    sample may hold a large part of them. Samples without id match nothing.
    """
    kept = F.struct(F.col("sample_id"), F.col("answer"), F.col("condition"))
    given = truths.filter(F.col("sample_id").isNotNull())
    exact = given.groupBy("sample_id", variant_or_original(F.col("condition.variant")).alias("_variant")).agg(F.max_by(kept, order).alias("_exact"))
    first = given.groupBy("sample_id").agg(F.min_by(kept, order).alias("_first"))
    keyed = results.withColumn("_variant", variant_or_original(F.col("meta")["variant"]))
    joined = lookup_join(keyed, exact, ["sample_id", "_variant"])
    joined = lookup_join(joined, first, ["sample_id"], counted=results)
    return joined.withColumn("truth", F.coalesce("_exact", "_first")).drop("_variant", "_exact", "_first")


def score(results: DataFrame, truths: DataFrame, prices: DataFrame | None = None, with_answer: bool = False) -> DataFrame:
    """One scored row per result, flat: identity, class, metrics, scores and conditions.

    A missing truth counts as empty answers, a missing prediction likewise; a non-empty
    ``error`` makes the class ``error``. Confidence may be a share or a percentage.
    With ``prices``, tokens are priced where the provider gave no cost; the
    ``cost_source`` says which. Null latency is 0. ``with_answer``: the truth's answer stays, as ``answer``.
    """
    joined = with_truth(results, truths)
    p, a, c = F.col("prediction"), F.col("truth.answer"), F.col("truth.condition")
    base = joined.select(
        "result_id", "run_id", F.coalesce(F.nullif(F.col("sample_id"), F.lit("")), "truth.sample_id", F.lit("")).alias("sample_id"), "provider", "model",
        variant_or_original(F.coalesce(F.nullif(F.col("meta")["variant"], F.lit("")), c["variant"])).alias("variant"),
        T.drug_name(a["drug_name"]).alias("tn"), T.drug_name(p["drug_name"]).alias("pn"),
        T.imprint(a["front_imprint"]).alias("tf"), T.imprint(a["back_imprint"]).alias("tb"),
        T.imprint(p["front_imprint"]).alias("pf"), T.imprint(p["back_imprint"]).alias("pb"),
        *([a.alias("answer")] if with_answer else []), p.alias("prediction"), V.unit_confidence(p["confidence"]).alias("confidence"),
        c["expected_readable"].alias("expected_readable"), *[c[f].alias(f) for f in ("light", "background", "blur", "angle")],
        T.safe("error").alias("error"), F.coalesce(V.finite("latency_ms"), F.lit(0.0)).alias("latency_ms"),
        F.col("usage"), "created_at",
    )
    sim = settled(base).withColumns(
        {
            "name_similarity": F.when((F.col("tn") == "") | (F.col("pn") == ""), 0.0).otherwise(T.similarity(F.col("tn"), F.col("pn"))),
            "ff": T.similarity(F.col("tf"), F.col("pf")), "bb": T.similarity(F.col("tb"), F.col("pb")),
            "fb": T.similarity(F.col("tf"), F.col("pb")), "bf": T.similarity(F.col("tb"), F.col("pf")),
        }
    )
    named = (F.col("tn") != "") & (F.col("pn") != "")
    contained = (F.least(F.length("tn"), F.length("pn")) >= 4) & (F.col("tn").contains(F.col("pn")) | F.col("pn").contains(F.col("tn")))
    swapped = (F.col("fb") + F.col("bf")) / 2 > (F.col("ff") + F.col("bb")) / 2
    marked = settled(sim).withColumns(
        {
            "exact_match": named & (F.col("tn") == F.col("pn")),
            "partial_match": named & (F.col("tn") != F.col("pn")) & ((F.col("name_similarity") >= PARTIAL_SIMILARITY) | contained),
            "swapped": swapped,
        }
    )
    swap = F.col("swapped")
    blank_name = T.trimmed(p["drug_name"]) == ""
    unreadable = V.says_unreadable(p["drug_name"], p["evidence"], p["uncertainty"]) | (blank_name & (F.coalesce(F.col("expected_readable"), F.lit(True)) == F.lit(False)))
    classed = settled(marked).withColumns(
        {
            "classification": F.when(F.col("error") != "", "error").when(unreadable, "unreadable").when(F.col("exact_match"), "correct").when(F.col("partial_match"), "partial").otherwise("incorrect"),
            "front_similarity": F.when(swap, F.col("fb")).otherwise(F.col("ff")),
            "back_similarity": F.when(swap, F.col("bf")).otherwise(F.col("bb")),
            "front_cer": T.character_error_rate(F.col("tf"), F.when(swap, F.col("pb")).otherwise(F.col("pf"))),
            "back_cer": T.character_error_rate(F.col("tb"), F.when(swap, F.col("pf")).otherwise(F.col("pb"))),
        }
    )
    present = [T.trimmed(p["drug_name"]) != "", T.trimmed(p["front_imprint"]) != "", T.trimmed(p["back_imprint"]) != "", F.col("confidence").isNotNull(), T.trimmed(T.first_filled(p["evidence"], p["uncertainty"])) != ""]
    hit = (F.col("classification") == "correct").cast("double")
    measured = settled(classed).withColumns(
        {
            "imprint_cer": (F.col("front_cer") + F.col("back_cer")) / 2,
            "imprint_similarity": (F.col("front_similarity") + F.col("back_similarity")) / 2,
            "brier": F.pow(F.col("confidence") - hit, F.lit(2.0)),
            "completeness": sum((x.cast("int") for x in present[1:]), present[0].cast("int")) / 5,
            "dangerous": (F.col("classification") == "incorrect") & ~blank_name & F.coalesce(F.col("confidence") >= DANGEROUS_CONFIDENCE, F.lit(False)),
        }
    )
    total = (
        F.when(F.col("classification") == "correct", 40).when(F.col("classification") == "partial", 20).otherwise(0)
        + F.col("imprint_similarity") * 25
        + F.when(F.col("brier").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("brier")) * 15)
        + F.col("completeness") * 20
    )
    scored = settled(measured).withColumn("legacy_score", total).withColumn("orientation", F.when(swap, "swapped").otherwise("direct"))
    if prices is not None:
        scored = with_cost(scored, prices)
    return scored.drop("tn", "tf", "tb", "pf", "pb", "ff", "bb", "fb", "bf", "swapped").withColumnRenamed("pn", "predicted_name_key")


def with_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """``rows`` with ``cost_usd`` and ``cost_source``.

    A provider's own cost counts first; else tokens by the price of provider (any case) and
    model, per million, with cached tokens at their own price (that of input if none);
    a missing count is 0 if another is there. Without price or count the cost is null.
    """
    u = F.col("usage")
    tokens = {k: V.finite(u[k]) for k in ("input_tokens", "output_tokens", "cached_tokens")}
    price = prices.groupBy(F.lower("provider").alias("_p"), F.col("model").alias("_m")).agg(
        F.max_by(F.struct("input", "output", "cached"), F.coalesce("input", F.lit(0.0))).alias("_price")
    )
    joined = lookup_join(rows.withColumn("_p", F.lower("provider")).withColumn("_m", F.col("model")), price, ["_p", "_m"])
    some = tokens["input_tokens"].isNotNull() | tokens["output_tokens"].isNotNull() | tokens["cached_tokens"].isNotNull()
    zero = {k: F.coalesce(v, F.lit(0.0)) for k, v in tokens.items()}
    rate = {k: F.coalesce(F.col("_price")[k], F.lit(0.0)) for k in ("input", "output")}
    priced = (
        F.greatest(F.lit(0.0), zero["input_tokens"] - zero["cached_tokens"]) * rate["input"]
        + zero["output_tokens"] * rate["output"]
        + zero["cached_tokens"] * F.coalesce(F.col("_price")["cached"], rate["input"])
    ) / 1e6
    direct = V.finite(u["cost_usd"])
    known = F.col("_price").isNotNull()
    return joined.withColumns(
        {
            "cost_usd": F.coalesce(direct, F.when(known & some, priced)),
            "cost_source": F.when(direct.isNotNull(), "provider").when(known & some, "pricing_table").when(known, "usage_missing").otherwise("pricing_unknown"),
        }
    ).drop("_p", "_m", "_price")
