"""Blind comparisons: ratings, leaderboard, run storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V


def accuracy_points(verdict: Column | str, score: Column | str) -> Column:
    """Points of a case: a manual score from 0 to 40 counts before the verdict (40, 20, 0); null for neither."""
    manual = V.finite(score)
    by_verdict = F.when(T.col(verdict) == "correct", 40.0).when(T.col(verdict) == "partial", 20.0).when(T.col(verdict) == "wrong", 0.0)
    return F.when(manual.between(0, 40), manual).otherwise(by_verdict)


def suggested_verdict(truth: Column | str, answer: Column | str) -> Column:
    """Verdict by the names alone: equal, one within the other, else wrong; empty without both."""
    a, b = T.drug_name_suggested(truth), T.drug_name_suggested(answer)
    return F.when((a == "") | (b == ""), "").when(a == b, "correct").when(a.contains(b) | b.contains(a), "partial").otherwise("wrong")


def leaderboard(ratings: DataFrame, totals: DataFrame, votes: DataFrame) -> DataFrame:
    """Per model: batches, rated cases, accuracy in percent, mean total, wins, ties.

    ``ratings``: a row per case with ``run_id, provider, model, verdict, score``; ``totals``: ``run_id,
    provider, model, total``; ``votes``: ``run_id, vote`` (a model or tie). A tie counts for every model of its run.
    """
    points = accuracy_points("verdict", "score") / 40
    cases = ratings.groupBy("provider", "model").agg(
        F.countDistinct("run_id").alias("batches"), F.count(points).alias("rated"), F.round(F.avg(points) * 100, 4).alias("accuracy")
    )
    voted = totals.join(votes, "run_id", "left")
    # totals have few decimals: summed as whole ten-thousandths, their mean does not depend on the order
    whole = F.sum(F.round(F.col("total") * 10_000).cast("bigint"))
    sums = voted.groupBy("provider", "model").agg(
        F.round(F.try_divide(whole, F.count("total")) / 10_000, 4).alias("mean_total"), F.count_if(F.col("vote") == F.col("model")).alias("wins"), F.count_if(F.col("vote") == "tie").alias("ties")
    )
    return cases.join(sums, ["provider", "model"], "left")


def condition_accuracy(ratings: DataFrame, column: str, unknown: str = "미상") -> DataFrame:
    """Rated cases and accuracy per value of a condition."""
    points = accuracy_points("verdict", "score") / 40
    return ratings.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown)).alias("value")).agg(
        F.count(points).alias("rated"), F.round(F.avg(points) * 100, 4).alias("accuracy")
    ).filter("rated > 0")


def apportioned(usage: Column | str, n_cases: Column | str) -> Column:
    """A batch's usage shared out over its cases; missing counts stay missing."""
    u, n = T.col(usage), F.greatest(T.col(n_cases), F.lit(1))
    return F.struct(*[(V.finite(u[c]) / n).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "cost_usd")])


def merge_runs(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both sets without repeats: of rows with equal ``keys`` the incoming one, then the last by ``order``."""
    both = existing.withColumn("_from", F.lit(0)).unionByName(incoming.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    whole = F.struct(*[c for c in both.columns if c != "_from"])
    return both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(whole, F.struct("_from", order)).alias("_r")).select("_r.*")


def new_runs(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming runs that are not there yet."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def retained(runs: DataFrame, when: str, key: str, most: int) -> DataFrame:
    """The latest ``most`` runs by time, then key; a top-k, so each task keeps no more than that many."""
    return runs.orderBy(F.desc_nulls_last(when), F.desc(key)).limit(most)


def evicted_to_fit(runs: DataFrame, when: str, key: str, size: str, limit: int) -> DataFrame:
    """The latest runs whose sizes together stay within ``limit`` bytes; runs without a time count as the oldest.

    Sizes are summed per hour, and the running sums over hours, one row each, tell which hours stay whole; only the runs
    of the one hour in which the limit is reached are put in order.
    """
    hour = F.coalesce(F.date_trunc("hour", F.col(when).cast("timestamp")), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    hourly = runs.groupBy(hour.alias("_hour")).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("_bytes"))
    latest = Window.orderBy(F.desc("_hour"))  # a row per hour
    summed = hourly.withColumn("_before", F.coalesce(F.sum("_bytes").over(latest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reached = summed.filter(F.col("_before") + F.col("_bytes") > limit).agg(F.max("_hour").alias("_cut"))
    marked = runs.withColumn("_hour", hour).join(F.broadcast(summed.select("_hour", "_before")), "_hour").crossJoin(F.broadcast(reached))  # hours, and one row
    whole = marked.filter(F.col("_cut").isNull() | (F.col("_hour") > F.col("_cut"))).select(*runs.columns)
    newest = Window.partitionBy("_hour").orderBy(F.desc_nulls_last(when), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    last = marked.filter(F.col("_hour") == F.col("_cut")).withColumn("_upto", F.col("_before") + F.sum(F.coalesce(F.col(size), F.lit(0))).over(newest))
    return whole.unionByName(last.filter(F.col("_upto") <= limit).select(*runs.columns))


def rating_source(automatic: Column, verdicts: Column, scores: Column, auto_verdicts: Column, components: dict[str, tuple[Column, Column]]) -> Column:
    """Where a rating comes from and what a person changed: ``source`` (automatic, manual_override, manual) and ``changed``.

    ``automatic``: whether there is an automatic rating; a case counts as changed (``case_1`` on) if its verdict differs or its points do by more
    than 0.05, a component (given, automatic) likewise.
    """
    def case(v: Column, i: Column) -> Column:
        auto = F.try_element_at(auto_verdicts, i + 1)
        used, own = accuracy_points(v, F.try_element_at(scores, i + 1)), accuracy_points(auto, F.lit(None).cast("double"))
        differs = (T.safe(v) != "") & ~v.eqNullSafe(auto)
        return F.when(differs | F.coalesce(F.abs(used - own) > 0.05, F.lit(False)), F.concat(F.lit("case_"), (i + 1).cast("string")))

    cases = F.filter(F.transform(verdicts, case), lambda x: x.isNotNull())
    parts = F.array_compact(F.array(*[F.when(F.coalesce(F.abs(V.finite(given) - own) > 0.05, F.lit(False)), F.lit(name)) for name, (given, own) in components.items()]))
    changed = F.when(automatic, F.concat(cases, parts)).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(~automatic, "manual").when(F.size(changed) > 0, "manual_override").otherwise("automatic").alias("source"), changed.alias("changed"))


def storage_report(runs: DataFrame, limit: int) -> DataFrame:
    """Runs, bytes as JSON, mean per run, what is left of the limit."""
    size = F.octet_length(F.to_json(F.struct(*runs.columns)))
    return runs.agg(F.count("*").alias("runs"), F.sum(size).alias("bytes"), F.round(F.avg(size), 2).alias("bytes_per_run")).withColumn(
        "remaining", F.greatest(F.lit(0), F.lit(limit) - F.coalesce("bytes", F.lit(0)))
    )


def pruned(results: DataFrame) -> DataFrame:
    """Results as they may be stored: without raw payloads and without evidence texts."""
    return results.drop("raw").withColumn("prediction", F.col("prediction").dropFields("evidence", "uncertainty"))


def vote_source(manual: Column, automatic: Column) -> Column:
    """Where a vote comes from: automatic if it follows the recommendation, else manual; empty without a vote."""
    return F.when(T.safe(manual) == "", "").when(manual == automatic, "automatic").otherwise("manual_override")


def changed_fields(automatic: dict[str, Column], given: dict[str, Column]) -> Column:
    """Names of the scores a person changed by more than 0.05."""
    return F.array_compact(F.array(*[F.when(F.abs(given[k] - automatic[k]) > 0.05, F.lit(k)) for k in automatic]))
