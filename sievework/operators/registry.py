"""The product registry: entries, deduplication, tagging, cumulative merge, efficacy, history, sample selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.skew import salted_left_join

# The kinds of substances that are tagged, and the least length of a name by language.
TAGGED_TYPES = ("마약", "향정신성의약품", "대마")
LEAST_LENGTH = {"kr": 2, "eng": 5}


def first_delivered(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: the first by ``order``. Rows without a key are left out."""
    whole = F.struct(*entries.columns)
    picked = entries.filter(T.trimmed(key) != "").groupBy(F.col(key).alias("_k")).agg(F.min_by(whole, F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def entry_of(row: DataFrame) -> DataFrame:
    """Registry entries from rows of the public interface; entries without any imprint have blank keys."""
    t = lambda c: T.trimmed(c)
    return row.select(
        t("ITEM_SEQ").alias("q"), t("ITEM_NAME").alias("n"), t("ENTP_NAME").alias("e"), t("PRINT_FRONT").alias("pf"), t("PRINT_BACK").alias("pb"),
        T.registry_mark("PRINT_FRONT").alias("cf"), T.registry_mark("PRINT_BACK").alias("cb"), t("DRUG_SHAPE").alias("sh"),
        T.colors(F.concat_ws("|", F.nullif(T.safe("COLOR_CLASS1"), F.lit("")), F.nullif(T.safe("COLOR_CLASS2"), F.lit("")))).alias("k1"),
        t("FORM_CODE_NAME").alias("fm"), t("CHART").alias("c"), t("CLASS_NAME").alias("cl"), t("ETC_OTC_NAME").alias("ot"), t("ITEM_ENG_NAME").alias("en"), t("ITEM_IMAGE").alias("img"),
    )


def tag_by_longest_name(entries: DataFrame, names: DataFrame, excluded: str | None = None) -> DataFrame:
    """``entries`` with ``nc``, the type of the longest listed name that an entry's name contains.

    ``names``: ``kr, eng, type, ord``. Korean names (without blanks, two characters or more) come before
    English ones (five or more), longer before shorter, then by ``ord``; a longest
    name of an untagged type leaves no tag, and an entry whose name fits ``excluded`` gets none.
    Names and entries meet over equal pieces: every piece of an entry's name that has the
    length of some listed name joins the list, so no entry is compared with all names.
    """
    listed = names.select(T.trimmed("kr").alias("name"), F.lit(1).alias("rank"), "type", "ord").filter(F.length("name") >= LEAST_LENGTH["kr"]).unionByName(
        names.select(F.lower(T.trimmed("eng")).alias("name"), F.lit(0).alias("rank"), "type", "ord").filter(F.length("name") >= LEAST_LENGTH["eng"])
    )
    lengths = listed.groupBy("rank").agg(F.collect_set(F.length("name")).alias("lengths"))  # a set of a few dozen lengths
    texts = entries.select(
        "q", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.regexp_replace(T.safe("n"), r"\s+", "").alias("text")), F.struct(F.lit(0).alias("rank"), F.lower(T.safe("en")).alias("text")))).alias("x")
    ).select("q", "x.rank", "x.text")
    if excluded is not None:
        texts = texts.join(texts.filter(F.col("text").rlike(excluded)).select("q").distinct(), "q", "left_anti")
    pieces = texts.join(F.broadcast(lengths), "rank").select(
        "q", "rank", F.explode(F.flatten(F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substring("text", i, n))))).alias("name")
    )
    hits = pieces.distinct().join(listed, ["rank", "name"]).groupBy("q").agg(F.max_by("type", F.struct("rank", F.length("name"), -F.col("ord"))).alias("_type"))
    return entries.drop("nc").join(hits, "q", "left").withColumn("nc", F.when(F.col("_type").isin(*TAGGED_TYPES), F.col("_type"))).drop("_type")


def cumulative(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Fresh entries and those of before that are gone, marked ``x`` 1."""
    gone = previous.join(fresh.select("q").distinct(), "q", "left_anti").withColumn("x", F.lit(1))
    return fresh.withColumn("x", F.lit(None).cast("int")).unionByName(gone, allowMissingColumns=True)


def substances(rows: DataFrame) -> DataFrame:
    """The list of controlled substances: names trimmed, rows without any name or type left out, in their order."""
    t = T.trimmed
    named = rows.select(t("kr").alias("kr"), t("eng").alias("eng"), t("type").alias("type"), "ord")
    return named.filter((F.col("type") != "") & ((F.col("kr") != "") | (F.col("eng") != "")))


def refresh(delivered: DataFrame, previous: DataFrame, names: DataFrame, order: list[str], excluded: str | None = None, least: float = 0.9) -> DataFrame:
    """The registry's next state: items once each, without those that have no imprint, tagged, with what is gone marked, by ``q``.

    A delivery that lost more than the share allowed leaves ``previous`` as it is.
    """
    fresh = first_delivered(delivered, "q", order)
    fresh = fresh.filter((T.registry_mark("pf") != "") | (T.registry_mark("pb") != ""))
    counts = fresh.agg(F.count("*").alias("n")).crossJoin(previous.filter(F.col("x").isNull()).agg(F.count("*").alias("n_before"))).first()  # two numbers
    if shrunk(counts["n"], counts["n_before"], least):
        return previous.orderBy("q")
    return cumulative(tag_by_longest_name(fresh, substances(names), excluded), previous).orderBy("q")


def without_imprint(entries: DataFrame) -> DataFrame:
    """How many entries have no imprint on either side and so are left out."""
    return entries.agg(F.count("*").alias("entries"), F.count_if((T.registry_mark("pf") == "") & (T.registry_mark("pb") == "")).alias("without_imprint"))


def shrunk(fresh: int, before: int, least: float = 0.9) -> bool:
    """Whether a refresh lost so much that the old state must be kept."""
    return before > 0 and fresh < before * least


def efficacy_of(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """``q, ef, at, src`` of registry entries: the first delivered text of each source, permits before summaries.

    A permit with efficacy counts first, then a summary with efficacy, then either with precautions.
    ``texts``: ``q, src, ef, at, eff_id``; rows with neither text are ignored.
    """
    filled = texts.filter((T.safe("ef") != "") | (T.safe("at") != ""))
    one = filled.groupBy("q").agg(*[F.min_by(F.struct("ef", "at"), F.when(F.col("src") == s, F.col("eff_id"))).alias(s) for s in ("prm", "easy")])
    has = lambda s, c: T.safe(F.col(s)[c]) != ""
    src = F.when(has("prm", "ef"), "prm").when(has("easy", "ef"), "easy").when(has("prm", "at"), "prm").when(has("easy", "at"), "easy")
    picked = entries.select("q").distinct().join(one, "q").withColumn("src", src).filter(F.col("src").isNotNull())
    rec = F.when(F.col("src") == "prm", F.col("prm")).otherwise(F.col("easy"))
    return picked.select("q", T.safe(rec["ef"]).alias("ef"), T.safe(rec["at"]).alias("at"), "src")


def recovered(snapshots: DataFrame, current: DataFrame, when: str) -> DataFrame:
    """Entries of older snapshots that the current state lacks: as first seen, with the last day they were there."""
    gone = snapshots.join(current.select("q").distinct(), "q", "left_anti")
    whole = F.struct(*[c for c in snapshots.columns if c != when])
    return gone.groupBy("q").agg(F.min_by(whole, when).alias("_r"), F.max(when).alias("last_seen")).select("_r.*", "last_seen")


def selection_key(item: Column | str, prefix: str) -> Column:
    """Order of selection: a hash of the item, the same everywhere."""
    return F.sha2(F.concat(F.lit(prefix), T.col(item)), 256)


def stratified(pool: DataFrame, total: int, shares: dict[str, float], color_share: float = 0.3, per_class: int = 4, prefix: str = "sample:") -> DataFrame:
    """``total`` items chosen one after the other under caps on shape, colour and class, then filled up without them.

    Two-sided items come first, then by hash of ``q``. An item is passed over when its shape has its share of
    the total, its colour the colour share, or its class ``per_class`` items. Counts only grow, so of each
    combination of shape, colour and class no item after the first ``total`` can be chosen; those first ones are all
    that the sequential choice reads.
    """
    keyed = pool.select("q", F.coalesce("sh", F.lit("")).alias("sh"), F.coalesce("k1", F.lit("")).alias("k1"), F.coalesce("cl", F.lit("")).alias("cl"), (T.safe("pb") == "").alias("one_sided"), selection_key("q", prefix).alias("key"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["one_sided", "key"], kind="stable")
        taken: list[str] = []
        counts: dict[tuple[str, str], int] = {}
        caps = {"sh": lambda v: round(shares.get(v, shares.get("", 1.0)) * total), "k1": lambda v: round(color_share * total), "cl": lambda v: per_class}
        for row in rows.itertuples():
            if len(taken) >= total:
                break
            if any(counts.get((c, getattr(row, c)), 0) >= cap(getattr(row, c)) for c, cap in caps.items()):
                continue
            for c in caps:
                counts[c, getattr(row, c)] = counts.get((c, getattr(row, c)), 0) + 1
            taken.append(row.q)
        chosen = set(taken)
        taken += [q for q in rows["q"] if q not in chosen][: total - len(taken)]
        return pd.DataFrame({"q": taken, "place": range(1, len(taken) + 1)})

    order = Window.partitionBy("sh", "k1", "cl").orderBy("one_sided", "key")
    first = keyed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= total).drop("_n")
    return first.groupBy(F.lit("all").alias("pool")).applyInPandas(run, "q string, place int")


# The nested sample sets: how many cases each has, and from how many candidates they are taken.
SAMPLE_SETS = ((20, 20), (120, 150), (240, 300))


def usable(entries: DataFrame, url: str, needed: tuple[str, ...] = ("q", "n", "img")) -> DataFrame:
    """Entries whose picture lies where ``url`` (a pattern) allows and whose needed fields are filled."""
    filled = F.lit(True)
    for c in needed:
        filled = filled & (T.trimmed(c) != "")
    return entries.filter(filled & T.safe("img").rlike(url))


def named_items(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries of a list (``place, q``) in its order; ``found`` tells those the registry lacks; columns of the entries named ``place`` or ``found`` are dropped. A list is a sample set, a few hundred items."""
    one = first_delivered(entries.drop("place", "found"), "q", ["q"])
    return wanted.join(one.withColumn("found", F.lit(True)), "q", "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("place")


def sample_pack(candidates: DataFrame, target: int, prefix: str) -> DataFrame:
    """The first ``target`` usable candidates (``place, q, usable, ...``) as numbered cases with the names of their images and a hash of each row.

    Cases are numbered without holes whichever candidates drop out. Fewer than ``target`` usable ones are an
    error of the query. Only ``target`` rows, a feature of the pack, reach the numbering.
    """
    first = candidates.filter("usable").orderBy("place").limit(target)
    numbered = first.withColumn("case_no", F.row_number().over(Window.orderBy("place"))).withColumn("case_id", F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("case_no").cast("string"), 3, "0")))
    sides = [F.concat("case_id", F.lit(f"_{side}.jpg")).alias(f"{side}_image") for side in ("front", "back")]
    there = F.count("*").over(Window.partitionBy(F.lit(1)))
    enough = F.when(there < target, F.raise_error(F.lit(f"fewer than {target} usable candidates")).cast("string")).otherwise(F.col("case_id"))
    row_hash = F.sha2(F.concat_ws("|", "case_id", "q", T.safe("n")), 256).alias("sha256")
    return numbered.select(enough.alias("case_id"), *sides, "q", "n", row_hash)


def nested_sets(pool: DataFrame, sizes: tuple[tuple[int, int], ...] = SAMPLE_SETS, prefix: str = "sample:") -> DataFrame:
    """``target, place, q`` of the candidates of each set: the same order for all, so a smaller set lies within the larger ones."""
    most = max(n for _, n in sizes)
    first = pool.select("q", selection_key("q", prefix).alias("key"), (T.safe("pb") == "").alias("one_sided")).orderBy("one_sided", "key").limit(most)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("one_sided", "key")))
    sets = F.array(*[F.struct(F.lit(target).alias("target"), F.lit(n).alias("n")) for target, n in sizes])
    return placed.withColumn("_s", F.explode(sets)).filter(F.col("place") <= F.col("_s.n")).select("_s.target", "place", "q")


def imprint_lookup(results: DataFrame, entries: DataFrame) -> DataFrame:
    """``result_id, matched, candidate``: whether an entry has both predicted imprints, and the name of the first that has.

    A result without any imprint is not looked up and has no row; imprints are compared as ``registry_mark`` has them. Of
    entries with equal imprints the smallest ``entry_id`` counts; one imprint pair may be asked by many results, so they join on salted keys.
    """
    mark = T.registry_mark
    asked = results.select("result_id", mark("prediction.front_imprint").alias("cf"), mark("prediction.back_imprint").alias("cb")).filter((F.col("cf") != "") | (F.col("cb") != ""))
    listed = entries.select("entry_id", "n", mark("pf").alias("cf"), mark("pb").alias("cb")).filter((F.col("cf") != "") | (F.col("cb") != ""))
    first = listed.groupBy("cf", "cb").agg(F.min_by(F.struct(T.safe("n").alias("n")), "entry_id").alias("_e"))
    joined = salted_left_join(asked, first, ["cf", "cb"])
    return joined.select("result_id", F.col("_e").isNotNull().alias("matched"), F.coalesce("_e.n", F.lit("")).alias("candidate"))
