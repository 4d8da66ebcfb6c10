"""Queries of the text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import canonical, lookalike, mixing, packing, quality, tokens, truncation
from sievework.session import materialize
from sievework.sources.tables import spread_table, table

NAME_FIELDS = {"drug_name": "n", "front_imprint": "pf", "back_imprint": "pb"}


def _name_cells(spark: SparkSession, folder: str) -> DataFrame:
    sheet = table(spark, folder, "answer_sheet").withColumnRenamed("mfds_item_id", "item")
    return lookalike.cells(sheet, "row_id", list(NAME_FIELDS), ["item"])


def _name_references(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "pill_registry").select(F.col("q").alias("item"), *[F.col(c).alias(f) for f, c in NAME_FIELDS.items()])
    return lookalike.cells(entries, "item", list(NAME_FIELDS), [])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that look like their registry entry's text but are not equal to it."""
    return lookalike.same_look_cells(_name_cells(spark, folder), _name_references(spark, folder))


def p1_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every name and imprint cell in its consistent form."""
    formed = lookalike.consistent_cells(_name_cells(spark, folder), _name_references(spark, folder))
    return formed.select("row_id", "field", "value", "canonical")


TYPED_FIELDS = ["shape", "color", "imprint_type"]


def _typed_cells(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.cells(table(spark, folder, "answer_sheet"), "row_id", TYPED_FIELDS, [])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entry that each freely typed cell stands for, 0 for none."""
    mapped = canonical.map_cells(_typed_cells(spark, folder), table(spark, folder, "canonical_value"))
    return mapped.select("row_id", "field", "value_id")


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed values that stand for no entry."""
    return canonical.unmatched_report(_typed_cells(spark, folder), table(spark, folder, "canonical_value"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows whose text stops before its end."""
    judged = truncation.judge(spread_table(spark, folder, "efficacy"), "eff_id", "feed", "at")
    return judged.filter("truncated").select("eff_id")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """How often each feed truncates."""
    return truncation.truncation_report(truncation.judge(spread_table(spark, folder, "efficacy"), "eff_id", "feed", "at"), "feed")


def _sized(spark: SparkSession, folder: str, *columns: Column) -> DataFrame:
    """The documents with their size in tokens, counted once and written down."""
    return materialize(spread_table(spark, folder, "documents").select(F.col("doc_id").alias("item"), *columns, tokens.token_count("text").alias("size")))


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "container_size").select("container", F.col("capacity_tokens").alias("capacity"))


#: Sources whose texts never share a container: a report must not stand beside the evidence that it evaluates.
CONFLICTING_SOURCES = (("eval_report", "model_evidence"),)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    items = _sized(spark, folder, F.col("source"), F.xxhash64("text").alias("text_key"))
    again = items.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1").select("text_key", F.lit(True).alias("again"))
    clustered = items.join(again, "text_key", "left").withColumn("cluster", F.when(F.col("again"), F.col("text_key")))
    return packing.pack(clustered.select("item", "size", "source", "cluster"), _containers(spark, folder), CONFLICTING_SOURCES)


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The bin of every text or piece, for each container; neither copies of a text nor sources in conflict share one."""
    return _packed(spark, folder).withColumnsRenamed({"item": "doc_id", "size": "tokens"})


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the bins of each container are filled."""
    return packing.fill_report(_packed(spark, folder), _containers(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.length("text"), "text").alias("b"))
    items = _sized(spark, folder, F.col("source"), key.alias("text_key"))
    return mixing.use_counts(items, table(spark, folder, "mix_target"))


def p7_use_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each text is used in the mix."""
    return _mixed(spark, folder).withColumnsRenamed({"item": "doc_id", "size": "tokens"})


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.share_report(_mixed(spark, folder), table(spark, folder, "mix_target"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are not prose."""
    return quality.kinds_of_texts(spread_table(spark, folder, "documents"), "doc_id", "text").filter("kind <> 'prose'").select("doc_id")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics and the kind of every document."""
    found = quality.kinds_of_texts(spread_table(spark, folder, "documents"), "doc_id", "text")
    return found.select("doc_id", *[F.round(c, 6).alias(c) if c != "n_words" else F.col(c) for c in quality.STATISTICS], "kind")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_consistent, p4_found, p4_unmatched, p5_found, p5_report, p6_pack, p6_fill, p7_use_counts, p7_shares,
        p8_found, p8_statistics,
    )
}
ORACLES: dict[str, str] = {}
