import pytest

from sievework.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5)]


@pytest.fixture
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark, targets):
    df = spark.range(6000).selectExpr("id as item", "case when id % 10 < 6 then 'a' when id % 10 < 8 then 'b' when id % 10 < 9 then 'c' else 'x' end as source", "10 + pmod(hash(id), 90) as size", "id as text_key")
    counted = mixing.use_counts(df, targets)
    assert counted.count() == 6000
    shares = {r.source: r for r in mixing.share_report(counted, targets).collect()}
    for source, share, cap in TARGETS[:3]:
        assert shares[source].actual_share == pytest.approx(share / 0.9, abs=0.01) and shares[source].most_uses <= cap
    assert shares["none"].used_size == 0 and counted.filter("source = 'x' and use_count > 0").count() == 0
    assert mixing.use_counts(df, targets).exceptAll(counted).count() == 0


def test_systematic_counts_differ_by_one_at_most(spark, targets):
    df = spark.range(500).selectExpr("id as item", "case when id < 300 then 'a' when id < 400 then 'b' else 'c' end as source", "cast(7 as bigint) as size", "id as text_key")
    plans = {r.source: r.copies for r in mixing.plan(df.selectExpr("*", "true as counts"), targets).collect()}
    for r in mixing.use_counts(df, targets).groupBy("source").agg({"use_count": "sum", "item": "count"}).collect():
        assert abs(r["sum(use_count)"] - plans[r.source] * r["count(item)"]) <= 1


def test_copies_count_once_and_edge_rows(spark, targets):
    rows = [(1, "a", 10, 1), (2, "a", 10, 1), (3, "b", 5, 2), (4, "c", 5, 3), (5, None, 9, 4), (6, "a", 0, 5), (7, "zz", 3, 6), (8, "b", 10, 1)]
    got = {r.item: r.use_count for r in mixing.use_counts(spark.createDataFrame(rows, "item bigint, source string, size bigint, text_key bigint"), targets).collect()}
    assert len(got) == 8 and got[2] == got[5] == got[6] == got[7] == got[8] == 0 and got[1] <= 1


def test_null_and_repeated_items(spark, targets):
    rows = [(None, "b", 10, 1), (None, "b", 10, 2), (3, "b", 10, 3), (3, "b", 10, 3), (4, "b", 10, 4)]
    df = spark.createDataFrame(rows, "item bigint, source string, size bigint, text_key bigint")
    got = mixing.use_counts(df, targets).collect()
    assert len(got) == len(rows)
    # "b" alone: every text is used max_repeats times, one row of the repeated one
    assert sorted((r.item or 0, r.use_count) for r in got) == [(0, 3), (0, 3), (3, 0), (3, 3), (4, 3)]


def test_empty(spark, targets):
    empty = spark.createDataFrame([], "item bigint, source string, size bigint, text_key bigint")
    assert mixing.use_counts(empty, targets).count() == 0
    assert {r.used_size for r in mixing.share_report(mixing.use_counts(empty, targets), targets).collect()} == {0}
