import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 3), st.sampled_from([0, 1, 2])), max_size=60))
def test_pack_shard_keeps_capacity_and_conflicts(items):
    sizes, clusters, sources = [s for s, _, _ in items], [c for _, c, _ in items], [s for _, _, s in items]
    place = packing.pack_shard(sizes, clusters, sources, {1: 2, 2: 1}, 50)
    bins: dict = {}
    for i, b in enumerate(place):
        bins.setdefault(b, []).append(i)
    for members in bins.values():
        assert sum(sizes[i] for i in members) <= 50
        named = [clusters[i] for i in members if clusters[i]]
        assert len(named) == len(set(named))
        assert not {1, 2} <= {sources[i] for i in members}


def test_pack_shard_is_best_fit():
    def plain(sizes, capacity):
        left, place = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [b for b in range(len(left)) if left[b] >= sizes[i]]
            b = min(fits, key=lambda b: left[b], default=None)
            if b is None:
                left.append(capacity)
                b = len(left) - 1
            left[b] -= sizes[i]
            place[i] = b
        return sorted(left)

    sizes = [(i * 37) % 91 + 1 for i in range(300)]
    place = packing.pack_shard(sizes, [0] * 300, [0] * 300, {}, 100)
    left = [100 - sum(s for s, p in zip(sizes, place) if p == b) for b in range(max(place) + 1)]
    assert sorted(left) == plain(sizes, 100)


@pytest.fixture
def containers(spark):
    return spark.createDataFrame([("small", 10), ("large", 100)], "container string, capacity int")


def test_pack(spark, containers):
    rows = [(i, i % 14, "a" if i % 2 else None, None) for i in range(200)] + [(500, 25, "a", None), (501, 30, "b", None)] + [(600 + i, 4, "c", 77) for i in range(30)]
    df = spark.createDataFrame(rows, "item bigint, size bigint, source string, cluster bigint")
    got = packing.pack(df, containers).collect()
    sizes = {r[0]: r[1] for r in rows}
    for name, capacity in (("small", 10), ("large", 100)):
        own = [r for r in got if r.container == name]
        total: dict = {}
        for r in own:
            total.setdefault(r.item, []).append(r)
        assert {k: sum(r.size for r in v) for k, v in total.items()} == sizes
        assert all(len(v) == max(1, -(-sizes[k] // capacity)) for k, v in total.items())
        bins: dict = {}
        for r in own:
            bins.setdefault(r.bin, []).append(r)
        assert all(sum(r.size for r in v) <= capacity for v in bins.values())
        assert all(sum(r.item >= 600 for r in v) <= 1 for v in bins.values())
    report = {r.container: r for r in packing.fill_report(packing.pack(df, containers), containers).collect()}
    assert report["large"].n_tokens == sum(sizes.values()) and 0 < report["large"].fill <= 1
    assert packing.pack(df.limit(0), containers).count() == 0 and packing.pack(df, containers.limit(0)).count() == 0


def test_many_shards_fill_well(spark):
    df = spark.range(60_000).selectExpr("id as item", "1 + pmod(hash(id), 97) as size", "'a' as source", "cast(null as bigint) as cluster")
    boxes = spark.createDataFrame([("c", 512)], "container string, capacity int")
    assert packing.fill_report(packing.pack(df, boxes), boxes).first().fill > 0.99
