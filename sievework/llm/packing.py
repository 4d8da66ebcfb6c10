"""Items packed into containers of fixed capacity.

Items are dealt into shards of bounded size by a hash, and each shard is packed by
best fit in decreasing order: open bins are ordered by what is left in them, a bit
set of the occupied residuals finds the tightest one that can hold the item, and the
search goes on to the next residual while the bin's bit sets of sources and duplicate
clusters conflict with the item. Only the last bins of a shard stay badly filled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least number of full containers' worth of items in a shard; the waste of a shard is about one container.
SHARD_BINS = 400
#: Most items in a shard.
SHARD_ITEMS = 20_000
#: Most kinds of containers; each item is packed once for every kind.
MOST_CONTAINERS = 1_000


class Bins:
    """Open bins of one shard, found by residual capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.occupied = 0  # bit r: some bin has r left
        self.at: dict[int, list[int]] = {}  # residual: its bins, in the order they came
        self.left: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[int] = []

    def _put(self, bin_: int) -> None:
        left = self.left[bin_]
        self.at.setdefault(left, []).append(bin_)
        self.occupied |= 1 << left

    def _take(self, bin_: int) -> None:
        left = self.left[bin_]
        self.at[left].remove(bin_)
        if not self.at[left]:
            del self.at[left]
            self.occupied &= ~(1 << left)

    def successors(self, size: int) -> Iterator[int]:
        """Open bins that can hold ``size``, tightest first."""
        rest = self.occupied >> size << size
        while rest:
            low = rest & -rest
            yield from tuple(self.at[low.bit_length() - 1])
            rest ^= low

    def open(self) -> int:
        self.left.append(self.capacity)
        self.clusters.append(0)
        self.sources.append(0)
        self._put(len(self.left) - 1)
        return len(self.left) - 1

    def fill(self, bin_: int, size: int, cluster: int, source: int) -> None:
        self._take(bin_)
        self.left[bin_] -= size
        self.clusters[bin_] |= cluster
        self.sources[bin_] |= source
        self._put(bin_)


def pack_shard(sizes: list[int], clusters: list[int], sources: list[int], conflicts: dict[int, int], capacity: int) -> list[int]:
    """The bin of each item; items of one duplicate cluster never share a bin, nor do sources in conflict.

    ``clusters``: a number per item, 0 for items without a duplicate in the shard;
    ``sources``: a bit per item; ``conflicts``: by source bit the bits it must not meet.
    All members of a cluster are placed in one walk over the bins, so a large cluster
    does not search the same bins again for each of its members.
    """
    bins = Bins(capacity)
    place = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], i))
    at = 0
    while at < len(order):
        first = order[at]
        size, cluster = sizes[first], clusters[first]
        end = at + 1
        if cluster:
            while end < len(order) and clusters[order[end]] == cluster and sizes[order[end]] == size:
                end += 1
        bit = 1 << cluster if cluster else 0
        waiting = order[at:end]
        if len(waiting) == 1:
            i, foe = first, conflicts.get(sources[first], 0)
            chosen = next((b for b in bins.successors(size) if not bins.clusters[b] & bit and not bins.sources[b] & foe), None)
            chosen = bins.open() if chosen is None else chosen
            bins.fill(chosen, size, bit, sources[i])
            place[i] = chosen
        else:
            fitting = [b for b in bins.successors(size) if not bins.clusters[b] & bit]
            for i in waiting:
                foe = conflicts.get(sources[i], 0)
                k = next((k for k, b in enumerate(fitting) if not bins.sources[b] & foe), None)
                chosen = bins.open() if k is None else fitting.pop(k)
                bins.fill(chosen, size, bit, sources[i])
                place[i] = chosen
        at = end
    return place


def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """Every item once per container, divided only if it alone exceeds the capacity.

    ``items``: ``item, size, source, cluster``; ``containers``: ``container, capacity``.
    An item above the capacity gives full pieces and a rest; ``piece`` counts from 0. An
    empty item is a piece of size 0.
    """
    kinds = containers.filter(F.col("capacity") > 0).select("container", "capacity").distinct().take(MOST_CONTAINERS + 1)
    if len(kinds) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} kinds of containers")
    named = [F.struct(F.lit(k["container"]).alias("container"), F.lit(k["capacity"]).cast("bigint").alias("capacity")) for k in kinds]
    none = F.array().cast("array<struct<container:string,capacity:bigint>>")
    each = items.withColumn("_k", F.explode(F.array(*named) if named else none)).select("*", "_k.container", "_k.capacity")
    n = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int")
    return each.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "container", "capacity", "item", "piece", F.least(F.col("size") - F.col("piece") * F.col("capacity"), F.col("capacity")).alias("size"), "source", F.coalesce("cluster", F.lit(0)).alias("cluster")
    )


def pack(items: DataFrame, containers: DataFrame, conflicting_sources: tuple[tuple[str, str], ...] = (), seed: int = 7) -> DataFrame:
    """``container, bin, item, piece, size``: a bin for every item or piece, for each container.

    Two items of one ``cluster`` (null or 0: no duplicates) never share a bin, nor do items of
    two sources named as conflicting (none by default). Full pieces have a bin of their
    own without a search; the others are packed by shards. The number of shards follows
    the data, a shard holds about ``SHARD_ITEMS`` items at most, and copies of one text
    are spread over all shards. An empty table gives no rows.
    """
    cut = pieces(items, containers)
    full = cut.filter(F.col("size") == F.col("capacity")).select(
        "container", F.concat_ws("-", F.lit("f"), "item", "piece").alias("bin"), "item", "piece", "size"
    )
    rest = cut.filter(F.col("size") < F.col("capacity"))
    shards = rest.groupBy("container", "capacity").agg(F.count("*").alias("n"), F.sum("size").alias("total")).select(
        "container",
        F.greatest(
            F.lit(1),
            F.least(F.ceil(F.col("n") / SHARD_ITEMS), F.ceil(F.col("n") / 50)),
            F.least(F.floor(F.col("total") / F.col("capacity") / SHARD_BINS), F.ceil(F.col("n") / 2000)),
        ).cast("int").alias("shards"),
    )
    dealt = rest.join(F.broadcast(shards), "container")  # a row per kind of container, of which there are few
    dealt = dealt.withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), "item", "piece"), F.col("shards")).cast("int")
    )
    foes = [tuple(pair) for pair in conflicting_sources]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "piece"], kind="stable")
        names = {s: 1 << i for i, s in enumerate(sorted({x for pair in foes for x in pair}))}
        against: dict[int, int] = {}
        for a, b in foes:
            against[names[a]] = against.get(names[a], 0) | names[b]
            against[names[b]] = against.get(names[b], 0) | names[a]
        several = rows["cluster"].astype(object).where(rows["cluster"].duplicated(keep=False) & (rows["cluster"] != 0))
        numbers = pd.factorize(several)[0] + 1  # 0: no duplicate in this shard
        places = pack_shard(
            rows["size"].tolist(), numbers.tolist(), [names.get(s, 0) for s in rows["source"]], against, int(rows["capacity"].iloc[0])
        )
        return pd.DataFrame(
            {
                "container": rows["container"],
                "bin": [f"{key[1]}-{p}" for p in places],
                "item": rows["item"],
                "piece": rows["piece"],
                "size": rows["size"],
            }
        )

    packed = dealt.groupBy("container", "shard").applyInPandas(run, "container string, bin string, item bigint, piece int, size bigint")
    return packed.unionByName(full)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: bins, items and pieces, tokens, and the share of the bins' capacity that is used."""
    bins = packed.groupBy("container", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    per = bins.groupBy("container").agg(
        F.count("*").alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("size").alias("n_tokens"), F.max("size").alias("fullest")
    )
    return per.join(containers, "container").select(
        "container", "capacity", "n_bins", "n_pieces", "n_tokens", "fullest",
        F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("fill"),
    )
