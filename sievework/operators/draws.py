"""Seeded draws that repeat exactly: a text seed, a 32-bit generator, rounds without repeats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

WORD = 0xFFFFFFFF


def fnv1a(text: str) -> int:
    """FNV-1a over the UTF-16 units of a text, 32 bits."""
    value = 2166136261
    raw = text.encode("utf-16-le")
    for unit in (raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)):
        value = (value ^ unit) * 16777619 & WORD
    return value


def mulberry32(state: int) -> Iterator[float]:
    """The public mulberry32 generator: numbers from 0 to below 1."""
    while True:
        state = state + 0x6D2B79F5 & WORD
        z = (state ^ state >> 15) * (state | 1) & WORD
        z ^= z + ((z ^ z >> 7) * (z | 61) & WORD) & WORD
        yield ((z ^ z >> 14) & WORD) / 2**32


def permutation(total: int, seed: str) -> list[int]:
    """Fisher–Yates order of ``total`` places under a text seed."""
    numbers, order = mulberry32(fnv1a(seed)), list(range(max(0, total)))
    for last in range(len(order) - 1, 0, -1):
        other = int(next(numbers) * (last + 1))
        order[last], order[other] = order[other], order[last]
    return order


@dataclass
class Queue:
    """Draws of a fixed size without repeats in a round; a round that cannot fill a draw gives way to the next."""

    total: int
    seed: str
    round: int = 0
    at: int = 0
    draws: int = 0
    order: list[int] = field(default_factory=list)

    def draw(self, size: int) -> list[int] | None:
        if self.total < size or size < 1:
            return None
        if self.at + size > len(self.order):
            self.round, self.at = self.round + 1, 0
            self.order = permutation(self.total, f"{self.seed}#{self.round}")
        self.at += size
        self.draws += 1
        return self.order[self.at - size : self.at]


def draw_table(spark: SparkSession, total: int, seed: str, size: int, n_draws: int) -> DataFrame:
    """``draw, round, position, item`` of the first draws; the order is made on the driver, as it is sequential."""
    queue, rows = Queue(total, seed), []
    for _ in range(n_draws):
        items = queue.draw(size)
        if items is None:
            break
        rows += [(queue.draws, queue.round, k, item) for k, item in enumerate(items)]
    return spark.createDataFrame(rows, "draw int, round int, position int, item int")


def blind_order(models: list[str], seed: str) -> dict[str, str]:
    """Models under the labels A, B, … in seeded order."""
    return {chr(65 + k): models[i] for k, i in enumerate(permutation(len(models), seed))}
