"""Statistics of each text that tell prose from lists, tables and junk.

The statistics are computed over the whole text. A Gaussian
mixture is fitted to the standardized statistics of all texts by expectation
maximization, started at inspected examples of each kind, and every component takes
the kind of the examples it explains best.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.examples import EXAMPLES
from sievework.session import materialize

# English function words, and endings of Korean words in sentences.
ENGLISH_WORDS = "the of to in is was were are be been and or but that which it its with for from on at by not do does you your if than when as had have has this these those them they we he she my so no after before while could may can should would will there nobody"
KOREAN_ENDINGS = "은 는 을 를 에 와 과 며 다 요 오 까 죠 네 으로 에서 에게 에게서 부터 까지 처럼 보다 하고 했고 되고 이고 아서 어서 여서 해서 하여 되어 하면 되면 으면 나면 지면 지만 므로 는데 어야 해야 하게 크게 높게 렇게 하지 지는 이나 거나 하기 되기 라고 려고"

_ENGLISH = frozenset(ENGLISH_WORDS.split())
_ENDINGS = tuple(KOREAN_ENDINGS.split())
LIST_LINE = re.compile(
    r"\s*(?:[-*·•▪◦□■○●▶>–—※☐✓+]\s|\(?(?:\d{1,3}|[a-zA-Z가-힣]|[ivx]{1,4})[.)]\s|[①-⑳]|[^\s:=]{1,12}(?: [^\s:=]{1,12})?\s?[:=]\s)"
)
COLUMN_GAP = re.compile(r"\t|\s*[|│┃]\s*|\S {2,}(?=\S)|(?<=\S)[,;](?=\S)|[-─]{3,}")
#: Stops and line ends; a point between two digits belongs to the number.
SENTENCE_BREAK = re.compile(r"(?:[!?。\n]|\.(?!(?<=\d\.)\d))+\s*")
STOPS = (".", "!", "?", "。")
CLOSERS = "\"”’)"
#: Replacement and control characters, and the letters that mis-decoded text is full of.
STRANGE = frozenset("�¡¢£¤¥¦§¨©ª«¬®¯°±²³´¶¸¹º»¼½¾¿ÂÃÄÅÎâãäåæçèêëìíîï" + "".join(map(chr, [*range(9), 11, 12, *range(14, 32), *range(0x7F, 0xA0)])))

STATISTICS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "strange_ratio", "stop_line_share",
    "common_word_share", "sentence_rate", "prose_share", "list_share", "column_share", "words_per_line", "repeat_share",
)
KINDS = ("prose", "list", "table", "junk")


class WordCounts(dict):
    """Per distinct word, packed in one number so that counts of many words add up in one sum:
    1 for a common word, and 2**32 times stops, 2**64 symbols, 2**96 digits, 2**128 strange characters."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        bare = word.strip("\"”’“‘()[].,!?:;")
        last = bare[-1:]
        common = bare.lower() in _ENGLISH or ("가" <= last <= "힣" and len(bare) > 1 and bare.endswith(_ENDINGS))
        stop = word.rstrip(CLOSERS).endswith(STOPS)
        symbols = sum(not ch.isalnum() for ch in word)
        digits = sum(ch.isdigit() for ch in word)
        strange = sum(ch in STRANGE for ch in word)
        if strange == 1 and "�" not in word:  # an accented letter of a name
            strange = 0
        packed = common | stop << 32 | symbols << 64 | digits << 96 | strange << 128
        if len(word) <= 64:
            self[word] = packed
        return packed


_COUNTS = WordCounts()
_LOW = (1 << 32) - 1


def measure(text: str | None) -> tuple[float, ...]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    if not text or not text.strip():
        return (0, *[0.0] * (len(STATISTICS) - 1))
    get = _COUNTS.__getitem__
    total = lines = words = chars = letters = stops = prose = marked = columns = 0
    runs_on = False  # the line before is prose without a full stop
    waiting = 0  # characters of lines before that are prose if the sentence they begin goes on in prose
    for line in text.split("\n"):
        parts = line.split()
        if not parts:
            continue
        packed = sum(map(get, parts))
        total += packed
        w, n, common = len(parts), len(line), packed & _LOW
        lines += 1
        words += w
        chars += n
        letters += len("".join(parts))
        stop = parts[-1].rstrip(CLOSERS).endswith(STOPS)
        stops += stop
        is_prose = (common >= 2 and common * 8 >= w) or (common > 0 and common * 5 >= w)
        wrapped, runs_on = runs_on, is_prose and not stop
        plain = not is_prose and not LIST_LINE.match(line) and not COLUMN_GAP.search(line)
        if is_prose or (wrapped and plain):
            prose += n + waiting
            waiting = 0
        else:
            waiting = waiting + n if plain and not stop and w >= 5 else 0
            if LIST_LINE.match(line):
                marked += n
            if len(COLUMN_GAP.findall(line)) >= 2:
                columns += n
    said = [x for x in map(str.strip, SENTENCE_BREAK.split(text)) if x]
    repeats = len(said) - len(set(said))
    size = len(text)
    return (
        words, letters / words, (total >> 64 & _LOW) / size, (total >> 96 & _LOW) / size, (total >> 128) / size, stops / lines,
        (total & _LOW) / words, (total >> 32 & _LOW) / words, prose / chars, marked / chars, columns / chars, words / lines,
        repeats / max(1, len(said)),
    )


def statistics(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the statistics of each text, all over the whole text.

    ``n_words``, ``mean_word_length`` (characters of words alone); shares of characters that are symbols, digits or
    strange (replacement, control and mis-decoded characters); ``stop_line_share``: lines
    that end with a full stop; ``common_word_share``: function words and inflected
    endings among words; ``sentence_rate``: full stops per word; shares of characters
    in lines with common words or in one sentence with such (prose), behind a list mark or label (list), or with
    column gaps (column); ``words_per_line``; ``repeat_share``: sentences equal to
    an earlier one of the text, at any distance. A null or blank text has 0 for all. A loop over distinct words
    with remembered counts is ten times faster here than regular expressions in the JVM.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(measure, b.column(1).to_pylist()))) or [[]] * len(STATISTICS)
            columns = [pa.array(c, pa.int64() if i == 0 else pa.float64()) for i, c in enumerate(found)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, *STATISTICS])

    schema = f"{key} bigint, n_words bigint, " + ", ".join(f"{c} double" for c in STATISTICS[1:])
    return texts.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def features() -> list[Column]:
    """The statistics as the mixture sees them: roots and logarithms take the tails off."""
    root = lambda c: F.sqrt(F.greatest(F.col(c), F.lit(0.0)))
    return [
        F.log1p("mean_word_length"), root("symbol_ratio"), root("digit_ratio"), root("strange_ratio"), F.col("stop_line_share"),
        F.least(F.col("common_word_share"), F.lit(0.6)), root("sentence_rate"), F.col("prose_share"), F.col("list_share"), F.col("column_share"),
        F.least(F.log1p("words_per_line"), F.lit(4.0)), F.pow("repeat_share", F.lit(3.0)),
    ]


@dataclass
class Mixture:
    """Weights, means and covariances of the components on standardized features, and the kind of each."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kinds: list[str]

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Of standardized rows ``x``: log of weight times density, by component."""
        out = np.empty((len(x), len(self.weights)))
        for k, (weight, mean, covariance) in enumerate(zip(self.weights, self.means, self.covariances)):
            root = np.linalg.cholesky(covariance)
            z = np.linalg.solve(root, (x - mean).T)
            out[:, k] = np.log(weight) - np.log(np.diag(root)).sum() - 0.5 * (z * z).sum(axis=0)
        return out - 0.5 * x.shape[1] * np.log(2 * np.pi)

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Responsibilities of the components for standardized rows."""
        return self.shares_and_likelihood(x)[0]

    def shares_and_likelihood(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Responsibilities, and the sum of the rows' log-likelihoods."""
        joint = self.log_joint(x)
        most = joint.max(axis=1, keepdims=True)
        p = np.exp(joint - most)
        total = p.sum(axis=1, keepdims=True)
        return p / total, float((most + np.log(total)).sum())


#: Added to each variance of the standardized features, so no component collapses onto equal texts.
RIDGE = 0.02
#: The weight, in texts, with which the inspected examples hold a component at its start.
ANCHOR_TEXTS = 20.0
#: The fit ends when a round raises the mean log-likelihood of the texts by less than this, or after so many rounds.
TOLERANCE = 0.002
ROUNDS = 40


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def fit_mixture(featured: DataFrame, examples: np.ndarray, groups: list[str], kinds: list[str], rounds: int = ROUNDS) -> Mixture:
    """Expectation maximization over all rows of ``featured`` (column ``x``), one component per group of examples.

    Each round adds up responsibilities, first and second moments in the executors; only
    these sums, whose size does not depend on the data, reach the driver. The components
    start at the means of their examples, which keep a small weight (``ANCHOR_TEXTS``),
    and take the kind that most of the examples they explain have.
    """
    d = examples.shape[1]
    summary = featured.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    rows = {r["i"]: r for r in summary.collect()}  # one row per feature
    center = np.array([rows[i]["m"] if i in rows else 0.0 for i in range(d)])
    scale = np.array([max(rows[i]["s"] if i in rows else 1.0, 1e-3) for i in range(d)])
    names = list(dict.fromkeys(groups))
    z = (examples - center) / scale
    start = np.array([z[[g == n for g in groups]].mean(axis=0) for n in names])
    mixture = Mixture(center, scale, np.full(len(names), 1 / len(names)), start.copy(), np.array([np.eye(d) * 0.5] * len(names)), [kinds[groups.index(n)] for n in names])
    k = len(names)
    before = -np.inf
    for _ in range(rounds if rows else 0):
        now = mixture

        def moments(batches: Iterable[pa.RecordBatch], now: Mixture = now) -> Iterator[pa.RecordBatch]:
            total, likelihood = np.zeros((k, 1 + d + d * d)), 0.0
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    x = (_matrix(b.slice(at, 4096)) - now.center) / now.scale
                    r, gained = now.shares_and_likelihood(x)
                    likelihood += gained
                    total[:, 0] += r.sum(axis=0)
                    total[:, 1 : 1 + d] += r.T @ x
                    for c in range(k):
                        total[c, 1 + d :] += ((x * r[:, c : c + 1]).T @ x).reshape(-1)
            flat = np.append(total.reshape(-1), likelihood)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size), pa.int32()), pa.array(flat)], ["i", "v"])

        sums = np.zeros(k * (1 + d + d * d) + 1)
        for r in featured.select("x").mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # components × moments
            sums[r["i"]] = r["v"]
        sums, likelihood = sums[:-1].reshape(k, -1), sums[-1] / max(1.0, sums[:-1].reshape(k, -1)[:, 0].sum())
        weight = sums[:, 0] + ANCHOR_TEXTS
        means = (sums[:, 1 : 1 + d] + ANCHOR_TEXTS * start) / weight[:, None]
        second = sums[:, 1 + d :].reshape(k, d, d) + ANCHOR_TEXTS * (np.einsum("ki,kj->kij", start, start) + 0.1 * np.eye(d))
        covariances = second / weight[:, None, None] - np.einsum("ki,kj->kij", means, means) + RIDGE * np.eye(d)
        mixture = Mixture(center, scale, weight / weight.sum(), means, covariances, mixture.kinds)
        if likelihood - before < TOLERANCE:
            break
        before = likelihood
    votes = mixture.shares(z)
    mixture.kinds = [
        max(KINDS, key=lambda kind: (sum(v for v, x in zip(votes[:, c], kinds) if x == kind), kind == mixture.kinds[c])) for c in range(k)
    ]
    return mixture


def label(featured: DataFrame, mixture: Mixture) -> DataFrame:
    """``featured`` without its last column ``x``, with ``kind, p_prose``: the most likely kind of each row, and how likely it is prose.

    Rows pass through one by one, so null and repeated keys are kept as they are.
    """
    members = np.array([[kind == x for x in KINDS] for kind in mixture.kinds], dtype=float)
    kept = featured.columns[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b) if b.num_rows else np.zeros((0, len(mixture.center)))
            p = mixture.shares((x - mixture.center) / mixture.scale) @ members if len(x) else np.zeros((0, len(KINDS)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([KINDS[i] for i in p.argmax(axis=1)] if len(p) else [], pa.string()), pa.array(p[:, 0])],
                [*kept, "kind", "p_prose"],
            )

    schema = ", ".join(f"`{c}` {kind}" for c, kind in featured.dtypes[:-1])
    return featured.mapInArrow(run, f"{schema}, kind string, p_prose double")


def example_features(spark: SparkSession) -> tuple[np.ndarray, list[str], list[str]]:
    """Features, groups and kinds of the inspected examples."""
    rows = [(i, text) for i, (_, _, text) in enumerate(EXAMPLES)]
    measured = statistics(spark.createDataFrame(rows, "i bigint, text string"), "i", "text").select("i", F.array(*features()).alias("x"))
    found = {r["i"]: r["x"] for r in measured.collect()}  # the examples, a bounded list
    return np.array([found[i] for i, _ in rows]), [g for _, g, _ in EXAMPLES], [k for k, _, _ in EXAMPLES]


def kinds_of_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, the statistics, ``kind`` and ``p_prose`` of every text.

    ``kind`` is prose, list, table or junk, as the mixture has it. A null or blank text is junk. The statistics are
    written once and read by each round of the fit.
    """
    measured = materialize(statistics(texts, key, text).withColumn("x", F.array(*features())))
    mixture = fit_mixture(measured.filter("n_words > 0"), *example_features(texts.sparkSession))
    labelled = label(measured, mixture)
    return labelled.withColumn("kind", F.when(F.col("n_words") == 0, F.lit("junk")).otherwise(F.col("kind")))
