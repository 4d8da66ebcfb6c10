"""Texts that stop before their end, and how often each source truncates.

All texts give a vocabulary of words, and of words behind the word before, with how
often each ends a line or a sentence. It is a trie by characters: a last word that
is unknown but a proper prefix of known words was cut, and a known one that all but
never ends anything stands in the middle of a sentence. The lengths at which a
source's cut texts pile up are further evidence where the trie tells nothing; cut
marks and open punctuation are so where neither does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sievework.operators.skew import salted_left_join
from sievework.session import materialize

# Marks that an interface leaves where it cuts a text.
CUT_MARKS = ("…", "⋯", "...", "[더보기]", "(계속)", "(이하 생략)", "[more]", "(continued)", "[truncated]")
#: A cut word or pair must end less than this share of its lines or sentences.
END_SHARE = 0.1
#: A length is a source's limit if so large a share of its cut texts stop there.
LIMIT_SHARE = 0.2

LIST_MARK = re.compile(r"(?:[-*·•▪◦□○●–—]|\(?\d{1,3}[.)]|[가나다라마바사아자차카타파하a-zA-Z][.)]|[①-⑳])$")
BROKEN_MARKUP = re.compile(r"(?:</?[A-Za-z!]?[^<>\s]{0,20}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?)$")
#: The beginning of an entity, whose names are in lower case; one letter on both sides, as in R&D or Q&a, is a word.
BROKEN_ENTITY = re.compile(r"(?<!^[A-Za-z])&(#\w{0,6}|[a-z]{0,5})$")
# Names of the entities of markup.
ENTITIES = ("nbsp", "amp", "lt", "gt", "quot", "apos")
DANGLING = tuple(",:;(/~[{·+=<“‘")
SENTENCE_END = tuple(".!?。！？")
CLOSING = tuple(")]}\"'”’」』")


DIGITS = re.compile(r"\d+")


def folded(word: str) -> str:
    """A word with each run of digits as one 0, so that numbers count as one word."""
    return DIGITS.sub("0", word)


def core(word: str) -> tuple[str, bool]:
    """A word without closing punctuation, and whether that ends a sentence."""
    bare = word.rstrip(".!?。！？\"'”’")
    return bare or word, word.rstrip("\"'”’").endswith(SENTENCE_END)


def markup_start(word: str) -> int:
    """Where the tag, escape or entity begins inside which a word ends; -1 if in none."""
    if entity := BROKEN_ENTITY.search(word):
        if entity[1][:1] == "#" or any(x.startswith(entity[1]) for x in ENTITIES):
            return entity.start()
    broken = BROKEN_MARKUP.search(word)
    return broken.start() if broken else len(word) - 1 if word.endswith("&") else -1


def ending(text: str | None) -> tuple[str, str, str, int, int]:
    """What a text's end shows by itself: a verdict, its last two words, and its length in characters and bytes without a cut mark.

    Verdicts: ``blank``, ``mark`` (a cut mark or a broken character), ``dangling``
    (a list mark, an open bracket, a comma, a broken tag), ``closed`` (a full stop or closing
    bracket), ``number_stop`` (a number with a full stop) and ``open`` (a bare word).
    Cut marks and broken tags are no part of the last word.
    """
    body = (text or "").rstrip()
    if not body:
        return "blank", "", "", 0, 0
    verdict, cut = "", body
    for mark in CUT_MARKS:
        if body.endswith(mark):
            verdict, cut = "mark", body[: -len(mark)].rstrip()
            break
    if body.endswith("�"):
        verdict, cut = "mark", body.rstrip("�").rstrip()
    line = cut.rsplit("\n", 1)[-1].split()
    word = line[-1] if line else ""
    before = folded(core(line[-2])[0]) if len(line) > 1 else ""
    bare, stop = core(word)
    if not verdict:
        broken = markup_start(word)
        if broken >= 0:
            verdict, bare = "dangling", word[:broken] or bare
        elif (len(line) == 1 and LIST_MARK.match(word)) or word.endswith(DANGLING):
            verdict = "dangling"
        elif stop:
            verdict = "number_stop" if re.search(r"\d$", bare) else "closed"
        elif word.endswith(CLOSING) or not any(ch.isalnum() for ch in word):
            verdict = "closed"
        else:
            verdict = "open"
    return verdict, before, folded(bare), len(cut), len(cut.encode("utf-8", "replace"))


def count_words(texts: Iterable[str | None]) -> dict[tuple[str, str], list[int]]:
    """``[n, n_end, n_stop]`` of each word behind each word of its line: how often it occurs, ends a
    line or sentence, and does so with a full stop. A text's last word counts only in a text closed by one.

    Whole lines of raw words are counted first; only distinct pairs are then folded.
    """
    seen: Counter[tuple[str, str]] = Counter()
    lasts: Counter[tuple[str, str]] = Counter()
    for text in texts:
        lines = [x for x in map(str.split, DIGITS.sub("0", text or "").split("\n")) if x]
        if lines and not (core(lines[-1][-1])[1] and ending(text)[0] == "closed"):
            tail = lines.pop()
            seen.update(zip(["", *tail[:-2]], tail[:-1]))
        for line in lines:
            before = ["", *line[:-1]]
            seen.update(zip(before, line))
            lasts[before[-1], line[-1]] += 1
    found: dict[tuple[str, str], list[int]] = {}
    cores = {w: core(w) for pair in seen for w in pair}
    for (before, word), n in seen.items():
        bare, stop = cores[word]
        counts = found.setdefault((cores[before][0], bare), [0, 0, 0])
        counts[0] += n
        counts[1] += n if stop else lasts.get((before, word), 0)
        counts[2] += n * stop
    return found


def word_table(texts: DataFrame, column: str) -> DataFrame:
    """``before, word, n, n_end, n_stop`` over all words of all texts, see ``count_words``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = count_words(b.column(0).to_pylist())
            pairs, counts = list(zip(*found)) or [[], []], list(zip(*found.values())) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(list(x), pa.string()) for x in pairs], *[pa.array(list(x), pa.int64()) for x in counts]],
                ["before", "word", "n", "n_end", "n_stop"],
            )

    counted = texts.filter(F.col(column).isNotNull()).select(column).mapInArrow(
        run, "before string, word string, n bigint, n_end bigint, n_stop bigint"
    )
    return counted.groupBy("before", "word").agg(*[F.sum(c).alias(c) for c in ("n", "n_end", "n_stop")])


def trie(words: DataFrame, asked: DataFrame) -> DataFrame:
    """The inner nodes of the trie of ``word`` per ``before`` that are asked for: ``before, word, n_below, n``.

    ``words`` has one row per ``before, word`` with its ``n``. A node's ``word`` is a proper prefix of ``n_below`` words, which occur ``n`` times. ``asked`` has
    ``before, word``: of each branch (first character) only the depths asked for are
    built, so a word of n characters has as many nodes as there are lengths asked
    for, not n. A branch's depths are one small array, joined on salted keys.
    """
    branch = F.left("word", F.lit(1)).alias("_branch")
    depths = asked.groupBy("before", branch).agg(F.collect_set(F.length("word")).alias("_depths"))
    per_word = words.select("before", "word", "n", branch)
    deep = F.explode(F.filter("_depths", lambda d: d < F.length("word")))
    nodes = salted_left_join(per_word, depths, ["before", "_branch"]).select("before", "word", "n", deep.alias("_depth"))
    return nodes.groupBy("before", F.left("word", F.col("_depth")).alias("word")).agg(F.count("*").alias("n_below"), F.sum("n").alias("n"))


def end_shares(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """Of each asked ``before, word`` that is a node of the vocabulary's trie: ``share``, how often it ends something, and ``stops``,
    how many of these ends are full stops. A node that is only a prefix of words ends nothing."""
    known = vocabulary.join(asked.select("before", "word"), ["before", "word"], "left_semi")
    inner = trie(vocabulary, asked).join(asked.select("before", "word"), ["before", "word"], "left_semi")
    every = known.select("before", "word", "n", "n_end", "n_stop", F.lit(1).alias("whole")).unionByName(
        inner.select("before", "word", F.col("n"), F.lit(0).cast("bigint").alias("n_end"), F.lit(0).cast("bigint").alias("n_stop"), F.lit(0).alias("whole"))
    )
    # a known word counts as itself, not as the beginning of longer ones
    return every.groupBy("before", "word").agg(
        F.max_by(F.struct((F.col("n_end") / F.col("n")).alias("share"), F.coalesce(F.try_divide("n_stop", "n_end"), F.lit(0.0)).alias("stops"), "whole"), "whole").alias("_s")
    ).select("before", "word", "_s.*")


def judge(rows: DataFrame, key: str, source: str, column: str) -> DataFrame:
    """``key, source, truncated, reason`` of every row.

    Reasons, the first that holds: ``cut_word`` (the last word begins known words and is none
    itself), ``open_sentence`` (it is known and ends less than ``END_SHARE`` of its lines and
    sentences; first behind the word before it, else by itself), ``open_letter`` (it is in no
    branch of the trie, is no end phrase that recurs, and words with its last letter do not
    end anything), ``mark`` and ``dangling`` (where the trie sees an end or nothing), ``at_limit``
    (its source's limit cut it just where a full stop belongs, or behind a word in no branch).
    Null and blank texts are not truncated. A text that ends with a
    full stop or a closing bracket and no cut mark is finished whatever its length. Rows are judged each by
    themselves, repeated rows alike; a null source is a source of its own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ending(t) for t in b.column(2).to_pylist()]
            columns = list(zip(*found)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(list(c), t) for c, t in zip(columns, types)]],
                ["_key", "_source", "verdict", "before", "word", "n_chars", "n_bytes"],
            )

    ends = rows.select(F.col(key).cast("bigint").alias("_key"), F.col(source).cast("string").alias("_source"), F.col(column).cast("string").alias("_text")).mapInArrow(
        run, "_key bigint, _source string, verdict string, before string, word string, n_chars bigint, n_bytes bigint"
    )
    ends = materialize(ends)
    pairs = materialize(word_table(rows.select(F.col(column).cast("string").alias("_text")), "_text"))
    words = pairs.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "n_end", "n_stop")])
    words = materialize(words.select(F.lit("").alias("before"), "word", "n", "n_end", "n_stop"))
    last = ends.filter(~F.col("verdict").isin("blank", "closed") & (F.col("word") != ""))
    asked = materialize(last.groupBy("before", "word").agg(F.countDistinct("n_chars").alias("n_lengths")))
    asked_words = asked.select(F.lit("").alias("before"), "word").distinct()
    by_letter = words.filter("word <> ''").groupBy(F.right("word", F.lit(1)).alias("_letter")).agg((F.sum("n_end") / F.sum("n")).alias("letter_share"))
    known = (
        asked.join(end_shares(pairs, asked).select("before", "word", F.struct("share", "stops", "whole").alias("pair")), ["before", "word"], "left")
        .join(end_shares(words, asked_words).select("word", F.struct("share", "stops", "whole").alias("alone")), "word", "left")
        .withColumn("_letter", F.right("word", F.lit(1))).join(by_letter, "_letter", "left")
    )
    node = F.coalesce("pair", "alone")
    clue = (
        F.when(node["whole"] == 0, F.lit("cut_word")).when(node["share"] < END_SHARE, F.lit("open_sentence")).when(node.isNotNull(), F.lit("ends"))
        # in no branch of the trie: an end phrase if it recurs, else what words with its last letter do
        .when(F.col("n_lengths") > 1, F.lit("ends")).when(F.col("letter_share") < END_SHARE, F.lit("open_letter")).otherwise(F.lit("unknown"))
    )
    clues = known.select("before", "word", clue.alias("clue"), F.coalesce(node["stops"] > 0.5, F.lit(False)).alias("stop_due"))
    judged = salted_left_join(ends, clues, ["before", "word"])
    reason = (
        F.when(F.col("verdict").isin("blank", "closed"), F.lit(None))
        .when(F.col("clue").isin("cut_word", "open_sentence", "open_letter"), F.col("clue"))
        .when(F.col("verdict").isin("mark", "dangling"), F.col("verdict"))
    )
    judged = materialize(judged.withColumn("reason", reason))
    limits = source_limits(judged)
    with_limits = salted_left_join(judged.withColumn("_source", F.coalesce("_source", F.lit("\0"))), limits, ["_source"])
    # a whole last word one short of the limit: the blank behind it was the limit's character and is stripped
    blank_cut = (F.col("n_chars") == F.col("char_limit") - 1) & F.coalesce(F.col("clue") != "cut_word", F.lit(True))
    at_limit = (F.col("n_chars") == F.col("char_limit")) | blank_cut | F.col("n_bytes").between(F.col("byte_limit") - 2, F.col("byte_limit"))
    # at the limit nothing but the length tells: where a full stop belongs, or behind a word of no branch
    bare = (F.col("verdict") == "open") & F.coalesce(F.col("stop_due") | (F.col("clue") == "unknown"), F.lit(False)) & F.coalesce(at_limit, F.lit(False))
    return with_limits.select(
        F.col("_key").alias(key),
        F.when(F.col("_source") != "\0", F.col("_source")).alias(source),
        F.coalesce(F.col("reason"), F.when(bare, F.lit("at_limit"))).alias("reason"),
        F.coalesce(at_limit, F.lit(False)).alias("at_limit"),
        (F.col("verdict") != "blank").alias("has_text"),
    ).withColumn("truncated", F.col("reason").isNotNull())


def source_limits(judged: DataFrame) -> DataFrame:
    """Per source the length, in characters or bytes, at which most of its cut texts stop, if any."""
    cut = judged.filter(F.col("reason").isNotNull()).withColumn("_source", F.coalesce("_source", F.lit("\0")))
    whole = Window.partitionBy("_source")
    out = []
    for column, name in (("n_chars", "char_limit"), ("n_bytes", "byte_limit")):
        piles = cut.groupBy("_source", column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(whole))
        out.append(
            piles.groupBy("_source").agg(F.max_by(F.struct(F.col(column).alias("at"), "share", "n"), F.struct("n", column)).alias("p"))
            .select("_source", F.when((F.col("p.share") >= LIMIT_SHARE) & (F.col("p.n") > 1), F.col("p.at")).alias(name))
        )
    return out[0].join(out[1], "_source")


def truncation_report(judged: DataFrame, source: str) -> DataFrame:
    """Per source: texts that are not blank, truncated ones, those at its limit, and the truncated share (null without texts)."""
    return judged.groupBy(source).agg(
        F.count("*").alias("n_rows"),
        F.count_if("has_text").alias("n_texts"),
        F.count_if("truncated").alias("n_truncated"),
        F.count_if(F.col("truncated") & F.col("at_limit")).alias("n_at_limit"),
        F.round(F.try_divide(F.count_if("truncated"), F.count_if("has_text")), 6).alias("truncated_share"),
    )
