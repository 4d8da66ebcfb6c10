"""Sizes of texts in tokens of a public tokenizer.

A byte-level BPE splits a text into pieces before merging, and no piece crosses from
the end of a run of non-blanks into the blanks that follow. So the size of a text is
the sum over its runs (blanks and the non-blanks after them), and each distinct run
is encoded once per worker.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The tokenizer whose tokens are counted: a rank file of byte-level BPE.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks as the tokenizer's pattern sees them; Python's \s has four more.
RUN = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")
#: Distinct runs kept per worker before the memory starts anew.
MEMORY_RUNS = 400_000


class RunSizes(dict):
    """Tokens of each run, encoded when first asked for."""

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, run: str) -> int:
        if len(self) >= MEMORY_RUNS:
            self.clear()
        size = len(self.encode(run))
        if len(run) <= 64:
            self[run] = size
        return size

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, RUN.findall(text)))


@lru_cache(maxsize=2)
def run_sizes(path: str) -> RunSizes:
    """The sizes known to this worker."""
    return RunSizes(os.path.realpath(path))


def token_count(text: Column | str, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens of ``text``; 0 for a null or empty one."""

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        sizes = run_sizes(tokenizer)
        return pa.array([sizes.of(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)
