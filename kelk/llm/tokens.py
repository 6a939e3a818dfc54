"""Sizes of texts in tokens of a public byte-level BPE tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession, types as T
from pyspark.sql.functions import arrow_udf

#: Fixed value: how the vocabulary's makers split a text before any merge; no token crosses these pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("KELK_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
CACHE = 500_000


def counter(vocabulary: str = VOCABULARY) -> Callable[[str | None], int]:
    """A function that counts the tokens of a text; 0 for null.

    A piece that starts with a blank never depends on what stands before it, so a text without double blanks is counted
    blank by blank, and the count of each such part is remembered. Texts with double blanks are encoded as a whole.
    """
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encode = tiktoken.Encoding("kelk", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, int] = {}

    def count(text: str | None) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        if not first or "" in rest:
            return len(encode(text))
        if len(known) > CACHE:
            known.clear()
        total = 0
        for part in (first, *[" " + r for r in rest]):
            if (n := known.get(part)) is None:
                n = known[part] = len(encode(part))
            total += n
        return total

    return count


def token_count(col: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text; 0 for null. The vocabulary file is sent from the driver, unless it is there on the executors only."""
    if os.path.exists(vocabulary):
        SparkSession.active().sparkContext.addFile(vocabulary)

    @arrow_udf(T.LongType())
    def sizes(texts: pa.Array) -> pa.Array:
        count = _counters.get(vocabulary)
        if count is None:
            sent = SparkFiles.get(os.path.basename(vocabulary))
            count = _counters[vocabulary] = counter(sent if os.path.exists(sent) else vocabulary)
        return pa.array([count(t) for t in texts.to_pylist()], pa.int64())

    return sizes(col)


_counters: dict[str, Callable[[str | None], int]] = {}
