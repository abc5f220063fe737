"""Token counts by a two-tier lookup on the map side; nothing is shuffled.

Tier 1 is a compact table, broadcast once, of the token counts of frequent pre-tokens: a BPE vocabulary lists the
commonest strings of its language, so its entries that are pre-tokens of their own are taken, and its size is bounded by
the vocabulary's. Tier 2 is a bounded cache of each worker, filled by the library itself for what tier 1 misses.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Cache, cut, groups
from .common import read_table

CACHE = 300_000


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _counts(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def frequent_lengths(path: str) -> tuple[bytes, bytes]:
    """Tier 1: the pre-tokens that start with a space, without it, and their token counts, one byte each."""
    tokenizer = _tokenizer(path)
    words = [w for w in (tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size(False))) if w[:1] == " " and w[1:].isalpha()]
    counts = np.array(_counts(tokenizer, words), "u1")
    return "\n".join(w[1:] for w in words).encode(), counts.tobytes()


class Counter:
    def __init__(self, path: str, table: tuple[bytes, bytes]):
        self.tokenizer = _tokenizer(path)
        self.frequent = dict(zip(table[0].decode().split("\n"), table[1], strict=True)) if table[1] else {}
        self.chunks, self.first = Cache(CACHE), Cache(CACHE // 8)

    def _learn(self, cache: Cache, wanted: set[str], space: str) -> None:
        chunks = cache.missing(wanted)
        for a in range(0, len(chunks), 20_000):
            some = chunks[a : a + 20_000]
            cache.young.update(zip(some, _counts(self.tokenizer, [space + c for c in some]), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        parts = [cut(t) for t in texts]
        seen = set().union(*(p[1:] for p in parts))
        self._learn(self.chunks, seen.difference(self.frequent), " ")
        self._learn(self.first, {p[0] for p in parts}, "")
        both = self.chunks.young | {c: self.frequent[c] for c in seen.intersection(self.frequent)}
        return [self.first.young[p[0]] + sum([both[c] for c in p[1:]]) for p in parts]


_held: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row.

    Counts are the library's, without added special tokens, truncation or padding; special strings inside a text are
    handled as its default does. Null and empty texts have no bytes and no tokens; repeated rows stay.
    The tokenizer must be byte-level with no normalizer, as `byte_bpe_50k.json` is; others are refused.
    """
    from json import load

    with open(path) as f:
        spec = load(f)
    if spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path}: a byte-level tokenizer without normalizer and prefix space is needed")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _held:
            _held[path] = Counter(path, table.value)
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            counts: list[int] = []
            for _, texts in groups(batch.column("text")):
                counts += _held[path].count(texts)
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        Cache.rest(_held[path].chunks, _held[path].first)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
