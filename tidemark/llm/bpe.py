"""Byte-level BPE by recursive DuckDB queries inside each partition.

Each step of the recursion lays the words' ids out as (word, position, token, next token) rows, joins them with the merge
table and contracts, in every word, the leftmost pair of smallest rank; words without a pair drop out. Decoding joins
ids with the vocabulary and puts the bytes together by an ordered aggregate. What has been encoded or decoded stays in
bounded caches of the Python worker, so a query sees each distinct word about once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Cache, groups
from .common import read_table

#: Longer words would make too many rows a step; they are contracted by the same rule with a heap.
LONG_WORD = 1024
#: Rows that the steps of one recursive query may make together.
STEP_ROWS = 3_000_000
CACHE = 400_000

_ENCODE = """
WITH RECURSIVE step(w, ids) AS (
  SELECT w, list(v.id ORDER BY p)
  FROM (SELECT w, s, unnest(range(1, length(s) + 1)) AS p FROM todo) t JOIN vocab v ON v.s = t.s[p] GROUP BY w
  UNION ALL
  SELECT w, ids[:(best & 1048575) - 1] || [(best >> 20)::INTEGER] || ids[(best & 1048575) + 2:]
  FROM step JOIN (
    SELECT w, min((m.id::BIGINT << 20) | p) AS best
    FROM (SELECT w, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS p FROM step) t
    JOIN merges m ON m.pair = t.a::BIGINT * 4294967296 + t.b GROUP BY w) USING (w)
)
SELECT w, arg_min(ids, len(ids)) AS ids FROM step GROUP BY w
"""
_DECODE = """
SELECT d, array_to_string(list(v.s ORDER BY p), '') AS s
FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM todo) JOIN vocab v USING (id) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """A vocabulary in an in-memory DuckDB with its caches; bytes stand there as Latin-1 text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.words, self.decoded = Cache(CACHE), Cache(CACHE)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        ids = pa.array(list(ranks.values()), pa.int32())
        self._table("vocab", {"id": ids, "s": pa.array([t.decode("latin-1") for t in ranks])})
        pairs, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        self._table("merges", {"pair": pa.array(pairs, pa.int64()), "id": pa.array(merged, pa.int32())})

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _run(self, sql: str, columns: dict) -> list[pa.Array]:
        self.con.register("todo", pa.table(columns))
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister("todo")
        return [c.combine_chunks() for c in out.columns]

    def _long(self, word: bytes) -> bytes:
        ids = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                rank = self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[after[i]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        """Put the words' ids, as little-endian 32-bit bytes, into the cache."""
        known = self.words.young
        todo: list[str] = []
        rows = 0
        for word in words:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:  # as the library does, a word that is a token is not contracted
                known[word] = np.array([rank], "<u4").tobytes()
            elif len(raw) > LONG_WORD:
                known[word] = self._long(raw)
            else:
                todo.append(word)
                rows += len(raw) * (len(raw) + 1) // 2
            if rows > STEP_ROWS:
                self._contract(todo)
                todo, rows = [], 0
        if todo:
            self._contract(todo)

    def _contract(self, words: list[str]) -> None:
        given = {"w": pa.array(range(len(words)), pa.int32()), "s": pa.array([w.encode().decode("latin-1") for w in words])}
        which, ids = self._run(_ENCODE, given)
        raw = ids.flatten().to_numpy().astype("<u4").tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])).tolist()
        for i, a, b in zip(which.to_pylist(), ends, ends[1:], strict=False):
            self.words.young[words[i]] = raw[a:b]

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its words, in order."""
        parts = [self.pattern.findall(t) for t in texts]
        self._learn(self.words.missing(set().union(*parts)))
        known = self.words.young
        return [list(map(known.__getitem__, p)) for p in parts]

    def decode(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The bytes of each piece of ids."""
        todo = self.decoded.missing(pieces)
        known = self.decoded.young
        known[b""] = b""
        for a in range(0, len(todo), 100_000):
            some = todo[a : a + 100_000]
            ends = pa.array(np.cumsum([0, *(len(p) // 4 for p in some)]), pa.int32())
            ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(some), "<u4").astype("i4")))
            which, texts = self._run(_DECODE, {"d": pa.array(range(len(some)), pa.int32()), "ids": ids})
            for i, s in zip(which.to_pylist(), texts.to_pylist(), strict=True):
                known[some[i]] = s.encode("latin-1")
        return known


_held: dict[tuple[str, str], Bpe] = {}


def _bpe(path: str, pattern: str) -> Bpe:
    """One for each worker process."""
    if (path, pattern) not in _held:
        _held[path, pattern] = Bpe(read_ranks(path), pattern)
    return _held[path, pattern]


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row. Null and empty texts have no ids; repeated rows stay; no special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            for start, texts in groups(batch.column("text")):
                ids = [np.frombuffer(b"".join(p), "<u4").astype("i4") for p in bpe.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        Cache.rest(bpe.words, bpe.decoded)

    rows = _named(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and decoded (binary) of rows of doc_id and ids; null and empty ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            pieces = [np.array(x.as_py() or [], "<u4").tobytes() for x in batch.column("ids")]
            decoded = bpe.decode(set(pieces))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decoded[p] for p in pieces], pa.binary())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids again, and return doc_id, n_tokens, ids_sha256 and decoded_sha256.

    The ids are decoded in the pieces that encoding gave, from the ids alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for start, texts in groups(batch.column("text")):
                encoded = bpe.encode(texts)
                decoded = bpe.decode(set().union(*encoded))
                ids = [b"".join(p) for p in encoded]
                back = [sha(b"".join(map(decoded.__getitem__, p))) for p in encoded]
                columns = [batch.column("doc_id").slice(start, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids)), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        Cache.rest(bpe.words, bpe.decoded)

    rows = _named(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
