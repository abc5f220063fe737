"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt to shards of bounded size, and each shard builds one forest: every tree is a sorted array of hash strings. A
symbol of a string is the signed axis that a vector lies nearest to after a random rotation of the tree, so near vectors
share prefixes. A query orders the symbols of every position by its own nearness to their axes. It descends in all trees to
the prefixes of its first choice and then ascends in all of them together: with each step the next choice of every position
is let in, until the ranges of one-symbol prefixes hold enough entries. A row's votes are the lengths of the prefixes by which
it was reached, over all trees; the rows of most votes are measured exactly. Ranges are taken whole and equal votes go to
smaller ids, so equal vectors are found in the order of their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read_table

TREES = 64
#: Symbols of a string, and axes that a rotation keeps at most.
LENGTH, AXES = 2, 64
#: The trees' ranges together hold so many entries for each row of the shard when the ascent ends.
REACH = 4.0
#: Of a shard's rows so large a part is measured, and SPARE times k at least.
SHARE, SPARE = 0.05, 16
SHARD_ROWS = 16_384


class Forest:
    """Of (ids, vectors) in any order; rows of one id may repeat."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by]
        self.middle = self.vectors.mean(axis=0)
        draw, d = np.random.default_rng(7), vectors.shape[1]
        m = min(d, AXES)
        self.rotations = [[np.linalg.qr(draw.standard_normal((d, m)))[0] for _ in range(LENGTH)] for _ in range(trees)]
        self.symbols = 2 * m
        moved = self.vectors - self.middle
        self.order = np.empty((trees, len(ids)), "i4")
        self.strings = np.empty((trees, len(ids)), "i8")
        for t, rotation in enumerate(self.rotations):
            string = np.zeros(len(ids), "i8")
            for r in rotation:
                p = moved @ r
                axis = np.abs(p).argmax(axis=1)
                string = string * self.symbols + 2 * axis + (p[np.arange(len(p)), axis] < 0)
            self.order[t] = np.argsort(string, kind="stable")
            self.strings[t] = string[self.order[t]]
        first = self.symbols ** (LENGTH - 1)
        self.starts = np.stack([np.searchsorted(s, np.arange(self.symbols + 1) * first) for s in self.strings])

    def _choices(self, moved: np.ndarray) -> np.ndarray:
        """[tree, position, query]: the symbols, nearest first."""
        out = np.empty((len(self.rotations), LENGTH, len(moved), self.symbols), "i2")
        for t, rotation in enumerate(self.rotations):
            for k, r in enumerate(rotation):
                p = moved @ r
                out[t, k] = np.argsort(-np.stack([p, -p], axis=2).reshape(len(p), -1), axis=1)
        return out

    def votes(self, choices: np.ndarray, reach: float) -> np.ndarray:
        """The rows' votes for one query, of choices [tree, position, symbol]."""
        n, tree = len(self.ids), np.arange(len(choices))[:, None]
        low, high = self.starts[tree, choices[:, 0]], self.starts[tree, choices[:, 0] + 1]
        width = 1 + int(np.searchsorted(np.cumsum((high - low).sum(axis=0)), reach * n))
        low, high = low[:, :width], high[:, :width]
        sizes = (high - low).ravel()
        at = np.repeat((low + tree * n).ravel() - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rows, strings, which = self.order.ravel()[at], self.strings.ravel()[at], np.repeat(tree.ravel(), (high - low).sum(axis=1))
        out = np.bincount(rows, minlength=n)
        for k in range(1, LENGTH):  # of those that match so far, the ones whose next symbol is let in
            near = np.zeros((len(choices), self.symbols), bool)
            near[tree, choices[:, k, :width]] = True
            hit = near[which, strings // self.symbols ** (LENGTH - 1 - k) % self.symbols]
            rows, strings, which = rows[hit], strings[hit], which[hit]
            out += np.bincount(rows, minlength=n)
        return out

    def candidates(self, query_votes: np.ndarray, own: int, k: int, share: float) -> np.ndarray:
        """The rows to measure, in the order of their ids: those of most votes, of equal ones the smaller ids."""
        n = len(self.ids)
        most = max(math.ceil(share * n), SPARE * k)
        worth = query_votes.astype("i8") * n - np.arange(n)
        worth[self.ids == own] = np.iinfo("i8").min
        at = np.arange(n) if most >= n else np.sort(np.argpartition(-worth, most)[:most])
        return at[self.ids[at] != own]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, share: float = SHARE, reach: float = REACH) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query (ids, distances) of its k nearest among the candidates, ties to smaller ids, and how many rows were
        measured for all of them. Rows with a query's own id are left out."""
        out, measured = [], 0
        for a in range(0, len(queries), 256):
            choices = self._choices(queries[a : a + 256] - self.middle)
            for q in range(choices.shape[2]):
                at = self.candidates(self.votes(choices[:, :, q], reach), int(own[a + q]), k, share)
                measured += len(at)
                far = np.sqrt(((self.vectors[at] - queries[a + q]) ** 2).sum(axis=1))
                by = np.lexsort((self.ids[at], far))[:k]
                out.append((self.ids[at[by]], far[by]))
        return out, measured


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of vectors that take part: with an id, not null, not zero, all components finite."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by Euclidean distance.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without an id. Candidates
    have the query's dimension and another id. Of several queries with one id the smallest vector asks; of several rows with
    one id the nearest counts. Fewer rows than k give all of them. Empty tables give no rows. Other columns don't matter.

    A shard's rows come before the queries in its task, which builds each forest once and then takes the queries as a stream
    of batches, however many there are.
    """
    rows, asked = _valid(vectors, id_col, vector_col), _valid(queries, id_col, vector_col)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    deal = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    left = rows.select(deal.alias("shard"), F.size("v").alias("d"), F.lit(False).alias("asks"), "id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("d"), F.lit(True).alias("asks"), "id", "v")
    met = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "d", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple | None = None  # the shard and dimension that `held` and `forest` belong to
        held: list[tuple[np.ndarray, np.ndarray]] = []
        forest: Forest | None = None
        for batch in batches:
            shard, size, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "d", "asks"))
            new = np.r_[True, (shard[1:] != shard[:-1]) | (size[1:] != size[:-1]) | (asks[1:] != asks[:-1])] if batch.num_rows else np.zeros(0, bool)
            ends = [*np.flatnonzero(new)[1:].tolist(), batch.num_rows]
            for a, b in zip(np.flatnonzero(new).tolist(), ends, strict=False):
                if (shard[a], size[a]) != of:
                    of, held, forest = (shard[a], size[a]), [], None
                part = batch.slice(a, b - a)
                ids, v = part.column("id").to_numpy(), part.column("v").flatten().to_numpy().reshape(b - a, int(size[a]))
                if not asks[a]:
                    held.append((ids, v))
                    continue
                if held:
                    forest, held = Forest(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if forest is not None:
                    found = forest.search(v, ids, k, share)[0]
                    near = [len(x) for x, _ in found]
                    columns = [pa.array(np.repeat(ids, near)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([y for _, y in found]))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))
