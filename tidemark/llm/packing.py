"""Packing documents into sequences by cutting-stock column generation.

Whole blocks of the capacity are cut off each document first; only what remains is packed. The histogram of the
remainders (at most capacity - 1 lengths) goes to a linear program whose rounded patterns are handed out to the
documents by their rank within their length class. What no good pattern takes is laid end to end and cut
at the capacity; the last, shorter stretch is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import cutting_stock
from .chunks import Cache, groups
from .common import before, materialize, numbered, read_table, row_key

CAPACITY = 2048
END_ID = 1
#: A pattern may leave so many places of a sequence empty.
WASTE = 4
#: Up to so many cut documents are sent to every executor; more are joined by a shuffle.
SMALL = 20_000
CACHE = 400_000
WORD_END = "</w>"
#: Stands between chunks that are encoded in one line.
BETWEEN = "\x01"


#: A mark between a letter and white space is a pre-token of its own.
_MARK = re.compile(r"([.,;:!?])(?<=[^\W\d_].)(?=[ \n]|\Z)")
#: Texts with these are left as they are: other scripts, whose case and marks need care, and special strings.
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f]|<\\|")


def _plain(text: str) -> bool:
    return "<|" not in text if text.isascii() else not _OTHER.search(text)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes. The tokenizer drops white space and case, so what stands between two
    spaces is encoded alike everywhere and kept; the library itself encodes what the cache misses. Each different chunk of a
    group is looked up once, and its ids are laid out by numpy wherever it stands."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.final[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.known = Cache(CACHE)

    def _learn(self, chunks: list[str]) -> None:
        """Chunks of letters are one word each, so a line of them is encoded at once and cut at the word ends. Other plain chunks
        are encoded in lines with a control character between them, which is a token of its own. If the cuts are not as many as
        they have to be, and for all other chunks, each is encoded alone."""
        known, alone, mixed = self.known.young, [], []
        words = [c for c in chunks if c.isalpha()]
        for c in chunks:
            if not c.isalpha():
                (mixed if self.between is not None and BETWEEN not in c and _plain(c) else alone).append(c)
        for a in range(0, len(words), 2_000):
            some = words[a : a + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(some):
                alone += some
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            known.update((w, raw[x:y]) for w, x, y in zip(some, cuts, cuts[1:], strict=False))
        for a in range(0, len(mixed), 2_000):
            some = mixed[a : a + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.between)
            if len(at) != len(some) - 1:
                alone += some
                continue
            raw = ids.tobytes()
            known.update((c, raw[4 * x : 4 * y]) for c, x, y in zip(some, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True))
        for a in range(0, len(alone), 20_000):
            some = alone[a : a + 20_000]
            for chunk, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[chunk] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        plain = [_MARK.sub(r" \1", t.lower()) if _plain(t) else t for t in texts]
        parts = pc.split_pattern(pc.replace_substring(pa.array(plain, pa.string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        # as one text, which is much faster to take over than a string at a time; chunks hold no space
        chunks = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ")
        where = coded.indices.to_numpy()
        self._learn(self.known.missing(set(chunks)))
        known = self.known.young
        pieces = [known[c] for c in chunks]
        sizes = np.array([len(x) // 4 for x in pieces], int)
        n = sizes[where]
        stop = np.cumsum(n)
        # of each id: where its chunk's ids begin, and how far behind their first it stands
        at = np.repeat((np.cumsum(sizes) - sizes)[where] - (stop - n), n)
        at += np.arange(len(at))
        raw = np.frombuffer(b"".join(pieces), "<u4")[at].tobytes()
        edges = (4 * np.r_[0, stop][parts.offsets.to_numpy()]).tolist()
        return [raw[a:b] + end for a, b in zip(edges, edges[1:], strict=False)]


_held: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def _check_drops_space(path: str) -> None:
    from json import load

    with open(path) as f:
        spec = load(f)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if spec["model"].get("end_of_word_suffix") != WORD_END:
        raise ValueError(f"{path}: a tokenizer that marks word ends is needed")
    cased = {"type": "Lowercase"} not in (spec["normalizer"] or {}).get("normalizers", [])
    if cased or not steps or steps[0]["type"] != "Split" or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
        raise ValueError(f"{path}: a tokenizer that drops white space and case is needed")


def tokenized(rows: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, __tm_key, n and crcs: the checksum of each block of `capacity` ids and of the remainder, of rows of
    doc_id, __tm_key, text."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * capacity
        for batch in batches:
            for start, texts in groups(batch.column("text")):
                ids = _encoder(path).encode(texts, end)
                crcs = [[zlib.crc32(memoryview(x)[a : a + step]) for a in range(0, len(x), step)] for x in ids]
                columns = [*(batch.column(c).slice(start, len(texts)) for c in ("doc_id", "__tm_key")), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "__tm_key", "n", "crcs"])
        Cache.rest(_encoder(path).known)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, __tm_key string, n long, crcs array<long>")


def _checksums(rows: DataFrame, path: str, end_id: int) -> DataFrame:
    """Key, start, length and checksum of the pieces in `cuts` of each row's text."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in groups(batch.column("text")):
                out: list[tuple] = []
                cuts = batch.column("cuts").slice(first, len(texts)).to_pylist()
                keys = batch.column("__tm_key").slice(first, len(texts)).to_pylist()
                for key, pieces, ids in zip(keys, cuts, _encoder(path).encode(texts, end), strict=True):
                    view = memoryview(ids)
                    out += [(key, p["start"], p["length"], zlib.crc32(view[4 * p["start"] : 4 * (p["start"] + p["length"])])) for p in pieces]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "s", "l", "ids_crc32"])
        Cache.rest(_encoder(path).known)

    return rows.mapInArrow(run, "k string, s long, l long, ids_crc32 long")


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY, waste: int = WASTE) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The classes' upper ends and the (times used, pattern) list for a histogram of lengths below the capacity."""
    counts = np.zeros(capacity, int)
    for length, n in histogram.items():
        counts[length] = n
    ends = cutting_stock.classes_of(counts)
    if not len(ends):
        return ends, []
    demand = np.add.reduceat(np.append(counts, 0), np.concatenate([[0], ends[:-1] + 1]))
    solution = cutting_stock.solve(ends, demand.astype(float), capacity)
    return ends, cutting_stock.rounded(solution, ends, demand, capacity, waste)


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, waste: int = WASTE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, then `end_id`; null and empty texts are that id alone. Every id lies in
    exactly one piece, repeated rows included. A sequence is shorter than the capacity by at most `waste` and the
    rounding of its length classes, or is as long as a power of two. An empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    _check_drops_space(path)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("__tm_key", row_key(F.col("doc_id"), F.col("text")))
    tokens = materialize(tokenized(rows, path, capacity, end_id), "pack-tokens")
    blocks, rest = F.floor(F.col("n") / capacity), F.col("n") % capacity
    held = {r["rest"]: r["count"] for r in tokens.select(rest.alias("rest")).groupBy("rest").count().collect()}  # at most `capacity` rows
    ends, patterns = plan_patterns({k: v for k, v in held.items() if k}, capacity, waste)

    ranges, filled, sequences = [], dict.fromkeys(range(len(ends)), 0), 0
    for times, pattern in patterns:
        for i in np.flatnonzero(pattern):
            many = int(pattern[i])
            ranges.append((int(i), filled[int(i)], filled[int(i)] + times * many, many, sequences))
            filled[int(i)] += times * many
        sequences += times
    table = spark.createDataFrame(ranges, "c int, low long, high long, many long, base long")

    edges = F.array(*[F.lit(int(e)) for e in ends]) if len(ends) else F.array().cast("array<int>")
    items = (
        tokens.where(rest > 0)
        .select("doc_id", "__tm_key", "n", rest.alias("rest"), F.element_at("crcs", -1).alias("ids_crc32"))
        .withColumn("class", F.size(F.filter(edges, lambda e: e < F.col("rest"))))
    )
    ranked = numbered(items, ["class"], ["__tm_key"], "rank")
    within = (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    place = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(table), within, "left").select(  # bounded: classes times patterns
        "doc_id", "__tm_key", "n", "rest", "ids_crc32", "class",
        (F.col("base") + F.floor(place / F.col("many"))).alias("sequence_id"), (place % F.col("many")).alias("order"),
    )
    placed = materialize(placed, "pack-items")
    start = (F.col("n") - F.col("rest")).alias("start")
    stand = W.partitionBy("sequence_id").orderBy(F.desc("class"), "order").rowsBetween(W.unboundedPreceding, -1)
    by_pattern = placed.where("sequence_id is not null").select(
        "doc_id", start, F.col("rest").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id",
        F.coalesce(F.sum("rest").over(stand), F.lit(0)).alias("offset"),
    )

    over = placed.where("sequence_id is null")
    total = over.agg(F.sum("rest").alias("t")).first()["t"] or 0
    by_cut = _laid_out(over, rows, path, total, capacity, end_id, sequences)
    after = sequences + total // capacity + capacity.bit_length()
    full = tokens.where(blocks > 0).select("doc_id", "__tm_key", "n", F.posexplode(F.slice("crcs", F.lit(1), blocks.cast("int"))).alias("b", "ids_crc32"))
    whole = numbered(full, [], ["__tm_key", "b"], "__tm_number").select(
        "doc_id", (F.col("b") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32",
        F.col("n").alias("doc_tokens"), (F.col("__tm_number") + after).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return whole.unionByName(by_pattern).unionByName(by_cut)


def _laid_out(over: DataFrame, rows: DataFrame, path: str, total: int, capacity: int, end_id: int, base: int) -> DataFrame:
    """The items that no pattern took, end to end, cut at the capacity and at powers of two at the end."""
    last = total // capacity * capacity
    sizes = [1 << k for k in range(capacity.bit_length() - 2, -1, -1) if (total - last) >> k & 1]
    ends = [last + sum(sizes[: i + 1]) for i in range(len(sizes))]
    laid = before(over.drop("sequence_id", "order"), [], ["__tm_key"], F.col("rest"), "at")
    stop = F.col("at") + F.col("rest")
    blocks = F.transform(
        F.sequence(F.floor(F.col("at") / capacity), F.floor((stop - 1) / capacity)),
        lambda b: F.struct((b * capacity).alias("low"), ((b + 1) * capacity).alias("high"), (b + base).alias("sequence_id")),
    )
    short = [(([last, *ends])[i], e, base + last // capacity + i) for i, e in enumerate(ends)]
    tail = F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), F.lit(s).cast("long").alias("sequence_id")) for a, b, s in short])
    every = F.filter(blocks, lambda x: x["low"] < last)
    if short:
        every = F.concat(every, tail)
    pieces = laid.withColumn("x", F.explode(F.filter(every, lambda x: (x["low"] < stop) & (x["high"] > F.col("at"))))).select(
        "doc_id", "__tm_key", "n", "rest", "ids_crc32",
        (F.greatest(F.col("at"), F.col("x.low")) - F.col("at") + F.col("n") - F.col("rest")).alias("start"),
        (F.least(stop, F.col("x.high")) - F.greatest(F.col("at"), F.col("x.low"))).alias("length"),
        F.col("x.sequence_id").alias("sequence_id"), (F.greatest(F.col("at"), F.col("x.low")) - F.col("x.low")).alias("offset"),
    )
    pieces = materialize(pieces, "pack-cut")
    columns = ["doc_id", "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset"]
    intact = pieces.where("length = rest").select(*columns)
    cut = pieces.where("length < rest")
    wanted = cut.select("__tm_key", "start", "length").distinct().groupBy(F.col("__tm_key").alias("__tm_want")).agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    few = cut.count() <= SMALL
    joined = rows.join(F.broadcast(wanted) if few else wanted, F.col("__tm_key") == F.col("__tm_want"), "inner").select("__tm_key", "text", "cuts")
    sums = _checksums(joined, path, end_id).groupBy("k", "s", "l").agg(F.first("ids_crc32").alias("__tm_crc"))  # repeated rows have one sum
    on = (F.col("__tm_key") == F.col("k")) & (F.col("start") == F.col("s")) & (F.col("length") == F.col("l"))
    return intact.unionByName(cut.drop("ids_crc32").join(sums, on, "inner").withColumn("ids_crc32", F.col("__tm_crc")).select(*columns))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
