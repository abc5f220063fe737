"""Near-duplicate detection by DartMinHash signatures and banded joins.

Each shingle owns a plane of weight by rank on which hashed darts fall as a Poisson process of intensity one; a document
takes the darts that lie within the weight of its shingles, up to a rank at which about K ln K + 2 K darts are to be expected
however many shingles it has. A dart hits one of K coordinates, and the earliest dart of each is the
signature. Two documents agree in a coordinate with the probability of their (weighted) Jaccard similarity. Bands of
coordinates are joined, candidates are checked exactly on their shingle sets, and links become classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, build_bloom, holds
from .chunks import Cache, groups
from .common import discard, materialize, read_table, repeated
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Two documents of similarity 0.8 share no band with chance (1 - 0.8 ** 5) ** 28 < 2e-5.
BANDS, ROWS = 28, 5
#: Words whose hashes a worker keeps between groups of texts; rarer ones are soon hashed again.
CACHE = 50_000
#: Texts, pairs or sets that a worker is handed at once.
BATCH = 1_000
#: Texts in a block of a bucket, and cells of a matrix of their shingles.
BLOCK, CELLS = 512, 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


_words = Cache(CACHE)


def _word_hashes(parts: list[list[str]]) -> np.ndarray:
    known = _words.young
    for w in _words.missing(set().union(*parts)):
        _words.young[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    known = _words.young
    return np.fromiter((known[w] for p in parts for w in p), "u8", sum(map(len, parts)))


def _runs(texts: list[str], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The 64-bit hashes of each text's runs of `width` words (between white space) in the order of the text; a shorter text
    with words has one, all of it."""
    parts = [t.split() for t in texts]
    flat = _word_hashes(parts)
    at = 0
    for p in parts:
        h = flat[at : at + len(p)]
        at += len(p)
        if not len(h):
            yield np.zeros(0, "u8")
            continue
        k = min(width, len(h))
        s = np.full(len(h) - k + 1, k, "u8")
        for i in range(k):
            s = _mix(s * _A + h[i : len(h) - k + 1 + i])
        yield s


def shingles(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct runs."""
    return [np.unique(s) for s in _runs(texts, width)]


def counted_shingles(texts: list[str], width: int = SHINGLE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same, and how often each stands in the text."""
    both = [np.unique(s, return_counts=True) for s in _runs(texts, width)]
    return [s for s, _ in both], [n.astype(float) for _, n in both]


def spread_out(shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A set in which a shingle of count n stands for n members, so that plain Jaccard similarity of such sets is the weighted one."""
    n = count.astype(int)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(np.where(number == 0, np.repeat(shingle, n), _mix(np.repeat(shingle, n) * _A + number.astype("u8"))))


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """One row of k 64-bit dart names for each set; weights (all one by default) are positive. Empty sets give zeros."""
    out = np.zeros((len(sets), k), "u8")
    todo = [i for i, s in enumerate(sets) if len(s)]
    expect = k * math.log(k) + 2 * k
    while todo:
        sizes = np.array([len(sets[i]) for i in todo])
        item = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        weight = np.ones(len(item)) if weights is None else np.concatenate([weights[i] for i in todo])
        norm = np.bincount(owner, weight, len(todo))
        most = (expect / norm)[owner]
        ranks, names, owners = [], [], []
        level = 0
        while len(item):  # slabs of the weight axis: [0, 1), [1, 2), [2, 4), ...; in each, darts come in order of rank
            low, high = (0.0, 1.0) if level == 0 else (float(1 << (level - 1)), float(1 << level))
            inside = weight > low
            item, owner, weight, most = item[inside], owner[inside], weight[inside], most[inside]
            if not len(item):
                break
            state = _mix(item * _B + np.uint64(seed * 1000 + level))
            rank = -np.log(_unit(state)) / (high - low)
            i, limit, w, o = state, most, weight, owner
            while True:
                near = rank <= limit
                if not near.any():
                    break
                i, limit, w, o, rank = i[near], limit[near], w[near], o[near], rank[near]
                hit = low + _unit(_mix(i ^ _A)) * (high - low) < w
                ranks.append(rank[hit])
                names.append(i[hit])
                owners.append(o[hit])
                i = _mix(i + _A)
                rank = rank - np.log(_unit(i)) / (high - low)
            level += 1
        rank, name, o = np.concatenate(ranks), np.concatenate(names), np.concatenate(owners)
        cell = o * k + (_mix(name ^ _B) % np.uint64(k)).astype(int)
        order = np.lexsort((rank, cell))
        cell, first = np.unique(cell[order], return_index=True)
        got = np.zeros(len(todo) * k, "u8")
        got[cell] = name[order][first] | np.uint64(1)
        got = got.reshape(len(todo), k)
        full = (got != 0).all(axis=1)
        for r in np.flatnonzero(full):
            out[todo[r]] = got[r]
        todo = [i for i, f in zip(todo, full, strict=True) if not f]
        expect *= 2  # a coordinate without a dart: throw further
    return out


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.tile(np.arange(bands, dtype="u8"), (len(signatures), 1))
    for r in range(rows):
        out = _mix(out * _A + signatures[:, r::rows][:, :bands])
    return out.view("i8")


def _signed(rows: DataFrame, weighted: bool) -> DataFrame:
    """key and bands of rows of key and text; rows without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Cache.rest()
        for batch in batches:
            for start, texts in groups(batch.column("text")):
                sets, weights = counted_shingles(texts) if weighted else (shingles(texts), None)
                at = np.array([i for i, s in enumerate(sets) if len(s)], int)
                for a in range(0, len(at), 256):
                    some = at[a : a + 256]
                    bands = band_hashes(dart_signatures([sets[i] for i in some], weights and [weights[i] for i in some]))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                    key = batch.column("key").slice(start, len(texts)).take(pa.array(some))
                    doc = batch.column("doc_id").slice(start, len(texts)).take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([doc, key, lists], ["doc_id", "key", "bands"])
        Cache.rest()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, bands array<long>")


def _sets(rows: DataFrame, weighted: bool) -> DataFrame:
    """key and the sorted shingle hashes as bytes of rows of key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Cache.rest()
        for batch in batches:
            for start, texts in groups(batch.column("text")):
                sets = [s.tobytes() for s in (map(spread_out, *counted_shingles(texts)) if weighted else shingles(texts))]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(texts)), pa.array(sets, pa.binary())], ["key", "shingles"])
        Cache.rest()

    return rows.select("key", "text").mapInArrow(run, "key binary, shingles binary")


def _similar(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose sets sa, sb have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8")
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    keep.append(False)
                    continue
                small, large = (x, y) if len(x) < len(y) else (y, x)
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                keep.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        Cache.rest()

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string")))


def _stars(members: DataFrame) -> DataFrame:
    """Within each band's bucket (value, key), edges from every key to the bucket's least and greatest. The ends are written
    first, so that a join that takes them can split a bucket's members."""
    ends = members.groupBy("value").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    ends = materialize(ends, "minhash-ends")
    joined = members.join(ends.withColumnRenamed("value", "v"), F.col("value") == F.col("v"), "inner")
    ways = F.array(F.struct(F.col("key").alias("a"), F.col("low").alias("b")), F.struct(F.col("high").alias("a"), F.col("key").alias("b")))
    return joined.select(F.explode(ways).alias("e")).select("e.a", "e.b").where("a > b").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def links_between(sets: list[np.ndarray], roots: list[bytes], blocks: np.ndarray, least: float) -> list[tuple[bytes, bytes]]:
    """Pairs of roots, one for each two classes of which two sets of different blocks (of one block, if there is but one) are similar.

    Shingles are folded to so many columns that a product of counts, which is never below the number of common shingles, leaves few
    pairs to look at one by one; it is taken for so many rows at once as fit CELLS.
    """
    sizes, names = np.array(list(map(len, sets))), sorted(set(roots))
    number = dict(zip(names, range(len(names)), strict=True))
    root, joined = np.array([number[r] for r in roots]), list(range(len(names)))

    def find(x: int) -> int:
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    order = np.argsort(sizes, kind="stable")
    width = 1 << max(10, int(8 * np.median(sizes)).bit_length())
    step = max(16, CELLS // width)
    parts = [order[a : a + step] for a in range(0, len(order), step)]
    several = blocks.min() != blocks.max()
    out = []

    def folded(rows: np.ndarray) -> np.ndarray:
        at = np.concatenate([i * width + (sets[r] % np.uint64(width)).astype("i8") for i, r in enumerate(rows)])
        return np.bincount(at, minlength=len(rows) * width).reshape(len(rows), width).astype("f4")

    for p, rows in enumerate(parts):
        left = None
        for others in parts[p:]:
            if sizes[rows[-1]] < least * sizes[others[0]]:
                break  # sizes ascend: all further ones are too long
            left = folded(rows) if left is None and len(sets) > 8 else left
            bound = left @ folded(others).T if left is not None else np.minimum(sizes[rows][:, None], sizes[others])
            need = least / (1 + least) * (sizes[rows][:, None] + sizes[others])
            maybe = (bound >= need - 1e-3) & (root[rows][:, None] != root[others])
            if several:
                maybe &= blocks[rows][:, None] != blocks[others]
            for i, k in np.argwhere(maybe):
                x, y = rows[i], others[k]
                if find(root[x]) != find(root[y]) and _common(sets[x], sets[y]) >= need[i, k] - 1e-9:
                    joined[find(root[x])] = find(root[y])
                    out.append((roots[x], roots[y]))
    return out


def _within_buckets(rooted: DataFrame, several: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the classes that meet in a bucket (rooted: value, key, root; several: v, n of buckets with two classes or more).

    A bucket is dealt over blocks of about BLOCK texts, and each two blocks meet in one place, so that no task holds a bucket. No
    pairs are made as rows: a place gives the links that join classes, fewer than it has texts.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rooted.join(several, F.col("value") == F.col("v"), "inner").withColumn("blocks", blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(sets, "key")
    other = rows.select("value", "root", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    placed = other.select("value", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("k"), "root", "block", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def links() -> pa.RecordBatch:
            found = links_between([np.frombuffer(s, "u8") for s, _, _ in held], [r for _, r, _ in held], np.array([b for _, _, b in held]), least)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

        for batch in batches:
            place = zip(*(batch.column(c).to_pylist() for c in ("value", "i", "k")), strict=True)
            for where, s, r, b in zip(place, *(batch.column(c).to_pylist() for c in ("shingles", "root", "block")), strict=True):
                if where != at:
                    if len(held) > 1:
                        yield links()
                    at, held = where, []
                held.append((s, r, b))
        if len(held) > 1:
            yield links()
        held = []
        Cache.rest()

    return placed.repartition("value", "i", "k").sortWithinPartitions("value", "i", "k").mapInArrow(run, "a binary, b binary")


def _bloom(keys: DataFrame) -> Bloom | None:
    n = keys.count()
    return build_bloom(keys.select("key"), n, 0.01) if n else None


def _maybe(bloom: Bloom | None, key: Column) -> Column:
    return F.lit(True) if bloom is None else holds(bloom, key)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, classes): key, least doc_id and rows of each distinct text with words; key and root of those in a class
    with another text.

    Distinct texts are signed once and every band's bucket offers its members' pairs with its least and greatest member,
    so a bucket of n costs 2 n pairs. Pairs that are checked and similar make classes, which settles most buckets. Those that
    still hold several classes are compared whole, in blocks, so every two texts of a bucket have been compared or are in one class.

    `weighted`: darts fall on regions as wide as a shingle is often in its text, and similarity is that of the counts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("key", text_key(F.col("text")))
    signed = materialize(_signed(rows, weighted), "minhash-signed", BATCH)
    texts = materialize(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "minhash-texts")
    discard(signed)
    every = texts.select("key", F.explode("bands").alias("value"))
    shared = materialize(every.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("value").alias("v")), "minhash-shared")
    members = materialize(every.join(shared, F.col("value") == F.col("v"), "left_semi"), "minhash-buckets")
    discard(shared)
    needed = members.select("key").distinct()
    bloom = _bloom(needed)
    wanted = rows.where(_maybe(bloom, F.col("key"))).join(needed.join(texts.select("key", "least"), "key"), "key", "inner")
    one = wanted.where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("key").agg(F.first("text").alias("text"))
    sets = materialize(_sets(one, weighted), "minhash-sets", BATCH)
    none = texts.select(F.col("key").alias("node"), F.col("key").alias("root")).limit(0)
    pairs = materialize(_stars(members), "minhash-pairs")
    if not pairs.head(1):
        return texts.drop("bands"), none
    with_sets = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    links = materialize(_similar(with_sets, similarity), "minhash-links", BATCH)
    classes = materialize(components(links, "minhash-components"), "minhash-classes")
    rooted = materialize(members.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "minhash-rooted")
    kinds = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    several = materialize(kinds.where("low < high").select(F.col("value").alias("v"), "n"), "minhash-several")
    more = materialize(_within_buckets(rooted, several, sets, similarity), "minhash-links", BATCH)
    if more.head(1):
        old, classes = classes, materialize(components(links.unionByName(more), "minhash-components"), "minhash-classes")
        discard(old)
    discard(members, sets, rooted, several, pairs, links, more)
    return texts.drop("bands"), classes


def class_ids(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """key, root (the class, a text's key), first (doc_id and key of the class's first row: that of the least doc_id, null ids last, of
    the least key among those) and class_rows, for each distinct text with words."""
    texts, classes = near_classes(docs, similarity, id_col, text_col, weighted)
    rooted = texts.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    place = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "key")
    ids = rooted.groupBy("root").agg(F.min(place).alias("first"), F.sum("copies").alias("class_rows")).withColumnRenamed("root", "r")
    ids = materialize(ids, "minhash-firsts")
    out = materialize(rooted.join(ids, F.col("root") == F.col("r"), "inner").select("key", "root", "first", "class_rows"), "minhash-ids")
    discard(texts, classes, ids)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """One row per input row: doc_id, class_id, class_key, class_rows (rows in the class) and kept (the class's first row).

    Similarity is Jaccard on the sets of five-word shingles of whole texts, or on their counts if `weighted`; equal texts are
    copies. A class has the id of its least doc_id (null if all are null), and as ids may repeat, also a key of its own. Just one
    row of a class is kept, also where rows repeat or ids are shared or null. Null texts and texts without words are each in a
    class of their own, with their doc_id and no key, and are kept. Empty tables give no rows; other columns don't matter.
    """
    ids = class_ids(docs, similarity, id_col, text_col, weighted).withColumnRenamed("key", "k")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"))
    counted = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("__tm_n"))  # equal rows, of which one may be kept
    joined = repeated(counted.join(ids, F.col("key") == F.col("k"), "left"), "__tm_n", "__tm_i")
    own = F.col("k").isNull()
    first = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("__tm_i") == 0)
    return joined.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.lower(F.hex("root")).alias("class_key"),
        F.when(own, F.lit(1)).otherwise(F.col("class_rows")).cast("long").alias("class_rows"),
        (own | first).alias("kept"),
    )


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """One row of each class, with all columns of documents: that of the least doc_id (null ids come last), of several the
    one of the least text key; of repeated rows one. Null texts and texts without words stay, and so does an empty table."""
    ids = class_ids(docs, similarity, weighted=weighted)
    at_stake = ids.where("class_rows > 1").select(F.col("key").alias("__tm_k"), F.col("root").alias("__tm_root"), F.col("first").alias("__tm_first"))
    if not at_stake.head(1):
        return docs
    bloom = _bloom(at_stake.select(F.col("__tm_k").alias("key")))
    keyed = docs.withColumn("__tm_key", text_key(F.col("text")))
    hit = F.coalesce(_maybe(bloom, F.col("__tm_key")), F.lit(False))
    free = keyed.where(~hit).select(*docs.columns)
    joined = keyed.where(hit).join(at_stake, F.col("__tm_key") == F.col("__tm_k"), "left")
    alone = joined.where("__tm_k is null").select(*docs.columns)
    firsts = joined.where((F.col("__tm_key") == F.col("__tm_first.key")) & F.col("doc_id").eqNullSafe(F.col("__tm_first.doc_id")))
    return free.unionByName(alone).unionByName(firsts.dropDuplicates(["__tm_root"]).select(*docs.columns))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
