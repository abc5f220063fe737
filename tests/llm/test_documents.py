"""Operators over documents: hostile rows, and brute-force versions."""

import collections
import hashlib
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import bpe, chunks, langid, minhash, packing, quality, sharding, suffix_dedup, token_counts
from tidemark.llm.common import materialize, numbered

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that clash with inner and outer ones
        T.StructField("key", T.StringType()),
        T.StructField("n_tokens", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("class_id", T.StringType()),
    ]
)
PROSE = " ".join(f"word{i % 97} of{i % 31}" for i in range(300)) + "."
TEXTS = [
    None,
    "",
    " ",
    "short",
    "No. It's <|endoftext|> 3.5 don't... É.\n\n  ß 中文 😀 \x00 \x1c İ.",
    PROSE,
    PROSE,
    PROSE + " tail",
    "head " + PROSE,
    "x" * 3000,
    "lorem ipsum dolor " * 4000,
    "a b c d e f g\n" * 40,
    "12345 67890 !!! ??? ###",
]


def rows(texts=TEXTS):
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None if t is None else len(t), "k", "n", i, "c") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, PROSE, None, None, None, None, None, None, None), (5, "another text with the same id", "en", "s1", 29, "k", "n", 1, "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1] or "") for r in rows()]


def test_bpe_is_the_librarys(docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t in pairs():
        ids = library.encode_ordinary(t)
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())))
    got = [tuple(r) for r in bpe.round_trip(docs, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted(str((r.doc_id, bytes(r.decoded).decode())) for r in back) == sorted(map(str, pairs()))
    assert bpe.round_trip(empty, path).count() == 0


def test_long_words_follow_the_same_rule():
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    one = bpe.Bpe(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("a" * 700, "abcab" * 130, "thethe" * 90 + "ing"):
        assert np.frombuffer(one._long(word.encode()), "<u4").tolist() == library.encode_ordinary(word)


def test_token_counts_are_the_librarys(docs, empty):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = []
    for i, t in pairs():
        n = len(library.encode(t, add_special_tokens=False).ids)
        expected.append((i, len(t.encode()), n, n > 1024))
    assert sorted(map(str, map(tuple, token_counts.count_tokens(docs, path).collect()))) == sorted(map(str, expected))
    assert token_counts.count_tokens(empty, path).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, P.path("word_bpe_49k.json"))


def check_packing(pieces, expected):
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    got = collections.Counter((p.doc_id, p.doc_tokens) for p in pieces for _ in range(p.length))
    want = collections.Counter()
    for i, ids in expected:
        want[i, len(ids)] += len(ids)
    assert got == want
    valid = collections.Counter()
    for i, ids in expected:
        for p in {(p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i and p.doc_tokens == len(ids)}:
            valid[i, p] += zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes()) == p[2]
    assert all(valid[p.doc_id, (p.start, p.length, p.ids_crc32)] for p in pieces)
    return sum(2048 - n for h in by_sequence.values() if (n := sum(p.length for p in h)) & (n - 1)), len(by_sequence)


def test_packing_encodes_chunks_in_lines(monkeypatch):
    """Words with marks are encoded many at a time, and control characters inside texts don't shift what stands between them."""
    path = P.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    asked = []
    library_call = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library_call.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    texts = [" ".join(f"ab{i}*** x{i}," for i in range(300)), "a\x01b \x01 \x01\x01 c,\x01 d.\n\x01", "", " ", "\x01", "É, ñ!\tб? <|ENDOFTEXT|>, e\u0301 İ.", "a  b\u00a0c,\u2003d \r\n e", "<|endoftext|> f."]
    got = encoder.encode(texts, b"")
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 40  # 600 of the chunks are plain


def test_packing_keeps_every_id(docs, empty, spark, sf):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    check_packing(packing.pack(docs, path).collect(), [(i, ids(t)) for i, t in pairs()])
    assert packing.pack(empty, path).count() == 0
    real = spark.read.parquet(f"{sf}/documents.parquet")
    padded, sequences = check_packing(packing.pack(real, path).collect(), [(r.doc_id, ids(r.text)) for r in real.collect()])
    assert padded < 0.02 * 2048 * sequences


def brute_quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_measures(docs, empty):
    got = sorted(str((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))) for r in quality.quality_report(docs).collect())
    assert got == sorted(str((i, brute_quality(t))) for i, t in pairs())
    assert quality.quality_report(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_a_bad_host_goes_and_a_good_one_stays(spark):
    good = " ".join(f"w{i}" for i in range(80))
    data = [(i, good + f" {i}" if i % 100 or h == "good" else good, h) for h in ("good", "fair") for i in range(100)]
    data += [(i, "too short" if i else good, "bad") for i in range(100)]
    report = {(r.doc_id, r.base_failed, r.kept) for r in quality.quality_report(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert (0, False, False) in report and (7, False, True) in report


def test_rare_hosts_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(quality, "HOT_PART", 3)
    good = " ".join(f"w{i}" for i in range(80))
    data = [(i, good if i % 7 else "short", None if i % 5 == 4 else "big" if i % 2 else f"s{i % 40}") for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    monkeypatch.setattr(quality, "HOT_PART", 10_000)
    every = sorted(map(tuple, quality.quality_report(df).collect()))
    monkeypatch.setattr(quality, "HOT_PART", 3)
    assert sorted(map(tuple, quality.quality_report(df).collect())) == every and len(every) == 400


def test_sharding_moves_rows_only_into_the_new_shard(docs, empty, spark):
    out = sharding.shard_documents(docs, sharding.founding_tree(40)).collect()
    assert len(out) == len(pairs())
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in out) == sorted(str((i, len(t.encode()) + 16, zlib.crc32(t.encode()))) for i, t in pairs())
    many = sharding.shard_documents(spark.range(4000).selectExpr("id as doc_id", "'x' as text"), sharding.founding_tree(40)).collect()
    assert {r.shard for r in many} == set(range(40))
    assert {r.grown_shard for r in many if r.grown_shard != r.shard} == {40}
    by = collections.defaultdict(list)
    for r in many:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(empty, sharding.founding_tree(3)).count() == 0


def test_the_tree_is_descended_by_the_least_draw(spark):
    import math
    import struct

    import xxhash

    def draw(name, key, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=xxhash.xxh64_intdigest(name.encode(), seed=42))
        return -math.log(((h & ((1 << 52) - 1)) + 0.5) / (1 << 52)) / weight

    def brute(key, tree):
        total = lambda rack: sum(w for _, w in rack)
        g = min(range(len(tree.regions)), key=lambda g: draw(f"g{g}", key, sum(map(total, tree.regions[g]))))
        first = sum(len(region) for region in tree.regions[:g])
        r = min(range(len(tree.regions[g])), key=lambda r: draw(f"r{first + r}", key, total(tree.regions[g][r])))
        return g, first + r, min(tree.regions[g][r], key=lambda s: draw(f"s{s[0]}", key, s[1]))[0]

    uneven = sharding.Tree(((((0, 1.0), (1, 3.0)), ((2, 0.5),)), (((3, 2.0), (4, 2.0)),)))
    for tree in (sharding.founding_tree(40), uneven):
        got = sharding.shard_documents(spark.range(2000).selectExpr("id * 7919 - 5000 as doc_id", "'x' as text"), tree).collect()
        assert all((r.region, r.rack, r.shard) == brute(r.doc_id, tree) and r.grown_shard == brute(r.doc_id, tree.grown())[2] for r in got)
    part = collections.Counter(r.shard for r in got)
    assert all(abs(part[s] / 2000 - w / 8.5) < 0.05 for region in uneven.regions for rack in region for s, w in rack)


def test_a_changed_weight_moves_rows_only_through_its_subtree(spark):
    keys = spark.range(3000)
    tree = sharding.founding_tree(16)
    light = sharding.Tree(tree.regions[:-1] + (((((8, 0.5), (9, 1.0), (10, 1.0), (11, 1.0))), tree.regions[-1][1]),))
    from pyspark.sql import functions as F

    moved = keys.select(*[c.alias(n) for t, p in ((tree, "a"), (light, "b")) for c, n in zip(sharding.place(F.col("id"), t), (p + "g", p + "r", p + "s"), strict=True)]).collect()
    assert all(r.ag == r.bg or r.ag == 1 for r in moved)
    assert any(r["as"] != r.bs for r in moved)


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 3, i // 2) for i in range(500)], "g int, x int")
    by = collections.defaultdict(list)
    for r in numbered(df, ["g"], ["x"], "n").collect():
        by[r.g].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(r.n for r in numbered(df, [], ["x"], "n").collect()) == list(range(500))


def test_repeated_rows_are_numbered_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.llm import common

    monkeypatch.setattr(common, "COPIES", 7)
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 3, 1 if i < 400 else i) for i in range(600)], "g int, x int")
    by = collections.defaultdict(list)
    for r in numbered(df, ["g"], ["x"], "n").collect():
        by[r.g].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 600
    at = sorted((r.n, r.x) for r in common.before(df, [], ["x"], F.col("x"), "n").collect())
    assert at[0][0] == 0 and all(b[0] == a[0] + a[1] for a, b in zip(at, at[1:], strict=False)) and len(at) == 600


def brute_repeats(data):
    first = {}
    for i, t in data:
        for a in range(len(t) - 49):
            if i is not None:
                w = t[a : a + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if i is not None and first[t[a : a + 50]] < i:
                gone[a : a + 50] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, "u1")[~gone])).hexdigest()))
    return sorted(map(str, out))


def test_suffix_dedup_is_exact(docs, empty, spark):
    got = sorted(str(tuple(r)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in pairs()])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdeé"), 160)) for _ in range(12)]
    data = []
    for i in range(60):
        a, b = rng.integers(0, 12, 2)
        x, y = rng.integers(0, 120, 2)
        data.append((int(i // 1.1), base[a][x : x + int(rng.integers(30, 90))] + base[b][y : y + int(rng.integers(45, 56))]))
    passage = "".join(rng.choice(list("abcdeé"), 90))
    for i in range(80):  # one passage in ever different company
        a, b, c = (int(rng.integers(0, n)) for n in (70, 70, 20))
        around = ["".join(rng.choice(list("vwxyz"), n)) for n in (a, b)]
        data.append((200 - i // 2 * 2 if i % 9 == 0 else 100 + i, around[0] + passage[c : c + 70] + around[1]))
    # few to a shard and few documents of a common anchor deal buckets over shards and parts, which are merged
    for shard, common in ((suffix_dedup.SHARD, suffix_dedup.COMMON), (20, suffix_dedup.COMMON), (suffix_dedup.SHARD, 2), (20, 5)):
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        got = sorted(str(tuple(r)) for r in suffix_dedup.remove_repeats(df, shard=shard, common=common).collect())
        assert got == brute_repeats([(i, t.encode()) for i, t in data])


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for sizes in ([500], [30] * 40, [int(x) for x in rng.integers(1, 90, 60)]):
        texts = [rng.integers(97, 99, n).astype("u1").tobytes() for n in sizes]
        texts += texts[:3]
        data, stop = np.frombuffer(b"".join(texts), "u1"), np.cumsum(list(map(len, texts)))
        ends = np.repeat(stop, list(map(len, texts)))
        raw = [data[i:e].tobytes() for i, e in enumerate(ends)]
        order = suffix_dedup.suffix_array(data, ends)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (raw[i], i))
        for k, n in enumerate(suffix_dedup.common_prefixes(data, order, ends, 50).tolist()):
            if k:
                a, b = raw[order[k - 1]], raw[order[k]]
                assert n == min(50, next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))


def test_a_shard_is_sorted_in_bounded_memory():
    """A full shard's arrays, under two of which an executor has to stay, and their result against plain sorting."""
    import tracemalloc

    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 200).astype("u1").tobytes()
    contexts = [passage[a : a + 50] + rng.integers(97, 123, 30).astype("u1").tobytes() for a in rng.integers(0, 150, 4000)]
    tracemalloc.start()
    which, offset, new, at = suffix_dedup.equal_strings(contexts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * sum(map(len, contexts))
    strings = [contexts[w][o : o + 50] for w, o in zip(which, offset, strict=True)]
    assert strings == sorted(c[i : i + 50] for c in contexts for i in range(31))
    assert new.tolist() == [True, *(a != b for a, b in zip(strings, strings[1:], strict=False))]
    assert at.tolist() == (which.astype(int) * 80 + offset).tolist()


def test_more_than_a_shard_is_sorted_alike():
    """Beyond 2^21 bytes positions no longer fit beside a pair of ranks."""
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 101, 4000).astype("u1").tobytes()
    contexts = [passage[a : a + 80] for a in rng.integers(0, 3920, 27_000)]
    assert len(b"".join(contexts)) >= 1 << 21
    which, offset, new, at = suffix_dedup.equal_strings(contexts)
    data = np.frombuffer(b"".join(contexts), "u1")
    strings = np.lib.stride_tricks.sliding_window_view(data, 50)[at].copy().view("S50").ravel()
    assert (strings[1:] >= strings[:-1]).all() and len(at) == 31 * len(contexts)
    assert (new[1:] == (strings[1:] != strings[:-1])).all() and (at == which.astype(int) * 80 + offset).all()


def test_open_surroundings_of_a_bucket_fit_one_shard():
    """An anchor stands at every 16 bytes; up to a fifth of them being open, buckets need no strings written and merged."""
    rng = np.random.default_rng(5)
    found = len(suffix_dedup.anchors([rng.integers(97, 123, 200_000).astype("u1").tobytes()])[0])
    assert found * suffix_dedup.BUCKET_BYTES / 200_000 / 5 <= suffix_dedup.SHARD


def test_texts_and_their_surroundings_are_shuffled_apart(docs, spark, monkeypatch):
    """What goes to the shards is read from a written table, so that the shuffle of whole texts is off the disk by then."""
    read = {}

    def write(df, name, then=suffix_dedup.materialize):
        read[name] = {Path(f).parent.name.rsplit("-", 1)[0] for f in df.inputFiles()}
        return then(df, name)

    monkeypatch.setattr(suffix_dedup, "materialize", write)
    assert suffix_dedup.remove_repeats(docs).count() > 0
    assert read["suffix-shards"] == {"suffix-surroundings"}


def test_good_documents_leave_no_table_of_texts(docs, spark):
    """Stages whose results are read later must not keep copies of the texts on disk until then."""
    from pyspark.sql import functions as F

    from tidemark.llm import common

    docs = docs.withColumn("source", F.concat(F.lit("h"), F.length("text") % 3))
    root = Path(common.checkpoint_root(spark).removeprefix("file:"), "tidemark")
    known = set(root.iterdir())
    kept = quality.keep_good(docs).collect()
    assert {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - known} == {"quality-hosts"}
    judged = quality.judged(common.materialize(quality.measured(docs), "test")).where("__tm_kept").select(*docs.columns).collect()
    assert sorted(map(str, kept)) == sorted(map(str, judged))


def test_written_steps_leave_no_files(docs, spark, tmp_path):
    """Neither the shuffles of a written table nor the tables that op6 has used up stay on disk."""
    from tidemark.llm import common

    shuffled = lambda: {f for d in local for f in Path(d).rglob("shuffle_*.data")}
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    known = shuffled()
    assert common.materialize(docs.groupBy("doc_id").count(), "test").count() > 0
    assert len(shuffled() - known) <= 1  # that of the count
    root = Path(common.checkpoint_root(spark).removeprefix("file:"), "tidemark")
    known = set(root.iterdir())
    assert suffix_dedup.remove_repeats(docs).count() > 0
    assert {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - known if any(p.glob("*.parquet"))} == {"suffix-codes", "bloom"}


def test_ids_must_be_numbers_for_suffixes(spark):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_cleaned_texts_stay_valid(docs):
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns
    first = {}
    for i, t in pairs():
        for a in range(len(t.encode()) - 49):
            if i is not None:
                w = t.encode()[a : a + 50]
                first[w] = min(first.get(w, i), i)
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49):
            if r[0] is not None and first[raw[a : a + 50]] < r[0]:
                gone[a : a + 50] = True
        text = None if r[1] is None else bytes(np.frombuffer(raw, "u1")[~gone]).decode("utf-8", "ignore")
        want.append(str((r[0], text, len(text) if gone.any() else r[4], *r[5:])))
    assert sorted(str((r.doc_id, r.text, r.n_chars, *r[5:])) for r in out.collect()) == sorted(want)


def sets_of(text):
    words = (text or "").split()
    if not words:
        return set()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_near_duplicate_classes(docs, empty, spark, sf):
    got = collections.Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
    assert got[6, 5] == 1 and got[7, 5] == 1 and got[8, 5] == 1 and got[5, 5] == 4 and got[None, 5] == 1
    assert got[0, 0] == 1 and got[1, 1] == 1 and got[2, 2] == 1
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_first(docs).collect()
    assert len([r for r in kept if r.text == PROSE]) == 1
    assert minhash.keep_first(docs).columns == docs.columns
    real = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sets = [sets_of(r.text) for r in real]
    parent = list(range(len(real)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(real)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(real):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    expected = {r.doc_id: least[root(i)] for i, r in enumerate(real)}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == expected


def test_shared_and_missing_ids_lose_no_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    for ids in ((None,) * 4, (5,) * 4, (None, 5, 5, None)):
        data = [(i, t, n) for n, (i, t) in enumerate(zip(ids, (a, a, b, b), strict=True))] + [(None, None, 9), (5, "", 10), (7, c, 11), (7, c, 12)]
        df = spark.createDataFrame(data, "doc_id long, text string, root int")
        assert sorted(str(r.text) for r in minhash.keep_first(df).collect()) == sorted(map(str, (a, b, c, "", None)))
        out = minhash.near_duplicates(df).collect()
        assert len(out) == len(data) and sum(r.kept for r in out) == 5
        by = collections.Counter(r.class_key for r in out if r.kept)
        assert by.pop(None) == 2 and set(by.values()) == {1} and len(by) == 3
        assert sorted((r.class_id, r.class_rows) for r in out if r.kept and r.doc_id == 7) == [(7, 2)]


def test_counts_as_weights(spark):
    rng = np.random.default_rng(11)
    lines = [" ".join(f"w{rng.integers(1 << 40)}" for _ in range(7)) for _ in range(6)]
    texts = [" \n ".join(lines[i] for i in rng.integers(0, 6, 30)) for _ in range(80)]
    texts += [t + " \n " + lines[0] for t in texts[:20]]
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, weighted=True).collect()} == dict(enumerate(root))


def spread(rng, text, n):
    """`text` with n words of its own, each at another place."""
    out = list(text)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"w{rng.integers(1 << 60)}"
    return out


@pytest.mark.parametrize("block", [minhash.BLOCK, 40])
def test_near_duplicates_meet_in_full_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    base, form = ([f"{c}{i}" for i in range(n)] for c, n in (("v", 200), ("t", 240)))
    texts = [spread(rng, base, n) for n in rng.integers(2, 7, 300)]  # variants: some pairs are similar, most are nearly so
    for _ in range(300):  # pairs over one form
        own = form + [f"w{rng.integers(1 << 60)}" for _ in range(80)]
        texts += [own, spread(rng, own, 4)]
    texts = [" ".join(texts[i]) for i in rng.permutation(len(texts))]
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(made).collect()} == {i: find(i) for i in range(len(texts))}


def test_no_pair_over_a_form_is_lost(spark):
    rng = np.random.default_rng(9)
    form = [f"t{i}" for i in range(1000)]
    texts = []
    for _ in range(300):  # pages of one form at 0.70, pairs of them at 0.81
        own = form + [f"w{rng.integers(1 << 60)}" for _ in range(215)]
        at = rng.choice(np.arange(5, 1210), 13, replace=False)
        texts += [own, [f"w{rng.integers(1 << 60)}" if i in set((at // 9 * 9).tolist()) else w for i, w in enumerate(own)]]
    texts = [" ".join(t) for t in texts]
    sets = [sets_of(t) for t in texts]
    similar = [i for i in range(0, 600, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(similar) > 250
    out = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert all(out[i] == out[i + 1] for i in similar)


def test_dart_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 60, 400).astype("u8"))
    for share in (0.3, 0.8):
        b = np.concatenate([a[: int(len(a) * share)], rng.integers(0, 1 << 60, int(len(a) * (1 - share))).astype("u8")])
        jaccard = len(set(a) & set(b)) / len(set(a) | set(b))
        x, y = minhash.dart_signatures([a, np.unique(b)], k=4000)
        assert abs((x == y).mean() - jaccard) < 0.04
    w = np.array([1.0, 3.0, 0.5]), np.array([1.0, 1.0, 2.5])
    items = np.array([5, 6, 7], "u8")
    x, y = minhash.dart_signatures([items, items], list(w), k=4000)
    assert abs((x == y).mean() - np.minimum(*w).sum() / np.maximum(*w).sum()) < 0.04


def test_languages(docs, empty, spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(real)
    out = {r.doc_id: r for r in langid.predict(real, model).collect()}
    held = [r for r in real.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(out[r.doc_id].held_out for r in held)
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    odd = langid.predict(docs, model).collect()
    assert len(odd) == len(pairs())
    assert {r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 12)} == {"und"}
    assert all(0 <= r.score <= 1 for r in odd)
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(empty)).collect()} == {"und"}
    assert langid.keep_accepted(real, model).count() > 0.95 * real.count()
    assert langid.keep_accepted(docs, model).columns == docs.columns


def test_texts_of_other_languages_are_rejected(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(real)
    other = [
        "Tämä on suomenkielinen teksti, jossa kerrotaan pitkästi järvistä, metsistä ja talvisista yöllisistä retkistä pohjoiseen.",
        "Это русский текст о реках, горах и долгих зимних вечерах, когда снег ложится на крыши домов и дороги.",
        "这是一段关于河流和山脉的中文文本，讲述了漫长的冬夜。",
        "xqzjv wkqpz vvxkq zzqwj kxjvq pqzxw jjkvx qwzzk vxqkj zpwqx kkjzv xwqpz",
    ]
    rows = spark.createDataFrame([(i, t * 5) for i, t in enumerate(other)], "doc_id long, text string")
    assert not langid.predict(rows, model).where("accepted").count()
    assert langid.keep_accepted(rows, model).count() == 0


def test_words_share_out_the_probability():
    from itertools import product

    model = langid.fit({"a": {"abab": 3, "ba": 1}, "b": {"cc": 2, "abc": 1}})
    words = ["".join(w) for n in range(1, 7) for w in product("abc", repeat=n)]
    total = np.exp2(-model.score(words)).sum(axis=0)
    assert (total > 0.6).all() and (total < 1).all()
    assert model.score(["abab"])[0, 0] < model.score(["abab"])[0, 1]


def test_near_duplicates_leave_no_words_in_a_worker(spark):
    """beside an executor's heap there was no room for what idle workers kept."""
    rows = spark.range(2_500).selectExpr("id AS doc_id", "cast(cast(id AS string) AS binary) AS key", "concat_ws(' ', transform(sequence(0, 49), i -> concat('w', id * 50 + i))) AS text")

    def watched(batches, of):
        sizes = []
        chunks.Cache.every.add(other := chunks.Cache(1))
        other.young["left"] = b"by another operator"

        def seen():
            for batch in batches:
                sizes.append((batch.num_rows, len(other.young)))
                yield batch

        rows_out = sum(batch.num_rows for batch in of(seen()))
        yield pa.RecordBatch.from_pydict({"out": [rows_out], "most": [max([0, *(n for n, _ in sizes)])], "other": [max([0, *(n for _, n in sizes[1:])])], "kept": [len(minhash._words.young) + len(minhash._words.old)]})

    class Taken:
        schema = rows.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return rows.coalesce(1).mapInArrow(lambda batches: watched(batches, run), "out long, most long, other long, kept long")

    for work in (minhash._signed, minhash._sets):
        got = materialize(work(Taken(), False), "test", minhash.BATCH).first()
        assert (got.out, got.most, got.other, got.kept) == (2_500, minhash.BATCH, 0, 0)
