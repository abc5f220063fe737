"""The pipeline's stages, and the registered queries' SQL twins."""

import collections

import duckdb
import numpy as np
import public_tokenizers as P
from test_documents import brute_quality, check_packing, sets_of
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import langid, quality, queries


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == names
        assert 0 < docs.count() <= n
        n = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == n


def brute_hosts(failed, source):
    hosts = collections.defaultdict(list)
    for f, s in zip(failed, source, strict=True):
        hosts[s].append(f)
    rates = np.array([np.mean(v) for v in hosts.values()])
    mean, spread = rates.mean(), rates.var()
    strength = max(mean * (1 - mean) / spread - 1, 1e-6) if spread else np.mean([len(v) for v in hosts.values()])
    return {s: (sum(v) + mean * strength) / (len(v) + strength) > quality.HOST_LIMIT for s, v in hosts.items()}


def brute_classes(docs):
    sets = [sets_of(d.text) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [d for i, d in enumerate(docs) if find(i) == i]


def brute_cut(docs):
    first, out = {}, {}
    for d in docs:
        raw = d.text.encode()
        for a in range(len(raw) - 49):
            first.setdefault(raw[a : a + 50], d.doc_id)
    for d in docs:
        raw = d.text.encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49):
            if first[raw[a : a + 50]] < d.doc_id:
                gone[a : a + 50] = True
        out[d.doc_id] = bytes(np.frombuffer(raw, "u1")[~gone]).decode("utf-8", "ignore")
    return out


def test_stages_match_brute_force(spark, sf):
    read = lambda df: sorted(df.collect(), key=lambda r: r.doc_id)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = read(docs)
    stage = {name: (lambda df, f=f: corpus_pipeline.materialize(f(spark, df, sf), name)) for name, f in corpus_pipeline.STAGES}
    failed = [brute_quality(r.text)[-1] for r in rows]
    bad = brute_hosts(failed, [r.source for r in rows])
    docs = stage["quality_rules"](docs)
    assert read(docs) == [r for r, f in zip(rows, failed, strict=True) if not f and not bad[r.source]]
    rows, model = read(docs), langid.learn(docs)
    accepted = {r.doc_id for r in langid.predict(docs, model).where("accepted").collect()}
    docs = stage["language_id"](docs)
    assert read(docs) == [r for r in rows if r.doc_id in accepted] and len(accepted) >= 0.98 * len(rows)
    rows = read(docs)
    docs = stage["near_duplicates"](docs)
    assert read(docs) == brute_classes(rows)
    cut = brute_cut(read(docs))
    docs = stage["suffix_dedup"](docs)
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in cut.items()}
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [(i, np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")) for i, t in cut.items()]
    padded, sequences = check_packing(stage["packing"](docs).collect(), ids)
    assert padded < 0.02 * 2048 * sequences


def test_the_pipeline_takes_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_sql_twins(spark, sf):
    for name, sql in queries.ORACLES.items():
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        expected = con.sql(sql)
        got = queries.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(expected.columns), name
        order = sorted(got.columns)
        want = sorted(map(str, con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall()))
        assert sorted(str(tuple(r)) for r in got.select(*order).collect()) == want, name
