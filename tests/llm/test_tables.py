"""URL filters and nearest neighbours."""

import numpy as np
import pytest

from tidemark.llm import ann, url_filter


def judge(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "https://example.net", "https://example.net/en/", "https://xexample.net/en/",
    "https://sub.example.com/de/1", "https://example.org/fr/2#q", "https://adult-x.example.com/x", "https://a.b.adult-x.example.com", "ftp://É.ORG/fr/",
    "https://" + "a." * 500_000 + "adult-x.example.com/" + "p" * 1000, "https://" + "b." * 30_000 + "net",
    "https://x.net?u=http://example.org/fr/", "https://multi\nline.org/fr/a", "https://a" + ".b" * 100 + ".net/", "https://adult-x.example.com/x",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([("adult-x.example.com",), ("nowhere.test",), ("",), (None,), ("a.b." + "c." * 2000 + "test",)], "key string")
    out = {r.page_id: r for r in url_filter.filter_urls(df, listed).collect()}
    for i, u in enumerate(URLS):
        host, path = judge(u)
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        hit = host == "adult-x.example.com" or host.endswith(".adult-x.example.com")
        rule, verdict = (max(fit)[1:]) if fit else (None, "block" if hit else "allow")
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict, out[i].listed) == (host, path, rule, verdict, hit), u
    assert url_filter.filter_urls(df.limit(0), listed).count() == 0
    assert not url_filter.filter_urls(df, listed.limit(0)).where("listed").count()
    with pytest.raises(ValueError):
        url_filter.filter_urls(df, listed, max_bytes=0)


def test_a_rules_host_that_is_listed_too(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://org/fr/x"), (3, "http://b.com/")], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict, r.listed) for r in url_filter.filter_urls(df, spark.createDataFrame([("org",)], "key string")).collect()}
    assert out == {1: (None, "block", True), 2: ("org/fr/", "allow", True), 3: (None, "allow", False)}


def test_a_list_of_thousands_from_the_pages(spark):
    data = [(i, f"http{'s' * (i % 3)}://{'m.' * (i % 2)}h{i % 4001}.d{i % 97}.example.com/{i}") for i in range(30_000)]
    df = spark.createDataFrame(data, "page_id long, url string")
    bad = {judge(u)[0] for _, u in data if u.startswith("http://m.")}
    assert len(bad) > 2000
    out = url_filter.filter_urls(df, url_filter.plain_mirrors(df)).collect()
    assert all(r.listed == any(".".join(r.host.split(".")[k:]) in bad for k in range(5)) for r in out) and len(out) == len(data)


def test_the_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 6000, 7).selectExpr("concat('k', id) as key")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    from pyspark.sql import functions as F

    got = {r.key for r in universe.where(cascade.listed(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 5000, 7)}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 16))
    v[100:400] = v[0]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5100, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (5200, [1.0] * 3, 0), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    out = ann.neighbours(df, df.where("vec_id % 100 = 0"), shard_rows=1000).collect()
    assert {r.query_id for r in out} == set(range(0, 3000, 100))
    hit = 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        want = np.lexsort((np.arange(3000), far))[:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11))
        assert all(s == np.sqrt(((v[i] - v[q]) ** 2).sum()) for _, i, s in got)
        hit += len({i for _, i, _ in got} & set(want.tolist()))
        if q in (0, 100, 200, 300):
            assert [g[1] for g in got] == want.tolist()
    assert hit >= 0.95 * 300
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0
    assert ann.neighbours(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def searched(v, asks, k=10, shards=1):
    """(recall, part of the candidates that was measured) over shards, against all distances."""
    deal = np.random.default_rng(3).integers(0, shards, len(v))
    found, measured = [[] for _ in asks], 0
    for s in range(shards):
        at = np.flatnonzero(deal == s)
        near, n = ann.Forest(at, v[at]).search(v[asks], asks, k)
        measured += n
        for out, (ids, far) in zip(found, near, strict=True):
            out += zip(far, ids, strict=True)
    hits = 0
    for q, out in zip(asks, found, strict=True):
        far = ((v - v[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len({i for _, i in sorted(out)[:k]} & set(np.argpartition(far, k)[:k].tolist()))
    return hits / k / len(asks), measured / len(asks) / len(v)


def test_the_forest_finds_the_nearest_without_measuring_most():
    import pyarrow.parquet as pq

    v = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), float)
    recall, measured = searched(v, np.arange(0, len(v), 20))
    assert recall >= 0.95 and measured < 0.1
    made = np.random.default_rng(8).standard_normal((50_000, 64))  # no structure at all, which is the hardest case
    recall, measured = searched(made, np.arange(0, len(made), 500), shards=3)
    assert recall >= 0.95 and measured < 0.1
