"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

The corpus's key universe (every host of a url and each of its parent domains) is known, so a list
can be answered exactly from Bloom filters alone. Level 1 holds the listed keys; level 2 the keys of
the universe that level 1 takes for listed but are not; level 3 the listed keys that level 2 takes
for those; and so on until a level makes no error. A key is listed if the first level that does not
hold it is an even one. The filters are scalar values in the plan: probing needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, build_bloom, holds
from .common import materialize, read_table

#: Fixed rules of the query: verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: A filter level beyond this (some hundred million listed hosts) is not put into a plan.
MOST_FILTER_BYTES = 128 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict), or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def labels_of(name: Column) -> Column:
    return F.size(F.split(name, r"\."))


def domains_of(host: Column, depths: Sequence[int]) -> list[Column]:
    """For each depth the domain of so many last labels, null for hosts with fewer and for an empty host. Each costs time in
    proportion to the host, however many labels that has."""
    n = labels_of(host)
    return [F.when((host != "") & (n >= d), F.substring_index(host, ".", -d)) for d in depths]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def listed(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(holds(self.levels[i], key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MOST_FILTER_BYTES) -> Cascade:
    """`listed` and `universe` have a column `key`; nulls are left out and repeats are harmless.

    One aggregation tags each distinct key; each level then takes one pass over the keys that are still
    in error. A list too large for `max_bytes` is refused.
    """
    tagged = (
        universe.select("key", F.lit(0).alias("l"))
        .unionByName(listed.select("key", F.lit(1).alias("l")))
        .where("key is not null")
        .groupBy("key")
        .agg(F.max("l").alias("l"))
    )
    tagged = materialize(tagged, "url-keys")
    sizes = {r["l"]: r["n"] for r in tagged.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside, outside = sizes.get(1, 0), sizes.get(0, 0)
    if not inside:
        return Cascade(())
    rate = min(0.5, max(1e-6, inside / (math.sqrt(2) * max(outside, 1))))
    levels: list[Bloom] = []
    held, n = tagged.where("l = 1").select("key"), inside
    other = tagged.where("l = 0").select("key")
    while n:
        bloom = build_bloom(held, n, rate if not levels else 0.5, len(levels) + 1, max_bytes)
        if bloom is None:
            raise ValueError(f"a filter of {n} keys is larger than {max_bytes} bytes")
        levels.append(bloom)
        wrong = other.where(holds(bloom, F.col("key")))
        held, other, n = wrong, held, wrong.count()
    return Cascade(tuple(levels))


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bytes: int = MOST_FILTER_BYTES,
) -> DataFrame:
    """Judge every url: the longest rule that fits decides, else the list (column `key`: a host that is
    blocked with its subdomains).

    The cascade holds the listed hosts and the rules' hosts. A url of whose domains it holds none is allowed as it is; where it
    holds a rule's host, the rules are compared one by one.

    Returns page_id, host, path, rule (null if none fits), verdict and listed. A null url and one without
    `://` have an empty host and path, match no rule and are allowed. Repeated rows stay; other columns don't matter. Empty
    tables give no rows, an empty list lists nothing.
    """
    spark, url = pages.sparkSession, F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    names = sorted({r[1] for r in rules})
    of_rules = spark.range(1).select(F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("key"))
    keys = listed.select("key").where("key is not null and key <> ''").unionByName(of_rules)
    # Only domains with as many labels as some key can be one; a host name has 127 labels at most.
    depths = sorted(r["d"] for r in keys.select(labels_of(F.col("key")).alias("d")).distinct().collect())
    both = {r["key"] for r in listed.where(F.col("key").isin(names)).select("key").distinct().collect()}
    universe = rows.groupBy("host").agg(F.lit(1).alias("one")).select(F.explode(F.array(*domains_of(F.col("host"), depths))).alias("key"))
    cascade = build_cascade(keys, universe, max_bytes)
    ruled, hit = F.lit(False), F.lit(False)
    for domain in domains_of(F.col("host"), depths):
        known = domain.isNotNull() & cascade.listed(domain)
        ruled = ruled | (known & domain.isin(names))
        hit = hit | (known & (~domain.isin(names) | domain.isin(sorted(both))))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("listed", F.coalesce(hit, F.lit(False))).withColumn("__tm_ruled", F.coalesce(ruled, F.lit(False)))
    return judged.select(
        "page_id", "host", "path", F.when(F.col("__tm_ruled"), rule).alias("rule"),
        F.coalesce(F.when(F.col("__tm_ruled"), verdict), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )


def plain_mirrors(pages: DataFrame) -> DataFrame:
    """A list taken from the pages by a rule: mobile mirrors (hosts `m.` something) that serve a page without encryption."""
    url = F.col("url")
    return pages.where(url.startswith("http://")).select(host_of(url).alias("key")).where(F.col("key").startswith("m.")).distinct()


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return filter_urls(pages, plain_mirrors(pages))


OP4_SQL = f"""
WITH u AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^(.*?)://([^/?#]*)', 2, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
fit AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict
  FROM (SELECT DISTINCT page_id, host, path FROM u) u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
  QUALIFY row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.h || r.p) DESC) = 1),
hit AS (
  SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM u) h
  JOIN (SELECT DISTINCT host AS k FROM u WHERE starts_with(url, 'http://') AND starts_with(host, 'm.')) ON h.host = k OR ends_with(h.host, '.' || k))
SELECT u.page_id, u.host, u.path, f.rule,
       coalesce(f.verdict, CASE WHEN hit.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       hit.host IS NOT NULL AS listed
FROM u LEFT JOIN fit f ON f.page_id IS NOT DISTINCT FROM u.page_id AND f.host = u.host AND f.path = u.path
LEFT JOIN hit ON hit.host = u.host
"""
