"""Quality rules by host, in DataFrame functions only.

Each document is measured from its own text. Failures are added up by host (`source`), a beta prior is
fitted to all hosts' failure rates by moments, each host's rate is shrunk towards it, and hosts whose
shrunk rate stays above a limit are rejected with all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: A host is rejected when its shrunk failure rate exceeds this: nearly all its documents fail.
HOST_LIMIT = 0.9
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A host with more than this part of all rows is hot.
HOT_PART = 10_000

_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _windows(words: Column) -> Column:
    """(hash, position) of each window of three words, sorted, so that equal windows are neighbours.

    Two different windows of one text count as equal with chance 2^-64 a pair.
    """
    n = F.size(words)
    hashed = F.transform(
        F.when(n >= 3, F.slice(words, F.lit(1), n - 2)).otherwise(F.array().cast("array<string>")),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.sort_array(hashed)


def _repeats(sorted_windows: Column) -> Column:
    """Start positions of the windows that occur twice or more, in order."""
    flagged = F.transform(
        sorted_windows,
        lambda w, k: F.when(
            (w["h"] == F.get(sorted_windows, k + 1)["h"]) | ((k > 0) & (w["h"] == F.get(sorted_windows, k - 1)["h"])), w["i"]
        ),
    )
    return F.sort_array(F.array_compact(flagged))


def _covered(starts: Column) -> Column:
    """Words that lie in a window of three at one of the starts."""
    steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add __tm_words, __tm_chars, __tm_symbols, __tm_lines, __tm_repeat and __tm_failed to every row. A null text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (
        docs.withColumn("__tm_w", words_of(text))
        .withColumn("__tm_l", lines)
        .withColumn("__tm_s", _windows(F.col("__tm_w")))
        .withColumn("__tm_r", _repeats(F.col("__tm_s")))
        .withColumn("__tm_words", F.size("__tm_w").cast("long"))
        .withColumn("__tm_chars", F.char_length(F.array_join("__tm_w", "")).cast("long"))
        .withColumn("__tm_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("__tm_lines", (F.size("__tm_l") - F.size(F.array_distinct("__tm_l"))).cast("long"))
        .withColumn("__tm_repeat", _covered(F.col("__tm_r")))
    )
    failed = (F.col("__tm_words") < MIN_WORDS) | (100 * F.col("__tm_repeat") > REPEAT_PERCENT * F.col("__tm_words"))
    return out.withColumn("__tm_failed", failed).drop("__tm_w", "__tm_l", "__tm_s", "__tm_r")


def host_verdicts(rows: DataFrame, host_col: str, limit: float = HOST_LIMIT) -> DataFrame:
    """One row a host: __tm_host, docs, failures, shrunk, rejected.

    The prior's mean m and strength s come from the moments of all hosts' rates: variance v of the rates around
    m gives s = m (1 - m) / v - 1; equal rates give the strength of all documents of an average host.
    """
    hosts = rows.groupBy(F.col(host_col).alias("__tm_host")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("__tm_failed").cast("long")).alias("failures")
    )
    rate = F.col("failures") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg("docs").alias("size"))
    strength = F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1e-6))).otherwise(F.col("size"))
    one = prior.select(F.struct((F.col("m") * strength).alias("a"), strength.alias("s")).alias("p"))
    prior_row = one.scalar()
    shrunk = (F.col("failures") + F.col("p")["a"]) / (F.col("docs") + F.col("p")["s"])
    return (
        hosts.withColumn("p", prior_row)
        .withColumn("shrunk", shrunk)
        .withColumn("rejected", F.col("shrunk") > limit)
        .drop("p")
    )


def hot_and_rest(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdicts, a written table, on hosts with over 1 / HOT_PART of all rows, of which there are fewer than HOT_PART, and all others."""
    total = verdicts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("docs") * HOT_PART > total
    return verdicts.where(often).drop("docs"), verdicts.where(~often).drop("docs")


def with_verdicts(rows: DataFrame, host_col: str, measures: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Add __tm_rejected to rows, which are read again for hosts that are not hot; `measures` hold the rows' host and __tm_failed.

    The verdicts on hot hosts are broadcast, so that their rows stay where they are; the rows of all other hosts are joined by
    host once. A null host is a host.
    """
    verdicts = materialize(host_verdicts(measures, host_col, limit).select("__tm_host", "docs", F.col("rejected").alias("__tm_rejected")), "quality-hosts")
    hot, rest = hot_and_rest(verdicts)
    on = F.col(host_col).eqNullSafe(F.col("__tm_host"))
    out = rows.join(F.broadcast(hot), on, "inner")
    if rest.head(1):
        others = rows.join(F.broadcast(hot.select("__tm_host")), on, "left_anti")
        out = out.unionByName(others.join(rest, on, "inner"))
    return out


def judged(rows: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Add __tm_kept to measured rows, which must be a written table as they are read more than once."""
    return with_verdicts(rows, host_col, rows, limit).withColumn("__tm_kept", ~F.col("__tm_failed") & ~F.col("__tm_rejected"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Repeated rows stay. The texts are read once: the measures,
    which are small, are written and read back for the two passes that hosts need.
    """
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__tm_text"), F.col(host_col).alias("__tm_source")), "__tm_text")
    rows = materialize(rows.drop("__tm_text"), "quality")
    return judged(rows, "__tm_source").select(
        "doc_id", F.col("__tm_words").alias("n_words"), F.col("__tm_chars").alias("word_chars"), F.col("__tm_symbols").alias("n_symbols"),
        F.col("__tm_lines").alias("n_dup_lines"), F.col("__tm_repeat").alias("n_repeat_words"), F.col("__tm_failed").alias("base_failed"),
        F.col("__tm_kept").alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of documents that pass, with all their columns; texts are carried along, so rows need no key.

    Null and empty texts have no words and go; each of repeated rows is judged alike; a null source is a host. The texts are measured
    twice, for the hosts' verdicts and for their own, as a table of measured rows would be most of the input on disk as long as the
    result may be read.
    """
    good = measured(with_verdicts(docs, "source", measured(docs)).where(~F.col("__tm_rejected")))
    # not deterministic for Spark, so that the filter stays above the measures; below it would work them out anew for each use
    failed = F.when(F.monotonically_increasing_id() >= 0, F.col("__tm_failed"))
    return good.withColumn("__tm_out", failed).where(~F.col("__tm_out")).select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
tri AS (
  SELECT rid, i, ws[i] || chr(9) || ws[i + 1] || chr(9) || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, sum(base_failed::INT) AS failures FROM b GROUP BY source),
p AS (
  SELECT avg(failures / docs) AS mean, CASE WHEN var_pop(failures / docs) > 0
         THEN greatest(avg(failures / docs) * (1 - avg(failures / docs)) / var_pop(failures / docs) - 1, 1e-6) ELSE avg(docs) END AS s FROM h),
v AS (SELECT source, (failures + mean * s) / (docs + s) > {HOST_LIMIT} AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN v ON v.source IS NOT DISTINCT FROM b.source
"""
