"""Language identification by interpolated Kneser-Ney models of characters.

Each language has a model of the letters of its words, with word ends. The n-grams of all languages stand in sorted
arrays of 64-bit hashes, one for each order, with a column of counts for each language; a text's cross-entropy under
each is the mean over its letters, and the lowest wins. A text whose best cross-entropy exceeds what documents of that
language, kept out of the counting, were seen to have is rejected.

Models are fitted on a bounded sample (`max_docs` documents of each language, drawn by a hash of the id); every whole
text is judged.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Cache, groups
from .common import read_table

ORDER = 4
#: Documents of each language that models are fitted on, a fifth of them for calibration.
MAX_DOCS = 500
#: Bits a letter that a text of one letter may lie above its language's limit.
STRAY = 4.0
CACHE = 300_000
_LETTERS = regex.compile(r"\p{L}+")
_START, _END = 2, 3  # stand for word ends; no letters
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order 0 to ORDER the raw hash of the characters that end at each predicted one (order 0: all alike),
    the word of each, and the predicted characters' positions; all flat."""
    lengths = np.fromiter(map(len, words), int, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = lengths + ORDER  # ORDER - 1 starts and one end
    flat = np.full(int(size.sum()), _START, "u8")
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(words) else np.zeros(0, int)
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    at = begin[owner] + ORDER - 1 + inner
    last = inner == lengths[owner]
    flat[at[~last]] = chars
    flat[at[last]] = _END
    out = [np.zeros(len(at), "u8")]
    for k in range(1, ORDER + 1):
        h = np.zeros(len(at), "u8")
        for back in range(k - 1, -1, -1):
            h = _mixed((h + flat[at - back] + np.uint64(1)) * _PRIME)
        out.append(h)
    return out, owner, at


def _contexts(words: list[str]) -> list[np.ndarray]:
    """For each order k the hash of the k - 1 characters before each predicted one."""
    lengths = np.fromiter(map(len, words), int, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = lengths + ORDER
    flat = np.full(int(size.sum()), _START, "u8")
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(words) else np.zeros(0, int)
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    at = begin[owner] + ORDER - 1 + inner
    flat[at[inner < lengths[owner]]] = chars
    out = [np.zeros(0, "u8")]
    for k in range(1, ORDER + 1):
        h = np.zeros(len(at), "u8")
        for back in range(k - 1, 0, -1):
            h = _mixed((h + flat[at - back] + np.uint64(1)) * _PRIME)
        out.append(h)
    return out


@dataclass
class Model:
    languages: list[str]
    #: For each order: sorted hashes of grams and their discounted counts, a row each and a column for each language;
    #: sorted hashes of contexts, their totals and the share of mass left to the lower order.
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    alphabet: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limits: dict[str, float] = field(default_factory=dict)
    tag: str = ""

    def score(self, words: list[str]) -> np.ndarray:
        """Negative log2 probability of each word under each language."""
        grams, owner, _ = _grams(words)
        contexts = _contexts(words)
        p = np.broadcast_to(1.0 / self.alphabet, (len(owner), len(self.languages)))
        for k in range(1, ORDER + 1):
            keys, discounted = self.grams[k - 1]
            own = _looked_up(keys, grams[k], discounted)
            keys, total, share = self.contexts[k - 1]
            at = np.minimum(np.searchsorted(keys, contexts[k]), len(keys) - 1)
            there = (keys[at] == contexts[k])[:, None]
            p = np.where(there, own * total[at] + share[at] * p, p)
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, owner, -np.log2(p)) if len(words) < 64 else _add(out, owner, -np.log2(p))
        return out


def _add(out: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out[owner[starts]] = np.add.reduceat(values, starts, axis=0)


def _looked_up(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0.0)


def fit(counts: dict[str, dict[str, int]]) -> Model:
    """A model of word counts by language, each a non-empty dict."""
    languages = sorted(counts)
    words = sorted(set().union(*counts.values()))
    often = np.zeros((len(words), len(languages)))
    row = {w: i for i, w in enumerate(words)}
    for j, lang in enumerate(languages):
        for w, n in counts[lang].items():
            often[row[w], j] = n
    grams, owner, _ = _grams(words)
    contexts = _contexts(words)
    model = Model(languages, alphabet=np.array([len({c for w in counts[x] for c in w}) + 2.0 for x in languages]))
    for k in range(1, ORDER + 1):
        if k == ORDER:
            keys, first, which = np.unique(grams[k], return_index=True, return_inverse=True)
            count = np.zeros((len(keys), len(languages)))
            np.add.at(count, which, often[owner])
        else:  # the number of different characters that stand before the gram, in each language
            longer, index, inverse = np.unique(grams[k + 1], return_index=True, return_inverse=True)
            seen = np.zeros((len(longer), len(languages)), bool)
            for j in range(len(languages)):
                seen[inverse[often[owner, j] > 0], j] = True
            keys, first, which = np.unique(grams[k][index], return_index=True, return_inverse=True)
            count = np.zeros((len(keys), len(languages)))
            np.add.at(count, which, seen.astype(float))
            first = index[first]
        context = contexts[k][first]
        names, of = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(names), len(languages))), np.zeros((len(names), len(languages)))
        once, twice = (count == 1).sum(0), (count == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.1, 0.95)
        np.add.at(total, of, count)
        np.add.at(kinds, of, (count > 0).astype(float))
        inverse_total = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
        share = np.where(total > 0, discount * kinds * inverse_total, 1.0)  # an unseen context leaves all to the lower order
        model.grams.append((keys, np.maximum(count - discount, 0)))
        model.contexts.append((names, inverse_total, share))
    return model


class Scorer:
    """Judges texts; each distinct word is scored about once in a worker."""

    def __init__(self, model: Model):
        self.model, self.known = model, Cache(CACHE)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best language's number (-1: none), its cross-entropy in bits a letter, the score, and whether the text is accepted."""
        n = len(self.model.languages)
        parts = [_LETTERS.findall(t.lower()) for t in texts]
        best, bits, score, letters = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts))
        seen = set().union(*parts)
        if not n or not seen:
            return best, bits, score, self._accepted(best, bits, letters)
        new, known = self.known.missing(seen), self.known.young
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            values = np.column_stack([self.model.score(some), np.fromiter(map(len, some), float, len(some)) + 1]).astype("f4")
            known.update(zip(some, map(bytes, values), strict=True))
        order = list(seen)
        index = dict(zip(order, range(len(order)), strict=True))
        table = np.frombuffer(b"".join([known[w] for w in order]), "f4").reshape(len(order), n + 1).astype(float)
        rows = [i for i, p in enumerate(parts) if p]
        flat = np.fromiter((index[w] for i in rows for w in parts[i]), int, sum(map(len, parts)))
        starts = np.cumsum([0, *(len(parts[i]) for i in rows)])[:-1]
        sums = np.add.reduceat(table[flat], starts, axis=0)
        entropy = sums[:, :n] / sums[:, n:]
        top = entropy.argmin(axis=1)
        low = entropy[np.arange(len(rows)), top]
        weight = np.minimum(sums[:, n], 40)[:, None]  # neighbouring letters are no independent evidence
        best[rows], bits[rows], letters[rows] = top, low, sums[:, n]
        score[rows] = 1 / np.exp2((low[:, None] - entropy) * weight).sum(axis=1)
        return best, bits, score, self._accepted(best, bits, letters)

    def _accepted(self, best: np.ndarray, bits: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """A short text's mean strays further, by the root of its letters."""
        limits = np.array([*(self.model.limits.get(x, np.inf) for x in self.model.languages), -np.inf])
        return bits - STRAY / np.sqrt(letters) <= limits[best]


_held: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if model.tag not in _held:
        _held.clear()
        _held[model.tag] = Scorer(model)
    return _held[model.tag]


def fold(id_column: Column) -> Column:
    """crc32 of the id as text modulo 5; a null id counts as fold 0, which is never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5, F.lit(0))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    """Fit and calibrate on the labelled rows outside fold 0.

    The limit of a language is its calibration documents' median cross-entropy plus eight times the distance from there to
    their 95th percentile, and a bit at least, so that documents like them stay and texts of other kinds go; but no more than what a
    model without any knowledge of the letters' order would give, which few and odd calibration documents could else exceed. No
    labelled rows give an empty model, which predicts nothing.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where((fold(F.col("i")) != 0) & F.col("l").isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([])
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs / n))])
    draw = F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < F.element_at(rate, F.col("l"))).withColumn("check", F.pmod(F.xxhash64("i", F.lit("check")), F.lit(5)) == 0)
    words = F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in sample.where("not check").select("l", words).groupBy("l", "w").count().toLocalIterator():
        counts[r["l"]][r["w"]] = r["count"]
    if not counts:
        return Model([])
    model = fit(counts)
    model.tag = f"{zlib.crc32(repr(sorted((k, len(v), sum(v.values())) for k, v in counts.items())).encode())}-raw"
    model.limits = {}
    seen = _judged(sample.where("check").select(F.col("i").alias("doc_id"), F.col("t").alias("text")), model).where("best is not null")
    for r in seen.groupBy("best").agg(F.expr("percentile(bits, array(0.5, 0.95))").alias("q")).collect():
        limit = float(r["q"][0] + max(8 * (r["q"][1] - r["q"][0]), 1.0))
        model.limits[r["best"]] = min(limit, float(np.log2(model.alphabet[model.languages.index(r["best"])])))
    model.tag = model.tag.replace("-raw", f"-{zlib.crc32(repr(sorted(model.limits.items())).encode())}")
    return model


def _judged(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, best (null: no letter), bits, score and accepted of rows of doc_id and text."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held.value)
        names = np.array([*scorer.model.languages, None], object)
        for batch in batches:
            for start, texts in groups(batch.column("text")):
                best, bits, score, accepted = scorer.judge(texts)
                columns = [batch.column("doc_id").slice(start, len(texts)), pa.array(names[best], pa.string()), pa.array(bits), pa.array(score), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "best", "bits", "score", "accepted"])
        Cache.rest(scorer.known)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, best string, bits double, score double, accepted boolean")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, bits (a letter) and accepted.

    `und` with score 0 if the text is null or has no letter, or nothing was learnt; such texts are not accepted. Ties go to
    the smaller language name. Repeated rows stay.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _judged(rows, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.coalesce("best", F.lit("und")).alias("lang_pred"), "score", "bits", "accepted")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is accepted, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held.value)
        for batch in batches:
            for start, texts in groups(batch.column(text_col)):
                yield batch.slice(start, len(texts)).filter(pa.array(scorer.judge(texts)[3]))
        Cache.rest(scorer.known)

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
