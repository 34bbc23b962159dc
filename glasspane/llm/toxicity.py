"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 5 letters, with word ends) of a whole text, hashed to 2 ** BITS
places. From labelled rows, each feature gets the log ratio of its smoothed document frequencies in toxic
and other texts; the features whose ratio stands out most from chance are kept, each scaled by its ratio,
and a logistic regression weighs them. Its probability is the score.

At most about ``bound`` labelled rows are learned from, chosen by a hash of the id; of rows that repeat an
id in the labels the larger label counts; null labels are left out. Without both labels, all scores are 0.
Null and empty texts have no features: their score is that of the intercept. Repeated rows are scored each
for itself; an empty table gives no rows; other columns are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language import letters
from .shared import crc_fold, in_batches

BITS, ORDERS, FEATURES, BOUND = 20, (3, 4, 5), 3000, 20_000
_FACTORS = np.random.default_rng(77).integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(4) + np.uint64(1)


def hashed(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, place of the n-gram) of all n-grams, for a few texts at a time."""
    at, own, size = 0, [], 0
    for k, text in enumerate([*texts, None]):
        if own and (k == len(texts) or size + len(text or "") > most):
            yield _places(own, at)
            at, own, size = k, [], 0
        own.append((text or "").lower())
        size += len(own[-1])


def _places(texts: list[str], at: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters(codes), codes, 0).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    inside = c != 0
    of, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        full = inside[1 : m + 1].copy()
        for k in range(2, n - 1):
            full &= inside[k : m + k]
        start = np.flatnonzero(full)
        h = np.full(len(start), np.uint64(n), np.uint64)
        for k in range(n):
            h += c[start + k] * _FACTORS[k]
        h ^= h >> np.uint64(29)
        places.append(((h * _FACTORS[7]) >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(np.searchsorted(ends, start, side="right"))
    return np.concatenate(of) + at, np.concatenate(places)


def distinct(texts: list[str | None], chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (number of the text, place), of the chosen places only if such are given."""
    for of, place in hashed(texts):
        if chosen is not None:
            there = chosen[place]
            of, place = of[there], place[there]
        key = np.unique(of << BITS | place)
        yield key >> BITS, key & ((1 << BITS) - 1)


class Classifier:
    """Weights by place (0 where a place is no feature) and the intercept; None: nothing learned."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, intercept: float | None):
        self.places, self.weights, self.intercept = places, weights, intercept

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        chosen, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        chosen[self.places], weight[self.places] = True, self.weights
        return chosen, weight

    def scores(self, texts: list[str | None], chosen: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if self.intercept is None:
            return np.zeros(len(texts))
        z = np.full(len(texts), self.intercept)
        for of, place in distinct(texts, chosen):
            z += np.bincount(of, weight[place], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float = 1.0, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by Adam on all rows: weights of the columns, intercept."""
    n = len(y)
    w, b = np.ones(width) * 0.1, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(rows, w[columns] * values, n)
        miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(columns, miss[rows] * values, width) + penalty * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def learn(docs: DataFrame, labels: DataFrame, features: int = FEATURES, bound: int = BOUND) -> Classifier:
    """A classifier from the rows of ``docs`` that ``labels`` (doc_id, toxic) marks."""
    nothing = Classifier(np.empty(0, np.int64), np.empty(0), None)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if not n:
        return nothing
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < bound / n * 1_000_003)
    # broadcast: `bound` rows of two numbers
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "toxic")

    def count(batches) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy() > 0
            rows += [int((~y).sum()), int(y.sum())]
            for of, place in distinct(texts):
                for k in (0, 1):
                    seen[k] += np.bincount(place[y[of] == k], minlength=1 << BITS)
        there = np.flatnonzero(seen.any(axis=0))
        columns = [np.append(there, -1), np.append(seen[0][there], rows[0]), np.append(seen[1][there], rows[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "other", "toxic"])

    counts = in_batches(sample, count, "place long, other long, toxic long").groupBy("place").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).persist()
    head = counts.where("place = -1").first()
    if head is None or not head["toxic"] or not head["other"]:
        counts.unpersist()
        return nothing
    a, b = F.col("toxic") + F.lit(0.5), F.col("other") + F.lit(0.5)
    ratio = F.log(a / (head["toxic"] + 1)) - F.log(b / (head["other"] + 1))
    ranked = counts.where("place >= 0 and toxic + other > 1").select("place", ratio.alias("ratio"), F.abs(ratio / F.sqrt(1 / a + 1 / b)).alias("stands_out"))
    chosen = ranked.orderBy(F.desc("stands_out"), "place").limit(features).collect()  # `features` rows
    counts.unpersist()
    places = np.array(sorted(r["place"] for r in chosen), np.int64)
    ratios = np.array([r["ratio"] for r in sorted(chosen, key=lambda r: r["place"])])

    def vectors(batches) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, bool)
        table[places] = True
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), [[] for _ in range(batch.num_rows)]
            for of, place in distinct(texts, table):
                for k, p in zip(of.tolist(), np.searchsorted(places, place).tolist()):
                    own[k].append(p)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], names=["columns", "toxic"])

    # `bound` rows of numbers, for the fit
    rows, columns, y = [], [], []
    for k, r in enumerate(in_batches(sample, vectors, "columns array<int>, toxic int").toLocalIterator()):
        columns.append(np.array(r["columns"], np.int64))
        rows.append(np.full(len(columns[-1]), k))
        y.append(r["toxic"])
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    weights, intercept = fit(rows, columns, ratios[columns], (np.array(y) > 0).astype(float), len(places))
    return Classifier(places, weights * ratios, intercept)


def score(docs: DataFrame, classifier: Classifier, *keep: str) -> DataFrame:
    """doc_id, score, and the columns named in keep."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    kept = [docs.schema[c] for c in keep]

    def run(batches) -> Iterator[pa.RecordBatch]:
        chosen, weight = shared.value.table()
        for batch in batches:
            s = shared.value.scores(batch.column(1).to_pylist(), chosen, weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), *batch.columns[2:]], names=["doc_id", "score", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return in_batches(rows, run, ", ".join(["doc_id long", "score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)]))


REJECT_FROM = 0.3


def accepted(docs: DataFrame, classifier: Classifier, reject_from: float = REJECT_FROM) -> DataFrame:
    """The documents whose score is under the limit, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches) -> Iterator[pa.RecordBatch]:
        chosen, weight = shared.value.table()
        for batch in batches:
            s = shared.value.scores(batch.column(0).to_pylist(), chosen, weight)
            yield batch.select([1]).filter(pa.array(s < reject_from))

    rows = docs.select(F.col("text").cast("string").alias("__text"), F.struct(*docs.columns).alias("__row"))
    return in_batches(rows, run, T.StructType([T.StructField("__row", docs.schema)])).select("__row.*")


def cross_checked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the rows that are not held out."""
    held = crc_fold(F.col("doc_id")) == 2
    found = score(docs, learn(docs.where(~held), labels.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"))
