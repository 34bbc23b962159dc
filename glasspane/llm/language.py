"""Language identification by rank-order profiles of character n-grams.

A language's profile ranks the most frequent n-grams (one to three letters, with word ends) of labelled
texts; a document's own most frequent n-grams, over its whole text, are compared with every profile by
the out-of-place distance: how far each n-gram's ranks lie apart, or ``places`` where a profile lacks it.

Profiles are learned from at most about ``bound`` labelled rows of each language, chosen by a hash of
the id and not by content. Null text, empty text and texts without letters are ``und`` with score 0, as
are all if no language was learned. Ties of count go by code points, ties of distance by the language's
name. Repeated rows are judged each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf, crc_fold, hot_join, in_batches

PLACES, BOUND = 300, 3000
_LETTER: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16))
    low = codes < 1 << 16
    found = _LETTER[0][np.where(low, codes, 0)] & low
    for c in np.unique(codes[~low]):
        if chr(c).isalpha():
            found |= codes == c
    return found


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers (21 bits a letter, 0 for a word's end); none crosses a word's end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate(([0], np.where(letters(codes), codes, 0), [0])).astype(np.uint64)
    c = c[(c != 0) | np.concatenate(([True], c[:-1] != 0))]
    a, b = c[:-1], c[1:]
    two = (a | b << np.uint64(21))[(a != 0) | (b != 0)] | np.uint64(1 << 63)
    three = (a[:-1] | a[1:] << np.uint64(21) | b[1:] << np.uint64(42))[a[1:] != 0] if len(c) > 2 else np.empty(0, np.uint64)
    one = c[c != 0] | np.uint64(1 << 62 | 1 << 63)
    return np.concatenate((one, two, three))


def most_frequent(grams: np.ndarray, places: int) -> np.ndarray:
    """The most frequent n-grams in order of rank; ties by number."""
    found, counts = np.unique(grams, return_counts=True)
    if len(found) > places:
        least = np.partition(counts, len(counts) - places)[len(counts) - places]
        sure = counts > least
        sure[np.flatnonzero(counts == least)[: places - int(sure.sum())]] = True
        found, counts = found[sure], counts[sure]
    return found[np.argsort(-counts, kind="stable")]


class Profiles:
    """ranks[i, j]: rank of n-gram known[i] in the profile of languages[j], or ``places``."""

    def __init__(self, rows: list[tuple[str, int, int]], places: int):
        self.places, self.languages = places, sorted({x for x, _, _ in rows})
        self.known = np.unique(np.array([g for _, g, _ in rows], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.known), len(self.languages)), places, np.int32)
        column = {x: j for j, x in enumerate(self.languages)}
        for language, gram, rank in rows:
            self.ranks[np.searchsorted(self.known, np.int64(gram).view(np.uint64)), column[language]] = rank

    def closest(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text) if text else np.empty(0, np.uint64)
        if not len(grams) or not self.languages:
            return "und", 0.0
        own = most_frequent(grams, self.places)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        there = self.known[at] == own
        missing = (len(own) - int(there.sum())) * self.places
        r = self.ranks[at[there]]
        distance = np.where(r < self.places, np.abs(r - np.flatnonzero(there)[:, None]), self.places).sum(axis=0) + missing
        best = int(np.argmin(distance))
        return self.languages[best], 1 - float(distance[best]) / (len(own) * self.places)


def learn(docs: DataFrame, places: int = PLACES, bound: int = BOUND) -> Profiles:
    """Profiles from the rows whose lang is not null; the caller leaves out what is held out."""
    rows = docs.select(F.xxhash64("doc_id").alias("order"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = Shelf(docs.sparkSession, "language").put(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    every = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drawn = hot_join(rows, sizes.withColumn("most", bound / F.col("n") * 1_000_003), "lang", "n", every).where(F.pmod("order", F.lit(1_000_003)) < F.col("most"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(language, []).append(ngrams(text))
            for language, grams in by.items():
                found, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = in_batches(drawn.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ties in unsigned order of the numbers, as for documents
    ranked = counted.selectExpr("lang", "gram", "row_number() over (partition by lang order by n desc, gram < 0, gram) - 1 as place")
    return Profiles([(r["lang"], r["gram"], r["place"]) for r in ranked.where(F.col("place") < places).collect()], places)  # `places` rows a language


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score; the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.closest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")


def cross_checked(docs: DataFrame, places: int = PLACES, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    held = crc_fold(F.col("doc_id")) == 2
    return identify(docs, learn(docs.where(~held), places, bound)).withColumn("held_out", crc_fold(F.col("doc_id")) == 2).select("doc_id", "held_out", "lang_pred", "score")
