"""Benchmark decontamination by template canonicalisation.

Words (ASCII letters and digits and all beyond ASCII; A-Z lower-cased; a point or comma between digits
belongs to its number) become typed placeholders where they are numbers (in digits or in words, see NUMBER_WORDS),
units after a number, or names (an upper-case word that opens no sentence). Names that follow each other are one
placeholder, whose value is all of them, so that a name of two words may stand for one of one. Windows of WINDOW
canonical words of all texts are joined by
hash with those of the benchmark items. What stands in the slots of the matched windows must be consistent:
each value of the item always has the same value in the text, so a question asked again with other numbers
and names is found, while a text that only looks alike is not.

A text contaminates if windows of one item cover at least ``enough`` of its words (or all of a shorter item)
and the slots are consistent. All matched places count; they are judged in groups: those of one offset (place in
the text less place in the item), those of offsets that follow each other within SHIFT, and the first place of
each window. One group that passes makes the leak, so nothing that stands elsewhere in the text can hide a copy;
of several the one that covers most is given. Windows that are mostly placeholders do not count; items of fewer words than
SHORTEST cannot be told from chance and are left out.

Verbatim copies are found by plain windows, too, whose words and numbers are as they stand (but for A-Z), so it
makes no difference what precedes them or how many placeholders they would be: as many words must be covered,
at one offset.

A filter of fixed size, made from the benchmark's windows, keeps windows that surely match nothing out of
the join; the join itself is Spark's, with a broadcast only if Spark finds the benchmark small enough, and salted, as
one window may stand in very many texts.

Null and empty texts contain nothing. Rows with a null doc_id are not searched, and are kept. Rows that
repeat a doc_id are one document. Empty tables give no rows; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shelf, in_batches
from .words import _ODD, ALPHANUMERIC, LOWER, Words, chunks, mixed

WINDOW, SHORTEST, ENOUGH, FILTER_BITS, SHIFT, SALTS = 8, 5, 10, 22, 8, 16
_NUMBER, _UNIT, _NAME = (np.uint64(0x1000000000000001 + k) for k in range(3))

#: Words that are units when a number stands before them (fixed values).
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml l s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds percent usd eur gbp dollars dollar euros euro cents cent meters metres meter metre miles mile feet inches grams gram kilograms liters litres c f k w kw kwh v a hz khz mhz ghz kb mb gb tb".split()


#: Words that are numbers (fixed values); "one" is not, as it seldom is one.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()


class Canonical(Words):
    """Words with canonical hashes; kinds: 0 a word, 1 a number, 2 a unit, 3 a name.

    ``hashes`` and ``first`` are those of the words as they stand; ``canonical`` and ``begins`` those of the canonical
    words, each of which runs from word ``at[k]`` to before ``at[k + 1]`` (a run of names).
    """

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        digit = (joined >= 48) & (joined <= 57)
        between = np.zeros(len(joined), bool)
        between[1:-1] = ((joined[1:-1] == 44) | (joined[1:-1] == 46)) & digit[:-2] & digit[2:]
        # such a point or comma becomes a letter of its word; the capitals of Latin-1 become small letters
        accented = np.zeros(len(joined), bool)
        accented[1:] = (joined[:-1] == 0xC3) & (joined[1:] >= 0x80) & (joined[1:] <= 0x9E) & (joined[1:] != 0x97)
        plain = np.where(accented, joined + np.uint8(32), np.where(between, np.uint8(48), joined))
        super().__init__([plain[:-1].tobytes()], ALPHANUMERIC)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.raw = joined
        n = len(self.starts)
        self.kinds = np.zeros(n, np.int8)
        if not n:
            self.at, self.begins, self.kind, self.canonical = np.zeros(1, np.int64), self.first, self.kinds, self.hashes
            return
        lead = joined[self.starts]
        capital = accented | (joined >= 65) & (joined <= 90)
        small = (joined >= 97) & (joined <= 122)
        small[:-1] |= (joined[:-1] == 0xC3) & (joined[1:] >= 0xA0)
        wide = (lead == 0xC3).astype(np.int64)
        last = len(joined) - 1
        upper = capital[np.minimum(self.starts + wide, last)] & small[np.minimum(self.starts + wide + 1, last)]
        ends = np.cumsum(np.isin(joined, np.frombuffer(b".!?:\n", np.uint8)) & ~between)
        opens = np.concatenate(([True], ends[self.starts[1:]] > ends[self.ends[:-1] - 1]))
        opens[self.first[:-1][self.first[:-1] < n]] = True
        self.kinds[upper & ~opens] = 3
        self.kinds[(lead >= 48) & (lead <= 57)] = 1
        self.kinds[(self.kinds == 0) & np.isin(self.hashes, _known_hashes(NUMBER_WORDS))] = 1
        after = np.concatenate(([False], self.kinds[:-1] == 1))
        self.kinds[after & (self.kinds == 0) & np.isin(self.hashes, _known_hashes(UNITS))] = 2
        # a name right after a name of the same text goes on with it
        same_text = np.ones(n, bool)
        same_text[self.first[:-1][self.first[:-1] < n]] = False
        goes_on = np.concatenate(([False], (self.kinds[1:] == 3) & (self.kinds[:-1] == 3))) & same_text
        heads = np.flatnonzero(~goes_on)
        self.at = np.append(heads, n)
        self.begins = np.searchsorted(heads, self.first)
        self.kind = self.kinds[heads]
        self.canonical = np.choose(self.kind, [self.hashes[heads], _NUMBER, _UNIT, _NAME])

    def value(self, low: int, high: int) -> str:
        return " ".join(LOWER[self.raw[self.starts[k] : self.ends[k]]].tobytes().decode(errors="replace") for k in range(low, high))

    def slots(self, place: int, size: int, plain: bool) -> list[str]:
        """The placeholders of a window, of a plain one its numbers in digits."""
        if plain:
            return [f"{k}:{self.value(place + k, place + k + 1)}" for k in range(size) if 48 <= self.raw[self.starts[place + k]] <= 57]
        return [f"{k}:{self.value(self.at[place + k], self.at[place + k + 1])}" for k in range(size) if self.kind[place + k]]


_KNOWN: dict[str, np.ndarray] = {}


def _known_hashes(words: list[str]) -> np.ndarray:
    if words[0] not in _KNOWN:
        _KNOWN[words[0]] = Words([" ".join(words).encode()], ALPHANUMERIC).hashes
    return _KNOWN[words[0]]


def windows(c: Canonical, size: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of windows that lie in one text and are mostly words; plain ones may be anything.

    The first word is a place among the canonical words, of plain windows among the words as they stand.
    """
    first = c.first if plain else c.begins
    c = copy.copy(c)
    c.hashes = c.hashes if plain else c.canonical
    h = c.windows(size)
    at = np.arange(len(h))
    of = np.searchsorted(first, at, side="right") - 1
    good = at + size <= first[of + 1]
    if not plain:
        words = np.concatenate(([0], np.cumsum(c.kind == 0)))
        good &= 2 * (words[at + size] - words[at]) > size
    return of[good], at[good], mixed(h[good] + np.uint64(int(_ODD[41 if plain else 40]) * size % (1 << 64))).view(np.int64)


def window_rows(table: DataFrame, key: str, sizes: dict[int, tuple[int, int]], only: np.ndarray | None) -> DataFrame:
    """key, n_words, place, word (the same among the words as they stand), size, plain, hash, slots: the windows of each size for texts of so many words (from, to)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, own in chunks(batch.column(1).to_pylist(), 1 << 18):
                c = Canonical(own)
                for (size, (low, high)), plain in itertools.product(sizes.items(), (False, True)):
                    first = c.first if plain else c.begins
                    n = np.diff(first)
                    of, place, hashes = windows(c, size, plain)
                    keep = (n[of] >= low) & (n[of] <= high)
                    if only is not None:
                        keep &= only[hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)]
                    of, place, hashes = of[keep], place[keep], hashes[keep]
                    if len(of):
                        slots = [c.slots(p, size, plain) for p in place]
                        word = place if plain else c.at[place]
                        columns = [ids[at + of], n[of].astype(np.int32), (place - first[of]).astype(np.int32), (word - c.first[of]).astype(np.int32), np.full(len(of), size, np.int32), np.full(len(of), plain), hashes]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(slots, pa.list_(pa.string()))], names=[key, "n_words", "place", "word", "size", "plain", "hash", "slots"])

    rows = table.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).where(F.col(key).isNotNull() & F.col("text").isNotNull())
    return in_batches(rows, run, f"{key} long, n_words int, place int, word int, size int, plain boolean, hash long, slots array<string>")


ANY = 1 << 30


def leaks(docs: DataFrame, benchmark: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """doc_id, item_id, n_windows, n_words (of the item that are covered), coverage, first_word (in the text), same_slots."""
    shelf = Shelf(docs.sparkSession, "leaks")
    items = shelf.put(window_rows(benchmark, "item_id", {WINDOW: (WINDOW, ANY), SHORTEST: (SHORTEST, WINDOW - 1)}, None), "items")
    only = np.zeros(1 << FILTER_BITS, bool)
    bits = items.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("bit")).distinct()
    only[[r["bit"] for r in bits.toLocalIterator()]] = True  # at most 2 ** FILTER_BITS
    own = window_rows(docs, "doc_id", {WINDOW: (WINDOW, ANY), SHORTEST: (SHORTEST, ANY)}, only)
    # a window that a third of all texts have is dealt by SALTS, and the items once for each
    own, items = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = own.alias("d").join(items.alias("i"), ["hash", "size", "plain", "salt"]).where(~F.col("plain") | (F.col("d.slots") == F.col("i.slots"))).select("doc_id", "item_id", F.col("i.n_words").alias("n"), "size", "plain", F.col("i.place").alias("q"), F.col("d.place").alias("p"), F.col("d.word").alias("word"), F.arrays_zip(F.col("i.slots").alias("a"), F.col("d.slots").alias("b")).alias("pairs"))
    pair = ["doc_id", "item_id", "n", "size", "plain"]
    offset = F.col("p") - F.col("q")
    ordered = Window.partitionBy(*pair).orderBy("offset")
    step = F.coalesce((F.col("offset") - F.lag("offset").over(ordered) > SHIFT).cast("int"), F.lit(0))
    placed = joined.withColumn("offset", offset).withColumn("step", step).withColumn("chain", F.sum("step").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("first", F.col("p") == F.min("p").over(Window.partitionBy(*pair, "q")))
    group = lambda kind, no: F.struct(F.lit(kind).alias("kind"), no.cast("long").alias("no"))
    groups = F.array(group(0, F.col("offset")), F.when(~F.col("plain"), group(1, F.col("chain"))), F.when(~F.col("plain") & F.col("first"), group(2, F.lit(0))))
    grouped = placed.withColumn("of", F.explode(groups)).where("of is not null").groupBy(*pair, "of")
    values = F.array_distinct(F.flatten(F.collect_list(F.transform("pairs", lambda z: F.struct(F.regexp_replace(z["a"], "^[0-9]+:", "").alias("a"), F.regexp_replace(z["b"], "^[0-9]+:", "").alias("b"))))))
    grouped = grouped.agg(F.array_sort(F.collect_set("q")).alias("q"), values.alias("values"), F.min("word").cast("long").alias("first_word"))
    gap = F.transform("q", lambda x, k: F.least(F.col("size"), F.coalesce(F.get("q", k + 1) - x, F.col("size"))))
    covered = F.aggregate(gap, F.lit(0), lambda a, x: a + x)
    consistent = F.col("plain") | (F.size(F.array_distinct(F.transform("values", lambda z: z["a"]))) == F.size("values"))
    same = F.col("plain") | F.forall("values", lambda z: z["a"] == z["b"])
    out = grouped.withColumn("covered", covered).where((F.col("covered") >= F.least(F.col("n"), F.lit(enough))) & consistent).withColumn("same_slots", same)
    best = F.max_by(F.struct(F.size("q").alias("n_windows"), "covered", "n", "first_word", "same_slots"), F.struct("covered", "same_slots", -F.col("first_word"), -F.col("of.kind"))).alias("x")
    out = out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")
    return out.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("covered").cast("long").alias("n_words"), (F.col("covered") / F.col("n")).alias("coverage"), "first_word", "same_slots")


def clean(docs: DataFrame, benchmark: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """The documents that leak nothing, as they were."""
    found = leaks(docs, benchmark, enough).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(found.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__doc"), "left_anti")
