"""Line deduplication by a tree of log templates.

A line's way through the tree: its number of words, its first word, then two of the LEADING next words (a word with a
digit counts as a variable field here). Of its possible leaves a line belongs to the one that most different lines
reach; a leaf of fewer than LEAST lines is none. In a leaf, a word is as well supported as there are lines with that
word at that place. For each power of two a line has a template: its words of at least that support are literal, all
others are fields that may hold anything; half of the words or more must be literal.

A line recurs exactly, or by a template with fields, if enough documents have it: their number times the square of
the number of literal words must reach STRENGTH, and for each field FIELD times as much again. So lines of 8 words
recur from 2 documents on, of 4 words from 8 on, and a template of 7 literal words and 2 fields from 12 on; a row of
numbers has hardly a literal word and recurs with its values only. Templates with fields need LEAST documents.
A recurring line is dropped, except in the document of the smallest doc_id that has the line or template, so that
no content is lost altogether.

With ``passages``, they are found wherever they stand in their lines: a run of PASSAGE words of one document (over
line ends, too) that another has word by word, with DISTINCT different words or more, goes from all documents but the
one of the smallest doc_id, and what else stands on its lines stays. Only runs count that hold a word which the lines
leave, in either document; what lines drop is not written out once more. Runs are joined exactly, in two steps: of the
shorter runs of PICKED words in each run of PASSAGE words the one of the least hash is posted; around those that
recur, every run of PASSAGE words is.

Before lines of some leaf, or runs around what recurs, are read again stands a filter of bits of a fixed size, which
lets through more where it is full but never less; joins decide.

Words are split at white space; A-Z are lower-cased. Lines without words stay as they are; a line that loses
all its words goes. A document all of whose worded lines go is dropped as a whole, and so is one of which less than
the share ``least_left`` of its words is left: a copy with few changes, of which only shreds would stay. Null and empty
texts and rows with a null doc_id pass as they are. Rows that repeat a doc_id are one document. An empty table gives
no rows; all columns are kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT_KEYS, Shelf, hot_join, in_batches
from .words import _ODD, UNSPACED, Words, _powers, chunks, mixed

LEADING, LEAST, STRENGTH, FIELD = 4, 3, 128, 1.75
PAIRS = list(itertools.combinations(range(1, LEADING + 1), 2))
PASSAGE, PICKED, DISTINCT, MOST_BITS = 50, 25, 20, 27
#: A posted run of HOT_LEAST / HOT_KEYS documents or fewer is not hot.
HOT_LEAST = 1_000_000
_FIELD = np.uint64(0x5DEECE66D1234567)


class Lines:
    """The lines with words of many texts: of (text), number (within the text), size (words), first (word), key
    (of all words) and nodes (a row of leaves for each line, one for each of PAIRS; 0 where it is too short)."""

    def __init__(self, w: Words):
        self.words = w
        if not len(w.starts):
            self.of = self.number = self.size = self.first = np.empty(0, np.int64)
            self.key, self.nodes = np.empty(0, np.int64), np.empty((0, len(PAIRS)), np.int64)
            return
        newline = np.cumsum(w.bytes == 10)
        of = np.searchsorted(w.offsets, w.starts, side="right") - 1
        line = newline[w.starts] + of  # texts are joined by a space, so the text counts too
        heads = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        size = np.diff(np.append(heads, len(line)))
        place = np.arange(len(line)) - np.repeat(heads, size)
        up = _powers(int(size.max()))[0][place] * _ODD[1]
        base = size.astype(np.uint64) * _ODD[2]
        first_line = newline[w.offsets[:-1]] + np.arange(len(w.offsets) - 1)
        self.of, self.size, self.first = of[heads], size, heads
        self.number = line[heads] - first_line[self.of]
        self.key = mixed(np.add.reduceat(mixed(w.hashes * _ODD[0] + up), heads) + base).view(np.int64)
        digit = np.concatenate(([0], np.cumsum((w.bytes >= 48) & (w.bytes <= 57))))
        known = np.where(digit[w.ends] > digit[w.starts], _FIELD, w.hashes)
        lead = mixed(known[heads] * _ODD[3] + base)
        nth = [known[np.minimum(heads + k, len(line) - 1)] for k in range(LEADING + 1)]
        nodes = [np.where(size > k, mixed(lead + nth[j] * _ODD[3 + j] + nth[k] * _ODD[8 + k]), np.uint64(0)).view(np.int64) for j, k in PAIRS]
        self.nodes = np.stack(nodes, axis=1)


def _textual(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("which"), text.alias("text")).where("doc_id is not null and text is not null")


def _arrays(nodes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * len(PAIRS)), pa.array(nodes.ravel()))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, which (text of this doc_id), line (its number), size, key, new (no earlier line of the text is equal), nodes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, which = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, own in chunks(batch.column(2).to_pylist()):
                x = Lines(Words(own, UNSPACED))
                new = np.zeros(len(x.of), bool)
                order = np.lexsort((x.number, x.key, x.of))
                a, b = x.of[order], x.key[order]
                new[order] = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)]
                columns = [ids[at + x.of], which[at + x.of], x.number.astype(np.int32), x.size.astype(np.int32), x.key, new]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _arrays(x.nodes)], names=["doc_id", "which", "line", "size", "key", "new", "nodes"])

    return in_batches(_textual(docs), run, "doc_id long, which long, line int, size int, key long, new boolean, nodes array<long>")


def reaching(docs: DataFrame, bits: int, known: np.ndarray) -> DataFrame:
    """doc_id, key, nodes, words (their hashes) of the lines of which a node's bit is set."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, own in chunks(batch.column(2).to_pylist()):
                x = Lines(Words(own, UNSPACED))
                some = np.flatnonzero(((x.nodes != 0) & _set(x.nodes, bits, known)).any(axis=1))
                if len(some):
                    ends = np.cumsum(np.concatenate(([0], x.size[some])))
                    places = np.arange(ends[-1]) + np.repeat(x.first[some] - ends[:-1], x.size[some])
                    words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.words.hashes[places].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + x.of[some]]), pa.array(x.key[some]), _arrays(x.nodes[some]), words], names=["doc_id", "key", "nodes", "words"])

    return in_batches(_textual(docs), run, "doc_id long, key long, nodes array<long>, words array<long>")


def enough(docs: F.Column, literal: F.Column, fields: F.Column) -> F.Column:
    """Whether so many documents with so many literal words and fields make a template recur."""
    return docs * literal * literal >= STRENGTH * (1 + FIELD * fields)


def templates(lines: DataFrame, nodes: DataFrame, shelf: Shelf) -> DataFrame:
    """key, keeper: the lines with a recurring template with fields, and the smallest doc_id that has it.

    lines: key, first (doc_id), nodes, words of different lines; nodes: node, lines.
    """
    total = lines.count()
    reached = lines.select("key", F.explode("nodes").alias("node")).where("node <> 0")
    leaf = hot_join(reached, nodes, "node", "lines", total).groupBy("key").agg(F.max(F.struct("lines", "node")).alias("leaf")).select("key", "leaf.*")
    words = lines.join(leaf, "key").select("key", "first", F.col("node").alias("leaf"), F.col("lines"), F.size("words").alias("size"), F.posexplode("words").alias("place", "word"))
    words = shelf.put(words.withColumn("there", F.xxhash64("leaf", "place", "word")), "words")
    support = shelf.put(words.groupBy("there").agg(F.count(F.lit(1)).alias("support")).where("support > 1"), "support")
    held = hot_join(words, support, "there", "support", words.count())
    held = held.groupBy("key", "first", "leaf", "lines", "size").agg(F.array_sort(F.collect_list(F.struct("place", "word", "support"))).alias("held"))
    powers = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.log2("lines")).cast("int"))), lambda k: F.pow(F.lit(2.0), k))
    literal = F.transform(powers, lambda p: F.transform(F.filter("held", lambda x: x["support"] >= p), lambda x: F.struct(x["place"].alias("place"), x["word"].alias("word"))))
    literal = F.filter(F.array_distinct(literal), lambda x: (2 * F.size(x) >= F.col("size")) & (F.size(x) < F.col("size")))
    made = held.select("key", "first", "leaf", "size", F.explode(literal).alias("words"))
    made = shelf.put(made.select("key", "first", F.xxhash64("leaf", "words").alias("template"), F.size("words").alias("literal"), (F.col("size") - F.size("words")).alias("fields")), "templates")
    often = made.groupBy("template", "literal", "fields", "first").agg(F.count(F.lit(1)).alias("n")).groupBy("template", "literal", "fields").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.min("first").alias("keeper"))
    often = shelf.put(often.where((F.col("docs") >= LEAST) & enough(F.col("docs"), F.col("literal"), F.col("fields"))).select("template", "n", "keeper"), "recurring")
    return hot_join(made.select("key", "template"), often, "template", "n", made.count()).groupBy("key").agg(F.min("keeper").alias("keeper"))


def recurring(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """doc_id, which, drop (array of line numbers): what goes from which document."""
    table = shelf.put(found(docs), "lines")
    counts = [F.count_if("new").alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")]
    different = shelf.put(table.groupBy("key", "size", "nodes").agg(*counts), "different")
    exact = different.where((F.col("first") < F.col("last")) & enough(F.col("docs"), F.col("size"), F.lit(0))).select("key", F.col("first").alias("keeper"), "docs")
    nodes = shelf.put(different.select(F.explode("nodes").alias("node")).where("node <> 0").groupBy("node").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= LEAST), "nodes")
    own = reaching(docs, *bits_of(nodes.select(F.col("node").alias("key")))).groupBy("key").agg(F.min("doc_id").alias("first"), F.any_value("nodes").alias("nodes"), F.any_value("words").alias("words"))
    general = templates(shelf.put(own, "reaching"), nodes, shelf).withColumn("docs", F.lit(1).cast("long"))
    keepers = shelf.put(exact.unionByName(general).groupBy("key").agg(F.min("keeper").alias("keeper"), F.max("docs").alias("docs")), "keepers")
    gone = hot_join(table.select("doc_id", "which", "line", "key"), keepers, "key", "docs", table.count()).where("doc_id <> keeper")
    drops = shelf.put(gone.groupBy("doc_id", "which").agg(F.collect_list("line").alias("drop")), "drops")
    shelf.drop_others(drops)
    return drops


def _set(keys: np.ndarray, bits: int, known: np.ndarray) -> np.ndarray:
    lead = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (known[lead >> 3] >> (lead & 7).astype(np.uint8)) & 1 == 1


def runs(w: Words, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, by its first word; runs may reach over into the next text."""
    n = len(w.hashes)
    if n < size:
        return np.empty(0, np.uint64)
    up, back = _powers(n)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(w.hashes * up, dtype=np.uint64)))
    return mixed((sums[size:] - sums[:-size]) * back[: n - size + 1] + np.uint64(int(_ODD[20]) * size % (1 << 64)))


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """The best of each ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        x, width = best(x[:-width], x[width:]), 2 * width
    return best(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def picked(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of the posted runs of PICKED words: each run of PASSAGE words in one text holds one, the same wherever it stands."""
    h = runs(w, PICKED)
    size = PASSAGE - PICKED + 1
    if len(h) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = _sliding(h, size, np.minimum)
    at = np.arange(len(least))
    least[at + PASSAGE > w.first[np.searchsorted(w.first, at, side="right")]] = 0  # over the end of its text
    edge = np.zeros(size - 1, np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), size, np.maximum)
    places = np.flatnonzero((most == h) & (h > 0))
    return places, h[places].view(np.int64)


def left_words(w: Words, drops: list) -> np.ndarray:
    """Sums of the words before each word, and of all, that stand on no line of these numbers (a list or None for each text)."""
    stay = np.ones(len(w.starts), np.int64)
    if any(d is not None and len(d) for d in drops):
        x = Lines(w)
        gone = [np.isin(x.number[a:b], drops[t]) if drops[t] is not None else np.zeros(b - a, bool) for t, (a, b) in enumerate(zip(*(np.searchsorted(x.of, np.arange(len(drops)) + k) for k in (0, 1))))]
        stay = np.repeat(~np.concatenate(gone), x.size).astype(np.int64)
    return np.concatenate(([0], np.cumsum(stay)))


def _marked(marked: DataFrame) -> DataFrame:
    return marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("__drop").alias("drop")).where("doc_id is not null and text is not null")


def posted(marked: DataFrame) -> DataFrame:
    """doc_id, key: each posted run near a word that lines leave, once for each row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, drops = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for at, own in chunks(batch.column(1).to_pylist()):
                w = Words(own, UNSPACED)
                left = left_words(w, drops[at : at + len(own)])
                places, keys = picked(w)
                texts = np.searchsorted(w.first, places, side="right") - 1
                near = left[np.minimum(places + PASSAGE, w.first[texts + 1])] > left[np.maximum(places - (PASSAGE - PICKED), w.first[texts])]
                if near.any():
                    texts, keys = _distinct(texts[near], keys[near])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + texts]), pa.array(keys)], names=["doc_id", "key"])

    return in_batches(_marked(marked), run, "doc_id long, key long")


def bits_of(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(number of leading bits, a bit for each value of them): 16 places or more for each key up to 2 ** MOST_BITS places."""
    bits = min(MOST_BITS, max(15, (16 * keys.count()).bit_length()))
    lead = F.shiftrightunsigned("key", 64 - bits)
    rows = keys.groupBy(F.shiftright(lead, 15).alias("block")).agg(F.bitmap_construct_agg(lead % 32768).alias("set")).toArrow()
    every = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for block, own in zip(rows["block"].to_pylist(), rows["set"].to_pylist()):
        every[block] = np.frombuffer(own, np.uint8)
    return bits, every.ravel()


def around(marked: DataFrame, bits: int, known: np.ndarray, hot: np.ndarray, wanted: bool) -> DataFrame:
    """doc_id, key: the runs of PASSAGE words with a word that lines leave whose own posted run has its bit set, each once for each row.

    Of these, those whose posted run is a hot one (wanted), or all others.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, drops = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for at, own in chunks(batch.column(1).to_pylist()):
                w = Words(own, UNSPACED)
                h = runs(w, PICKED)
                if len(h) <= PASSAGE - PICKED:
                    continue
                least = _sliding(h, PASSAGE - PICKED + 1, np.minimum).view(np.int64)
                starts = np.flatnonzero(_set(least, bits, known) & (np.isin(least, hot) == wanted))
                starts = starts[starts + PASSAGE <= w.first[np.searchsorted(w.first, starts, side="right")]]
                if not len(starts):
                    continue
                left = left_words(w, drops[at : at + len(own)])
                starts = starts[left[starts + PASSAGE] > left[starts]]
                keys = runs(w, PASSAGE)[starts].view(np.int64)
                for k in range(0, len(starts), 4096):
                    some = np.sort(w.hashes[starts[k : k + 4096, None] + np.arange(PASSAGE)], axis=1)
                    rich = (some[:, 1:] != some[:, :-1]).sum(axis=1) >= DISTINCT - 1
                    texts = np.searchsorted(w.first, starts[k : k + 4096][rich], side="right") - 1
                    if len(texts):
                        texts, own_keys = _distinct(texts, keys[k : k + 4096][rich])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + texts]), pa.array(own_keys)], names=["doc_id", "key"])

    return in_batches(_marked(marked), run, "doc_id long, key long")


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[new], b[new]


def repeated(marked: DataFrame, shelf: Shelf) -> DataFrame:
    """doc_id, cut (array of keys of runs of PASSAGE words): what goes from which document.

    Runs are dealt by key once. Those around hot posted runs (HOT_KEYS at most) are counted where they are instead.
    """
    ends = [F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")]
    often = shelf.put(posted(marked).groupBy("key").agg(*ends).where("keeper < last").select("key", "n"), "posted")
    every = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.array([r["key"] for r in often.where(F.col("n") * HOT_KEYS > F.greatest(F.lit(every), F.lit(HOT_LEAST))).collect()], np.int64)  # HOT_KEYS at most
    bits, known = bits_of(often.select("key"))
    keeper = F.min("doc_id").over(Window.partitionBy("key"))
    gone = around(marked, bits, known, hot, False).withColumn("keeper", keeper).where("doc_id <> keeper").select("doc_id", "key")
    if len(hot):
        again = shelf.put(around(marked, bits, known, hot, True), "passages")
        shared = shelf.put(again.groupBy("key").agg(*ends).where("keeper < last").drop("last"), "shared")
        gone = gone.unionByName(hot_join(again, shared, "key", "n", again.count()).where("doc_id <> keeper").select("doc_id", "key"))
    cuts = shelf.put(gone.groupBy("doc_id").agg(F.collect_set("key").alias("cut")), "cuts")
    shelf.drop_others(cuts, marked)
    return cuts


def without_lines(text: str, drop: list, least_left: float) -> str | None:
    """The text without the lines of these numbers; None if too little is left."""
    gone, lines = set(drop), text.encode().split(b"\n")
    return _enough_left(b"\n".join(x for k, x in enumerate(lines) if k not in gone), text, least_left)


def without(text: str, drop: list, cut: list, least_left: float) -> str | None:
    """The text without the lines of these numbers and these runs of words; None if too little is left."""
    raw = text.encode()
    w, lines, gone = Words([raw], UNSPACED), raw.split(b"\n"), set()
    starts = np.flatnonzero(np.isin(runs(w, PASSAGE).view(np.int64), np.asarray(cut, np.int64)))
    steps = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + PASSAGE, -1)
    _cut(w, (np.cumsum(steps[:-1]) > 0) | (np.diff(left_words(w, [drop])) == 0), lines, gone)
    return _enough_left(b"\n".join(x for k, x in enumerate(lines) if k not in gone), text, least_left)


def _enough_left(left: bytes, text: str, least_left: float) -> str | None:
    n = len(left.split())  # bytes split at the same white space
    return left.decode() if n and n >= least_left * len(text.encode().split()) else None


def _cut(w: Words, out: np.ndarray, lines: list[bytes], gone: set[int]) -> None:
    """Takes these words out of their lines; lines all of whose words go are added to ``gone``."""
    newlines = np.flatnonzero(w.bytes == 10)
    line = np.searchsorted(newlines, w.starts)
    begins = np.concatenate(([0], newlines + 1))
    for k in np.unique(line[out]).tolist():
        low, high = np.searchsorted(line, [k, k + 1])
        if out[low:high].all():
            gone.add(k)
            continue
        left, at = [], int(begins[k])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], out[low:high], [False])).astype(np.int8))) + low
        for i, j in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            # with the space after them, at the end of a line with the space before them
            a, b = (w.starts[i], w.starts[j]) if j < high else (w.ends[i - 1], w.ends[j - 1])
            left.append(lines[k][at - begins[k] : a - begins[k]])
            at = int(b)
        lines[k] = b"".join(left) + lines[k][at - begins[k] :]


def _joined(docs: DataFrame, drops: DataFrame, on: dict) -> DataFrame:
    """docs with the last column of ``drops``; on: the columns of docs that its others are equal to."""
    drops = drops.withColumnsRenamed({k: f"__{k}" for k in drops.columns})
    return docs.join(drops.hint("shuffle_hash"), [v == F.col(f"__{k}") for k, v in on.items()], "left").drop(*[f"__{k}" for k in on])


def dedup(docs: DataFrame, passages: bool = False, least_left: float = 0.0) -> DataFrame:
    """The documents with recurring lines (and passages) dropped, all columns as they were; n_chars follows the text."""
    shelf = Shelf(docs.sparkSession, "lines")
    doc, which = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    marked = _joined(docs, recurring(docs, shelf), {"doc_id": doc, "which": which})
    if passages:
        marked = shelf.put(marked, "marked")
        marked = _joined(marked, repeated(marked, shelf), {"doc_id": doc})
    else:
        marked = marked.withColumn("__cut", F.lit(None).cast("array<long>"))

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, drop: pd.Series, cut: pd.Series) -> pd.Series:
        new = [None if t is None else without_lines(t, d, least_left) if c is None else without(t, [] if d is None else d, c, least_left) for t, d, c in zip(text, drop, cut)]
        return pd.Series(new, dtype=object)

    cleaned = cleaned.asNondeterministic()  # else Spark runs it once for the filter and once for the column
    some = F.col("__drop").isNotNull() | F.col("__cut").isNotNull()
    changed = marked.withColumn("__some", some).withColumn("__text", cleaned(F.when(some, F.col("text").cast("string")), "__drop", "__cut"))
    left = changed.where("not __some or __text is not null").withColumn("text", F.when(F.col("__some"), F.col("__text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("__some"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)
