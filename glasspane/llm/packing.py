"""Best-fit packing by the linear grouping scheme.

Every document becomes its token ids and one closing id; documents over the sequence length are cut
into full pieces, of which the first may be shorter. The lengths lie in 1..2048, so their histogram
is a statistic of bounded size: the driver plans on it, however many documents there are.

1. Large lengths (over ``small_up_to``) are dealt, in order, to groups of equal cardinality, and each
   is rounded up to the largest of its group.
2. Column generation finds how often to use which configuration of the few rounded sizes.
3. Actual lengths take the places of the rounded ones, the longest first.
4. What has no place yet, and all small lengths, go by best fit into the room that is left.

The plan is a list of runs: equal bins are kept once, with how many there are. Each piece has a rank
among the pieces of its length; a run states which ranks it holds, so placing is a lookup by row.

Null text counts as empty (one token, the closing id). Repeated rows and ties are packed each for
itself; a null doc_id is carried along. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf, in_batches

SEQUENCE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: Words of plain texts, cut as the tokenizer's own pattern does; texts with other signs go to the tokenizer whole.
_PLAIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\x20-\x7e\n{_LETTERS}]|<\|")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Words come back often, so the ids of a word are kept; the memory for that is bounded by
    ``keep`` words of at most 40 signs each.
    """

    def __init__(self, path: str, keep: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.core = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary in a form that encodes single words faster, if that library is there."""
        try:
            import json

            import tiktoken
        except ImportError:
            return None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        signs = _byte_of_sign()
        ranks = {bytes(map(signs.__getitem__, k)): v for k, v in vocabulary.items() if all(x in signs for x in k) and not k.startswith("<|")}
        if len(ranks) < 256:
            return None
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if len(word) > 40 or self.core is None:
            ids = self.whole(word)
        else:
            ids = self.core.encode_to_tiktoken_buffer(word, set())
        if len(word) <= 40:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self.whole(text)
        get, word = self.known.get, self.word
        return b"".join([get(w) or word(w) for w in _PLAIN.findall(text)])


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies show each byte as a printable sign: printable ones as themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def cut(ids: bytes, limit: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, ids) of the pieces: full ones, the first shorter where it does not come out even."""
    n = len(ids) // 4
    first = n if n <= limit else (n - 1) % limit + 1
    start, end = 0, first
    while start < n:
        yield start, end - start, ids[4 * start : 4 * end]
        start, end = end, end + limit


def tokenized(docs: DataFrame, tokenizer: str, limit: int, keep_ids: bool = False) -> DataFrame:
    """A row per piece; ``nth`` counts the pieces of one length within one task."""

    def run(batches):
        encoder, task, seen = Encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = (encoder(text) if text else b"") + b"\0\0\0\0"
                for k, (start, length, own) in enumerate(cut(ids, limit)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(own), task, seen[length], np.frombuffer(own, "<u4").tolist() if keep_ids else None)):
                        column.append(value)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
            columns = [pa.array(c, t) for c, t in zip(out, kinds)]
            n = 8 if keep_ids else 7
            yield pa.RecordBatch.from_arrays(columns[:n], names=names[:n])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES + (", ids array<int>" if keep_ids else ""))


# --- the plan, on the histogram of lengths ---------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Length -> rounded length. Groups hold as equal a number of pieces as whole lengths allow."""
    order = sorted(counts, reverse=True)
    each, rounded, top, full = max(1, -(-sum(counts.values()) // groups)), {}, 0, 0
    for length in order:
        if full == 0:
            top = length
        rounded[length] = top
        full += counts[length]
        if full >= each:
            full = 0
    return rounded


def best_configuration(sizes: list[int], worth: np.ndarray, limit: int) -> tuple[float, list[int]]:
    """The configuration of greatest worth that fits: a knapsack with repeats."""
    value = np.zeros(limit + 1)
    chosen = np.full((len(sizes), limit + 1), 0, np.int16)
    for k, s in enumerate(sizes):
        base = value
        value = base.copy()
        for times in range(1, limit // s + 1):
            other = base[: limit + 1 - times * s] + times * worth[k]
            better = other > value[times * s :] + 1e-12
            value[times * s :][better] = other[better]
            chosen[k, times * s :][better] = times
    room, taken = limit, [0] * len(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        taken[k] = int(chosen[k, room])
        room -= taken[k] * sizes[k]
    return float(value[limit]), taken


def configurations(demand: dict[int, int], limit: int, rounds: int = 600) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often to use each: the relaxed optimum by column generation, rounded down."""
    sizes = sorted(demand, reverse=True)
    m = len(sizes)
    if not m:
        return []
    need = np.array([demand[s] for s in sizes], float)
    columns = np.diag([float(limit // s) for s in sizes])
    inverse = np.diag([1.0 / (limit // s) for s in sizes])
    used = inverse @ need
    for step in range(rounds):
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
            used = inverse @ need
        worth = inverse.sum(axis=0)
        gain, taken = best_configuration(sizes, np.maximum(worth, 0), limit)
        if gain <= 1 + 1e-6:
            break
        column = np.array(taken, float)
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, np.maximum(used, 0) / direction, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        used = used - ratio[out] * direction
        used[out] = ratio[out]
        columns[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    found = []
    for k in range(m):
        times = int(np.floor(used[k] + 1e-9))
        if times > 0:
            found.append(({s: int(columns[i, k]) for i, s in enumerate(sizes) if columns[i, k] > 0.5}, times))
    return found


class Bins:
    """Runs of equal bins by the room that is left: (first bin, number of bins) under each room."""

    def __init__(self, limit: int):
        self.limit, self.next, self.by_room, self.rooms = limit, 0, defaultdict(list), []

    def add(self, room: int, first: int, n: int) -> None:
        if n > 0:
            if not self.by_room[room]:
                k = bisect_left(self.rooms, room)
                if k == len(self.rooms) or self.rooms[k] != room:
                    self.rooms.insert(k, room)
            self.by_room[room].append((first, n))

    def new(self, n: int) -> int:
        self.next += n
        return self.next - n

    def tightest(self, length: int) -> int | None:
        k = bisect_left(self.rooms, length)
        return self.rooms[k] if k < len(self.rooms) else None

    def take(self, room: int) -> tuple[int, int]:
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.rooms[bisect_left(self.rooms, room)]
        return run


def plan(histogram: dict[int, int], limit: int = SEQUENCE, groups: int = 200, small_up_to: int = 900) -> dict[str, np.ndarray]:
    """Runs (length, first rank, first bin, ranks per bin, offset): ranks first .. are dealt to bins in turn."""
    left = {k: n for k, n in histogram.items() if n > 0}
    rank: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = Bins(limit)

    def place(length: int, first_bin: int, n: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], first_bin, each, offset))
        rank[length] += n * each
        left[length] -= n * each
        if not left[length]:
            del left[length]

    large = {k: n for k, n in left.items() if small_up_to < k}
    rounded = linear_groups(large, groups)
    demand: dict[int, int] = defaultdict(int)
    for length, n in large.items():
        demand[rounded[length]] += n
    members: dict[int, list[int]] = defaultdict(list)
    for length in sorted(large):
        members[rounded[length]].append(length)  # the longest is last
    for shape, times in configurations(dict(demand), limit):
        # open bins of this shape as runs whose bins are still alike: (first bin, how many, room used)
        alike = [(bins.new(times), times, 0)]
        for size in sorted(shape, reverse=True):
            for _ in range(shape[size]):
                nxt = []
                for first, n, filled in alike:
                    while n:
                        own = members[size]
                        while own and own[-1] not in left:
                            own.pop()
                        if not own:
                            nxt.append((first, n, filled))
                            break
                        length = own[-1]
                        k = min(n, left[length])
                        place(length, first, k, 1, filled)
                        nxt.append((first, k, filled + length))
                        first, n = first + k, n - k
                alike = nxt
        for first, n, filled in alike:
            bins.add(limit - filled, first, n)
    for length in sorted(left, reverse=True):
        while length in left:
            room = bins.tightest(length)
            if room is None:
                each = limit // length
                n = max(1, left[length] // each)
                each = min(each, left[length])
                first = bins.new(n)
                place(length, first, n, each, 0)
                bins.add(limit - each * length, first, n)
                continue
            first, n = bins.take(room)
            k = min(n, left[length])
            place(length, first, k, 1, limit - room)
            bins.add(room - length, first, k)
            bins.add(room, first + k, n - k)
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"length": table[:, 0], "rank": table[:, 1], "bin": table[:, 2], "each": table[:, 3], "offset": table[:, 4], "bins": np.array([bins.next])}


def pack(docs: DataFrame, tokenizer: str, limit: int = SEQUENCE, groups: int = 200, small_up_to: int = 900, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row per piece, placed."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "packing")
    pieces = shelf.put(tokenized(docs, tokenizer, limit, keep_ids), "pieces")
    own = shelf.put(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("own")), "own")
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("own").alias("n")).collect()}  # at most `limit` rows
    layout = spark.sparkContext.broadcast(plan(histogram, limit, groups, small_up_to))
    before = own.selectExpr("length", "task", "sum(own) over (partition by length order by task) - own as before")
    ranked = pieces.join(before, ["length", "task"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "before + nth as rank", *(["ids"] if keep_ids else []))

    def run(batches):
        p = layout.value
        key = p["length"] * (1 << 40) + p["rank"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            past = rank - p["rank"][at]
            spots = [pa.array(p["bin"][at] + past // p["each"][at]), pa.array(p["offset"][at] + past % p["each"][at] * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *spots, *batch.columns[6:]], names=[*names, *(["ids"] if keep_ids else [])])

    return in_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else ""))
