"""Alignment of two tokenizers over a corpus, with an identity map as its fast path.

Each text is encoded as space + text by a byte-level tokenizer A and by a piece tokenizer B. The byte offsets at
which tokens of both end cut the tokens into groups; tokens whose byte ranges overlap are linked. A pair of ids
(a, b) counts in how many documents it is linked; every document then gets sums over its links' counts.

1. ``same[a]`` is the B id of the same bytes, or -1; it is made once from the two vocabularies. Links with
   b = same[a], as in groups of one token each, are counted in a vector as long as A's vocabulary: a row an id and task.
2. All other links are irregular. They are taken together by blocks of documents (BLOCK pairs of document and id
   pair at most, or one document): a block has each of its pairs once, with how many of its documents hold it. Only these
   rows enter the shuffle by pair, where a window gives each the pair's total; so a pair that all documents hold
   costs a row a block.
3. A block's totals meet its documents again by the block's number. Documents keep places in the block's sorted
   list of pairs, which is small, not pairs. Nothing is broadcast but two vectors as long as A's vocabulary.

Encoding runs word by word where that gives the same tokens as whole texts: behind a sign that is no white space
a new token begins at a space, for both tokenizers (B has no piece with a space within), and line feeds stand
alone; and if no piece of B has a stop behind a letter, a cut may also be there. Texts with other white space are encoded whole. Words come back often, so each word's alignment is kept, up to a bound.

Null and empty texts, and those whose tokens' bytes are not those of space + text, have no tokens: zeros and an empty
string. Repeated rows are documents each; doc_id may be null or repeat and is only carried along. An empty table
gives no rows. Other columns are ignored. A very long text is a block of its own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shelf, byte_of_sign, in_batches

#: Pairs of a document and an irregular id pair in a block of documents, about.
BLOCK = 1 << 20
#: Words whose alignment is kept, and links of them.
KEEP, KEEP_LINKS = 300_000, 6_000_000

_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎]")
_SEGMENTS = re.compile(r"\n(?=[^ \n])|[ \n]*[^ \n]+|[ \n]+")
_LETTER, _STOP = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
#: The same, with a cut between a letter and a stop.
_STOPPED = re.compile(rf"\n(?=[^ \n])|[ \n]*+(?:[^ \n{_LETTER}]*+[{_LETTER}]++(?=[{_STOP}])|[^ \n]+)|[ \n]+")


class Vocabularies:
    """Both tokenizers, the bytes of each id, and the map of A ids to B ids of the same bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        signs = byte_of_sign()
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(map(signs.__getitem__, piece)) if all(x in signs for x in piece) else piece.encode()
        n = self.b.get_piece_size()
        raw = [self.b.is_byte(i) for i in range(n)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if raw[i] else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        own = {}
        for i in [*(i for i in range(n) if raw[i]), *(i for i in range(n) if not raw[i] and not self.b.is_control(i) and not self.b.is_unknown(i))]:
            own[self.b_bytes[i]] = i  # a piece goes before a raw byte
        self.same = np.array([own.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_sizes, self.b_sizes = [*map(len, self.a_bytes)], [*map(len, self.b_bytes)]
        self.a_names, self.b_names = [*map(str, range(len(self.a_bytes)))], [*map(str, range(n))]
        pieces = [self.b.id_to_piece(i) for i in range(n) if not raw[i]]
        letter_stop = re.compile(f"[{_LETTER}][{_STOP}]")
        self.segments = _SEGMENTS if any(map(letter_stop.search, (x for x in pieces if x not in ("<unk>", "<s>", "</s>")))) else _STOPPED

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """A's and B's ids of each segment; B adds its space to those that start with one, the others follow a line feed."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        spaced = [s[0] == " " and len(s) > 1 for s in segments]
        b = self.b.encode([s[1:] if own else "\n" + s for s, own in zip(segments, spaced)], num_threads=1)
        return [(x, y if own else y[2:]) for own, x, y in zip(spaced, a, b)]


def aligned(a: list[int], b: list[int], v: Vocabularies) -> tuple[list[str], list[int]]:
    """The groups as text, and the linked pairs of ids in order as a * (size of B) + b, of two token lists over the same bytes."""
    a_sizes, b_sizes, base = v.a_sizes, v.b_sizes, len(v.b_bytes)
    a_names, b_names = [v.a_names[x] for x in a], [v.b_names[x] for x in b]
    groups, links = [], []
    i = j = first_a = first_b = 0
    start, ahead = a[0] * base, a_sizes[a[0]] - b_sizes[b[0]]  # ahead: bytes by which A's token ends behind B's
    while True:
        links.append(start + b[j])
        if ahead == 0:
            i, j = i + 1, j + 1
            groups.append(",".join(a_names[first_a:i]) + "|" + ",".join(b_names[first_b:j]))
            if i == len(a):
                return groups, links
            first_a, first_b = i, j
            start = a[i] * base
            ahead = a_sizes[a[i]] - b_sizes[b[j]]
        elif ahead < 0:
            i += 1
            start = a[i] * base
            ahead += a_sizes[a[i]]
        else:
            j += 1
            ahead -= b_sizes[b[j]]


class _Grown:
    """A numpy array that grows at its end."""

    def __init__(self):
        self.data, self.n = np.zeros(1 << 12, np.int64), 0

    def extend(self, values) -> None:
        k = len(values)
        while self.n + k > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.data[self.n : self.n + k] = values
        self.n += k

    @property
    def now(self) -> np.ndarray:
        return self.data[: self.n]


class Aligner:
    """Alignments of texts, word by word."""

    def __init__(self, vocabularies: Vocabularies):
        self.v, self.base = vocabularies, len(vocabularies.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.known, self.groups = {}, []  # number of a segment; its groups as text, None if its bytes differ
        self.sizes, self.codes, self.first = _Grown(), _Grown(), _Grown()  # tokens of A, of B and groups by threes; codes of links; where a segment's begin
        self.first.extend([0])

    def cut(self, text: str) -> list[str]:
        whole = " " + text
        return [whole] if _OTHER_SPACE.search(text) else self.v.segments.findall(whole)

    def learn(self, segments: list[str]) -> None:
        """Aligns new segments; each gets the next number."""
        v, sizes, codes, ends = self.v, [], [], []
        at = self.codes.n
        for segment, (a, b) in zip(segments, v.encode(segments)):
            own = segment.encode()
            if b"".join([v.a_bytes[x] for x in a]) != own or b"".join([v.b_bytes[x] for x in b]) != own:
                self.groups.append(None)
                sizes += (0, 0, 0)
            else:
                groups, links = aligned(a, b, v)
                self.groups.append(";".join(groups))
                sizes += (len(a), len(b), len(groups))
                codes += links
            ends.append(at + len(codes))
        self.sizes.extend(sizes)
        self.codes.extend(codes)
        self.first.extend(ends)

    def __call__(self, texts: list[str | None]):
        """(sizes by document: n_a, n_b, n_groups; hashes of groups; documents, codes and numbers of their links)."""
        if len(self.groups) > KEEP or self.codes.n > KEEP_LINKS:
            self.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = list({s for own in cut for s in own} - self.known.keys())
        if fresh:
            n = len(self.groups)
            self.learn(fresh)
            self.known.update(zip(fresh, range(n, n + len(fresh))))
        known, groups = self.known, self.groups
        numbers, hashes, lengths = [], [], []
        for own in cut:
            mine = [known[s] for s in own]
            parts = [groups[k] for k in mine]
            if None in parts:
                mine = parts = []
            hashes.append(hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "")
            numbers += mine
            lengths.append(len(mine))
        for s in [s for s in fresh if len(s) > 60]:
            del known[s]  # seldom met again
        docs, segments = np.repeat(np.arange(len(texts)), lengths), np.array(numbers, np.int64)
        sums = np.zeros((len(texts), 3), np.int64)
        np.add.at(sums, docs, self.sizes.now.reshape(-1, 3)[segments])
        # each document's segments once, with how often it has them; then their links likewise
        found, times = np.unique(docs * (len(groups) + 1) + segments, return_counts=True)
        docs, segments = found // (len(groups) + 1), found % (len(groups) + 1)
        first = self.first.now
        n = first[segments + 1] - first[segments]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[segments], n)
        codes, docs, times = self.codes.now[at], np.repeat(docs, n), np.repeat(times, n)
        span = self.base * len(self.v.a_bytes)
        keys, where = np.unique(docs * span + codes, return_inverse=True)
        return sums, hashes, keys // span, keys % span, np.bincount(where, times, len(keys)).astype(np.int64)


# --- what documents keep of their links -----------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers under 2^32, compressed byte by byte."""
    flat = np.concatenate([np.array([len(x) for x in arrays]), *arrays]).astype("<u4")
    raw = flat.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)
    flat = np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.split(flat[n:], np.cumsum(flat[:n])[:-1])


def steps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=0)


DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
ROWS = f"kind int, block long, {DOC}, groups_sha256 string, held binary, codes array<long>, docs array<long>"
#: Kinds of rows: documents; a block's irregular pairs; a task's identity links by A id.
DOCUMENT, PAIRS, IDENTITY = range(3)


class _Block:
    """Documents until their irregular pairs are many."""

    def __init__(self):
        self.docs, self.links, self.size = [], [], 0

    def rows(self, number: int):
        """Rows of the block's pairs, and of its documents with their links' places among them."""
        codes, where, counts = np.unique(np.concatenate([x[0] for x in self.links]), return_inverse=True, return_counts=True)
        at = 0
        held = []
        for own, times, ids, id_times in self.links:
            held.append(packed(steps(where[at : at + len(own)]), times, steps(ids), id_times))
            at += len(own)
        for k in range(0, len(codes), 1 << 14):
            yield {"kind": [PAIRS], "block": [number], "codes": [codes[k : k + (1 << 14)]], "docs": [counts[k : k + (1 << 14)]]}
        for k in range(0, len(self.docs), 500):
            part = self.docs[k : k + 500]
            columns = {name: [d[i] for d in part] for i, name in enumerate(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"))}
            yield {"kind": [DOCUMENT] * len(part), "block": [number] * len(part), **columns, "held": held[k : k + 500]}


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def alignments(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """ROWS of all kinds."""
    long_ = pa.int64()
    schema = pa.schema([("kind", pa.int32()), ("block", long_), *((c.split()[0], long_) for c in DOC.split(", ")), ("groups_sha256", pa.string()), ("held", pa.binary()), ("codes", pa.list_(long_)), ("docs", pa.list_(long_))])

    def run(batches):
        v = Vocabularies(a_path, b_path)
        align, vector, now, number = Aligner(v), np.zeros(len(v.a_bytes), np.int64), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sums, hashes, own, codes, times = align(texts)
            regular = v.same[codes // align.base] == codes % align.base
            np.add.at(vector, codes[regular] // align.base, 1)
            ends = [np.concatenate(([0], np.cumsum(np.bincount(own[s], minlength=len(ids))))) for s in (~regular, regular)]
            codes_, times_, ids_, id_times = codes[~regular], times[~regular], codes[regular] // align.base, times[regular]
            for k, doc in enumerate(ids):
                (a, b), (c, d) = (e[k : k + 2] for e in ends)
                n_a, n_b, n_groups = sums[k].tolist()
                now.docs.append((doc, n_a, n_b, n_groups, n_a + n_b - n_groups, hashes[k]))
                now.links.append((codes_[a:b], times_[a:b], ids_[c:d], id_times[c:d]))
                now.size += int(b - a)
                if now.size >= block:
                    yield from (_batch(x, schema) for x in now.rows(number))
                    now, number = _Block(), number + 1
        if now.docs:
            yield from (_batch(x, schema) for x in now.rows(number))
        used = np.flatnonzero(vector)
        yield _batch({"kind": [IDENTITY], "codes": [used], "docs": [vector[used]]}, schema)

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, ROWS)


def align(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per document."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "alignment")
    rows = shelf.put(alignments(docs, a_path, b_path, block), "rows")
    v = Vocabularies(a_path, b_path)
    base, n = len(v.b_bytes), len(v.a_bytes)
    each = lambda kind: rows.where(F.col("kind") == kind).select("block", F.explode(F.arrays_zip("codes", "docs")).alias("x")).select("block", "x.codes", "x.docs")
    totals = each(PAIRS).select("block", F.col("codes").alias("code"), F.sum("docs").over(Window.partitionBy("codes")).alias("total"))
    totals = shelf.put(totals, "totals")
    # at most a row for each id of A's vocabulary
    counts, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in each(IDENTITY).groupBy("codes").agg(F.sum("docs").alias("n")).collect():
        counts[r["codes"]] = best[r["codes"]] = r["n"]
    for r in totals.groupBy(F.floor(F.col("code") / base).alias("a")).agg(F.max("total").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])
    vectors = spark.sparkContext.broadcast((counts, best))

    def judged(own: pa.Table, pairs: pa.Table) -> pa.Table:
        counts, best = vectors.value
        code, total = (pairs.column(c).to_numpy() for c in ("code", "total"))
        order = np.argsort(code)
        code, total = code[order], total[order]
        is_best = total == best[code // base]
        n_best, count_sum = [], []
        for held in own.column("held").to_pylist():
            at, times, ids, id_times = unpacked(held, 4)
            at, ids = np.cumsum(at), np.cumsum(ids)
            n_best.append(int(times[is_best[at]].sum() + id_times[counts[ids] == best[ids]].sum()))
            count_sum.append(int((times * total[at]).sum() + (id_times * counts[ids]).sum()))
        named = {c: own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(named | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": own.column("groups_sha256")})

    own = rows.where(F.col("kind") == DOCUMENT).select("block", *(c.split()[0] for c in DOC.split(", ")), "groups_sha256", "held")
    return own.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(judged, f"{DOC}, n_best long, count_sum long, groups_sha256 string")
