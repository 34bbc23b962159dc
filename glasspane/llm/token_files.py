"""Token ids as binary files: a concatenated id array with Elias-Fano coded document boundaries.

``write`` deals documents out by range of doc_id, encodes each whole text, appends the end id and lets a data
source of this module write them, so that the files in order hold all documents in ascending doc_id order.
``read`` is the same source's reader: a task a file, and a start that counts the ids of all documents before.

A file, little-endian: MAGIC; the ids, of two bytes each if the vocabulary allows it, else four; an Elias-Fano
list of the documents' ends in the id array; one of their doc_ids, less the smallest; the trailer (TRAILER).
No table of 64-bit offsets is kept: a reader selects the ends it needs. Files hold ``ids_per_file`` ids or one
longer document, so whatever the corpus, a task holds one batch and a few bits a document.

A file is written under a name of its own attempt; the manifest, written last, names those that count. A task
that is lost and repeated leaves at most a file that no manifest names. The folder must be one that pyarrow can
open on all executors (file, hdfs, s3, gs).

Null and empty texts have the end id alone. Repeated rows are documents each; of one doc_id, they stand in the
order of their texts' hashes. Rows with a null doc_id come first. An empty table gives a manifest without files
and no rows. Other columns are ignored. A doc_id that holds a large share of all rows is dealt out by its texts'
hashes and row numbers.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .elias_fano import EliasFano
from .shared import byte_of_sign, give_back, in_batches

MAGIC = b"GPTOKEN1"
#: Documents, those of them with a null doc_id (they come first), ids, bytes an id, smallest doc_id, bytes of the two lists.
TRAILER = "<QQQQqQQ8s"
MANIFEST = "_manifest.json"
IDS_PER_FILE = 1 << 26
FORMAT = "glasspane_tokens"

# --- encoding --------------------------------------------------------------------------------

#: How the tokenizer whose words are cut here splits lower-cased text.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-zß-öø-ÿ"
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: Signs, in Latin-1, of texts that are cut into words; others are cut at white space, or not at all if it is a special one.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
_WHOLE = re.compile(r"[^\S \n\t\r]|[\x1c-\x1f\x85]")


class LowerCaseEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, for tokenizers that drop white space.

    Words come back often, so the ids of up to ``keep`` words, and words with their stops, of 40 signs at most are
    kept. A word of a plain text goes straight to the tokenizer's model, anything else through all of the tokenizer.
    A tokenizer that splits texts in another way than the one above encodes each text whole.
    """

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        split, *more = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) or [{}]
        self.by_words = split.get("pattern", {}).get("Regex") == _WORD_SPLIT and split.get("invert") and split.get("behavior") == "Removed" and [x["type"] for x in more] == ["ByteLevel"]
        self.model, self.signs = self.tokenizer.model, {b: sign for sign, b in byte_of_sign().items()}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def kept(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 40:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Of a lower-cased plain word: its bytes as the model's signs, merged by the model."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
        return self.kept(word, np.array([x.id for x in self.model.tokenize(shown)], "<u4").tobytes())

    def plain(self, chunk: str) -> bytes:
        """Of signs without white space between: often one word, or a word and a stop."""
        words = _WORDS.findall(chunk)
        get = self.known.get
        ids = b"".join([get(w) or self.word(w) for w in words])
        return ids if len(words) == 1 else self.kept(chunk, ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words or "<|" in text:
            return self.whole(text)
        get = self.known.get
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join([get(c) or self.plain(c) for c in text.lower().split()])
        if _WHOLE.search(text):
            return self.whole(text)
        return b"".join([get(c) or self.kept(c, self.whole(c)) for c in text.split()])


# --- the data source -------------------------------------------------------------------------


def opened(folder: str):
    """(file system, path) of a folder's URI or plain path; s3a is s3 to pyarrow."""
    import pyarrow.fs

    if "://" not in folder and not folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), folder
    folder = re.sub(r"^s3a://", "s3://", folder)
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list


class _File:
    """One file in the making: ids go out as they come, a few bytes a document stay."""

    def __init__(self, fs, folder: str, width: int):
        self.name = f"ids-{uuid.uuid4().hex}.bin"
        self.out, self.kind = fs.open_output_stream(f"{folder}/{self.name}"), np.dtype(f"<u{width}")
        self.out.write(MAGIC)
        self.ends, self.docs, self.nulls, self.n = [], [], 0, 0

    def add(self, doc: int | None, ids: bytes) -> None:
        own = np.frombuffer(ids, "<u4")
        if len(own) and own.max() > np.iinfo(self.kind).max:
            raise ValueError("an id does not fit the width of the file")
        self.out.write(own.astype(self.kind).tobytes())
        self.n += len(own)
        self.ends.append(self.n)
        if doc is None:
            self.nulls += 1
        else:
            self.docs.append(doc)

    def close(self) -> dict:
        base = self.docs[0] if self.docs else 0
        ends = EliasFano.of(np.array(self.ends, np.uint64)).tobytes()
        docs = EliasFano.of(np.array([d - base for d in self.docs], np.uint64)).tobytes()
        self.out.write(ends)
        self.out.write(docs)
        self.out.write(struct.pack(TRAILER, len(self.ends), self.nulls, self.n, self.kind.itemsize, base, len(ends), len(docs), MAGIC))
        self.out.close()
        return {"name": self.name, "docs": len(self.ends), "ids": self.n, "first": self.docs[0] if self.docs else None, "last": self.docs[-1] if self.docs else None}


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.width, self.limit = options["path"], int(options.get("width", 4)), int(options.get("idsperfile", IDS_PER_FILE))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = opened(self.folder)
        fs.create_dir(folder, recursive=True)
        now, done = None, []
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids.as_py()
                if now and now.n + len(ids) // 4 > self.limit:
                    done.append(now.close())
                    now = None
                now = now or _File(fs, folder, self.width)
                now.add(doc, ids)
        if now:
            done.append(now.close())
        give_back()
        return Written(TaskContext.get().partitionId(), done)

    def commit(self, messages: list) -> None:
        """A line for each file: their number, not that of documents, bounds what the driver holds."""
        fs, folder = opened(self.folder)
        fs.create_dir(folder, recursive=True)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"width": self.width, "files": files}).encode())

    def abort(self, messages: list) -> None:
        fs, folder = opened(self.folder)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{folder}/{f['name']}")


class TokenFile:
    """Random access to one file: only the trailer, the lists and the ids asked for are read."""

    def __init__(self, fs, path: str):
        self.source = fs.open_input_file(path)
        size = self.source.size()
        self.n, self.nulls, self.n_ids, self.width, self.base, ends, docs, magic = struct.unpack(TRAILER, self.source.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        at = size - struct.calcsize(TRAILER) - docs - ends
        self.ends = EliasFano.frombytes(self.source.read_at(ends, at))
        self.docs = EliasFano.frombytes(self.source.read_at(docs, at + ends))

    def ids(self, first: int, end: int) -> np.ndarray:
        data = self.source.read_at((end - first) * self.width, len(MAGIC) + first * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def bounds(self, k: int) -> tuple[int, int]:
        return self.ends.select(k - 1) if k else 0, self.ends.select(k)

    def places(self, doc: int) -> range:
        """Which documents of the file have this doc_id."""
        a, b = (self.docs.search(max(0, doc - self.base + x)) for x in (0, 1))
        return range(self.nulls + a, self.nulls + b)


@dataclass
class OneFile(InputPartition):
    name: str
    before: int


class TokenReader(DataSourceReader):
    """Rows of each file; the option docIds leaves only files that can hold one of them, and selects in those."""

    STEP = 1 << 20

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.wanted = {int(x) for x in options["docids"].split(",") if x} if "docids" in options else None

    def partitions(self):
        fs, folder = opened(self.folder)
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        before, parts = 0, []
        for f in files:
            if self.wanted is None or f["first"] is not None and any(f["first"] <= d <= f["last"] for d in self.wanted):
                parts.append(OneFile(f["name"], before))
            before += f["ids"]
        return parts or [OneFile("", 0)]

    def read(self, part: OneFile):
        if not part.name:
            return
        fs, folder = opened(self.folder)
        file = TokenFile(fs, f"{folder}/{part.name}")
        if self.wanted is not None:
            for doc in sorted(self.wanted):
                for k in file.places(doc):
                    a, b = file.bounds(k)
                    yield self.rows([doc], part.before, np.array([a, b]), file)
            return
        ends = np.concatenate(([0], file.ends.values().astype(np.int64)))
        docs = [None] * file.nulls + (file.docs.values().astype(np.int64) + file.base).tolist()
        k = 0
        while k < file.n:
            most = max(k + 1, min(int(np.searchsorted(ends, ends[k] + self.STEP, side="right")) - 1, k + 4096))
            yield self.rows(docs[k:most], part.before, ends[k : most + 1], file)
            k = most

    @staticmethod
    def rows(docs: list, before: int, ends: np.ndarray, file: TokenFile) -> pa.RecordBatch:
        data = file.ids(int(ends[0]), int(ends[-1])).tobytes()
        offsets = ((ends - ends[0]) * 4).astype(np.int32)
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        columns = [pa.array(docs, pa.int64()), pa.array(before + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), ids]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """The data source: options path; docIds (comma-joined) for reading; width (bytes an id) and idsPerFile for writing."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)


# --- the operator ----------------------------------------------------------------------------


def encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, closed by the end id), in the order of the rows."""

    def run(batches):
        encoder, close = LowerCaseEncoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = pa.array([encoder(text) + close for text in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids binary")


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, ids_per_file: int = IDS_PER_FILE) -> None:
    """All documents, encoded, to files in a new folder, in ascending doc_id order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    width = 2 if max(end, Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else 4
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = own.withColumn("__tie", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    order = ["doc_id", "__tie", "__row"]
    dealt = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    encoded(dealt, tokenizer, end).write.format(FORMAT).mode("append").option("width", width).option("idsPerFile", ids_per_file).save(folder)


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit).

    With doc_ids, only files that can hold them are opened, and only their ids are read.
    """
    spark.dataSource.register(TokenFiles)
    reader = spark.read.format(FORMAT)
    return (reader if doc_ids is None else reader.option("docIds", ",".join(map(str, doc_ids)))).load(folder)
