"""Token files: exact round trips of the lists, the encoder and the files."""

import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glasspane.llm import queries, token_files
from glasspane.llm.elias_fano import SAMPLE, EliasFano

WORDS = queries.tokenizer_path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20), max_size=700), st.integers(0, 43))
def test_lists_give_back_their_numbers(steps, shift):
    numbers = np.cumsum(np.array([s << shift if shift < 30 else s for s in steps], np.uint64), dtype=np.uint64)
    own = EliasFano.frombytes(EliasFano.of(numbers).tobytes())
    assert own.values().tolist() == numbers.tolist()
    assert [own.select(i) for i in range(len(numbers))] == numbers.tolist()
    for x in [0, 1, *numbers[:5].tolist(), *(numbers[-3:] + np.uint64(1)).tolist()]:
        assert own.search(x) == int(np.searchsorted(numbers, np.uint64(x)))


def test_lists_are_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    size = len(EliasFano.of(ends).tobytes())
    assert size * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 32 / SAMPLE + 0.2
    with pytest.raises(IndexError):
        EliasFano.of(ends).select(len(ends))
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


ODD = [None, "", " \n", "It's 10 o'clock; I'M here", "ÀÉ straße Ünïcode", "a\x1cb \x85 c\xa0d", "x" * 300 + " y", "<|endoftext|> q<|startoftext|>", "тест Ωσς 日本語 café e\u0301", "İstanbul ǅ ſ", "0 00 a0b 0", "''s 'S 've...!!?", "½²³ 4ª", "\u200b\ufeff\u180e w", "tab\tand\rreturn"]


def test_words_encode_as_whole_texts(spark, sf):
    tokenizer, encoder = Tokenizer.from_file(WORDS), token_files.LowerCaseEncoder(WORDS, keep=3000)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert encoder.by_words
    for t in texts + ODD:
        assert np.frombuffer(encoder(t), "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def plain(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) rows in ascending order."""
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query_like_plain_encoding(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op13_tokens(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_odd_rows_and_small_files(spark, tmp_path):
    rows = [(k - 7, t) for k, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "again"), (3, "again"), (2**62, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "start", "__tie", "__row")}).repartition(3)
    folder = f"file://{tmp_path}/files"
    token_files.write(docs, folder, WORDS, end=2, ids_per_file=50)
    got = token_files.read(spark, folder).collect()
    # of one doc_id the order is that of the texts' hashes: ids and starts are compared apart
    want = list(plain(rows))
    key = lambda rows: sorted(rows, key=str)
    assert key([(r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got]) == key([(d, n, c) for d, _, n, c in want])
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == [None] * ids.count(None) + sorted(x for x in ids if x is not None)
    with open(tmp_path / "files" / token_files.MANIFEST) as f:
        manifest = json.load(f)
    assert manifest["width"] == 2 and len(manifest["files"]) > 3 and sum(f["docs"] for f in manifest["files"]) == len(rows)
    data = (tmp_path / "files" / manifest["files"][0]["name"]).read_bytes()
    assert data[:8] == token_files.MAGIC == data[-8:] and struct.unpack_from("<Q", data, len(data) - struct.calcsize(token_files.TRAILER))[0] == manifest["files"][0]["docs"]


def test_one_document_is_selected(spark, tmp_path):
    rows = [(k * 5, f"text number {k}") for k in range(400)]
    folder = f"file://{tmp_path}/files"
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, WORDS, end=2, ids_per_file=300)
    want = {d: (s, n) for d, s, n, _ in plain(rows)}
    for doc in (0, 5, 1000, 1995):
        some = token_files.read(spark, folder, [doc])
        assert [(r["start"], r["n_tokens"]) for r in some.collect()] == [want[doc]]
        assert some.rdd.getNumPartitions() == 1
    assert token_files.read(spark, folder, [7]).collect() == token_files.read(spark, folder, []).collect() == []
    assert {r["doc_id"] for r in token_files.read(spark, folder, [10, 500, 11]).collect()} == {10, 500}


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), folder, WORDS, end=2)
    assert token_files.read(spark, folder).collect() == []
