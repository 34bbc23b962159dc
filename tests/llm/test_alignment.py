"""Alignment of two tokenizers against a plain version that encodes whole texts and compares all byte ranges."""

import collections
import hashlib

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glasspane.llm import alignment, queries
from glasspane.llm.shared import byte_of_sign

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
SIGNS = byte_of_sign()


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    docs, counts = [], collections.Counter()
    for t in texts:
        groups, links = [], []
        if t:
            ends, ids = [], [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)]
            own = [[bytes(SIGNS[x] for x in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
            if all(b"".join(x) == (" " + t).encode() for x in own):
                for x in own:
                    at, mine = 0, []
                    for piece in x:
                        mine.append((at, at + len(piece)))
                        at += len(piece)
                    ends.append(mine)
                j = 0
                for i, (p, q) in enumerate(ends[0]):
                    while ends[1][j][1] <= p:
                        j += 1
                    k = j
                    while k < len(ends[1]) and ends[1][k][0] < q:
                        links.append((ids[0][i], ids[1][k]))
                        k += 1
                both = sorted({q for _, q in ends[0]} & {q for _, q in ends[1]})
                sides = []
                for side in (0, 1):
                    parts, k = [], 0
                    for end in both:
                        part = []
                        while k < len(ends[side]) and ends[side][k][1] <= end:
                            part.append(str(ids[side][k]))
                            k += 1
                        parts.append(",".join(part))
                    sides.append(parts)
                groups = [f"{x}|{y}" for x, y in zip(*sides)]
                docs.append((len(ids[0]), len(ids[1]), groups, links))
                counts.update(set(links))
                continue
        docs.append((0, 0, [], []))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for n_a, n_b, groups, links in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "\n", "  two  spaces \n\n and feeds\n", "a\nb\n\nc \n d", "line\r\nend\r {\r", "tab\there\xa0x", "▁ and ▁▁x", "<|endoftext|> <s> </s> <unk> <0x0A>", "naïve Ünï ß 日本語 тест 🙂🙂", "\x00 nul \x1c x\x85", "aaaaaaaaaa" * 40, "I'm 12345 don't x=1;;; '''", "word᠎ word​ w", "Haanth.\nReoush hewh", "trailing space ", " leading"]


def compared(got, texts, ids):
    want = collections.Counter(zip(ids, plain(texts)))
    assert collections.Counter((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in got) == want


def test_query_like_plain_alignment(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_alignment(spark, sf)
    assert got.columns == ["doc_id", *COLUMNS]
    compared(got.collect(), [r["text"] for r in rows], [r["doc_id"] for r in rows])


def test_odd_texts_in_small_blocks(spark):
    """Blocks of a few links: counts of one pair come from many blocks; ties, repeated rows, null ids, clashing columns."""
    texts = ODD * 2 + ["the thing of the other", "the thing of the other", "things of the others"] * 3
    ids = [None if k % 9 == 0 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("kind", "block", "codes", "docs", "n_a")}).repartition(3)
    compared(alignment.align(docs, A, B, block=20).collect(), texts, ids)
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_words_align_as_whole_texts():
    """With little memory for words, and again once they are known."""
    align = alignment.Aligner(alignment.Vocabularies(A, B))
    for _ in range(2):
        sums, hashes, *_ = align(ODD)
        assert [(*s, h) for s, h in zip(sums.tolist(), hashes)] == [(a, b, g, h) for a, b, g, _, _, _, h in plain(ODD)]
        align.clear()


def test_identity_map():
    v = alignment.Vocabularies(A, B)
    assert (v.same >= 0).sum() > 5000
    assert all(v.b_bytes[b] == v.a_bytes[a] for a, b in enumerate(v.same.tolist()) if b >= 0)
    assert not v.b.is_byte(int(v.same[v.a.token_to_id("e")]))
