"""The pipeline against a plain version of each stage, applied to what the stage before kept; odd rows stage by stage."""

import collections
import math
import re

from pyspark.sql import functions as F

import corpus_pipeline
from glasspane.llm import lines, packing, toxicity
from glasspane.llm.queries import tokenizer_path
from glasspane.llm.shared import Shelf

from test_lines import UP, plain_tree
from test_models import plain_places
from test_operators import components, shingles


def plain_lines(texts: dict[int, str]) -> dict[int, str]:
    """Lines by the plain tree, then the passages of 50 words in what they leave, then documents of shreds."""
    lined = plain_tree(texts)
    words, stays, starts = {}, {}, collections.defaultdict(list)
    for d, t in texts.items():
        left = collections.Counter(lined.get(d, "").split("\n"))
        words[d], stays[d] = [], []
        for raw in t.split("\n"):
            own = raw.translate(UP).split()
            keep = left[raw] > 0
            left[raw] -= keep
            words[d] += own
            stays[d] += [keep] * len(own)
        for k in range(len(words[d]) - 49):
            run = tuple(words[d][k : k + 50])
            if len(set(run)) >= 20 and any(stays[d][k : k + 50]):
                starts[run].append((d, k))
    for found in starts.values():
        first = min(d for d, _ in found)
        for d, k in found:
            if d != first:
                stays[d][k : k + 50] = [False] * 50
    out = {}
    for d, t in texts.items():
        if len(stays[d]) and (not any(stays[d]) or sum(stays[d]) < 0.2 * len(stays[d])):
            continue
        out[d] = [w for w, s in zip(words[d], stays[d]) if s]
    return out


def test_like_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, shelf = docs.columns, Shelf(spark, "test")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    after = lambda name, df: shelf.put(stages[name](spark, df, sf), name.replace(" ", "-"))
    held = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    c = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(c.places.tolist(), c.weights.tolist()))
    calm = {d: t for d, t in texts.items() if 1 / (1 + math.exp(-(c.intercept + sum(weight.get(p, 0.0) for p in plain_places(t))))) < toxicity.REJECT_FROM}
    one = after("toxicity", docs)
    assert held(one) == calm and one.columns == columns

    two = after("line dedup", one)
    got, want = held(two), plain_lines(calm)
    assert {d: t.translate(UP).split() for d, t in got.items()} == want and two.columns == columns

    three = after("near duplicates", two)
    roots = components({d: shingles(t, 5) for d, t in got.items()})
    unique = {d: t for d, t in got.items() if roots[d] == d}
    assert held(three) == unique and three.columns == columns

    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = re.findall(r"\S+", r["text"].lower())
        grams |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    leaks = lambda t: any(tuple(w[k : k + 10]) in grams for w in [re.findall(r"\S+", t.lower())] for k in range(len(w) - 9))
    four = after("decontamination", three)
    clean = {d: t for d, t in unique.items() if not leaks(t)}
    assert held(four) == clean and four.columns == columns

    encoder = packing.Encoder(tokenizer_path())
    packed = stages["packing"](spark, four, sf).collect()
    sizes = collections.Counter()
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {d: len(encoder(t)) // 4 + 1 for d, t in clean.items()}
    whole = collections.Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        whole[r["doc_id"]] += r["length"]
    assert whole == sizes


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "where is the old house with the red door and the seven windows on the hill"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    own = "a few plain words of a text that says nothing much at all to anyone"
    leak = "so: where is the old house with the red door and the seven windows on the hill"
    rows = [(None, own), (None, leak), (1, None), (2, ""), (3, " \n"), (4, own), (4, own), (5, f"{own} here"), (6, leak), (7, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("drop", "key", "score", "node", "hash", "__x")})
    want = {"toxicity": rows, "line dedup": rows, "near duplicates": [r for r in rows if r[0] != 5], "decontamination": [r for r in rows if r[0] != 6]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want[name], key=str), name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    encoder, sizes = packing.Encoder(tokenizer_path()), collections.Counter()
    for r in pieces:
        sizes[r["doc_id"]] += r["length"]
    want_sizes = collections.Counter()
    for d, t in rows:
        want_sizes[d] += len(encoder(t or "")) // 4 + 1
    assert sizes == want_sizes


def test_all_words_of_lines(spark):
    """Ties: of equal documents the smallest doc_id stays, in whatever order they come."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(9, text), (3, text), (7, text), (3, text)]
    for some in (rows, rows[::-1]):
        got = lines.dedup(spark.createDataFrame(some, "doc_id long, text string"), passages=True, least_left=0.2).collect()
        assert [(r["doc_id"], r["text"]) for r in got] == [(3, text)] * 2
