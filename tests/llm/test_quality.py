"""The estimate against a made table of known accuracies, and rules that are outvoted."""

import collections

import numpy as np
from pyspark.sql import functions as F

from glasspane.llm import quality

RATES = [((0.02, 0.10), (0.70, 0.20)), ((0.10, 0.05), (0.60, 0.10)), ((0.05, 0.30), (0.50, 0.30)), ((0.20, 0.10), (0.20, 0.10)), ((0.01, 0.04), (0.35, 0.15))]


def made(n: int, share: float, seed: int):
    """Vote patterns of documents of which so many are good; each rule's chances of -1 and 0 on good and on bad ones are RATES."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    votes = []
    for on_good, on_bad in RATES:
        low, mid = np.where(good, on_good[0], on_bad[0]), np.where(good, sum(on_good), sum(on_bad))
        x = rng.random(n)
        votes.append(np.where(x < low, -1, np.where(x < mid, 0, 1)))
    return good, list(zip(*(v.tolist() for v in votes)))


def test_known_accuracies_are_recovered():
    for share, seed in ((0.9, 1), (0.7, 2)):
        truth, votes = made(60_000, share, seed)
        good, chances = quality.estimate(sorted(collections.Counter(votes).items()))
        assert abs(good - share) < 0.03
        for (on_good, on_bad), c in zip(RATES, chances):
            for g, (low, mid) in ((True, on_good), (False, on_bad)):
                assert np.allclose(c[g], (low, mid, 1 - low - mid), atol=0.04)
        right = np.mean([(quality.posterior(v, good, chances) >= 0.5) == t for v, t in zip(votes, truth)])
        assert right > 0.9
        # the fourth rule says the same of good and bad ones: its bad vote alone drops nothing
        assert quality.posterior((1, 1, 1, -1, 1), good, chances) > 0.9 > 0.1 > quality.posterior((-1, -1, -1, 1, -1), good, chances)


def test_swapped_start_ends_with_the_same_kinds():
    _, votes = made(20_000, 0.4, 3)
    good, chances = quality.estimate(sorted(collections.Counter(votes).items()))
    assert abs(good - 0.4) < 0.05 and sum(c[True][2] for c in chances) > sum(c[False][2] for c in chances)


def test_held_against_labels(spark):
    """Of the labelled documents past the base, nearly all good ones are kept and nearly all bad ones dropped; some kept ones have a bad vote."""
    sf = "/root/testdata/sf0.01"
    out = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed")
    voted = F.exists(F.array(*[f"vote_{k}" for k in quality.rules()]), lambda v: v < 0)
    rows = out.withColumn("voted", voted).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id", "left").collect()
    share = lambda own: np.mean([r["kept"] for r in own])
    assert share([r for r in rows if r["label"] == 1]) > 0.97 and share([r for r in rows if r["label"] == 0]) < 0.1
    assert any(r["kept"] and r["voted"] for r in rows)


def test_odd_rows(spark):
    prose = "the cat and the dog went to the park on a sunny day of the year with nothing to do but run. " * 1 + "they saw a bird in a tree by the lake."
    rows = [(1, None), (2, ""), (3, " \n "), (4, prose), (4, prose), (None, prose), (5, "a " * 40_000), (6, "x" * 300_000)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "m", "t", "quality", "vote_length", "kept")})).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_words"], r["base_failed"], r["kept"]))
    n = len(prose.split())
    assert by[1] == by[2] == by[3] == [(0, True, False)] and by[4] == [(n, False, True)] * 2 and by[None] == [(n, False, True)]
    assert by[5] == [(40_000, True, False)] and by[6] == [(1, True, False)]
