"""Batches that are stopped and run again, aggregators that merge states, draws that are exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.operators import aggregators, learning
from glasspane.plans import batches, pipeline
from glasspane.sources.pixels import pixels
from glasspane.streaming import arrivals

TEXT = "[pipeline]\nsteps = LightDarkModule.getIntensityThresholdPercent:a\n BasicModule.finalComputations\n[LightDarkModule.getIntensityThresholdPercent:a]\nname = bright\nupper_threshold = {}\n"


def seven(spark, sf):
    return pixels(spark, sf).where("slide_id < 7 and r < 8")


def test_a_stopped_run_goes_on(spark, sf, tmp_path, monkeypatch):
    px, seen, metrics = seven(spark, sf), [], pipeline.metrics

    def stopping(state):
        seen.append(1)
        if len(seen) == 3:
            raise KeyboardInterrupt
        return metrics(state)

    monkeypatch.setattr(pipeline, "metrics", stopping)
    with pytest.raises(KeyboardInterrupt):
        batches.run(px, TEXT.format(".5"), str(tmp_path / "out"), size=2)
    ledger = batches.Ledger(spark, str(tmp_path / "out"))
    assert len(ledger.batches()) == 2 and ledger.results().count() == 4
    (tmp_path / "out" / "batch=00000002" / "part").mkdir(parents=True)  # what a killed job leaves: no mark of success
    rows = batches.run(px, TEXT.format(".5"), str(tmp_path / "out"), size=2)
    assert len(ledger.batches()) == 4 and len(seen) == 5
    want = {r["slide_id"]: r["pixels_to_use"] for r in metrics(pipeline.folded(px, *pipeline.parsed(TEXT.format(".5")))).collect()}
    assert len(want) == 7 and {r["slide_id"]: r["pixels_to_use"] for r in rows.collect()} == want and rows.count() == 7
    # nothing is left to do, and with force all is done again, each slide once
    batches.run(px, TEXT.format(".5"), str(tmp_path / "out"), size=2)
    assert len(seen) == 5
    again = batches.run(px.where("slide_id < 3"), TEXT.format(".45"), str(tmp_path / "out"), size=2, force=True)
    got = {r["slide_id"]: r["pixels_to_use"] for r in again.collect()}
    assert again.count() == 7 and len(seen) == 7 and all(got[k] == want[k] for k in range(3, 7)) and any(got[k] != want[k] for k in range(3))


def test_slides_that_arrive(spark, sf, tmp_path):
    px = seven(spark, sf)
    work = lambda df: pipeline.metrics(pipeline.folded(df, *pipeline.parsed(TEXT.format(".5"))))
    ledger = batches.Ledger(spark, str(tmp_path / "out"))
    px.where("slide_id < 2").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    px.where("slide_id in (1, 2)").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = lambda: arrivals.arrivals(spark, str(tmp_path / "in" / "*"), px.schema, per_trigger=1)
    arrivals.processed_slides(stream(), work, ledger, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["slide_id"] for r in ledger.rows().collect()) == [0, 1, 2]
    # a batch that is handed over again is known by its number
    assert ledger.add(work, px, key="stream-0") is None
    arrivals.processed_slides(stream(), work, ledger, str(tmp_path / "other")).awaitTermination()
    assert ledger.rows().count() == 3


def test_states_merge(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 11 == 0 else f"g{k % 3}", None if k % 7 == 0 else float(rng.integers(1, 9)), str(k % 5) if k % 2 else "x") for k in range(500)] + [("void", None, "y")]
    df = spark.createDataFrame(rows, "g string, v double, t string").repartition(7)
    wanted = {"s": ("spread", "v"), "m": ("mode", "v"), "r": ("range", "t"), "l": ("geometric_mean", "v")}
    for most in (10_000, 1):
        got = {r["g"]: r for r in aggregators.aggregated(df, "g", wanted, most).collect()}
        assert set(got) == {None, "g0", "g1", "g2", "void"}
        assert all(got["void"][k] is None for k in wanted)
        for g in (None, "g0", "g1", "g2"):
            v = np.array([x for a, x, _ in rows if a == g and x is not None])
            t = [float(x) for a, _, x in rows if a == g and x.isdigit()]
            values, counts = np.unique(v, return_counts=True)
            assert got[g]["s"] == pytest.approx(v.var(ddof=1)) and got[g]["m"] == values[counts.argmax()] and got[g]["r"] == max(t) - min(t) and got[g]["l"] == pytest.approx(np.exp(np.log(v).mean()))


@pytest.mark.parametrize("few", [100_000, 3])
def test_draws_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(learning, "FEW", few)
    rows = [(k, "big" if k % 4 else None if k % 8 else "small") for k in range(900)] + [(1000, "one"), (1001, "one"), (1002, "single")]
    df = spark.createDataFrame(rows, "k long, g string").repartition(4)
    for share in (0.2, 0.5, 1.0, 0.0):
        counts = learning.drawn_share(df, "k", "g", share).where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("drawn").alias("m")).collect()
        assert len(counts) == 4 and all(r["m"] == int(r["n"] * share + 0.5) for r in counts)
    assert learning.drawn_share(df, "k", "g", 0.3).exceptAll(learning.drawn_share(df.repartition(2), "k", "g", 0.3)).count() == 0
