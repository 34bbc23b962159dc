"""Texture over patches that lie across bands of rows and over the slide's edge."""

import numpy as np
import pandas as pd
import pytest

from glasspane.operators import stats


def test_patches_are_no_rows(spark):
    rng = np.random.default_rng(2)
    r, c = (x.ravel() for x in np.mgrid[0:150, 0:70])
    value = rng.integers(0, 256, r.size)
    px = pd.DataFrame({"slide_id": 1, "r": r, "c": c, "red": value, "green": value, "blue": value})[rng.random(r.size) > 0.1]
    corners = [(1, 0, 40, 10), (1, 1, 120, 50), (1, 2, 0, 0)]
    made = stats.texture(spark.createDataFrame(px), spark.createDataFrame(corners, "slide_id long, patch long, r0 int, c0 int"))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()  # each pixel once, not once for each patch that it is in
    shade = {(a, b): int(np.ceil(round(v / 255 * 7, 9))) for a, b, v in zip(px["r"], px["c"], px["red"])}
    contrast = []
    for _, _, r0, c0 in corners:
        pairs = [shade[a, b] - shade[a, b + 5] for a in range(r0, r0 + 32) for b in range(c0, c0 + 27) if (a, b) in shade and (a, b + 5) in shade]
        contrast.append(np.mean(np.square(pairs)))
    got = made.first()
    assert got["contrast"] == pytest.approx(np.mean(contrast)) and got["contrast_std"] == pytest.approx(np.std(contrast))
