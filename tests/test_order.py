"""Sums of doubles in the order of the SQL, to the last bit."""

import duckdb
import numpy as np
import pandas as pd

from glasspane.functions.colour import gray
from glasspane.operators import neighbourhood
from glasspane.queries.pixel_masks import LAP


def test_laplacian_adds_as_its_sql(spark):
    rng = np.random.default_rng(3)
    r, c = (x.ravel() for x in np.mgrid[0:24, 0:24])
    px = pd.DataFrame({"slide_id": 1, "r": r, "c": c, **{k: rng.integers(90, 165, r.size) for k in ("red", "green", "blue")}})
    got = neighbourhood.laplacian(spark.createDataFrame(px).withColumn("v", gray()), "v", "q").select("r", "c", "q").toPandas()
    want = duckdb.connect().register("px", px).sql(f"WITH {LAP} SELECT r, c, q FROM l").df()
    both = got.merge(want, on=["r", "c"])
    assert len(both) == r.size and (both["q_x"] == both["q_y"]).all()
