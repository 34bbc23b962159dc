"""Masks, thresholds, neighbourhoods and components of the pixel fixture."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.colour import gray, gray8
from ..operators import masks, neighbourhood, raster
from ..plans.pipeline import isolated
from ..sources.pixels import pixels
from .registry import GRAY, NINE, PX, query, r6, rounded

LOW, HIGH, SPREAD = 0.47, 0.53, 20.0
DENSE, SPARSE = 122, 119


@query(
    "intensity_threshold",
    f"""WITH {PX}, m AS (SELECT slide_id, {GRAY} > {LOW}::DOUBLE AND {GRAY} < {HIGH}::DOUBLE AND {NINE} < {9 * SPREAD * SPREAD}::DOUBLE AS k FROM px)
SELECT slide_id, count(*) AS total, count(*) FILTER (k) AS kept, {r6("1 - count(*) FILTER (k) / count(*)")} AS removed, {r6("count(*) FILTER (k) / count(*)")} AS remaining FROM m GROUP BY slide_id""",
)
def intensity_threshold(spark, d):
    df = pixels(spark, d).withColumn("k", masks.intensity(LOW, HIGH, upper_std=SPREAD))
    n = df.groupBy("slide_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("k").alias("kept"))
    mode = lambda m: masks.statistic(m, F.col("total"), F.col("kept"), F.col("total"))
    return rounded(n.select("slide_id", "total", "kept", mode("relative2mask").alias("removed"), mode("relative2image").alias("remaining")))


@query(
    "mask_stat_modes",
    f"""WITH {PX}, m AS (SELECT slide_id, count(*) AS t, count(*) FILTER (red < 110) AS a, count(*) FILTER (red < 130) AS b, count(*) FILTER (red > 300) AS e FROM px GROUP BY slide_id)
SELECT slide_id, {r6("1 - a / t")} AS first_removed, {r6("CASE WHEN a = 0 THEN -100.0 ELSE 1 - b / a END")} AS grown_removed, {r6("CASE WHEN e = 0 THEN -100.0 ELSE 1 - a / e END")} AS of_nothing, {r6("b / t")} AS remaining, b::DOUBLE AS pixels FROM m""",
)
def mask_stat_modes(spark, d):
    n = pixels(spark, d).groupBy("slide_id").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("red") < 110).alias("a"), F.count_if(F.col("red") < 130).alias("b"), F.count_if(F.col("red") > 300).alias("e"))
    c = F.col
    s = masks.statistic
    return rounded(n.select("slide_id", s("relative2mask", c("t"), c("a"), c("t")).alias("first_removed"), s("relative2mask", c("a"), c("b"), c("t")).alias("grown_removed"), s("relative2mask", c("e"), c("a"), c("t")).alias("of_nothing"), s("relative2image", c("a"), c("b"), c("t")).alias("remaining"), s("absolute", c("a"), c("b"), c("t")).alias("pixels")))


@query(
    "mask_algebra",
    f"""WITH {PX}, m AS (SELECT slide_id, red > 120 AS a, green > 125 AS b, blue > 140 AS f FROM px)
SELECT slide_id, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS without, count(*) FILTER (NOT a) AS complement, count(*) FILTER (b AND NOT a) AS added, count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND NOT b AND NOT f) AS final FROM m GROUP BY slide_id""",
)
def mask_algebra(spark, d):
    df = pixels(spark, d).select("slide_id", (F.col("red") > 120).alias("a"), (F.col("green") > 125).alias("b"), (F.col("blue") > 140).alias("f"))
    a, b = F.col("a"), F.col("b")
    n = F.count_if
    return df.groupBy("slide_id").agg(n(a & b).alias("both"), n(a & ~b).alias("without"), n(~a).alias("complement"), n(b & ~a).alias("added"), n(a | b).alias("either"), n(masks.forced_out(a, b, F.col("f"))).alias("final"))


OTSU = f"""g AS (SELECT *, {GRAY} AS v FROM px), e AS (SELECT slide_id, min(v) AS low, max(v) AS high FROM g GROUP BY slide_id),
b AS (SELECT g.slide_id, low, high, least(255, floor((v - low) / (CASE WHEN high > low THEN high - low ELSE 1.0::DOUBLE END) * 256))::INT AS bin, count(*) AS n FROM g JOIN e USING (slide_id) GROUP BY ALL),
f AS (SELECT e.slide_id, k::INT AS bin, e.low + (k + 0.5::DOUBLE) * (e.high - e.low) / 256 AS centre, coalesce(b.n, 0) AS n FROM e CROSS JOIN range(256) t(k) LEFT JOIN b ON b.slide_id = e.slide_id AND b.bin = k),
w AS (SELECT *, sum(n) OVER (PARTITION BY slide_id ORDER BY bin)::DOUBLE AS w1, sum(n * centre) OVER (PARTITION BY slide_id ORDER BY bin) AS s1, sum(n) OVER (PARTITION BY slide_id)::DOUBLE AS w, sum(n * centre) OVER (PARTITION BY slide_id) AS s FROM f),
x AS (SELECT *, coalesce(round(w1 * (w - w1) * (s1 / nullif(w1, 0) - (s - s1) / nullif(w - w1, 0)) * (s1 / nullif(w1, 0) - (s - s1) / nullif(w - w1, 0)), 4), -1.0) AS q FROM w),
level AS (SELECT slide_id, centre AS threshold FROM x QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY q DESC, bin) = 1)"""


@query("otsu_threshold", f"WITH {PX}, {OTSU} SELECT g.slide_id, {r6('any_value(threshold)')} AS threshold, count(*) FILTER (v < threshold) AS kept FROM g JOIN level USING (slide_id) GROUP BY g.slide_id")
def otsu_threshold(spark, d):
    return rounded(masks.otsu(pixels(spark, d)).groupBy("slide_id").agg(F.first("threshold").alias("threshold"), F.count_if("mask").alias("kept")))


def _lloyd() -> str:
    near = "CASE WHEN abs(v - k0) <= abs(v - k1) AND abs(v - k0) <= abs(v - k2) THEN 0 WHEN abs(v - k1) <= abs(v - k2) THEN 1 ELSE 2 END"
    sql = f"WITH {PX}, g AS (SELECT slide_id, {GRAY} AS v, count(*) AS n FROM px GROUP BY ALL), c0 AS (SELECT DISTINCT slide_id, 0.25::DOUBLE AS k0, 0.5::DOUBLE AS k1, 0.75::DOUBLE AS k2 FROM g)"
    for i in range(5):
        new = ", ".join(f"coalesce(round(sum(v * n) FILTER (j = {j}) / sum(n) FILTER (j = {j}), 9), any_value(k{j})) AS k{j}" for j in range(3))
        sql += f", c{i + 1} AS (SELECT slide_id, {new} FROM (SELECT g.*, k0, k1, k2, {near} AS j FROM g JOIN c{i} USING (slide_id)) GROUP BY slide_id)"
    return sql + f" SELECT slide_id, {r6('min(v) FILTER (j = 2)')} AS level, sum(n) FILTER (j = 2)::BIGINT AS bright FROM (SELECT g.*, {near} AS j FROM g JOIN c5 USING (slide_id)) GROUP BY slide_id"


@query("bright_cluster", _lloyd())
def bright_cluster(spark, d):
    df = pixels(spark, d)
    return rounded(df.join(masks.bright_cluster_level(df), "slide_id").groupBy("slide_id").agg(F.first("level").alias("level"), F.count_if(gray() >= F.col("level")).alias("bright")))


G8 = f"floor({GRAY} * 255)::INT"


@query(
    "neighbourhood_min",
    f"""WITH {PX}, g AS (SELECT slide_id, r, c, {G8} AS v FROM px), m AS (SELECT a.slide_id, a.r, a.c, min(b.v) AS low FROM g a JOIN g b ON a.slide_id = b.slide_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY ALL)
SELECT slide_id, count(*) FILTER (low > 110) AS bright, count(*) FILTER (NOT low > 110) AS kept, sum(low)::BIGINT AS total FROM m GROUP BY slide_id""",
)
def neighbourhood_min(spark, d):
    df = neighbourhood.extreme(neighbourhood.by_slide(pixels(spark, d)).withColumn("v", gray8()), "v", 3, "min", "low")
    return df.groupBy("slide_id").agg(F.count_if(F.col("low") > 110).alias("bright"), F.count_if(~(F.col("low") > 110)).alias("kept"), F.sum("low").alias("total"))


def disk_offsets(radius: int) -> str:
    from ..functions.kernels import disk

    return "(VALUES " + ", ".join(f"({a}, {b})" for a, b in disk(radius)) + ") o(dr, dc)"


@query(
    "neighbourhood_min_disk",
    f"""WITH {PX}, g AS (SELECT slide_id, r, c, {G8} AS v FROM px), m AS (SELECT a.slide_id, a.r, a.c, min(b.v) AS low FROM g a CROSS JOIN {disk_offsets(2)} JOIN g b ON a.slide_id = b.slide_id AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL)
SELECT slide_id, count(*) FILTER (low > 105) AS bright, sum(low)::BIGINT AS total FROM m GROUP BY slide_id""",
)
def neighbourhood_min_disk(spark, d):
    from ..functions import kernels

    df = raster.per_slide(pixels(spark, d).withColumn("v", gray8()), lambda x: {"low": kernels.lowest(kernels_masked(x), kernels.disk(2))}, ["v"], {"low": "int"})
    return df.groupBy("slide_id").agg(F.count_if(F.col("low") > 105).alias("bright"), F.sum("low").alias("total"))


def kernels_masked(x):
    import numpy as np

    return np.where(x["present"], x["v"], x["v"].max())


@query(
    "equalize",
    f"""WITH {PX}, g AS (SELECT slide_id, {G8} AS v FROM px), e AS (SELECT slide_id, v, cume_dist() OVER (PARTITION BY slide_id ORDER BY v) AS q FROM g)
SELECT slide_id, v AS gray8, {r6("any_value(q)")} AS equalised, count(*) AS n FROM e GROUP BY slide_id, v""",
)
def equalize(spark, d):
    df = masks.equalised(pixels(spark, d)).withColumn("gray8", gray8())
    return rounded(df.groupBy("slide_id", "gray8").agg(F.first("equalised").alias("equalised"), F.count(F.lit(1)).alias("n")))


def box(side: int) -> str:
    back, ahead = side // 2, side - 1 - side // 2
    return f"""g AS (SELECT slide_id, r, c, {GRAY} AS v FROM px), m AS (SELECT a.slide_id, a.r, a.c, a.v, sum(b.v) / {side * side} AS mean FROM g a JOIN g b ON a.slide_id = b.slide_id
  AND b.r BETWEEN a.r - {back} AND a.r + {ahead} AND b.c BETWEEN a.c - {back} AND a.c + {ahead} GROUP BY ALL)"""


@query("smoothness", f"WITH {PX}, {box(4)} SELECT slide_id, count(*) FILTER (abs(mean - v) < 0.02::DOUBLE) AS flat, {r6('avg(mean)')} AS mean FROM m GROUP BY slide_id")
def smoothness(spark, d):
    df = neighbourhood.box_mean(neighbourhood.by_slide(pixels(spark, d)).withColumn("v", gray()), "v", 4, "mean")
    return rounded(df.groupBy("slide_id").agg(F.count_if(F.abs(F.col("mean") - F.col("v")) < 0.02).alias("flat"), F.avg("mean").alias("mean")))


LAP = f"""g AS (SELECT slide_id, r, c, {GRAY} AS v FROM px), l AS (SELECT slide_id, r, c, v, coalesce(lag(v) OVER x, v) + coalesce(lead(v) OVER x, v) + coalesce(lag(v) OVER y, v) + coalesce(lead(v) OVER y, v) - 4 * v AS q FROM g
  WINDOW x AS (PARTITION BY slide_id, r ORDER BY c), y AS (PARTITION BY slide_id, c ORDER BY r))"""


@query("laplacian_blur", f"WITH {PX}, {LAP} SELECT slide_id, {r6('sum(abs(q))')} AS sharpness, count(*) FILTER (abs(q) <= 0.1::DOUBLE) AS soft FROM l GROUP BY slide_id")
def laplacian_blur(spark, d):
    df = neighbourhood.laplacian(neighbourhood.by_slide(pixels(spark, d)).withColumn("v", gray()), "v", "q")
    return rounded(df.groupBy("slide_id").agg(F.sum(F.abs("q")).alias("sharpness"), F.count_if(F.abs("q") <= 0.1).alias("soft")))


def _gauss() -> str:
    from ..functions.kernels import gaussian_weights

    w = ", ".join(f"({k - 4}, {x!r}::DOUBLE)" for k, x in enumerate(gaussian_weights(1.0).tolist()))
    return f"""WITH {PX}, {LAP}, w(k, x) AS (VALUES {w}), a AS (SELECT *, abs(q) AS s FROM l), e AS (SELECT slide_id, max(r) AS h, max(c) AS w FROM px GROUP BY slide_id),
one AS (SELECT a.slide_id, a.r, a.c, sum(x * b.s) AS s FROM a JOIN e USING (slide_id) CROSS JOIN w JOIN a b ON b.slide_id = a.slide_id AND b.c = a.c AND b.r = least(greatest(a.r + k, 0), h) GROUP BY ALL),
two AS (SELECT a.slide_id, a.r, a.c, sum(x * b.s) AS s FROM one a JOIN e USING (slide_id) CROSS JOIN w JOIN one b ON b.slide_id = a.slide_id AND b.r = a.r AND b.c = least(greatest(a.c + k, 0), e.w) GROUP BY ALL)
SELECT slide_id, {r6("avg(s)")} AS mean_sharpness, count(*) FILTER (s <= 0.085::DOUBLE) AS blurry FROM two GROUP BY slide_id"""


@query("gaussian_blur", _gauss())
def gaussian_blur(spark, d):
    df = neighbourhood.laplacian(neighbourhood.by_slide(pixels(spark, d)).withColumn("v", gray()), "v", "q").withColumn("q", F.abs("q"))
    return rounded(raster.blurred(df, "q", 1.0, "s").groupBy("slide_id").agg(F.avg("s").alias("mean_sharpness"), F.count_if(F.col("s") <= 0.085).alias("blurry")))


@query(
    "dilate_square",
    f"""WITH {PX}, m AS (SELECT a.slide_id, a.r, a.c, bool_or(b.red > 150) AS k FROM px a JOIN px b ON a.slide_id = b.slide_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY ALL)
SELECT slide_id, count(*) FILTER (k) AS dilated FROM m GROUP BY slide_id""",
)
def dilate_square(spark, d):
    df = neighbourhood.dilate_square(neighbourhood.by_slide(pixels(spark, d)).withColumn("m", F.col("red") > 150), "m", 3, "k")
    return df.groupBy("slide_id").agg(F.count_if("k").alias("dilated"))


@query(
    "open_disk",
    f"""WITH {PX}, m AS (SELECT slide_id, r, c, red > {DENSE - 12} AS k FROM px), e AS (SELECT a.slide_id, a.r, a.c, bool_and(coalesce(b.k, true)) AS k FROM m a CROSS JOIN {disk_offsets(1)} LEFT JOIN m b ON b.slide_id = a.slide_id AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL),
f AS (SELECT a.slide_id, a.r, a.c, bool_or(b.k) AS k FROM e a CROSS JOIN {disk_offsets(1)} JOIN e b ON b.slide_id = a.slide_id AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL)
SELECT m.slide_id, count(*) FILTER (m.k) AS before, count(*) FILTER (f.k AND m.k) AS opened FROM m JOIN f USING (slide_id, r, c) GROUP BY m.slide_id""",
)
def open_disk(spark, d):
    df = raster.open_disk(pixels(spark, d).withColumn("m", F.col("red") > DENSE - 12), "m", 1, "k")
    return df.groupBy("slide_id").agg(F.count_if("m").alias("before"), F.count_if("k").alias("opened"))


def lab(name: str, source: str, connectivity: int) -> str:
    """A keyed recursion: each pixel of ``source`` (slide_id, r, c) ends with the least code of its component."""
    near = "abs(n.r - l.r) + abs(n.c - l.c) = 1" if connectivity == 4 else "abs(n.r - l.r) <= 1 AND abs(n.c - l.c) <= 1"
    return f"""{name}(slide_id, r, c, l) USING KEY (slide_id, r, c) AS (SELECT slide_id, r, c, (r::BIGINT * 2147483648 + c) FROM {source} UNION
  SELECT n.slide_id, n.r, n.c, min(l.l) FROM {name} l JOIN {source} n ON n.slide_id = l.slide_id AND n.r BETWEEN l.r - 1 AND l.r + 1 AND {near} JOIN recurring.{name} k ON k.slide_id = n.slide_id AND k.r = n.r AND k.c = n.c WHERE l.l < k.l GROUP BY ALL)"""


def _components(connectivity: int) -> str:
    return f"WITH RECURSIVE {PX}, s AS MATERIALIZED (SELECT slide_id, r, c FROM px WHERE red < {SPARSE}), {lab('lab', 's', connectivity)} SELECT slide_id, l AS label, count(*) AS area FROM lab GROUP BY ALL"


def _labelled(spark, d, connectivity: int):
    df = raster.label_components(pixels(spark, d).withColumn("m", F.col("red") < SPARSE), "m", connectivity)
    return df.where("label is not null").groupBy("slide_id", "label").agg(F.count(F.lit(1)).alias("area"))


@query("label_components_4", _components(4))
def label_components_4(spark, d):
    return _labelled(spark, d, 4)


@query("label_components_8", _components(8))
def label_components_8(spark, d):
    return _labelled(spark, d, 8)


SIZED = f"WITH RECURSIVE {PX}, s AS MATERIALIZED (SELECT slide_id, r, c FROM px WHERE red < {SPARSE}), {lab('lab', 's', 4)}, z AS (SELECT *, count(*) OVER (PARTITION BY slide_id, l) AS area FROM lab), n AS (SELECT slide_id FROM px GROUP BY slide_id)"


def _sized(condition: str) -> str:
    return f"{SIZED} SELECT n.slide_id, count(z.area) AS kept FROM n LEFT JOIN z ON z.slide_id = n.slide_id AND {condition} GROUP BY n.slide_id"


@query("remove_small", _sized("area >= 4"))
def remove_small(spark, d):
    return raster.remove_small(pixels(spark, d).withColumn("m", F.col("red") < SPARSE), "m", 4, "k").groupBy("slide_id").agg(F.count_if("k").alias("kept"))


@query("remove_large", _sized("area <= 20"))
def remove_large(spark, d):
    return raster.remove_large(pixels(spark, d).withColumn("m", F.col("red") < SPARSE), "m", 20, "k").groupBy("slide_id").agg(F.count_if("k").alias("kept"))


@query("fill_holes", f"{SIZED} SELECT px.slide_id, count(*) FILTER (z.area IS NULL OR z.area < 6) AS kept, count(*) FILTER (z.area < 6) AS filled FROM px LEFT JOIN z USING (slide_id, r, c) GROUP BY px.slide_id")
def fill_holes(spark, d):
    df = raster.fill_holes(pixels(spark, d).withColumn("m", F.col("red") >= SPARSE), "m", 6, "k")
    return df.groupBy("slide_id").agg(F.count_if("k").alias("kept"), F.count_if(F.col("k") & ~F.col("m")).alias("filled"))


@query(
    "fat_like",
    f"""{SIZED}, a AS MATERIALIZED (SELECT slide_id, r, c FROM z WHERE area < 14), {lab("lab2", "a", 4)}, b AS (SELECT *, count(*) OVER (PARTITION BY slide_id, l) AS area FROM lab2),
g AS MATERIALIZED (SELECT DISTINCT px.slide_id, px.r, px.c FROM px JOIN b ON b.slide_id = px.slide_id AND b.area >= 9 AND abs(b.r - px.r) <= 1 AND abs(b.c - px.c) <= 1), {lab("lab3", "g", 4)},
f AS (SELECT *, count(*) OVER (PARTITION BY slide_id, l) AS area FROM lab3)
SELECT n.slide_id, count(f.area) AS fat FROM n LEFT JOIN f ON f.slide_id = n.slide_id AND f.area > 30 GROUP BY n.slide_id""",
)
def fat_like(spark, d):
    df = raster.fat_like(pixels(spark, d).withColumn("m", F.col("red") >= SPARSE), "m", cell=14, kernel=3, keep=30, name="k")
    return df.groupBy("slide_id").agg(F.count_if("k").alias("fat"))


@query(
    "region_stats",
    f"""WITH RECURSIVE {PX}, s AS MATERIALIZED (SELECT slide_id, r, c FROM px WHERE red < {SPARSE - 8}), {lab("lab", "s", 8)}, z AS (SELECT slide_id, l, count(*) AS area FROM lab GROUP BY ALL), n AS (SELECT slide_id FROM px GROUP BY slide_id)
SELECT n.slide_id, count(z.area) AS num_regions, {r6("coalesce(avg(z.area), 0)")} AS mean_area, coalesce(max(z.area), 0)::BIGINT AS max_area, coalesce(min(z.area), 0)::BIGINT AS min_area FROM n LEFT JOIN z USING (slide_id) GROUP BY n.slide_id""",
)
def region_stats(spark, d):
    return rounded(raster.region_statistics(pixels(spark, d).withColumn("m", F.col("red") < SPARSE - 8), "m", 8))


@query(
    "tissue_pieces",
    f"WITH RECURSIVE {PX}, s AS MATERIALIZED (SELECT slide_id, r, c FROM px WHERE {GRAY} < 0.44::DOUBLE), {lab('lab', 's', 8)}, n AS (SELECT slide_id FROM px GROUP BY slide_id) SELECT n.slide_id, count(DISTINCT l) AS pieces FROM n LEFT JOIN lab USING (slide_id) GROUP BY n.slide_id",
)
def tissue_pieces(spark, d):
    df = raster.region_statistics(pixels(spark, d).withColumn("m", gray() < 0.44), "m", 8)
    return df.select("slide_id", F.col("num_regions").alias("pieces"))


_HALF = "SELECT slide_id, (r // 2)::INT AS r, (c // 2)::INT AS c, round_even(avg(red), 0)::INT AS red, round_even(avg(green), 0)::INT AS green, round_even(avg(blue), 0)::INT AS blue FROM"


def _pyramid(spark, d):
    from ..session import shared_folder
    from ..sources import pyramid

    folder = f"{shared_folder(spark)}/pyramid-{uuid.uuid4().hex}"
    pyramid.write(pixels(spark, d), folder, tile=16, levels=3)
    return folder


@query("pyramid_region", f"WITH {PX}, half AS ({_HALF} px GROUP BY ALL) SELECT slide_id::VARCHAR AS slide_id, r, c, red, green, blue FROM half WHERE r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 27")
def pyramid_region(spark, d):
    """A box of level 1 of a pyramid of all slides: no tile of other levels, and none beyond the box, is opened."""
    from ..sources import pyramid

    return pyramid.region(spark, _pyramid(spark, d), level=1, left=10, top=5, width=18, height=16).select("slide_id", "r", "c", "red", "green", "blue")


@query("pyramid_thumbnail", f"WITH {PX}, half AS ({_HALF} px GROUP BY ALL), quarter AS ({_HALF} half GROUP BY ALL), e AS ({_HALF} quarter GROUP BY ALL) SELECT slide_id::VARCHAR AS slide_id, r, c, red, green, blue FROM e")
def pyramid_thumbnail(spark, d):
    """An eighth of each slide, of the coarsest level that is fine enough."""
    from ..sources import pyramid

    return pyramid.thumbnail(spark, _pyramid(spark, d), factor=8, levels=3)


def _own_size() -> str:
    from ..functions.kernels import gaussian_weights

    w = ", ".join(f"({k - 4}, {x!r}::DOUBLE)" for k, x in enumerate(gaussian_weights(1.0).tolist()))
    return f"""WITH {PX}, half AS ({_HALF} px GROUP BY ALL), {LAP.replace("FROM px", "FROM half")}, w(k, x) AS (VALUES {w}), a AS (SELECT *, abs(q) AS s FROM l), e AS (SELECT slide_id, max(r) AS h, max(c) AS w FROM half GROUP BY slide_id),
one AS (SELECT a.slide_id, a.r, a.c, sum(x * b.s) AS s FROM a JOIN e USING (slide_id) CROSS JOIN w JOIN a b ON b.slide_id = a.slide_id AND b.c = a.c AND b.r = least(greatest(a.r + k, 0), h) GROUP BY ALL),
two AS (SELECT a.slide_id, a.r, a.c, sum(x * b.s) AS s FROM one a JOIN e USING (slide_id) CROSS JOIN w JOIN one b ON b.slide_id = a.slide_id AND b.r = a.r AND b.c = least(greatest(a.c + k, 0), e.w) GROUP BY ALL),
f AS (SELECT slide_id, max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY slide_id),
m AS (SELECT px.slide_id, coalesce(two.s <= 0.05::DOUBLE, false) AS blurry FROM px JOIN f USING (slide_id) JOIN e ON e.slide_id = px.slide_id
  LEFT JOIN two ON two.slide_id = px.slide_id AND two.r = floor((px.r + 0.5) * (e.h + 1) / f.h)::INT AND two.c = floor((px.c + 0.5) * (e.w + 1) / f.w)::INT)
SELECT slide_id, {r6("1 - count(*) FILTER (NOT blurry) / count(*)")} AS blurry_removed_percent, (count(*) FILTER (NOT blurry))::DOUBLE AS pixels_to_use FROM m GROUP BY slide_id"""


@query("blur_own_size", _own_size())
def blur_own_size(spark, d):
    """Blur found at half the working size, and taken off the mask at the working size."""
    from ..plans.pipeline import Step, folded, metrics
    from ..sources.pixels import decimated

    px = pixels(spark, d)
    steps = [Step("blur", None, {"image_work_size": "0.5", "blur_radius": "1", "blur_threshold": "0.05"}), Step("final")]
    return rounded(metrics(folded(px, steps, sizes={"0.5": decimated(px, 2)})).select("slide_id", "blurry_removed_percent", "pixels_to_use"))


@query("decimated_thumbnail", f"WITH {PX} SELECT slide_id, (r // 4)::INT AS r, (c // 4)::INT AS c, round_even(avg(red), 0)::INT AS red, round_even(avg(green), 0)::INT AS green, round_even(avg(blue), 0)::INT AS blue FROM px GROUP BY ALL")
def decimated_thumbnail(spark, d):
    from ..sources.pixels import decimated

    return decimated(pixels(spark, d), 4)


@query(
    "nearest_resize",
    f"""WITH {PX}, s AS (SELECT slide_id, r // 2 AS r, c // 2 AS c, red FROM px WHERE r % 2 = 0 AND c % 2 = 0)
SELECT p.slide_id, count(*) AS n, count(s.red) AS met, sum(s.red)::BIGINT AS total FROM px p LEFT JOIN s ON s.slide_id = p.slide_id AND s.r = floor((p.r + 0.5) * 32 / 64)::INT AND s.c = floor((p.c + 0.5) * 32 / 64)::INT GROUP BY p.slide_id""",
)
def nearest_resize(spark, d):
    """A picture of half the size, every second pixel of every second row, brought back to the whole slide's size."""
    px = pixels(spark, d)
    half = px.where("r % 2 = 0 and c % 2 = 0").selectExpr("slide_id", "cast(r div 2 as int) as r", "cast(c div 2 as int) as c", "red")
    df = neighbourhood.resized(half, "red", 64, 32, px, "small")
    return df.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.count("small").alias("met"), F.sum("small").alias("total"))


@query("alpha_flatten", f"WITH {PX} SELECT slide_id, sum(round_even(red * (blue / 255.0::DOUBLE) + 255 * (1 - blue / 255.0::DOUBLE), 0))::BIGINT AS red, sum(round_even(green * (blue / 255.0::DOUBLE) + 255 * (1 - blue / 255.0::DOUBLE), 0))::BIGINT AS green FROM px GROUP BY slide_id")
def alpha_flatten(spark, d):
    from ..sources.pixels import flattened

    df = flattened(pixels(spark, d).withColumn("alpha", F.col("blue")), "alpha")
    return df.groupBy("slide_id").agg(F.sum("red").alias("red"), F.sum("green").alias("green"))


@query("mask_overlay", f"WITH {PX} SELECT slide_id, r, c, CASE WHEN red > 120 THEN 255 ELSE 0 END AS over_red, {G8} AS over_green, CASE WHEN red > 120 THEN 255 ELSE 0 END AS over_blue FROM px")
def mask_overlay(spark, d):
    return masks.overlaid(pixels(spark, d).withColumn("m", F.col("red") > 120), "m")


@query(
    "failure_isolation",
    f"""WITH {PX} SELECT slide_id, CASE WHEN slide_id % 3 = 1 THEN 'failed' ELSE 'done' END AS status, CASE WHEN slide_id % 3 = 1 THEN 'ValueError: slide ' || slide_id END AS error, CASE WHEN slide_id % 3 <> 1 THEN count(*) END AS n FROM px GROUP BY slide_id""",
)
def failure_isolation(spark, d):
    def work(pdf):
        if pdf["slide_id"].iloc[0] % 3 == 1:
            raise ValueError(f"slide {pdf['slide_id'].iloc[0]}")
        return {"n": len(pdf)}

    return isolated(pixels(spark, d), work, "n long")


@query("pixel_features")
def pixel_features(spark, d):
    """All texture features of the pixels, summed up per slide; tested against plain loops."""
    df = raster.features(pixels(spark, d).withColumn("v", gray()), "v", raster.FEATURES)
    return df.groupBy("slide_id").agg(*[F.avg(k).alias(k) for k in raster.FEATURES])


@query("local_otsu")
def local_otsu(spark, d):
    from ..functions import kernels

    df = raster.per_slide(pixels(spark, d).withColumn("v", gray8()), lambda x: {"t": kernels.local_otsu(x["v"], 3)}, ["v"], {"t": "int"})
    return df.groupBy("slide_id").agg(F.count_if(F.col("v") < F.col("t")).alias("kept"), F.avg("t").alias("threshold"))


@query("mask_geojson")
def mask_geojson(spark, d):
    return raster.contours(pixels(spark, d).withColumn("m", F.col("red") < SPARSE - 8), "m", 16.0)
