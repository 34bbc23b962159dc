"""Metrics, texture, tiles, annotations and classifiers on the pixel fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.colour import LINEAR, gray, unmixing
from ..operators import annotations, learning, masks, stats, tiles
from ..plans.pipeline import Step, folded, metrics
from ..session import table
from ..sources import tables
from ..sources.pixels import pixels, u8
from .registry import GRAY, PX, query, r6, rounded

TISSUE = 124


def masked(spark, d):
    return pixels(spark, d).withColumn("m", F.col("red") < TISSUE)


def _moments(values: dict[str, str], where: str, empty_std: str) -> str:
    parts = [f"{r6(f'coalesce(avg({v}) FILTER ({where}), -100.0)')} AS \"{n}\", {r6(f'coalesce(stddev_pop({v}) FILTER ({where}), {empty_std})')} AS \"{s}\"" for (n, s), v in values.items()]
    return f"SELECT slide_id, {', '.join(parts)} FROM px GROUP BY slide_id"


def _channels(values: list[str], tail: str) -> dict:
    return {(f"chan{k}_brightness{tail}", f"chan{k}_brightness_std{tail}"): v for k, v in enumerate(values, 1)}


GRAY_NAMES = {("grayscale_brightness", "grayscale_brightness_std"): GRAY}


@query("gray_brightness", f"WITH {PX} " + _moments(GRAY_NAMES, f"red < {TISSUE}", "0.0"))
def gray_brightness(spark, d):
    return rounded(stats.brightness(masked(spark, d), None, "m"))


@query("background_brightness", f"WITH {PX} " + _moments({("background_grayscale_brightness", "background_grayscale_brightness_std"): GRAY}, f"NOT red < {TISSUE}", "0.0"))
def background_brightness(spark, d):
    return rounded(stats.brightness(masked(spark, d), None, "m", True, "background_"))


@query("empty_mask_brightness", f"WITH {PX} " + _moments(GRAY_NAMES, "red > 300", "0.0"))
def empty_mask_brightness(spark, d):
    return rounded(stats.brightness(pixels(spark, d).withColumn("m", F.col("red") > 300), None, "m"))


@query("empty_mask_channels", f"WITH {PX} " + _moments(_channels(["red::DOUBLE", "green::DOUBLE", "blue::DOUBLE"], ""), "red > 300", "0.0"))
def empty_mask_channels(spark, d):
    return rounded(stats.brightness(pixels(spark, d).withColumn("m", F.col("red") > 300), "RGB", "m"))


@query("channel_brightness_rgb", f"WITH {PX} " + _moments(_channels(["red::DOUBLE", "green::DOUBLE", "blue::DOUBLE"], ""), f"red < {TISSUE}", "0.0"))
def channel_brightness_rgb(spark, d):
    return rounded(stats.brightness(masked(spark, d), "RGB", "m"))


def _linear(space: str, offsets=(0.0, 0.0, 0.0)) -> str:
    rows = [" + ".join(f"{w!r}::DOUBLE * ({n} / 255.0::DOUBLE)" for w, n in zip(row, ("red", "green", "blue"))) + f" + {o!r}::DOUBLE" for row, o in zip(LINEAR[space], offsets)]
    return f"WITH {PX} " + _moments(_channels(rows, f"_{space}"), f"red < {TISSUE}", "0.0")


@query("channel_brightness_yuv", _linear("YUV"))
def channel_brightness_yuv(spark, d):
    return rounded(stats.brightness(masked(spark, d), "YUV", "m"))


@query("channel_brightness_yiq", _linear("YIQ"))
def channel_brightness_yiq(spark, d):
    return rounded(stats.brightness(masked(spark, d), "YIQ", "m"))


@query("channel_brightness_ypbpr", _linear("YPbPr"))
def channel_brightness_ypbpr(spark, d):
    return rounded(stats.brightness(masked(spark, d), "YPbPr", "m"))


@query("channel_brightness_ycbcr", _linear("YCbCr", (16.0, 128.0, 128.0)))
def channel_brightness_ycbcr(spark, d):
    return rounded(stats.brightness(masked(spark, d), "YCbCr", "m"))


@query("channel_brightness_rgb_cie", _linear("RGB CIE"))
def channel_brightness_rgb_cie(spark, d):
    return rounded(stats.brightness(masked(spark, d), "RGB CIE", "m"))


_HSV = f"""WITH {PX.replace("px AS", "raw AS", 1)}, u AS (SELECT slide_id, red, red / 255.0::DOUBLE AS a, green / 255.0::DOUBLE AS b, blue / 255.0::DOUBLE AS e FROM raw), v AS (SELECT *, greatest(a, b, e) AS t, least(a, b, e) AS l FROM u),
h AS (SELECT *, (CASE WHEN t = l THEN 0.0 WHEN a = t THEN (b - e) / (t - l) WHEN b = t THEN 2.0 + (e - a) / (t - l) ELSE 4.0 + (a - b) / (t - l) END) / 6.0::DOUBLE AS x FROM v),
px AS (SELECT slide_id, red, CASE WHEN x < 0 THEN x + 1.0 ELSE x END AS hue, CASE WHEN t = 0 THEN 0.0 ELSE (t - l) / t END AS sat, t AS val FROM h) """


@query("channel_brightness_hsv", _HSV + _moments(_channels(["hue", "sat", "val"], "_HSV"), f"red < {TISSUE}", "0.0"))
def channel_brightness_hsv(spark, d):
    return rounded(stats.brightness(masked(spark, d), "HSV", "m"))


def _xyz() -> str:
    from ..functions.colour import XYZ

    lin = lambda n: f"(CASE WHEN {n} / 255.0::DOUBLE > 0.04045::DOUBLE THEN pow(({n} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {n} / 255.0::DOUBLE / 12.92::DOUBLE END)"
    rows = [" + ".join(f"{w!r}::DOUBLE * {lin(n)}" for w, n in zip(row, ("red", "green", "blue"))) for row in XYZ]
    return f"WITH {PX} " + _moments(_channels(rows, "_XYZ"), f"red < {TISSUE}", "0.0")


@query("channel_brightness_xyz", _xyz())
def channel_brightness_xyz(spark, d):
    return rounded(stats.brightness(masked(spark, d), "XYZ", "m"))


_SOBEL = f"""g AS (SELECT slide_id, r, c, red < {TISSUE} AS m, {GRAY} AS v FROM px), a AS (SELECT *, (coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v)) / 2 AS d, (coalesce(lag(v) OVER x, v) + 2 * v + coalesce(lead(v) OVER x, v)) / 4 AS s FROM g WINDOW x AS (PARTITION BY slide_id, r ORDER BY c)),
b AS (SELECT *, (coalesce(lag(d) OVER y, d) + 2 * d + coalesce(lead(d) OVER y, d)) / 4 AS h, (coalesce(lead(s) OVER y, s) - coalesce(lag(s) OVER y, s)) / 2 AS w FROM a WINDOW y AS (PARTITION BY slide_id, c ORDER BY r))"""


@query(
    "contrast",
    f"WITH {PX}, {_SOBEL} SELECT slide_id, {r6('sqrt(sum((h * h + w * w) / 2) FILTER (m)) / count(*) FILTER (m)')} AS \"tenenGrad_contrast\", {r6('(max(v) FILTER (m) - min(v) FILTER (m)) / (max(v) FILTER (m) + min(v) FILTER (m))')} AS michelson_contrast, {r6('stddev_pop(v) FILTER (m)')} AS rms_contrast FROM b GROUP BY slide_id",
)
def contrast(spark, d):
    return rounded(stats.contrast(masked(spark, d), "m"))


@query(
    "histogram_density",
    f"""WITH {PX}, v AS (SELECT slide_id, unnest(['red', 'green', 'blue']) AS channel, unnest([red, green, blue]) AS x, red < {TISSUE} AS m FROM px), h AS (SELECT slide_id, channel, least(floor(x * 20 / 255::DOUBLE), 19)::INT AS bin, count(*) FILTER (m) AS n FROM v GROUP BY ALL),
t AS (SELECT slide_id, channel, sum(n) AS total FROM h GROUP BY ALL) SELECT t.slide_id, t.channel, k::INT AS bin, {r6("coalesce(n, 0) * 20 / (total * 255.0::DOUBLE)")} AS density FROM t CROSS JOIN range(20) b(k) LEFT JOIN h ON h.slide_id = t.slide_id AND h.channel = t.channel AND h.bin = k""",
)
def histogram_density(spark, d):
    return rounded(stats.histogram(masked(spark, d), 20, "m"))


@query(
    "template_distance",
    f"""WITH {PX}, v AS (SELECT slide_id, unnest(['red', 'green', 'blue']) AS channel, unnest([red, green, blue]) AS x FROM px), h AS (SELECT slide_id, channel, least(floor(x * 20 / 255::DOUBLE), 19)::INT AS bin, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT slide_id, channel, sum(n) AS total FROM h GROUP BY ALL), d AS (SELECT t.slide_id, t.channel, k AS bin, coalesce(n, 0) * 20 / (total * 255.0::DOUBLE) AS q FROM t CROSS JOIN range(20) b(k) LEFT JOIN h ON h.slide_id = t.slide_id AND h.channel = t.channel AND h.bin = k)
SELECT a.slide_id, 'slide' || b.slide_id AS template, (round(sum((a.q - b.q) * (a.q - b.q)), 9) + 0.0)::DOUBLE AS distance FROM d a JOIN d b ON a.channel = b.channel AND a.bin = b.bin AND b.slide_id < 2 GROUP BY ALL""",
)
def template_distance(spark, d):
    h = stats.histogram(pixels(spark, d), 20)
    templates = h.where("slide_id < 2").withColumn("template", F.concat(F.lit("slide"), F.col("slide_id").cast("string")))
    return rounded(stats.template_distance(h, templates), 9)


def _stains(name: str) -> str:
    m = unmixing(name)
    od = lambda n: f"ln(greatest({n} / 255.0::DOUBLE, 1e-6::DOUBLE)) / ln(1e-6::DOUBLE)"
    conc = ", ".join("greatest(0.0, " + " + ".join(f"{m[i][j]!r}::DOUBLE * o{i}" for i in range(3)) + f") AS c{j}" for j in range(3))
    cut = ", ".join(f"quantile_cont(c{j}, 0.99) AS q{j}" for j in range(3))
    clip = ", ".join(f"least(c{j}, q{j}) AS c{j}" for j in range(3))
    out = ", ".join(f"{r6(f'(avg(c{j}) - min(c{j})) / (max(c{j}) - min(c{j}))')} AS deconv_c{j}_mean, {r6(f'stddev_pop(c{j}) / (max(c{j}) - min(c{j}))')} AS deconv_c{j}_std" for j in range(3))
    return f"""WITH {PX}, o AS (SELECT slide_id, red < {TISSUE} AS m, {od("red")} AS o0, {od("green")} AS o1, {od("blue")} AS o2 FROM px), s AS (SELECT slide_id, m, {conc} FROM o), q AS (SELECT slide_id, {cut} FROM s GROUP BY slide_id),
k AS (SELECT slide_id, m, {clip} FROM s JOIN q USING (slide_id)) SELECT slide_id, {out} FROM k WHERE m GROUP BY slide_id"""


@query("stain_stats", _stains("hed"))
def stain_stats(spark, d):
    return rounded(stats.stains(masked(spark, d), "hed", "m"))


@query("stain_stats_rbd", _stains("rbd"))
def stain_stats_rbd(spark, d):
    return rounded(stats.stains(masked(spark, d), "rbd", "m"))


_GLCM = f"""WITH {PX}, g AS (SELECT slide_id, r, c, ceil(round({GRAY} * 7, 9))::INT AS v FROM px), k AS (SELECT slide_id, row_number() OVER (PARTITION BY slide_id ORDER BY r, c) - 1 AS patch, r AS r0, c AS c0 FROM px WHERE red < {TISSUE} AND (slide_id * 7919 + r * 64 + c) % 97 = 0),
p AS (SELECT k.slide_id, k.patch, a.v AS i, b.v AS j FROM k JOIN g a ON a.slide_id = k.slide_id AND a.r BETWEEN k.r0 AND k.r0 + 15 AND a.c BETWEEN k.c0 AND k.c0 + 10 JOIN g b ON b.slide_id = a.slide_id AND b.r = a.r AND b.c = a.c + 5),
q AS (SELECT slide_id, patch, i, j FROM p UNION ALL SELECT slide_id, patch, j, i FROM p), n AS (SELECT slide_id, patch, i, j, count(*)::DOUBLE AS n FROM q GROUP BY ALL),
s AS (SELECT slide_id, patch, sum(n) AS t, sum(n * (i - j) * (i - j)) AS co, sum(n * abs(i - j)) AS di, sum(n / (1 + (i - j) * (i - j))) AS ho, sum(n * n) AS n2, sum(n * i) AS si, sum(n * i * i) AS sii, sum(n * i * j) AS sij FROM n GROUP BY ALL),
f AS (SELECT slide_id, co / t AS contrast, di / t AS dissimilarity, ho / t AS homogeneity, n2 / (t * t) AS asm_, sqrt(n2 / (t * t)) AS energy, CASE WHEN sii / t - (si / t) * (si / t) < 1e-15 THEN 1.0 ELSE (sij / t - (si / t) * (si / t)) / (sii / t - (si / t) * (si / t)) END AS correlation FROM s)
SELECT slide_id, """ + ", ".join(f"{r6(f'avg({v})')} AS \"{n}\", {r6(f'stddev_pop({v})')} AS \"{n}_std\"" for n, v in (("contrast", "contrast"), ("dissimilarity", "dissimilarity"), ("homogeneity", "homogeneity"), ("ASM", "asm_"), ("energy", "energy"), ("correlation", "correlation"))) + " FROM f GROUP BY slide_id"


@query("glcm_features", _GLCM)
def glcm_features(spark, d):
    df = masked(spark, d)
    chosen = df.where("m and (slide_id * 7919 + r * 64 + c) % 97 = 0").selectExpr("slide_id", "row_number() over (partition by slide_id order by r, c) - 1 as patch", "r as r0", "c as c0")
    return rounded(stats.texture(df, chosen, side=16, levels=8))


_SAMPLED = f"""o AS (SELECT slide_id, r, c, row_number() OVER (PARTITION BY slide_id ORDER BY r, c) - 1 AS k, count(*) OVER (PARTITION BY slide_id) AS n FROM px WHERE red < {TISSUE}),
y AS (SELECT DISTINCT slide_id, n, i FROM o, range(20) x(i)),
k AS (SELECT slide_id, i AS patch, r AS r0, c AS c0 FROM y JOIN o USING (slide_id, n) WHERE k = ('0x' || substr(md5('0:' || slide_id || ':' || i), 1, 15))::BIGINT % n)"""


@query("glcm_sampled", _GLCM[: _GLCM.index("k AS (")] + _SAMPLED + _GLCM[_GLCM.index(",\np AS (") :])
def glcm_sampled(spark, d):
    """Texture over patches drawn by hash, as pipelines do."""
    df = masked(spark, d)
    return rounded(stats.texture(df, stats.sampled_corners(df, "m", 20), side=16))


# --- tiles ----------------------------------------------------------------------------------------------

FACTOR, TILE, STRIDE = 16.0, 200, 150
_BOX = f"t AS (SELECT slide_id, 0::BIGINT AS region, min(r) AS top, min(c) AS lft, max(r) + 1 AS bottom, max(c) + 1 AS rgt FROM px WHERE red < {TISSUE - 20} GROUP BY slide_id)"
_T, _S = TILE / FACTOR, STRIDE / FACTOR
_GRID = f"""{_BOX}, l AS (SELECT slide_id, region, (lft + k * ((lft + {_S}::DOUBLE)::BIGINT - lft))::DOUBLE AS l FROM (SELECT *, trunc(rgt - {_T}::DOUBLE)::BIGINT + 1 AS stop FROM t), range(100) x(k) WHERE k < ceil((stop - lft) / {_S}::DOUBLE)),
u AS (SELECT slide_id, region, (top + k * (trunc(top + {_S}::DOUBLE)::BIGINT - top))::DOUBLE AS t FROM (SELECT *, trunc(bottom - {_T}::DOUBLE)::BIGINT + 1 AS stop FROM t), range(100) x(k) WHERE k < ceil((stop - top) / {_S}::DOUBLE)),
w AS (SELECT l.slide_id, l.region, l AS "left", t AS top, l + {_T}::DOUBLE AS "right", t + {_T}::DOUBLE AS bottom FROM l JOIN u USING (slide_id, region))""".replace(f"(lft + {_S}::DOUBLE)::BIGINT", f"trunc(lft + {_S}::DOUBLE)::BIGINT")
_TISSUE = f"""{_GRID}, q AS (SELECT w.*, sum(CASE WHEN p.red < {TISSUE - 20} THEN 1 ELSE 0 END) / ((round_even(bottom, 0) - round_even(top, 0)) * (round_even("right", 0) - round_even("left", 0))) AS tissue
FROM w JOIN px p ON p.slide_id = w.slide_id AND p.r >= round_even(top, 0) AND p.r < round_even(bottom, 0) AND p.c >= round_even("left", 0) AND p.c < round_even("right", 0) GROUP BY w.slide_id, w.region, w."left", w.top, w."right", w.bottom), k AS (SELECT * FROM q WHERE tissue >= 0.06::DOUBLE)"""


def _tissue(spark, d):
    df = pixels(spark, d).withColumn("m", F.col("red") < TISSUE - 20)
    return df, tiles.grid(tiles.tissue_boxes(df, "m"), TILE, STRIDE, FACTOR)


@query("tile_grid", f"WITH {PX}, {_GRID} SELECT * FROM w")
def tile_grid(spark, d):
    return _tissue(spark, d)[1]


@query("tile_tissue_filter", f'WITH {PX}, {_TISSUE} SELECT slide_id, region, "left", top, "right", bottom, {r6("tissue")} AS tissue FROM k')
def tile_tissue_filter(spark, d):
    df, grid = _tissue(spark, d)
    return rounded(tiles.with_tissue(grid, df, "m", 0.06))


@query(
    "tiles_json",
    f"""WITH {PX}, {_TISSUE}, z AS (SELECT slide_id, region, [trunc("left" * 16.0)::INT, trunc(top * 16.0)::INT, trunc("right" * 16.0)::INT, trunc(bottom * 16.0)::INT] AS b FROM k), j AS (SELECT slide_id, region, '[' || string_agg('[' || array_to_string(b, ',') || ']', ',' ORDER BY b[1], b[2]) || ']' AS t FROM z GROUP BY ALL)
SELECT slide_id, '[' || string_agg(t, ',' ORDER BY region) || ']' AS tiles FROM j GROUP BY slide_id""",
)
def tiles_json(spark, d):
    df = pixels(spark, d).withColumn("m", F.col("red") < TISSUE - 20)
    return tiles.as_json(tiles.extract_tiles(df, "m", 1024, 64, TILE, STRIDE, 0.06))


_WINDOWS = f'z AS (SELECT slide_id, region, trunc("left")::INT AS "left", trunc(top)::INT AS top, trunc("right")::INT AS "right", trunc(bottom)::INT AS bottom FROM w)'


@query(
    "tile_screen",
    f"""WITH {PX}, {_GRID}, {_WINDOWS}, q AS (SELECT z.*, ("right" - "left") * (bottom - top) AS n, coalesce(sum(greatest(red, green, blue) - least(red, green, blue)), 0) AS total FROM z LEFT JOIN px p ON p.slide_id = z.slide_id AND p.r >= top AND p.r < bottom AND p.c >= "left" AND p.c < "right" GROUP BY ALL)
SELECT slide_id, region, "left", top, "right", bottom FROM q WHERE total >= 24.0::DOUBLE * n""",
)
def tile_screen(spark, d):
    """Windows whose own pixels are colourful enough, decided on each tile's array."""
    df, grid = _tissue(spark, d)
    return tiles.screened(tiles.zoomed(grid, 1.0), df, tiles.SCREENS["saturation"](24.0), block=16).select("slide_id", "region", "left", "top", "right", "bottom")


# --- annotations ------------------------------------------------------------------------------------------

def _texts(spark, d):
    """A GeoJSON text for each slide, made of its vectors: each draws a quadrangle, and a hole where it is large enough.

    Regions of a slide overlap, lie in each other's holes and touch its edges.
    """
    u = lambda k: u8(F.get("embedding", F.lit(k)))
    v = table(spark, d, "embeddings").select("vec_id", "label", F.expr("vec_id div 64").alias("slide_id"), (u(0) % 48).alias("x"), (u(1) % 48).alias("y"), (u(2) % 21 + 3).alias("w"), (u(3) % 21 + 3).alias("h"))
    points = lambda *ps: "[" + ", ".join(f"[{x}, {y}]" for x, y in ps) + "]"
    outer = points(*[("%d", "%d.5")] * 4, ("%d", "%d.5"))
    c = F.col
    corners = [(c("x"), c("y")), (c("x") + c("w"), c("y") + F.expr("h div 3")), (c("x") + c("w") - 2, c("y") + c("h")), (c("x"), c("y") + c("h") - 1)]
    inner = [(c("x") + 4, c("y") + 6), (c("x") + 8, c("y") + 6), (c("x") + 8, c("y") + 9), (c("x") + 4, c("y") + 9)]
    shown = lambda ps: F.format_string(outer, *[p for xy in [*ps, ps[0]] for p in xy])
    hole = F.when((c("w") > 12) & (c("h") > 12), F.concat(F.lit(", "), shown(inner))).otherwise("")
    feature = F.concat(F.lit('{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": ['), shown(corners), hole, F.lit(']}, "properties": {"classification": {"name": "'), c("label").cast("string"), F.lit('"}}}'))
    each = v.select("slide_id", F.struct("vec_id", feature.alias("text")).alias("f"))
    texts = each.groupBy("slide_id").agg(F.concat_ws(",\n", F.transform(F.array_sort(F.collect_list("f")), lambda f: f["text"])).alias("t"))  # 64 vectors a slide
    return texts.select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "t", F.lit("]}")).alias("json"), F.col("slide_id").cast("string").alias("uri"))


def _regions(spark, d):
    return annotations.valid(annotations.geojson_regions(_texts(spark, d)))


def _painted(spark, d):
    return _regions(spark, d).withColumn("slide_id", F.col("uri").cast("long"))


_DRAWN = """v AS (SELECT vec_id // 64 AS slide_id, vec_id % 64 AS position, label, floor((embedding[1]::DOUBLE + 1) * 127.5)::INT % 48 AS x, floor((embedding[2]::DOUBLE + 1) * 127.5)::INT % 48 AS y,
  floor((embedding[3]::DOUBLE + 1) * 127.5)::INT % 21 + 3 AS w, floor((embedding[4]::DOUBLE + 1) * 127.5)::INT % 21 + 3 AS h FROM embeddings),
ring AS (
  SELECT slide_id, position, 0 AS ring, 1 AS value, [[x, y], [x + w, y + h // 3], [x + w - 2, y + h], [x, y + h - 1], [x, y], [x, y]] AS p FROM v
  UNION ALL SELECT slide_id, position, 1, 0, [[x + 4, y + 6], [x + 8, y + 6], [x + 8, y + 9], [x + 4, y + 9], [x + 4, y + 6], [x + 4, y + 6]] FROM v WHERE w > 12 AND h > 12),
e AS (SELECT slide_id, position, ring, value, p[k][1] AS x1, p[k][2] AS y1, p[k + 1][1] AS x2, p[k + 1][2] AS y2 FROM ring, range(1, 6) t(k)),
l AS (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1)) AS n FROM e),
q AS (SELECT slide_id, position, ring, value, CASE WHEN n = 0 THEN x1 ELSE x1 + floor((2 * (x2 - x1) * k + n)::DOUBLE / (2 * n))::INT END AS c, CASE WHEN n = 0 THEN y1 ELSE y1 + floor((2 * (y2 - y1) * k + n)::DOUBLE / (2 * n))::INT END AS r FROM l, range(70) t(k) WHERE k <= n),
i AS (SELECT px.slide_id, px.r, px.c, position, ring, value FROM px JOIN e ON e.slide_id = px.slide_id AND (y1 > r) <> (y2 > r) AND c < (x2 - x1)::DOUBLE * (r - y1)::DOUBLE / (y2 - y1)::DOUBLE + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
z AS (SELECT slide_id, r, c, arg_max(value, position * 2 + ring) AS value FROM (SELECT slide_id, r, c, position, ring, value FROM i UNION ALL SELECT slide_id, r, c, position, ring, value FROM q) GROUP BY ALL),
a AS (SELECT px.*, coalesce(z.value, 0) = 1 AS k FROM px LEFT JOIN z ON z.slide_id = px.slide_id AND z.r = px.r AND z.c = px.c)"""


@query(
    "annotation_rings",
    f"""WITH {PX}, {_DRAWN} SELECT slide_id::VARCHAR AS uri, position::INT AS position, any_value(v.label)::VARCHAR AS label, max(CASE WHEN ring = 0 THEN 5 END) AS n_outer, max(ring) AS n_holes, sum(CASE WHEN ring = 0 THEN list_sum([a[1] + a[2] FOR a IN p[1:5]]) END)::BIGINT AS total
FROM ring JOIN v USING (slide_id, position) GROUP BY slide_id, position""",
)
def annotation_rings(spark, d):
    add = lambda a, p: a + p["x"] + p["y"]
    return _regions(spark, d).select("uri", "position", "label", F.size("outer").alias("n_outer"), F.size("holes").alias("n_holes"), F.aggregate("outer", F.lit(0).cast("long"), lambda a, p: add(a, p).cast("long")).alias("total"))


@query(
    "annotation_mask",
    f"""WITH {PX}, {_DRAWN} SELECT slide_id, count(*) FILTER (k) AS inside, coalesce(sum(r * 64 + c) FILTER (k), 0)::BIGINT AS places, count(*) AS total FROM a GROUP BY slide_id""",
)
def annotation_mask(spark, d):
    df = annotations.annotation_mask(pixels(spark, d), _painted(spark, d))
    return df.groupBy("slide_id").agg(F.count_if("annotated").alias("inside"), F.coalesce(F.sum(F.when(F.col("annotated"), F.col("r") * 64 + F.col("c"))), F.lit(0)).cast("long").alias("places"), F.count(F.lit(1)).alias("total"))


@query("annotation_repair", "SELECT vec_id, 2::BIGINT AS parts, (2 * w * h)::DOUBLE AS area FROM (SELECT vec_id, floor((embedding[3]::DOUBLE + 1) * 127.5)::INT % 21 + 3 AS w, floor((embedding[4]::DOUBLE + 1) * 127.5)::INT % 21 + 3 AS h FROM embeddings)")
def annotation_repair(spark, d):
    """A bow tie for each vector, 2 w wide and 2 h high, becomes two triangles that meet at its middle."""
    u = lambda k: u8(F.get("embedding", F.lit(k)))
    v = table(spark, d, "embeddings").select("vec_id", u(0).alias("x"), u(1).alias("y"), (u(2) % 21 + 3).alias("w"), (u(3) % 21 + 3).alias("h"))
    c = F.col
    corners = [(c("x"), c("y")), (c("x") + 2 * c("w"), c("y") + 2 * c("h")), (c("x") + 2 * c("w"), c("y")), (c("x"), c("y") + 2 * c("h"))]
    ring = F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in corners])
    regions = v.select("vec_id", F.lit(0).alias("part"), ring.alias("outer"), F.array().cast(f"array<{annotations.POINT}>").alias("holes"))
    made = annotations.repaired(regions)
    n = F.size("outer")
    doubled = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.get("outer", i)["x"] * F.get("outer", (i + 1) % n)["y"] - F.get("outer", (i + 1) % n)["x"] * F.get("outer", i)["y"])
    return made.groupBy("vec_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.abs(doubled) / 2).alias("area"))


_NAMES = {str(k): ("tissue", "fold", "ink")[k % 3] for k in range(10)}


@query("annotation_labels", "SELECT (vec_id // 64)::VARCHAR AS uri, CASE label % 3 WHEN 0 THEN 'tissue' WHEN 1 THEN 'fold' ELSE 'ink' END AS label, count(*) AS n, min(vec_id % 64)::INT AS first FROM embeddings GROUP BY ALL")
def annotation_labels(spark, d):
    named = annotations.relabelled(_regions(spark, d), _NAMES)
    firsts = named.groupBy("uri", "label").agg(F.min("position").alias("first"))
    return annotations.by_label(named).select("uri", "label", F.size("regions").cast("long").alias("n")).join(firsts, ["uri", "label"])


# --- classifiers ------------------------------------------------------------------------------------------

_TRAIN = "t AS (SELECT red, green, blue, CASE WHEN red + green > 2 * blue THEN 1 ELSE 0 END AS label FROM px WHERE slide_id < 2)"
_NB = f"""WITH {PX}, {_TRAIN}, w AS (SELECT 1e-9::DOUBLE * greatest(var_pop(red), var_pop(green), var_pop(blue)) AS x, count(*) AS n FROM t),
k AS (SELECT label, count(*) / any_value(w.n) AS p, avg(red) AS m1, var_pop(red) + any_value(x) AS v1, avg(green) AS m2, var_pop(green) + any_value(x) AS v2, avg(blue) AS m3, var_pop(blue) + any_value(x) AS v3 FROM t, w GROUP BY label),
s AS (SELECT slide_id, r, c, k.label, ln(p) - 0.5 * ln(6.283185307179586::DOUBLE * v1) - (red - m1) * (red - m1) / (2 * v1) - 0.5 * ln(6.283185307179586::DOUBLE * v2) - (green - m2) * (green - m2) / (2 * v2) - 0.5 * ln(6.283185307179586::DOUBLE * v3) - (blue - m3) * (blue - m3) / (2 * v3) AS z FROM px, k),
q AS (SELECT slide_id, r, c, 1.0 / (1.0 + exp(max(z) FILTER (label = 0) - max(z) FILTER (label = 1))) AS p FROM s GROUP BY ALL) SELECT slide_id, {r6("avg(p)")} AS mean_probability, count(*) FILTER (p > 0.5) AS marked FROM q GROUP BY slide_id"""


def _training(px):
    return px.where("slide_id < 2").withColumn("label", F.when(F.col("red") + F.col("green") > 2 * F.col("blue"), 1).otherwise(0))


@query("naive_bayes", _NB)
def naive_bayes(spark, d):
    px = pixels(spark, d)
    p = learning.gaussian_bayes(_training(px), ["red", "green", "blue"])
    return rounded(px.withColumn("p", p).groupBy("slide_id").agg(F.avg("p").alias("mean_probability"), F.count_if(F.col("p") > 0.5).alias("marked")))


@query("forest_by_example")
def forest_by_example(spark, d):
    """A forest on colour and texture features, its marks cleaned of specks and dilated."""
    from ..operators import neighbourhood, raster

    px = neighbourhood.laplacian(neighbourhood.by_slide(pixels(spark, d)).withColumn("v", gray()), "v", "laplace")
    names = ["red", "green", "blue", "laplace"]
    model = learning.forest(_training(px), names, trees=5)
    marked = learning.probability(model, px, names).withColumn("m", F.col("probability") > 0.5).drop("probability")
    grown = neighbourhood.dilate_square(raster.remove_small(marked, "m", 5), "m", 3, "m2")
    return grown.groupBy("slide_id").agg(F.count_if("m").alias("marked"), F.count_if("m2").alias("dilated"))


@query("bright_kmeans")
def bright_kmeans(spark, d):
    """For each slide the pixels above the least luminance of its brightest cluster."""
    df = pixels(spark, d).withColumn("v", gray())
    return df.join(masks.bright_cluster_level(df), "slide_id").groupBy("slide_id").agg(F.count_if(F.col("v") > F.col("level")).alias("bright"))


@query("test_rows", "SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) THEN 1 ELSE 0 END AS testind FROM embeddings")
def test_rows(spark, d):
    """A fifth of each label's vectors, exact to a row."""
    return learning.drawn_share(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.2, 7, "testind")


@query("cohort_clusters")
def cohort_clusters(spark, d):
    wide = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(64)])
    return learning.cohort_clusters(wide, "vec_id", [f"f{k}" for k in range(64)], 5)


_SCORES = f"""WITH p AS (SELECT vec_id, label, d, embedding[d + 1]::DOUBLE AS x FROM embeddings, range(64) t(d)), k AS (SELECT label, d, avg(x) AS m FROM p GROUP BY ALL), w AS (SELECT d, avg(x) AS w FROM p GROUP BY d),
q AS (SELECT vec_id, p.label, sum((x - m) * (x - m)) AS q FROM p JOIN k ON k.label = p.label AND k.d = p.d GROUP BY ALL), i AS (SELECT label, avg(sqrt(q)) AS s, sum(q) AS w, count(*) AS n FROM q GROUP BY label),
e AS (SELECT a.label AS g, b.label AS h, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM k a JOIN k b ON a.d = b.d AND a.label <> b.label GROUP BY ALL), o AS (SELECT g, max((a.s + b.s) / e.d) AS r FROM e JOIN i a ON a.label = g JOIN i b ON b.label = h GROUP BY g),
b AS (SELECT k.label, sum((m - w) * (m - w)) AS b FROM k JOIN w USING (d) GROUP BY k.label)
SELECT (SELECT {r6("avg(r)")} FROM o) AS davies_bouldin, {r6("(sum(b.b * i.n) / (count(*) - 1)) / (sum(i.w) / (sum(i.n) - count(*)))")} AS calinski_harabasz FROM b JOIN i USING (label)"""


@query("cluster_scores", _SCORES)
def cluster_scores(spark, d):
    df = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return rounded(learning.cluster_scores(df, "vec_id", "label", "v"))


_SILHOUETTE = f"""WITH p AS (SELECT vec_id, label, d, embedding[d + 1]::DOUBLE AS x FROM embeddings, range(64) t(d)), m AS (SELECT label, d, avg(x) AS m FROM p GROUP BY ALL), s AS (SELECT vec_id, label, sum(x * x) AS s FROM p GROUP BY ALL),
q AS (SELECT label AS k, avg(s) AS q, count(*) AS n FROM s GROUP BY label), o AS (SELECT p.vec_id, p.label, m.label AS k, sum(x * m.m) AS o FROM p JOIN m ON m.d = p.d GROUP BY ALL),
f AS (SELECT o.vec_id, o.label, o.k, n, s + q - 2 * o AS d FROM o JOIN s ON s.vec_id = o.vec_id JOIN q ON q.k = o.k),
e AS (SELECT vec_id, any_value(CASE WHEN label = k THEN n END) AS n, max(CASE WHEN label = k AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN label <> k THEN d END) AS b FROM f GROUP BY vec_id)
SELECT {r6("avg(CASE WHEN a IS NULL THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END)")} AS silhouette FROM e"""


@query("cluster_silhouette", _SILHOUETTE)
def cluster_silhouette(spark, d):
    score = learning.silhouette(table(spark, d, "embeddings"), "label", "embedding")
    return rounded(spark.createDataFrame([(score,)], "silhouette double"))


# --- whole pipelines ----------------------------------------------------------------------------------------

_CHAIN = f"""p AS (SELECT slide_id, r, c, red, green, blue, {GRAY} AS v FROM px), n AS (SELECT slide_id, count(*) AS t, count(*) FILTER (v < 0.52::DOUBLE) AS a, count(*) FILTER (v < 0.52::DOUBLE AND NOT v < 0.46::DOUBLE) AS b FROM p GROUP BY slide_id),
m AS (SELECT slide_id, {r6("1 - a / t")} AS bright, {r6("CASE WHEN a = 0 THEN -100.0 ELSE 1 - b / a END")} AS dark, b::DOUBLE AS pixels_to_use FROM n)"""


def _chain(px):
    steps = [Step("intensity", "tissue", {"name": "bright", "upper_threshold": ".52"}), Step("intensity", "dark", {"name": "dark", "upper_threshold": ".46", "invert": "true"}), Step("final")]
    return metrics(folded(px, steps))


@query("pipeline_chain", f"WITH {PX}, {_CHAIN} SELECT * FROM m")
def pipeline_chain(spark, d):
    return rounded(_chain(pixels(spark, d)).select("slide_id", "bright", "dark", "pixels_to_use"))


@query("long_metrics", f"""WITH {PX}, {_CHAIN} SELECT slide_id, unnest([0, 1, 2])::INT AS pos, unnest(['bright', 'dark', 'pixels_to_use']) AS name, unnest([bright, dark, pixels_to_use]) AS num FROM m""")
def long_metrics(spark, d):
    return tables.long(pipeline_chain(spark, d), "slide_id", ["bright", "dark", "pixels_to_use"]).drop("value")


@query("wide_export", f"WITH {PX}, {_CHAIN} SELECT slide_id, bright, dark, CAST(NULL AS DOUBLE) AS never_made, pixels_to_use FROM m")
def wide_export(spark, d):
    longs = tables.long(pipeline_chain(spark, d), "slide_id", ["bright", "dark", "pixels_to_use"]).withColumn("value", F.col("num"))
    return tables.wide(longs, ["bright", "dark", "never_made", "pixels_to_use"])


@query(
    "warnings_join",
    f"""WITH {PX}, n AS (SELECT slide_id, count(*) FILTER ({GRAY} > 0.6::DOUBLE) AS a, count(*) FILTER ({GRAY} > 2.0::DOUBLE) AS b FROM px GROUP BY slide_id)
SELECT slide_id, '' || CASE WHEN a = 0 THEN '|After intensity NO tissue remains detectable' ELSE '' END || CASE WHEN b = 0 THEN '|After intensity NO tissue remains detectable' ELSE '' END AS warnings FROM n""",
)
def warnings_join(spark, d):
    steps = [Step("intensity", "a", {"name": "a", "lower_threshold": ".6"}), Step("intensity", "b", {"name": "b", "lower_threshold": "2.0"})]
    return metrics(folded(pixels(spark, d), steps)).select("slide_id", tables.joined_warnings().alias("warnings"))


@query("preset_pipeline")
def preset_pipeline(spark, d):
    """The fullest preset with kernels that suit small rasters, all metrics of each slide in one row."""
    from ..plans.presets import preset

    changes = {"minimum_neighbourhood": {"disk_size": "1", "upper_threshold": "160"}, "smoothness": {"kernel_size": "3", "min_object_size": "8"}, "fat_like": {"kernel_size": "3", "max_keep_size": "30", "fat_cell_size": "14"}, "fill_holes": {"min_size": "6"}, "remove_small": {"min_size": "4"}, "texture__background": {"prefix": "background", "invert": "True", "npatches": "10", "patch_size": "16"}, "texture__final": {"prefix": "final", "npatches": "10", "patch_size": "16"}, "spur": {"disk_radius": "1"}, "area": {"area_threshold": "16"}, "blur": {"blur_radius": "1", "blur_threshold": ".05"}}
    return metrics(folded(pixels(spark, d), preset("v2.1", **changes)))


@query("published_pipeline")
def published_pipeline(spark, d):
    """The fullest preset with its published parameters, on slides of 256 x 256: sixteen slides side by side make one."""
    from ..plans.presets import preset

    k = F.col("slide_id") % 16
    wide = pixels(spark, d).select(F.expr("slide_id div 16").alias("slide_id"), (F.col("r") + 64 * F.floor(k / 4)).cast("int").alias("r"), (F.col("c") + 64 * (k % 4)).cast("int").alias("c"), "red", "green", "blue")
    return metrics(folded(wide, preset("v2.1")))


@query("classified_pipeline")
def classified_pipeline(spark, d):
    """Annotation, both classifiers, tiles and ridges as steps of one pipeline."""
    px = pixels(spark, d)
    regions = _painted(spark, d)
    steps = [
        Step("annotation"),
        Step("classify_bayes", None, {"name": "ink", "threshold": ".9"}),
        Step("classify_examples", None, {"name": "edge", "features": "rgb\nlaplace", "area_threshold": "3", "dilate_kernel_size": "3"}),
        Step("tiles", None, {"tile_size": "200", "tile_stride": "150", "tissue_ratio": ".3", "scale": "16"}),
        Step("roi_scan", None, {"win_size": "32", "area_threshold": "4"}),
        Step("keep"),
        Step("final"),
    ]
    return metrics(folded(px, steps, given={"training": _training(px), "examples": _training(px), "regions": regions}))


@query(
    "annotated_pipeline",
    f"""WITH {PX}, {_DRAWN}, u AS (SELECT slide_id, k OR slide_id > 5 AS k FROM a) SELECT slide_id, {r6("1 - count(*) FILTER (k) / count(*)")} AS "getAnnotationMask", (count(*) FILTER (k))::DOUBLE AS pixels_to_use FROM u GROUP BY slide_id""",
)
def annotated_pipeline(spark, d):
    """Slides from number 6 on have no annotations and stay whole."""
    regions = _painted(spark, d).where("slide_id <= 5")
    return rounded(metrics(folded(pixels(spark, d), [Step("annotation"), Step("final")], given={"regions": regions})).select("slide_id", "getAnnotationMask", "pixels_to_use"))
