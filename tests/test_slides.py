"""Pipelines, tables, annotations and golden identities."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.functions import colour, kernels
from glasspane.operators import annotations, raster, tiles
from glasspane.plans import pipeline, presets
from glasspane.session import ranked
from glasspane.sources import slides, tables
from glasspane.sources.pixels import from_images, pixels
from glasspane.streaming import arrivals


def test_gray_and_yuv_identities(spark):
    """Luminance and YUV of known channel means, as published with a golden run."""
    df = spark.range(1).select(F.lit(255).alias("red"), F.lit(255).alias("green"), F.lit(255).alias("blue"))
    row = df.select(colour.gray().alias("g"), *[c.alias(f"y{k}") for k, c in enumerate(colour.converted("YUV"))]).first()
    assert row["g"] == pytest.approx(1) and row["y0"] == pytest.approx(1)
    assert abs(row["y1"]) < 1e-6 and abs(row["y2"]) < 1e-6


def test_unmixing_inverts_stains():
    for name, vectors in colour.STAINS.items():
        m = colour.unmixing(name)
        for i, v in enumerate(vectors):
            if any(v):
                got = [sum(v[k] * m[k][j] for k in range(3)) for j in range(3)]
                assert got == pytest.approx([1.0 if j == i else 0.0 for j in range(3)], abs=1e-6)
    with pytest.raises(ValueError):
        colour.unmixing("none")


INI = """
[pipeline]
steps = BasicModule.getBasicStats
    # LightDarkModule.getIntensityThresholdPercent:off
    LightDarkModule.getIntensityThresholdPercent:tissue
    LightDarkModule.getIntensityThresholdPercent:dark
    ;MorphologyModule.removeSmallObjects
    BasicModule.finalComputations
[LightDarkModule.getIntensityThresholdPercent:tissue]
name: bright
upper_threshold: .52
upper_variance: 3
[LightDarkModule.getIntensityThresholdPercent:dark]
name: dark
upper_threshold: .46
invert: true
[BaseImage.BaseImage]
mask_statistics = relative2image
"""


def test_ini_steps_and_warnings(spark, sf):
    steps, mode = pipeline.parsed(INI)
    assert [s.label for s in steps] == [None, "tissue", "dark", None] and mode == "relative2image"
    assert pipeline.bound(steps)[1] == ["LightDarkModule.getIntensityThresholdPercent:tissue does not read upper_variance"]
    out = pipeline.run(pixels(spark, sf), INI).collect()
    assert out and all(0 <= r["dark"] <= r["bright"] <= 1 for r in out)
    with pytest.raises(NameError):
        pipeline.bound([pipeline.Step("Nothing.here")])
    with pytest.raises(ValueError):
        pipeline.parsed("[pipeline]\nsteps = a.b:c.d")


def test_fractions_multiply_out(spark, sf):
    steps = presets.preset("light", smoothness={"min_object_size": "8", "kernel_size": "3"}, spur={"disk_radius": "1"}, area={"area_threshold": "4"}, fill_holes={"min_size": "2"}, remove_small={"min_size": "2"})
    row = pipeline.metrics(pipeline.folded(pixels(spark, sf), steps)).first()
    left = 1.0
    for step in ("bright", "flat_areas", "dark", "small_tissue_filled_percent", "small_tissue_removed_percent", "blurry_removed_percent", "spur_pixels", "areaThresh"):
        if row[step] == -100:
            left = 0
        left *= 1 - row[step]
    n = pixels(spark, sf).where(F.col("slide_id") == row["slide_id"]).count()
    assert left * n == pytest.approx(row["pixels_to_use"], abs=1e-6)


def test_presets_bind():
    assert presets.names() == ["clinical", "default", "first", "ihc", "light", "v2.1"]
    for name in presets.names():
        assert pipeline.bound(presets.preset(name))[1] == []
    with pytest.raises(KeyError):
        presets.preset("none")


def test_one_exchange_by_slide(spark, sf):
    """Windows and aggregates by slide reuse the one exchange."""
    from glasspane.operators import neighbourhood

    df = neighbourhood.flat(neighbourhood.by_slide(pixels(spark, sf)).withColumn("v", F.col("red") / 255), "v", 3)
    plan = df.groupBy("slide_id").agg(F.count_if("flat"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.svs", 1.5, None), ("b.svs", -100.0, "x")], "filename string, m double, note string")
    tables.export(df, str(tmp_path / "t"), ["#start_time:\tnow"], ["filename", "m", "note"])
    back = tables.metrics(spark, str(tmp_path / "t")).orderBy("filename").collect()
    assert [(r["filename"], r["m"], r["note"], r["sitecol"], r["embed_x"]) for r in back] == [("a.svs", 1.5, None, "None", None), ("b.svs", -100.0, "x", "None", None)]
    assert [r[0] for r in tables.listed(spark, str(tmp_path / "t"), "/base").orderBy("path").collect()] == ["/base/a.svs", "/base/b.svs"]


def test_ranked_is_total(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 101)
    rows = ranked(df, [F.col("k"), F.col("id")]).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 1001))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_xml_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<Annotations><Annotation Name="T"><Regions><Region><Vertices><Vertex X="1.9" Y="2"/><Vertex X="9" Y="2"/><Vertex X="9" Y="9"/></Vertices></Region></Regions></Annotation></Annotations>')
    row = annotations.xml_regions(spark, str(tmp_path / "a.xml")).first()
    assert row["label"] == "T" and [(p["x"], p["y"]) for p in row["outer"]] == [(1, 2), (9, 2), (9, 9)]
    with pytest.raises(Exception, match="geometry cannot be read"):
        annotations.geojson_regions(spark.createDataFrame([(json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}), "p")], "json string, uri string")).collect()


def test_images_become_pixels(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"\0" + bytes([10, 20, 30, 1, 2, 3]) + b"\0" + bytes([40, 50, 60, 7, 8, 9])
    (tmp_path / "s.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    got = {(r["r"], r["c"]): (r["red"], r["green"], r["blue"]) for r in from_images(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (10, 20, 30), (0, 1): (1, 2, 3), (1, 0): (40, 50, 60), (1, 1): (7, 8, 9)}


def test_sizes_that_are_no_sizes(spark):
    df = spark.createDataFrame([("12.5x",), ("",), ("x",), ("1.25x",), ("500",)], "s string")
    got = {r["s"]: r["k"] for r in df.select("s", slides.working_size(F.col("s"), F.lit(4000), F.lit(3000), F.lit(20.0))["kind"].alias("k")).collect()}
    assert got == {"12.5x": None, "": None, "x": None, "1.25x": "magnification", "500": "pixels"}


def test_tiles_lie_in_their_box(spark, sf):
    df = pixels(spark, sf).withColumn("m", F.col("red") < 124)
    box = {r["slide_id"]: r for r in tiles.tissue_boxes(df, "m").collect()}
    for t in tiles.grid(tiles.tissue_boxes(df, "m"), 10, 7, 1.0).collect():
        b = box[t["slide_id"]]
        assert b["left"] <= t["left"] and t["right"] <= b["right"] + 1 and b["top"] <= t["top"] and t["bottom"] <= b["bottom"] + 1


def test_arrivals_run_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        arrivals.processed(arrivals.arrivals(spark, str(tmp_path / "in"), "id long"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_steps_that_need_tables(spark, sf):
    with pytest.raises(ValueError, match="needs a table"):
        pipeline.folded(pixels(spark, sf), [pipeline.Step("classify_bayes", None, {"name": "ink"})])
    with pytest.raises(NameError, match="no such feature"):
        pipeline.with_features(pixels(spark, sf), ["rgb", "magic"])
    assert tables.split_pairs("C:\\a.png:C:\\b.png\n./x.png:./y.png") == [("C:\\a.png", "C:\\b.png"), ("./x.png", "./y.png")]


def test_example_pictures(spark, tmp_path):
    import struct
    import zlib

    def png(path, rows):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + bytes(r) for r in rows)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]) // 3, len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    png(tmp_path / "e.png", [[10, 20, 30, 1, 2, 3]])
    png(tmp_path / "m.png", [[0, 0, 0, 255, 255, 255]])
    rows = tables.exemplars(spark, [(str(tmp_path / "e.png"), str(tmp_path / "m.png"))]).orderBy("c").collect()
    assert [(r["red"], r["label"]) for r in rows] == [(10, 0), (1, 1)]
    h = tables.template_histograms(spark, str(tmp_path / "e.png"), 5)
    assert {r["template"] for r in h.collect()} == {"e"} and h.count() == 15
    (tmp_path / "t.tsv").write_text("Class\tR\tG\tB\n0\t1\t2\t3\n1\t9\t8\t7\n")
    assert [tuple(r) for r in tables.training_colours(spark, str(tmp_path / "t.tsv")).orderBy("label").collect()] == [(0, 1.0, 2.0, 3.0), (1, 9.0, 8.0, 7.0)]


def test_bright_clusters_of_every_slide(spark, sf):
    """A level a slide, by Lloyd's rounds over its own pixels."""
    from glasspane.functions.colour import gray
    from glasspane.queries.pixel_metrics import bright_kmeans
    from glasspane.sources.pixels import pixels

    want = {}
    for r in pixels(spark, sf).withColumn("v", gray()).groupBy("slide_id").agg(F.collect_list("v").alias("v")).collect():
        centres = [0.25, 0.5, 0.75]
        near = lambda v: min(range(3), key=lambda j: abs(v - centres[j]))
        for _ in range(5):
            parts = [[v for v in r["v"] if near(v) == j] for j in range(3)]
            centres = [round(sum(x) / len(x), 9) if x else c for x, c in zip(parts, centres)]
        bright = [v for v in r["v"] if near(v) == 2]
        want[r["slide_id"]] = sum(v > min(bright) for v in r["v"]) if bright else 0
    assert len(want) > 1
    assert {r["slide_id"]: r["bright"] for r in bright_kmeans(spark, sf).collect()} == want


def test_tsv_of_the_whole_table(spark, sf, monkeypatch):
    """All rows are written and read back."""
    from glasspane.queries import review_queries

    seen, read = [], review_queries.tables.metrics
    monkeypatch.setattr(review_queries.tables, "metrics", lambda s, path: seen.append(read(s, path)) or seen[0])
    review_queries.tsv_roundtrip(spark, sf)
    assert seen[0].count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_every_step_twice(spark, sf):
    """Labelled repeats: no step's columns get in the way of its second run."""
    px = pixels(spark, sf)
    params = {"intensity": {"name": "bright", "upper_threshold": ".6"}, "minimum_neighbourhood": {"disk_size": "1"}, "smoothness": {"kernel_size": "3", "min_object_size": "8"}, "fat_like": {"kernel_size": "3"}, "spur": {"disk_radius": "1"}, "area": {"area_threshold": "4"}, "keep_named": {"suffix": "first"}, "geojson": {"suffix": "outline"}, "blur": {"blur_radius": "1"}, "texture": {"npatches": "3", "patch_size": "8"}}
    names = "intensity otsu minimum_neighbourhood brightest smoothness fat_like fill_holes remove_small remove_large blur spur area pieces keep_named".split()
    one_slide = px.where("slide_id = 0")
    for name in names:
        step = pipeline.Step(name, None, params.get(name, {}))
        assert pipeline.metrics(pipeline.folded(one_slide, [step, step])).count() == 1


def test_a_failed_slide_leaves_the_others_alone(spark, sf, monkeypatch):
    from glasspane.operators import raster

    df = pixels(spark, sf).withColumn("m", F.col("red") < 124).withColumn("__failed", F.lit(None).cast("string"))

    def picky(x):
        if int(x["red"][0, 0]) == first:
            raise ValueError("unreadable")
        return {"out": x["m"]}

    first = df.where("slide_id = 0 and r = 0 and c = 0").first()["red"]
    got = raster.per_slide(raster.per_slide(df, picky, ["m", "red"], {"out": "boolean"}), lambda x: {"more": x["out"]}, ["out"], {"more": "boolean"})
    failed = {r["slide_id"]: r["e"] for r in got.groupBy("slide_id").agg(F.max("__failed").alias("e")).collect()}
    assert failed[0] == "ValueError: unreadable" and all(e is None or k == 0 for k, e in failed.items())
    state = pipeline.folded(pixels(spark, sf), [pipeline.Step("intensity", None, {"name": "a", "upper_threshold": ".6"}), pipeline.Step("final")])
    from dataclasses import replace

    bad = replace(state, df=state.df.withColumn("__failed", F.when(F.col("slide_id") == 0, "broken")))
    rows = {r["slide_id"]: r for r in pipeline.metrics(bad).collect()}
    assert rows[0]["status"] == "failed" and rows[0]["a"] is None and rows[0]["error"] == "broken"
    assert all(r["status"] == "done" and r["a"] is not None for k, r in rows.items() if k != 0)


def test_outputs_of_steps(spark, sf, tmp_path):
    """Pictures and outlines are made by steps, and read back as what they show; what cannot be made is a warning."""
    px = pixels(spark, sf).where("slide_id = 0")
    text = "[pipeline]\nsteps = LightDarkModule.getIntensityThresholdPercent:tissue\n SaveModule.saveMask\n SaveModule.saveMask:a\n SaveModule.saveMacro\n SaveModule.saveMask2Geojson:b\n SaveModule.saveThumbnails\n SaveModule.saveFinalMask\n[LightDarkModule.getIntensityThresholdPercent:tissue]\nname = bright\nupper_threshold = .6\n[SaveModule.saveMask:a]\nsuffix = mask_a\n[SaveModule.saveMask2Geojson:b]\nsuffix = out\n[SaveModule.saveThumbnails]\nsmall_dim = 16\n"
    steps, mode = pipeline.parsed(text)
    assert pipeline.bound(steps)[1] == []
    state = pipeline.folded(px, steps, mode)
    made = pipeline.outputs(state)
    assert set(made) == {"mask_a", "out", "thumb", "thumb_small", "mask_use", "fuse"}
    assert pipeline.metrics(state).first()["warnings"][:2] == ["Please set the suffix for mask use.", "Can't Read 'macro' Image from Slide's Associated Images"]
    for name in ("mask_a", "thumb", "thumb_small"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.png").write_bytes(made[name].first()["png"])
    back = from_images(spark, str(tmp_path / "thumb"))
    assert back.drop("slide_id").exceptAll(px.select("r", "c", "red", "green", "blue")).count() == 0 and back.count() == px.count()
    assert from_images(spark, str(tmp_path / "thumb_small")).agg(F.max("r"), F.max("c")).first() == (15, 15)
    mask = from_images(spark, str(tmp_path / "mask_a")).select("r", "c", (F.col("red") > 0).alias("m"))
    assert mask.exceptAll(state.df.select("r", "c", F.col("mask_mask_a").alias("m"))).count() == 0
    assert '"FeatureCollection"' in made["out"].first()["geojson"]
    head = pipeline.header(text, "now", "/out", arguments="-n 1")
    assert len(head) == 5 and head[0] == "#start_time:\tnow" and "LightDarkModule.getIntensityThresholdPercent:tissue" in head[1]


def test_local_threshold_and_feature_parameters(spark, sf):
    px = pixels(spark, sf).where("slide_id = 0 and r < 24 and c < 24")
    row = pipeline.metrics(pipeline.folded(px, [pipeline.Step("otsu", None, {"local": "True", "radius": "3", "name": "near"}), pipeline.Step("final")])).first()
    assert 0 < row["pixels_to_use"] < px.count()
    params = {"gabor_theta": "2", "gabor_sigma": "(1,)", "gabor_frequency": "(0.1, 0.2)", "median_disk_size": "1", "lbp_points": "4", "lbp_radius": "1", "frangi_scale_range": "(1, 4)", "gaussian_multichan": "True"}
    out, columns = pipeline.with_features(px, ["gabor", "median", "lbp", "frangi", "gaussian"], params)
    assert columns == ["gabor_0_1_10", "gabor_0_1_20", "gabor_1_1_10", "gabor_1_1_20", "median", "lbp", "frangi", "gaussian_red", "gaussian_green", "gaussian_blue"] or set(columns) >= {"gabor_1_1_20", "gaussian_blue"}
    assert out.agg(F.max("lbp")).first()[0] <= 15
    with pytest.raises(ValueError, match="binary pattern"):
        pipeline.features_of({"lbp_method": "magic"})


def test_pipelines_over_blocks(spark, sf):
    """The same metrics, whether kernels see whole slides or blocks of them."""
    px = pixels(spark, sf).where("slide_id < 2")
    step = pipeline.Step
    steps = [step("intensity", None, {"name": "bright", "upper_threshold": ".52"}), step("minimum_neighbourhood", None, {"disk_size": "1", "upper_threshold": "150"}), step("fill_holes", None, {"min_size": "6"}), step("blur", None, {"blur_radius": "1", "blur_threshold": ".05"}), step("spur", None, {"disk_radius": "1"}), step("final")]
    whole, cut = (sorted(pipeline.metrics(pipeline.folded(px, steps, block=b)).drop("completed").collect()) for b in (None, 24))
    assert len(whole) == 2 and whole == cut


def test_ridges_like_a_plain_loop(spark):
    """Windows of 16 over 24 x 40: what lies beyond is black; marks are joined across windows before small ones go."""
    rng = np.random.default_rng(6)
    a = rng.integers(120, 255, (24, 40))
    a[10:12, 2:38] = 20
    a[3:6, 20] = 30
    rows = [(1, r, c, *[int(a[r, c])] * 3) for r in range(24) for c in range(40)]
    df = spark.createDataFrame(rows, "slide_id long, r int, c int, red int, green int, blue int")
    grey = np.zeros((32, 48))
    grey[:24, :40] = a * (0.2125 + 0.7154 + 0.0721) / 255
    marks = np.zeros(grey.shape, bool)
    for i in range(0, 32, 16):
        for j in range(0, 48, 16):
            w = grey[i : i + 16, j : j + 16]
            marks[i : i + 16, j : j + 16] = kernels.without_small((kernels.ridges(w, (1, 3, 5), 0.5, 100.0) / 8.875854409275627e-08 > 5) & (w < 0.3), 3, 4)
    for least in (0, 150):
        want = kernels.without_small(marks, least, 4).mean()
        got = pipeline.metrics(pipeline.folded(df.limit(1), [pipeline.Step("roi_scan", None, {"name": "ridges", "win_size": "16", "area_threshold": str(least)})], sizes={"level 1": df}))
        assert raster.ridge_share(df, 16, least, "ridges", specks=3).first()["ridges"] == pytest.approx(want)
        assert got.first()["warnings"] == [] and got.first()["ridges"] >= 0
    assert 0 < want <= marks.mean()
    assert "No pixels of level 1" in pipeline.metrics(pipeline.folded(df, [pipeline.Step("roi_scan", None, {"win_size": "16"})])).first()["warnings"][0]


def test_tiles_are_screened_and_saved(spark):
    """Slide pixels at twice the mask's size; tiles that reach over the slide's edge are black there."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (40, 40, 3))
    a[:, 20:] = a[:, 20:, :1]  # grey
    own = spark.createDataFrame([(7, r, c, *a[r, c].tolist()) for r in range(40) for c in range(40)], "slide_id long, r int, c int, red int, green int, blue int")
    mask = spark.createDataFrame([(7, r, c, 9, 9, 9) for r in range(20) for c in range(20)], own.schema)
    params = {"tile_size": "12", "tile_stride": "10", "scale": "2", "screen": "saturation", "screen_limit": "30", "save": "True"}
    state = pipeline.folded(mask, [pipeline.Step("tiles", None, params)], sizes={"slide": own})
    windows = [w for region in json.loads(pipeline.metrics(state).first()["tiles"]) for w in region]
    every = [w for region in json.loads(pipeline.metrics(pipeline.folded(mask, [pipeline.Step("tiles", None, {k: v for k, v in params.items() if k[:2] != "sc" or k == "scale"})])).first()["tiles"]) for w in region]
    assert windows == [w for w in every if (lambda t: (t.max(axis=2) - t.min(axis=2)).mean() >= 30)(a[w[1] : w[3], w[0] : w[2]])] and 0 < len(windows) < len(every)
    for r in pipeline.outputs(state)["tiles"].collect():
        assert (kernels.unpng(bytes(r["png"])) == a[r["top"] : r["bottom"], r["left"] : r["right"]]).all()
    over = spark.createDataFrame([(7, 0, -3, 36, 9, 48)], "slide_id long, region long, left int, top int, right int, bottom int")
    out = kernels.unpng(bytes(tiles.pictures(over, own, 16).first()["png"]))
    assert out.shape == (12, 12, 3) and (out[:4, 3:] == a[36:, :9]).all() and not out[4:].any() and not out[:, :3].any()
    assert "neither screened" in pipeline.metrics(pipeline.folded(mask, [pipeline.Step("tiles", None, params)])).first()["warnings"][0]


def test_what_steps_save(spark, sf):
    """The overlay is the mask, the luminance and the mask; outlines are in slide pixels; an empty mask is a warning."""
    px = pixels(spark, sf).where("slide_id < 2")
    step = pipeline.Step
    state = pipeline.folded(px, [step("intensity", None, {"name": "x", "upper_threshold": ".5"}), step("geojson", None, {"suffix": "out"}), step("keep")], scale=4.0)
    made = pipeline.outputs(state)
    out = {r["slide_id"]: kernels.unpng(bytes(r["png"])) for r in made["fuse"].collect()}
    for r in state.df.where("slide_id = 1 and r < 3").collect():
        grey = round(0.2125 * r["red"] + 0.7154 * r["green"] + 0.0721 * r["blue"])
        assert (out[1][r["r"], r["c"]] == [255 * r["final"], out[1][r["r"], r["c"], 1], 255 * r["final"]]).all() and abs(int(out[1][r["r"], r["c"], 1]) - grey) <= 1
    corners = {x for f in json.loads(made["out"].first()["geojson"])["features"] for ring in f["geometry"]["coordinates"] for p in ring for x in p}
    assert all(x % 4 == 0 for x in corners) and max(corners) > 64
    assert set(pipeline.outputs(pipeline.folded(px, [step("keep", None, {"use_mask": "False"})]))) == {"mask_use"}
    none = pipeline.metrics(pipeline.folded(px, [step("intensity", None, {"name": "x", "upper_threshold": "-1"}), step("geojson", None, {"suffix": "out"}), step("final")])).first()["warnings"]
    assert any("No contour detected" in w for w in none)
    row = pipeline.metrics(pipeline.folded(px, [step("texture", None, {"npatches": "2", "patch_size": "8", "feats": "contrast:energy"}), step("keep_named", None, {"suffix": "red"}), step("contrast", None, {"mask_name": "img_mask_red"})])).columns
    assert {"contrast", "contrast_std", "energy"} <= set(row) and "homogeneity" not in row


def test_annotations_by_slide(spark, sf, tmp_path):
    shape = '{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}, "properties": {}}'
    (tmp_path / "0_ann.geojson").write_text(shape)
    px = pixels(spark, sf).where("slide_id < 2")
    step = lambda kind: pipeline.Step("annotation", None, {"format": kind, "file_path": str(tmp_path), "suffix": "_ann"})
    rows = {r["slide_id"]: r["pixels_to_use"] for r in pipeline.metrics(pipeline.folded(px, [step("geojson"), pipeline.Step("final")])).collect()}
    assert 80 <= rows[0] <= 121 and rows[1] == px.where("slide_id = 1").count()
    assert "unsupported" in pipeline.metrics(pipeline.folded(px, [step("doc"), pipeline.Step("final")])).first()["warnings"][0]
