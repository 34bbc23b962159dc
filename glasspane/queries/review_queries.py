"""Review queries on wide tables, text handling, incremental work and streaming."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F

from ..operators import review
from ..session import ranked, shared_folder, table
from ..sources import slides, tables
from ..streaming import arrivals
from .registry import query, r6, rounded


def lines(spark, d):
    return table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


KEY = "l_orderkey * 10 + l_linenumber AS id"


@query("brush_and", f"SELECT {KEY}, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05")
def brush_and(spark, d):
    return lines(spark, d).where(review.brush({"l_quantity": [(10, 20)], "l_discount": [(0.02, 0.05)]})).select("id", "l_quantity", "l_discount")


@query("brush_or", f"SELECT {KEY}, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 48 AND 50 OR l_discount BETWEEN 0.095 AND 0.2")
def brush_or(spark, d):
    return lines(spark, d).where(review.brush({"l_quantity": [(48, 50)], "l_discount": [(0.095, 0.2)]}, "or")).select("id", "l_quantity", "l_discount")


@query("brush_multi", f"SELECT {KEY}, l_quantity, l_tax FROM lineitem WHERE (l_quantity BETWEEN 1 AND 3 OR l_quantity BETWEEN 45 AND 46) AND l_tax BETWEEN 0.01 AND 0.06")
def brush_multi(spark, d):
    return lines(spark, d).where(review.brush({"l_quantity": [(1, 3), (45, 46)], "l_tax": [(0.01, 0.06)], "l_discount": []})).select("id", "l_quantity", "l_tax")


@query("brush_none", "SELECT count(*) AS n FROM lineitem")
def brush_none(spark, d):
    return lines(spark, d).where(review.brush({})).agg(F.count(F.lit(1)).alias("n"))


_SCALED = f"WITH e AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0, max(l_extendedprice) AS p1 FROM lineitem), s AS (SELECT {KEY}, (l_quantity - q0) / (q1 - q0) AS a, (l_extendedprice - p0) / (p1 - p0) AS b FROM lineitem, e)"


@query("strum", f"{_SCALED} SELECT id FROM s WHERE (a + (b - a) * 0.2::DOUBLE - 0.1::DOUBLE) * (a + (b - a) * 0.8::DOUBLE - 0.6::DOUBLE) <= 0")
def strum(spark, d):
    return review.strum(lines(spark, d), "l_quantity", "l_extendedprice", ((0.8, 0.6), (0.2, 0.1))).select("id")


@query("angular_brush", f"{_SCALED} SELECT id FROM s WHERE atan2(b - a, 1.0::DOUBLE) BETWEEN -0.3 AND -0.1")
def angular_brush(spark, d):
    return review.angular(lines(spark, d), "l_quantity", "l_extendedprice", -0.3, -0.1).select("id")


POLYGON = [(5.0, 1000.0), (40.0, 5000.0), (30.0, 60000.0), (10.0, 30000.0)]


def _inside(x: str, y: str) -> str:
    hits = [f"(CASE WHEN ({y1}::DOUBLE > {y}) <> ({y2}::DOUBLE > {y}) AND {x} < {x2 - x1}::DOUBLE * ({y} - {y1}::DOUBLE) / {y2 - y1}::DOUBLE + {x1}::DOUBLE THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]])]
    return f"({' + '.join(hits)}) % 2 = 1"


@query("lasso", f"SELECT {KEY}, l_quantity, l_extendedprice FROM lineitem WHERE {_inside('l_quantity', 'l_extendedprice')}")
def lasso(spark, d):
    return lines(spark, d).where(review.in_polygon(F.col("l_quantity"), F.col("l_extendedprice"), POLYGON)).select("id", "l_quantity", "l_extendedprice")


@query("lasso_semi", f"SELECT p_partkey, p_name FROM part WHERE {_inside('p_size', 'p_retailprice * 10')}")
def lasso_semi(spark, d):
    part = table(spark, d, "part").withColumn("y", F.col("p_retailprice") * 10).withColumn("x", F.col("p_size").cast("double"))
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(POLYGON, [*POLYGON[1:], POLYGON[0]])], "x1 double, y1 double, x2 double, y2 double")
    return part.join(review.lasso_ids(part, "p_partkey", "x", "y", edges), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("lasso_empty", "SELECT count(*) AS n FROM part")
def lasso_empty(spark, d):
    return table(spark, d, "part").where(review.in_polygon(F.col("p_size"), F.col("p_retailprice"), [])).agg(F.count(F.lit(1)).alias("n"))


@query("sort_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def sort_page(spark, d):
    return review.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 2, 25, ascending=False)


@query("page_clamped", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name, n_nationkey LIMIT 10 OFFSET 20")
def page_clamped(spark, d):
    return review.page(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", "n_nationkey", 99, 10)


@query("row_numbers", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS row FROM supplier")
def row_numbers(spark, d):
    return review.row_numbers(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


@query("random_subset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def random_subset(spark, d):
    return review.random_subset(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 7)


@query(
    "ordered_groups",
    """WITH g AS (SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1),
v AS (SELECT unnest(['1-URGENT', '5-LOW', '0-NEVER', '3-MEDIUM']) AS o_orderpriority)
SELECT v.o_orderpriority, n, top, kinds, row_number() OVER (ORDER BY n DESC NULLS LAST, v.o_orderpriority) AS place FROM v LEFT JOIN g ON g.o_orderpriority = v.o_orderpriority""",
)
def ordered_groups(spark, d):
    aggregators = {"n": F.count(F.lit(1)), "top": F.max("o_totalprice"), "kinds": F.count_distinct("o_orderstatus")}
    return review.ordered_groups(table(spark, d, "orders"), "o_orderpriority", aggregators, ["1-URGENT", "5-LOW", "0-NEVER", "3-MEDIUM"], [F.col("n").desc_nulls_last()])


@query("sort_lexicographic", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey::VARCHAR, s_suppkey) AS place FROM supplier")
def sort_lexicographic(spark, d):
    return ranked(table(spark, d, "supplier").select("s_suppkey"), [F.col("s_suppkey").cast("string"), F.col("s_suppkey")])


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return review.ordered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", False).limit(10)


@query("argmax_per_group", "SELECT o_orderpriority, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_orderpriority")
def argmax_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


def _totals(c: str) -> str:
    return f"{r6(f'avg({c})')} AS avg_{c}, {r6(f'min({c})')} AS min_{c}, {r6(f'max({c})')} AS max_{c}, round(sum({c}), 2)::DOUBLE AS sum_{c}, count(*) AS count_{c}"


def _even(df):
    """Sums to two places, the rest to six."""
    return df.select(*[(F.round(c, 2 if c.startswith("sum_") else 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("group_totals", f"SELECT l_returnflag, l_linestatus, {_totals('l_quantity')} FROM lineitem GROUP BY ALL")
def group_totals(spark, d):
    return _even(review.group_totals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"]))


@query("rollup_totals", f"SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, {_totals('l_extendedprice')} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, d):
    return _even(review.group_totals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice"], nested=True))


@query("child_group_totals", "SELECT o_orderstatus, count(*) AS groups, max(n) AS largest, sum(n)::BIGINT AS orders FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def child_group_totals(spark, d):
    inner = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return inner.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"), F.sum("n").alias("orders"))


@query("page_then_group", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2)::DOUBLE AS total FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 100) GROUP BY o_orderstatus")
def page_then_group(spark, d):
    shown = review.page(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 1, 100)
    return shown.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_AXES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("axis_summary", " UNION ALL ".join(f"SELECT '{c}' AS axis, count({c}) AS count, round(avg({c}), 3)::DOUBLE AS mean, round(stddev_samp({c}), 3)::DOUBLE AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem" for c in _AXES))
def axis_summary(spark, d):
    return review.axis_summary(table(spark, d, "lineitem"), _AXES)


@query("axis_extents", " UNION ALL ".join(f"SELECT '{c}' AS axis, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM lineitem" for c in _AXES))
def axis_extents(spark, d):
    return review.extents(table(spark, d, "lineitem"), _AXES)


@query("common_scale", "SELECT unnest(['l_quantity', 'l_discount']) AS axis, least(min(l_quantity), min(l_discount))::DOUBLE AS low, greatest(max(l_quantity), max(l_discount))::DOUBLE AS high FROM lineitem")
def common_scale(spark, d):
    return review.extents(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], common=True)


@query("text_axis_order", "SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def text_axis_order(spark, d):
    return review.by_frequency(table(spark, d, "part"), "p_brand")


@query("axis_order_by_row", "SELECT (row_number() OVER (ORDER BY v, axis) - 1)::INT AS place, axis FROM (SELECT unnest([p_size::DOUBLE, p_retailprice, p_partkey::DOUBLE]) AS v, unnest(['p_size', 'p_retailprice', 'p_partkey']) AS axis FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))")
def axis_order_by_row(spark, d):
    part = table(spark, d, "part")
    return review.axis_order(part, "p_partkey", part.agg(F.min("p_partkey")).first()[0], ["p_size", "p_retailprice", "p_partkey"])


@query("bundle_centroids", f"SELECT p_brand, {r6('avg(p_size)')} AS p_size, {r6('avg(p_retailprice)')} AS p_retailprice FROM part GROUP BY p_brand")
def bundle_centroids(spark, d):
    return rounded(review.bundle_centroids(table(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"]))


@query("violin_hist", "SELECT floor(l_extendedprice / 500.0::DOUBLE) * 500.0::DOUBLE AS bin, count(*) AS n FROM lineitem GROUP BY bin")
def violin_hist(spark, d):
    return review.violin_histogram(table(spark, d, "lineitem"), "l_extendedprice", 500.0)


@query(
    "stateful_groups",
    f"""WITH m AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), o AS (SELECT l_returnflag, l_quantity FROM m QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) = 1),
g AS (SELECT l_returnflag, count(*) AS n, {r6("var_samp(l_extendedprice)")} AS spread, {r6("exp(avg(ln(l_extendedprice)))")} AS middle, {r6("max(l_discount) - min(l_discount)")} AS span FROM lineitem GROUP BY l_returnflag)
SELECT g.*, o.l_quantity AS usual, row_number() OVER (ORDER BY spread DESC, g.l_returnflag) AS place FROM g JOIN o USING (l_returnflag)""",
)
def stateful_groups(spark, d):
    """Groups compared by an aggregate that merges states, beside others that do."""
    wanted = {"spread": ("spread", "l_extendedprice"), "middle": ("geometric_mean", "l_extendedprice"), "span": ("range", "l_discount"), "usual": ("mode", "l_quantity")}
    return rounded(review.ordered_groups(table(spark, d, "lineitem"), "l_returnflag", {"n": F.count(F.lit(1))}, None, [F.col("spread").desc_nulls_last()], wanted))


TICKS = [k / 4 for k in range(201)]


@query("kde", f"SELECT t.k / 4.0::DOUBLE AS tick, {r6('coalesce(sum(0.75::DOUBLE * (1 - ((t.k / 4.0::DOUBLE - l_quantity) / 0.3::DOUBLE) * ((t.k / 4.0::DOUBLE - l_quantity) / 0.3::DOUBLE)) / 0.3::DOUBLE) FILTER (abs(t.k / 4.0::DOUBLE - l_quantity) <= 0.3::DOUBLE), 0) / count(*)')} AS density FROM range(201) t(k), lineitem GROUP BY t.k")
def kde(spark, d):
    return rounded(review.kernel_density(table(spark, d, "lineitem"), "l_quantity", TICKS))


@query("numeric_infer", "SELECT p_partkey, try_cast(split_part(p_name, ' ', 1) AS DOUBLE) AS from_name, try_cast(trim(regexp_replace(p_brand, '[^0-9]', '', 'g')) AS DOUBLE) AS from_brand FROM part")
def numeric_infer(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.split("p_name", " ")[0].alias("a"), F.regexp_replace("p_brand", "[^0-9]", "").alias("b"))
    return part.select("p_partkey", review.numeric_if_all(part, "a").alias("from_name"), review.numeric_if_all(part, "b").alias("from_brand"))


@query("numeric_columns", "SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS axis")
def numeric_columns(spark, d):
    return spark.createDataFrame([(c,) for c in review.numeric_columns(table(spark, d, "lineitem"))], "axis string")


@query("tsv_roundtrip", "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, o_orderpriority FROM orders")
def tsv_roundtrip(spark, d):
    """The metric table written with its header and read back with inference."""
    path = f"{shared_folder(spark)}/tsv-{uuid.uuid4().hex}"
    tables.export(table(spark, d, "orders"), path, ["#start_time:\tnow"], ["o_orderkey", "o_totalprice", "o_orderpriority"])
    return tables.metrics(spark, path).select("o_orderkey", "o_totalprice", "o_orderpriority")


# --- slides' metadata -----------------------------------------------------------------------------------




def _slides(spark, d):
    """Property bags made from parts: some properties are missing or no numbers."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    pairs = [("openslide.vendor", F.when(key % 5 != 0, F.col("p_brand"))), ("openslide.objective-power", F.when(key % 3 == 0, size).when(key % 3 == 1, F.lit("n/a"))), ("aperio.AppMag", F.when(key % 2 == 0, size)), ("openslide.comment", F.concat(F.col("p_type"), F.lit("\n"), size)), ("openslide.bounds-x", size), ("openslide.bounds-y", F.lit("3")), ("openslide.bounds-width", F.when(key % 4 != 0, size)), ("openslide.bounds-height", F.lit("12"))]
    bag = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]), lambda x: x["v"].isNotNull()))
    return table(spark, d, "part").select(F.col("p_partkey").alias("slide_id"), bag.alias("properties"))


@query("property_lookup", "SELECT p_partkey AS slide_id, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE 'NA' END AS type, 'NA' AS levels, 'NA' AS height, 'NA' AS width, 'NA' AS mpp_x, 'NA' AS mpp_y, p_type || ' ' || p_size AS comment FROM part")
def property_lookup(spark, d):
    return slides.basic(_slides(spark, d))


@query("bounding_box", "SELECT p_partkey AS slide_id, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS x, CASE WHEN p_partkey % 4 <> 0 THEN 3 END AS y, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS w, CASE WHEN p_partkey % 4 <> 0 THEN 12 END AS h FROM part")
def bounding_box(spark, d):
    return _slides(spark, d).select("slide_id", slides.bounds().alias("b")).select("slide_id", "b.*")


@query("magnification_parse", "SELECT p_partkey AS slide_id, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE 20.0 END AS magnification FROM part")
def magnification_parse(spark, d):
    return _slides(spark, d).select("slide_id", slides.magnification(20.0).alias("magnification"))


_TEXTS = "CASE p_partkey % 7 WHEN 0 THEN (p_size % 9 + 1) || 'x' WHEN 1 THEN '.5' WHEN 2 THEN (p_size * 10 + 100)::VARCHAR WHEN 3 THEN '12.5x' WHEN 4 THEN '1.25X' WHEN 5 THEN (p_size % 9)::VARCHAR ELSE 'big' END"


@query(
    "size_grammar",
    f"""WITH t AS (SELECT p_partkey AS slide_id, {_TEXTS} AS s FROM part), n AS (SELECT *, try_cast(regexp_replace(s, '[xX]$', '') AS DOUBLE) AS n, upper(right(s, 1)) = 'X' AS p FROM t WHERE regexp_full_match(s, '\\d?\\.?\\d*[xX]?') AND regexp_matches(s, '\\d')),
f AS (SELECT *, CASE WHEN p THEN 20.0 / nullif(n, 0) WHEN n < 1 THEN 1.0 / nullif(n, 0) WHEN n >= 100 THEN 4000 / n END AS factor FROM n)
SELECT t.slide_id, t.s AS size, CASE WHEN f.p THEN 'magnification' WHEN f.n < 1 THEN 'factor' WHEN f.n < 100 THEN 'level' WHEN f.n >= 100 THEN 'pixels' END AS kind, {r6("factor")} AS factor,
CASE WHEN NOT f.p AND f.n >= 100 THEN f.n::INT ELSE round_even(4000 / factor, 0)::INT END AS width, CASE WHEN NOT f.p AND f.n >= 100 THEN floor(3000 / factor)::INT ELSE round_even(3000 / factor, 0)::INT END AS height
FROM t LEFT JOIN f ON f.slide_id = t.slide_id""",
)
def size_grammar(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("slide_id"), F.expr(_TEXTS.replace("::VARCHAR", "").replace("(p_size * 10 + 100)", "cast(p_size * 10 + 100 as string)").replace("(p_size % 9)", "cast(p_size % 9 as string)").replace("(p_size % 9 + 1) ||", "cast(p_size % 9 + 1 as string) ||")).alias("size"))
    s = slides.working_size(F.col("size"), F.lit(4000), F.lit(3000), F.lit(20.0))
    return rounded(t.select("slide_id", "size", s.alias("s")).select("slide_id", "size", "s.kind", "s.factor", "s.width", "s.height"))


@query("level_choice", "WITH f AS (SELECT p_partkey AS slide_id, p_size / 2.0::DOUBLE AS f FROM part) SELECT slide_id, (CASE WHEN abs(f - 1) <= 0.01 * f THEN 0 WHEN abs(f - 4) <= 0.01 * f THEN 1 WHEN abs(f - 16) <= 0.01 * f THEN 2 WHEN f >= 16 THEN 2 WHEN f >= 4 THEN 1 ELSE 0 END)::INT AS level FROM f")
def level_choice(spark, d):
    f = F.col("p_size") / F.lit(2.0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("slide_id"), slides.nearest_level(f, F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0)))["level"].alias("level"))


# --- incremental work ---------------------------------------------------------------------------------------


@query("skip_completed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def skip_completed(spark, d):
    done = table(spark, d, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return tables.unfinished(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("batch_rotation", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders")
def batch_rotation(spark, d):
    return tables.batched(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("failure_count", "SELECT count(*) FILTER (event_type = 'error') AS failed, count(*) AS slides FROM events")
def failure_count(spark, d):
    return table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count(F.lit(1)).alias("slides"))


@query("json_properties", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("labels_left_join", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def labels_left_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("stream_daily_arrivals", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def stream_daily_arrivals(spark, d):
    """A stream over the events table, run to its end; its sink is a table of the session."""
    import uuid

    source = table(spark, d, "events")
    name = f"daily_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    running = arrivals.daily(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


