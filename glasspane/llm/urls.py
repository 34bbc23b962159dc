"""URL filters by a path-template tree.

Fixed rules decide the urls they fit; the longest rule wins. All urls are judged by a tree of path templates, learned
per host from the rules' verdicts as labels; where no rule fits, that judgement is the verdict.

Segments with a digit are wildcards. At every depth, sibling branches become a wildcard where they are alike: with
labels on both sides, where a branch's share of blocked urls does not differ from that of its siblings of the same
shape (a two-proportion test); where either has no labels, if they are of the same shape and of like fan-out, within a
factor of FANOUT. The shape of a branch: letters only or not, and whether wildcards, words or neither follow. Urls of
one template share their labels. A template's purity is the share of blocked urls among its labelled ones, smoothed
towards the purity of the template above it with WEIGHT labels' worth and towards PRIOR with PULL labels' worth, and
so on up to the host: one without labels has the purity of what stands above it, less sure with each segment. From
``reject_from`` on it is rejected.

Null urls and urls without ``://`` have an empty host and path. Repeated rows and ties count each for itself;
a null page_id is carried along. An empty table gives no rows. Other columns are ignored. Counts are gathered
by path before anything else, and hot hosts, branches and paths are joined where they stand (``hot_join``).
Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Shelf, hot_join

#: Verdict, host and path of each rule (fixed values).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
WEIGHT, PULL, PRIOR, REJECT_FROM, DEVIATIONS, FANOUT = 4.0, 2.0, 0.25, 0.75, 1.96, 2.0


def parts(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def fitting(rules: tuple, host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def chained(host: Column, segments: Column) -> Column:
    """A hash for the host and one for each path from it to a segment."""
    return F.aggregate(segments, F.array(F.xxhash64(host)), lambda a, s: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), s))))


def templated(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, given (the rule's verdict), segments, nodes (their hashes, the host's first) and leaf (the last)."""
    host, path = parts(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = fitting(rules, F.col("host"), F.col("path"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), "*").otherwise(x))
    base = base.select("*", name.alias("rule"), verdict.alias("given"), segments.alias("segments"))
    return base.withColumn("nodes", chained(F.col("host"), F.col("segments"))).withColumn("leaf", F.element_at("nodes", -1))


def alike(l: Column, b: Column, f: Column, k: Column, lt: Column, bt: Column, ft: Column) -> Column:  # noqa: E741
    """Whether a branch (labelled, blocked, fan-out) is like the others of its k siblings (with it: lt, bt, ft)."""
    lo, bo, fo, pooled = lt - l, bt - b, F.try_divide(ft - f, k - 1), F.try_divide(bt, lt)
    near = F.abs(F.try_divide(b, l) - F.try_divide(bo, lo)) <= DEVIATIONS * F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), l) + F.try_divide(F.lit(1), lo)))
    return (k > 1) & F.when((l > 0) & (lo > 0), near).otherwise(FANOUT * F.least(f, fo) >= F.greatest(f, fo))


def merged(leaves: DataFrame, shelf: Shelf) -> DataFrame:
    """node, leaves: the branches that their siblings are like."""
    levels = leaves.select("labelled", "blocked", F.explode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("segments")).alias("parent"), F.slice("nodes", F.lit(2), F.size("segments")).alias("node"), F.col("segments").alias("segment"))).alias("x")).select("labelled", "blocked", "x.*")
    child = shelf.put(levels.groupBy("parent", "node", "segment").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("leaves")), "branches")
    fan = child.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("f"), F.bool_or(F.col("segment") == "*").alias("wild"), F.bool_or(F.col("segment") != "*").alias("plain"))
    shape = F.struct(F.col("segment").rlike("^[A-Za-z]+$"), "wild", "plain")
    kids = child.where("segment <> '*'").join(fan, "node", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    kids = shelf.put(kids.withColumn("family", F.xxhash64("parent", shape)), "siblings")
    families = kids.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("l").alias("lt"), F.sum("b").alias("bt"), F.sum("f").alias("ft"))
    both = hot_join(kids, shelf.put(families, "families"), "family", "k", kids.count())
    return shelf.put(both.where(alike(*map(F.col, ("l", "b", "f", "k", "lt", "bt", "ft")))).select("node", "leaves"), "merged")


def verdicts(pages: DataFrame, rules: tuple = RULES, reject_from: float = REJECT_FROM, hidden: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, method (what the method says). hidden: on the result's page_id, host or path, rows whose labels the tree is not to see."""
    shelf = Shelf(pages.sparkSession, "urls")
    urls = templated(pages, rules)
    seen = urls if hidden is None else urls.withColumn("given", F.when(~hidden, F.col("given")))
    leaves = seen.groupBy("leaf").agg(*[F.any_value(c).alias(c) for c in ("host", "segments", "nodes")], F.count(F.lit(1)).alias("urls"), F.count("given").alias("labelled"), F.count_if(F.col("given") == "block").alias("blocked"))
    leaves = shelf.put(leaves, "leaves")
    n = leaves.count()
    steps = leaves.select("leaf", F.posexplode(F.slice("nodes", F.lit(2), F.size("segments"))).alias("depth", "node"))
    wild = hot_join(steps, merged(leaves, shelf), "node", "leaves", n).groupBy("leaf").agg(F.collect_set("depth").alias("wild"))
    template = F.transform("segments", lambda s, i: F.when(F.coalesce(F.array_contains("wild", i), F.lit(False)), "*").otherwise(s))
    grown = leaves.join(wild, "leaf", "left").withColumn("template", template)
    grown = shelf.put(grown.select("leaf", "urls", "labelled", "blocked", "template", chained(F.col("host"), F.col("template")).alias("nodes")), "templates")
    steps = grown.select("leaf", "labelled", "blocked", F.posexplode("nodes").alias("depth", "node"))
    sums = shelf.put(steps.groupBy("node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("leaves")), "sums")
    chain = hot_join(steps.select("leaf", "depth", "node"), sums, "node", "leaves", n).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "l", "b"))).alias("chain"))
    purity = F.aggregate("chain", F.lit(PRIOR), lambda p, x: (x["b"] + WEIGHT * p + PULL * PRIOR) / (x["l"] + WEIGHT + PULL))
    judged = grown.join(chain, "leaf").select("leaf", "urls", F.array_join("template", "/").alias("template"), F.round(purity, 6).alias("purity"))
    found = hot_join(urls.drop("segments", "nodes"), shelf.put(judged, "judged"), "leaf", "urls", pages.count())
    method = F.when(F.col("purity") >= reject_from, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "template", "purity", method.alias("method"))


def verdicts_sql() -> str:
    """The same in DuckDB's SQL."""
    name = verdict = ""
    for what, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        name, verdict = name + f" WHEN {fits} THEN '{h}{p}'", verdict + f" WHEN {fits} THEN '{what}'"
    return f"""WITH base AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
urls AS (SELECT *, CASE{name} END AS rule, CASE{verdict} END AS given,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS segs FROM base),
leaf AS (SELECT host, segs, count(given) AS l, count(*) FILTER (given = 'block') AS b FROM urls GROUP BY host, segs),
level AS (SELECT host, segs, d, segs[1:d] AS node, segs[1:d - 1] AS parent, segs[d] AS seg, l, b FROM leaf, unnest(range(1, len(segs) + 1)) t(d)),
child AS (SELECT host, parent, node, seg, sum(l) AS l, sum(b) AS b FROM level GROUP BY ALL),
fan AS (SELECT host, parent AS node, count(*) AS f, bool_or(seg = '*') AS stars, bool_or(seg <> '*') AS words FROM child GROUP BY ALL),
kid AS (SELECT c.*, coalesce(f.f, 0) AS f, stars, words, regexp_matches(seg, '^[A-Za-z]+$') AS plain FROM child c LEFT JOIN fan f ON c.host = f.host AND c.node = f.node WHERE seg <> '*'),
kin AS (SELECT *, count(*) OVER w AS k, sum(l) OVER w - l AS lo, sum(b) OVER w - b AS bo, (sum(f) OVER w - f) / nullif(count(*) OVER w - 1, 0) AS fo FROM kid WINDOW w AS (PARTITION BY host, parent, plain, stars, words)),
merged AS (SELECT host, node FROM kin WHERE k > 1 AND CASE WHEN l > 0 AND lo > 0
  THEN abs(b / l - bo / lo) <= {DEVIATIONS} * sqrt((b + bo) / (l + lo) * (1 - (b + bo) / (l + lo)) * (1 / l + 1 / lo)) ELSE {FANOUT} * least(f, fo) >= greatest(f, fo) END),
wild AS (SELECT v.host, v.segs, list(v.d) AS ds FROM level v JOIN merged m ON v.host = m.host AND v.node = m.node GROUP BY v.host, v.segs),
grown AS (SELECT f.host, f.segs, f.l, f.b, list_transform(range(1, len(f.segs) + 1), lambda i: CASE WHEN list_contains(coalesce(w.ds, []), i) THEN '*' ELSE f.segs[i] END) AS template
  FROM leaf f LEFT JOIN wild w ON f.host = w.host AND f.segs = w.segs),
step AS (SELECT host, segs, d, template[1:d] AS node, l, b FROM grown, unnest(range(0, len(template) + 1)) t(d)),
sums AS (SELECT host, node, sum(l) AS l, sum(b) AS b FROM step GROUP BY host, node),
chain AS (SELECT s.host, s.segs, list({{'l': t.l::DOUBLE, 'b': t.b::DOUBLE, 'p': 0::DOUBLE}} ORDER BY s.d) AS c FROM step s JOIN sums t ON s.host = t.host AND s.node = t.node GROUP BY s.host, s.segs),
judged AS (SELECT g.host, g.segs, array_to_string(template, '/') AS template,
  round(list_reduce(list_prepend({{'l': 0::DOUBLE, 'b': 0::DOUBLE, 'p': {PRIOR}::DOUBLE}}, c), lambda a, x: {{'l': 0::DOUBLE, 'b': 0::DOUBLE, 'p': (x.b + {WEIGHT}::DOUBLE * a.p + {PULL * PRIOR}::DOUBLE) / (x.l + {WEIGHT + PULL}::DOUBLE)}}).p, 6) AS purity
  FROM grown g JOIN chain h ON g.host = h.host AND g.segs = h.segs)
SELECT page_id, u.host, path, rule, coalesce(given, CASE WHEN purity >= {REJECT_FROM} THEN 'block' ELSE 'allow' END) AS verdict, template, purity, CASE WHEN purity >= {REJECT_FROM} THEN 'block' ELSE 'allow' END AS method
FROM urls u JOIN judged j ON u.host = j.host AND u.segs = j.segs"""
