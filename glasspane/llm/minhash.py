"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the distinct ``size``-word shingles of its whole text (hashed to 63 bits; with
fewer words the whole sequence is one shingle; without words it is empty and linked with nothing).
Two documents are linked if the Jaccard similarity of their sets is at least ``percent`` / 100.

1. Sketch: the ``retained`` smallest hashes of a set; sets of up to ``full`` shingles are kept whole.
2. Documents of equal sets are one class; only classes go on, so exact copies never meet in pairs.
3. Inverted lists hold the ``posted`` smallest values of each class. A list order common to all (rare
   values first) lets a class post only its first few: two sets that are similar enough share one of
   those. Short lists give all their pairs. In a long list each class pairs with the list's hub, of the classes of
   about its size the one that has least of its own.
4. Union sketches estimate the similarity of each pair (five standard errors of slack); where both
   sets are kept whole this is the exact value. Otherwise the exact Jaccard of the full sets decides.
5. Classes of long lists then meet across components only, so that no link that would join components is missed and
   members of one component are not compared again. Two that are kept whole meet at their first common value in the
   order of all values that such classes share, rare ones first: what they can have in common is what each shares from
   there on, and must be enough for a pair of their sizes. This bound is exact. Of a large group of near copies, each
   changed in its own places, only those meet whose changes are few enough. How many classes share a value is counted
   by what sets each class apart from a hub of its lists, not by all it holds; two classes of one hub are as far apart
   as these differences are, so that only similar ones of them leave the join.
6. Where one of the two is not kept whole they meet by windows, which are two retained values that stand next to each
   other in a class's sketch: two sets that are similar enough have several windows in common, and two that share a
   common passage only seldom do. Again rare ones come first, and a class posts only so many that MET common ones are
   among them (or all there are). A pair is met once, at the first common window of this order, and goes on only if
   there are windows enough behind it and MET common ones among the posted. A window (or value) of many classes is
   dealt in pairs of blocks.

Rows with a null doc_id link with nothing: component_id null, kept true. Null and empty texts: no
shingles, kept. Repeated rows count as copies of each other, one result row each; of rows that repeat
a doc_id all have that id as doc_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Shelf, hot_join, in_batches
from .words import UNSPACED, Words, chunks, one

RETAINED, FULL, POSTED, LONG_LIST = 128, 256, 64, 24
#: Classes that share a window are joined in pairs of blocks of about so many of them.
BLOCK = 1000
#: Pairs with fewer common windows than this (or than any similar pair of theirs has) are not compared.
MET = 8


def shingle_sets(texts: list, size: int):
    """The sorted distinct shingle hashes of each text."""
    for _, own in chunks(texts):
        words = Words(own, UNSPACED)
        windows = words.windows(size) >> np.uint64(1)
        for k in range(len(own)):
            a, b = words.first[k], words.first[k + 1]
            if b - a >= size:
                found = np.sort(windows[a : b - size + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                yield np.array([one(words.hashes[a:b]) >> np.uint64(1)], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64)))


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, size: int, whole: bool = False) -> DataFrame:
    """doc_id, n, same (fingerprint of the set, null if empty), values: the sketch, or the whole set."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = list(shingle_sets(part.column(1).to_pylist(), size))
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                kept = [s if whole or len(s) <= FULL else s[:RETAINED] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), _lists(kept)], names=["doc_id", "n", "same", "values"])

    return in_batches(_text_rows(docs), run, "doc_id long, n long, same binary, values array<long>")


def slack(n: Column, drawn: int, percent: int) -> Column:
    """Five standard errors of the share of common values among ``drawn`` of a union of at least n."""
    p = percent / 100
    return 5 * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / drawn * (1 - drawn / (n / p))))


def prefix_length(n: Column, percent: int) -> Column:
    """So many of a class's posted values, rare first, meet those of any class that is similar enough.

    Of its posted values a class has at least ``least`` in common with those of such a partner: exactly, while both
    post all they have, else by five standard errors. All but that many, and one more, must hold a common one.
    """
    drawn = F.floor(POSTED * (percent / 100 - slack(n, POSTED, percent)))
    least = F.least(F.ceil(n * percent / 100), drawn)
    return (F.least(n, F.lit(POSTED)) - least + 1).cast("int")


def common_windows(n: Column, percent: int, width: int) -> Column:
    """So many windows of ``width`` retained values at least a class has in common with one that is similar enough.

    Among the ``drawn`` smallest values of the union (or all, if they are fewer) those that both have are ``common``
    ones: exactly ``percent`` or more of a small union, by five standard errors otherwise. The others stand between
    them and each breaks ``width`` - 1 windows at most.
    """
    kept = lambda common, drawn: common - (width - 1) * (1 + drawn - common)
    whole = kept(F.ceil(n * percent / 100), n)
    sampled = kept(F.floor(RETAINED * (percent / 100 - slack(n, RETAINED, percent))), F.lit(RETAINED))
    return F.when(100 * n <= percent * RETAINED, whole).when(n <= RETAINED, F.least(whole, sampled)).otherwise(sampled)


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def can_share(shared: Column, n: Column, other: Column, percent: int) -> Column:
    """Whether a set of n values, ``shared`` of which other sets have too, can be similar enough to a set of ``other`` values."""
    return shared * (100 + percent) >= percent * (n + other)


def estimate(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Similarity of two sets by their sketches; exact where both are whole."""
    common = F.size(F.array_intersect(a, b))
    exact = common / (na + nb - common)
    u, v = F.slice(a, 1, RETAINED), F.slice(b, 1, RETAINED)
    union = F.slice(F.array_sort(F.array_union(u, v)), 1, RETAINED)
    drawn = F.size(F.array_intersect(F.array_intersect(u, v), union)) / RETAINED
    return F.when((na <= FULL) & (nb <= FULL), exact).otherwise(drawn)


def may_link(value: Column, na: Column, nb: Column, percent: int) -> Column:
    """Exact values decide as they are, estimates with slack."""
    whole = (na <= FULL) & (nb <= FULL)
    return F.when(whole, value * 100 >= percent - 1e-9).otherwise(value >= percent / 100 - slack(F.greatest(na, nb), RETAINED, percent))


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """node, root (smallest of its component) of all nodes with edges a, b: alternating large and small stars."""
    now = shelf.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    total = 2 * now.count()
    stored = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a star's hub is one key: its rows stay where they are (hot_join)
        least = shelf.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("degree")).where("degree > 0"), "least")
        large = hot_join(both.where("b > a"), least, "a", "degree", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = shelf.put(small, "edges")
        if stored is not None:
            shelf.drop(stored)
        stored = now
        # done when every node points to one root, and no root points on
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("out")))
        if ends.groupBy("node").agg(F.sum("out").alias("outs"), F.min("out").alias("low")).where("outs > 1 or outs = 1 and low = 0").isEmpty():
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


class Linker:
    """Linking of the classes of one table; see the module's account."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.shelf = Shelf(docs.sparkSession, "minhash")

    def classes(self) -> None:
        all_rows = self.shelf.put(sketches(self.docs, self.size), "sketches")
        named = all_rows.where("same is not null and doc_id is not null")
        self.nodes = self.shelf.put(named.groupBy("same").agg(F.min(F.struct("doc_id", "n", "values")).alias("x")).select(F.monotonically_increasing_id().alias("node"), "same", "x.*"), "classes")
        self.rows = self.shelf.put(all_rows.select("doc_id", "n", "same"), "rows")
        self.shelf.drop(all_rows)

    def postings(self) -> None:
        """node, n, odd, value, spread: what each class posts of values that other classes have as well; odd: its share of others."""
        posted = self.nodes.select("node", "n", F.explode(F.slice("values", 1, POSTED)).alias("value"))
        spread = posted.groupBy("value").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1")
        own = posted.join(spread, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("spread", "value"))).alias("shared"))
        alone = F.least(F.col("n"), F.lit(POSTED)) - F.size("shared")
        length = F.greatest(F.lit(0), prefix_length(F.col("n"), self.percent) - alone).cast("int")
        odd = (alone / F.least(F.col("n"), F.lit(POSTED))).alias("odd")  # the share of values that no other class has
        self.prefixes = self.shelf.put(own.select("node", "n", odd, F.slice("shared", F.lit(1), length).alias("shared")).where("size(shared) > 0"), "prefixes")
        self.posts = self.prefixes.select("node", "n", "odd", F.explode("shared").alias("x")).select("node", "n", "odd", "x.*")

    def first_pairs(self) -> DataFrame:
        fit = sizes_fit(F.col("l.n"), F.col("r.n"), self.percent)
        short = self.posts.where(F.col("spread") <= LONG_LIST)
        pairs = short.alias("l").join(short.alias("r"), (F.col("l.value") == F.col("r.value")) & (F.col("l.node") < F.col("r.node")) & fit)
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / self.percent))).alias("band")
        self.long_posts = long_ = self.posts.where(F.col("spread") > LONG_LIST).select("node", "n", "odd", "value", band)
        # the hub is one that has least of its own: the nearer it is to all, the more of them link with it
        hubs = long_.groupBy("value", "band").agg(F.min(F.struct("odd", F.xxhash64("node", "value"), "node", "n")).alias("hub")).select("value", "band", "hub.odd", "hub.node", "hub.n")
        self.hubs = hubs = self.shelf.put(hubs, "hubs")  # else the join stays dealt by the hubs' groups, and a long list cannot be split
        star = hubs.alias("l").join(long_.alias("r"), (F.col("l.value") == F.col("r.value")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.node") != F.col("r.node")) & fit)
        named = [F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")]
        return pairs.select(*named).unionByName(star.select(*named)).distinct()

    def estimated(self, pairs: DataFrame) -> DataFrame:
        l, r = (self.nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("values").alias(f"v{k}")) for k in "ab")
        value = estimate(F.col("va"), F.col("vb"), F.col("na"), F.col("nb"))
        found = pairs.join(l, "a").join(r, "b").select("a", "b", "na", "nb", value.alias("value"))
        return found.where(may_link(F.col("value"), F.col("na"), F.col("nb"), self.percent))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose exact similarity on the full sets is enough; a, b."""
        whole = pairs.where((F.col("na") <= FULL) & (F.col("nb") <= FULL)).select("a", "b")
        rest = pairs.where((F.col("na") > FULL) | (F.col("nb") > FULL)).select("a", "b")
        if rest.isEmpty():
            return whole
        needed = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes.select("node", "doc_id", "same"), "node")
        texts = _text_rows(self.docs).join(needed.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
        sets = sketches(texts, self.size, whole=True).join(needed, ["doc_id", "same"]).groupBy("node").agg(F.first("values").alias("values"))
        sets = self.shelf.put(sets, "sets")
        l, r = (sets.select(F.col("node").alias(k), F.col("values").alias(f"v{k}")) for k in "ab")
        common = F.size(F.array_intersect("va", "vb"))
        enough = common * 100 >= self.percent * (F.size("va") + F.size("vb") - common)
        out = self.shelf.put(rest.join(l, "a").join(r, "b").where(enough).select("a", "b"), "verified")
        self.shelf.drop(sets)
        return whole.unionByName(out)

    def apart(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose two components differ."""
        l, r = (roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        return pairs.join(l, "a", "left").join(r, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").drop("ra", "rb")

    def late_pairs(self, roots: DataFrame) -> DataFrame:
        """Pairs of classes of long lists across components that share a posted value or window, with their estimates."""
        long_ = self.prefixes.where(F.exists("shared", lambda x: x["spread"] > LONG_LIST)).select("node", "n").join(self.nodes.select("node", "values"), "node")
        long_ = self.shelf.put(long_, "long")
        pairs = self.by_values(long_.where(F.col("n") <= FULL), roots).unionByName(self.by_windows(long_.where(F.col("n") * 100 >= self.percent * (FULL + 1)), roots))
        return self.estimated(pairs).select("a", "b", "na", "nb")

    def differences(self, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
        """node, n, hub, plus, minus: what each class has besides the values of its hub, and what it lacks of them; and hub, base: those values.

        Its hub is that of the least odd hub of its lists, so that few hubs serve. Where that takes more than what the class holds, hub is null and all is plus.
        """
        shelf = self.shelf
        kin = self.long_posts.select("node", "value", "band").join(self.hubs.select("value", "band", "odd", F.col("node").alias("hub")), ["value", "band"])
        first = shelf.put(kin.groupBy("node").agg(F.min(F.struct("odd", "hub")).alias("x")).select("node", "x.hub"), "kin")
        led = first.join(self.hubs.select("node").distinct(), "node").select(F.col("node").alias("hub"), F.col("hub").alias("own"))  # hubs, few as they are
        near = shelf.put(whole.join(first.join(led, "hub", "left").select("node", F.coalesce("own", "hub").alias("hub")), "node"), "near")
        uses = near.groupBy("hub").agg(F.count(F.lit(1)).alias("uses"))
        bases = shelf.put(uses.join(self.nodes.select(F.col("node").alias("hub"), F.col("values").alias("base")), "hub"), "bases")
        told = hot_join(near, bases, "hub", "uses", near.count()).withColumn("plus", F.array_except("values", "base")).withColumn("minus", F.array_except("base", "values"))
        fits = F.size("plus") + F.size("minus") <= F.size("values")
        told = told.select("node", "n", F.when(fits, F.col("hub")).alias("hub"), F.when(fits, F.col("plus")).otherwise(F.col("values")).alias("plus"), F.when(fits, F.col("minus")).otherwise(F.array().cast("array<long>")).alias("minus"))
        told = shelf.put(told, "told")
        shelf.drop(near)
        return told, bases.select("hub", "base")

    def shared_values(self, told: DataFrame, bases: DataFrame) -> DataFrame:
        """node, n, hub, delta (all that sets it apart from its hub), shared: its values that other classes have too, with their spread; rare ones first."""
        shelf = self.shelf
        each = F.concat(F.transform("plus", lambda x: F.struct(x.alias("value"), F.lit(1).alias("k"))), F.transform("minus", lambda x: F.struct(x.alias("value"), F.lit(-1).alias("k"))))
        apart = told.select(F.col("node").alias("owner"), F.lit(False).alias("base"), F.explode(each).alias("x")).select("owner", "base", "x.value", F.col("x.k").cast("long").alias("k"))
        followed = told.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("k")).join(bases, "hub")
        values = shelf.put(apart.unionByName(followed.select(F.col("hub").alias("owner"), F.lit(True).alias("base"), F.explode("base").alias("value"), "k")), "values")
        # a hub's value counts for all of its classes, less those that lack it
        spread = shelf.put(values.groupBy("value").agg(F.sum("k").alias("spread"), F.count_if(F.col("k") > 0).alias("held")).where("spread > 1"), "common")
        held = values.where("k > 0")
        own = hot_join(held, spread, "value", "held", held.count()).groupBy("owner", "base").agg(F.collect_list(F.struct("spread", "value")).alias("shared"))
        own = shelf.put(own, "held")
        shelf.drop(values)
        own, of_hub = own.where("not base").select(F.col("owner").alias("node"), F.col("shared").alias("added")), own.where("base").select(F.col("owner").alias("hub"), F.col("shared").alias("kept"))
        some = lambda name: F.coalesce(name, F.array().cast("array<struct<spread:long,value:long>>"))
        shared = F.array_sort(F.concat(some("added"), F.filter(some("kept"), lambda x: ~F.array_contains("minus", x["value"]))))
        return told.join(own, "node", "left").join(of_hub, "hub", "left").select("node", "n", "hub", F.concat("plus", "minus").alias("delta"), shared.alias("shared"))

    def by_values(self, whole: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs a, b of classes kept whole: what two have in common is bounded by what each shares, from their first common value on."""
        shelf, percent, n = self.shelf, self.percent, F.col("n")
        own = self.shared_values(*self.differences(whole))
        length = F.greatest(F.lit(0), F.size("shared") - F.ceil(n * percent / 100) + 1).cast("int")  # one of so many is common
        own = own.select("node", "n", "hub", "delta", F.size("shared").alias("total"), F.transform(F.slice("shared", F.lit(1), length), lambda x: x["value"]).alias("first"))
        own = shelf.put(own, "heads")  # a filter here would have the arrays made twice
        left = lambda side: F.col(f"{side}total") - F.col(f"{side}place")
        in_list = can_share(left(""), n, F.greatest(F.col("low"), F.ceil(n * percent / 100)), percent)
        in_pair = can_share(F.least(left("l."), left("r.")), F.col("l.n"), F.col("r.n"), percent)
        # two classes of one hub differ in what their differences from it do not have in common
        both, apart = F.col("l.n") + F.col("r.n"), F.size("l.delta") + F.size("r.delta") - 2 * F.size(F.array_intersect("l.delta", "r.delta"))
        similar = F.coalesce(F.col("l.hub") != F.col("r.hub"), F.lit(True)) | (100 * (both - apart) >= percent * (both + apart))
        return self.across(own, roots, in_list, [in_pair, similar], ["delta"])

    def by_windows(self, long_: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs a, b of classes of which one at least is not kept whole."""
        shelf, width = self.shelf, 2 if self.percent >= 75 else 1
        drawn = F.slice("values", 1, RETAINED)
        windows = F.transform(F.slice(drawn, F.lit(1), F.greatest(F.lit(0), F.size(drawn) - (width - 1))), lambda x, i: F.xxhash64(x, *[F.get(drawn, i + k) for k in range(1, width)]))
        posted = shelf.put(long_.select("node", "n", F.explode(windows).alias("window")), "windows")
        spread = shelf.put(posted.groupBy("window").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1"), "spread")
        own = hot_join(posted, spread, "window", "spread", posted.count()).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("spread", "window"))).alias("shared"))
        # of at least ``need`` common windows, ``met`` lie among all but the last need - met of either class
        need = F.greatest(F.lit(1), common_windows(F.col("n"), self.percent, width)).cast("int")
        met = F.least(need, F.lit(MET))
        length = F.greatest(F.lit(0), F.size("shared") - need + met).cast("int")
        own = shelf.put(own.select("node", "n", need.alias("need"), met.alias("met"), F.size("shared").alias("total"), F.transform(F.slice("shared", F.lit(1), length), lambda x: x["window"]).alias("first")), "first")
        shelf.drop(posted)
        # so many windows that both have can come yet, this one included
        behind = F.least(F.col("l.total") - F.col("l.place"), F.col("r.total") - F.col("r.place")) >= F.greatest("l.need", "r.need")
        together = F.size(F.array_intersect("l.first", "r.first")) >= F.least("l.met", "r.met")
        return self.across(own, roots, F.lit(True), [F.greatest("l.n", "r.n") > FULL, behind, together])

    def across(self, own: DataFrame, roots: DataFrame, in_list: Column, in_pair: list[Column], wide: list[str] | None = None) -> DataFrame:
        """Pairs a, b of different components that have one of their ``first`` keys in common, each at its first such key.

        in_list: what lets a class (with the smallest size, low, of the key's classes) stay in a key's list; in_pair: what a pair must fulfil;
        wide: columns that in_pair alone reads.
        """
        shelf, wide = self.shelf, ["first", *(wide or [])]
        placed = own.select(*[c for c in own.columns if c not in wide], F.posexplode("first").alias("place", "window")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = shelf.put(placed, "placed")
        # most classes of a window are often of one component: they meet the others only
        kinds = placed.groupBy("window", "root").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low")).groupBy("window").agg(F.sum("c").alias("every"), F.min("low").alias("low"), F.max(F.struct("c", "root")).alias("main"))
        kinds = kinds.where("every > main.c").select("window", "every", "low", F.col("main.root").alias("main"), F.ceil((F.col("every") - F.col("main.c")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("every") / BLOCK).cast("int").alias("columns"))
        side = hot_join(placed, shelf.put(kinds, "kinds"), "window", "every", placed.count()).where(in_list)
        side = shelf.put(side.join(own.select("node", *wide), "node").withColumn("earlier", F.slice("first", F.lit(1), F.col("place"))), "sides")
        at = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
        l = side.where("root <> main").withColumn("i", at("rows")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).alias("l")
        r = side.withColumn("j", at("columns")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).alias("r")
        on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("window", "i", "j")]
        on += [F.col("l.root") != F.col("r.root"), (F.col("r.root") == F.col("r.main")) | (F.col("l.node") < F.col("r.node")), sizes_fit(F.col("l.n"), F.col("r.n"), self.percent)]
        on += in_pair
        # a pair is met at its first common window alone, and counted there
        on.append(~F.arrays_overlap("l.earlier", "r.earlier"))
        return l.join(r, on).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """For each class its most similar partner, and of those that seem similar enough the one that others choose too."""
        chosen = []
        for own, other in (("a", "b"), ("b", "a")):
            row = F.struct("a", "b", "na", "nb")
            order = F.when(F.col("value") * 100 >= self.percent, F.xxhash64(other))
            chosen.append(pairs.groupBy(own).agg(F.max_by(row, "value").alias("x"), F.min_by(row, order).alias("y")).select(F.explode(F.array("x", "y")).alias("z")).where("z is not null").select("z.*"))
        return chosen[0].unionByName(chosen[1]).distinct()

    def run(self) -> DataFrame:
        self.classes()
        self.postings()
        shelf = self.shelf
        pairs = shelf.put(self.estimated(self.first_pairs()), "pairs")
        exact = (F.col("na") <= FULL) & (F.col("nb") <= FULL)
        open_ = pairs.where(~exact)
        links = pairs.where(exact).select("a", "b").unionByName(self.verified(shelf.put(self.likely(open_), "likely")))
        roots = shelf.put(components(links, shelf), "roots")
        late = self.verified(shelf.put(self.apart(open_, roots).select("a", "b", "na", "nb").unionByName(self.late_pairs(roots)), "late"))
        # the late links join components; only their roots matter
        l, r = (roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        between = late.join(l, "a", "left").join(r, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
        merged = components(between, shelf).select(F.col("node").alias("root"), F.col("root").alias("top"))
        own = self.nodes.select("node", "same", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(merged, "root", "left").withColumn("root", F.coalesce("top", "root"))
        least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        by_class = own.join(least, "root").select("same", "component_id")
        found = self.rows.join(by_class, "same", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept."""
    return Linker(docs, size, percent).run()
