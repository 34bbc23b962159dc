"""Conversation prefix trie: every subtree's totals by parallel tree contraction.

Conversations are first rebuilt (``rebuilt``): some opening turns come from the first conversation of their family.
The sequences of first turns are the nodes of a trie. For each node: who starts with it, its children, the leaves
below, and the tokens that sharing it and all below saves.

1. Turns are numbered by range partitions of (conversation, order) and the counts of the partitions before, so a
   conversation that holds a third of all rows is many tasks' work. A prefix is known by the sum of its turns'
   128-bit hashes, each of which covers the turn's place; running sums go by blocks of BLOCK turns.
2. Grouping by prefix, pre-aggregated, gives the nodes; their parents' labels come by a join whose hot parents are broadcast.
3. Contraction (``contract``), in rounds of joins. Rake: all leaves go, their totals are added to their parents. Compress:
   of nodes with one child an independent set goes, chosen by hashes of the round; their values are added to the node
   above, and their child hangs there. Each round takes all leaves and about a third of every chain, so a chain of n turns
   takes O(log n) rounds. Every join of a round has a unique key on both sides: neither hot nodes nor long chains
   gather rows.
4. Re-expansion, last round first: a raked node's total was its value when it went; a compressed one's is its value
   then plus its child's total. Round by round the tables halve, so all rounds together cost a few passes.

Turns go by turn (null first), of one turn by role and text; null roles and texts are empty. Rows without a
conv_id belong to no conversation and are left out. Repeated rows are turns each. An empty table gives no rows. Other
columns are ignored. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shelf, hot_join, in_batches

#: Turns of one conversation whose running sums one task makes.
BLOCK = 4096
#: Conversations whose ids stand in one string on the way to a node's hash.
IDS = 4096
FAMILY, OPENINGS = 20, 4
WORD = "[^\\x20\\x09-\\x0D]+"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_LOW = (1 << 32) - 1


# --- turns, rebuilt --------------------------------------------------------------------------


def numbered(conversations: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at (from 1), role, text) and (conv_id, n)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    order = ["conv_id", "turn", "role", "text", "__row"]
    parts = int(shelf.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # in this order, the ids count the rows of a partition
    stored = shelf.put(dealt.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("row")).withColumn("part", F.shiftright("row", 33)), "turns")
    spans = stored.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    spans = shelf.put(spans.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")), "spans")
    turns = stored.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("first") + F.col("before") + 1).alias("at"), "role", "text")
    return turns, spans.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations whose first h turns are those of their family's first, h = crc32(id) % OPENINGS.

    The family's first is conv_id - conv_id % FAMILY. Where it has fewer turns, all are taken; where it is absent, none.
    """
    turns, lengths = numbered(conversations, shelf)
    turns, lengths = shelf.put(turns, "numbered"), shelf.put(lengths, "lengths")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.when(first == F.col("conv_id"), F.lit(0)).otherwise(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(OPENINGS))).cast("int")
    own = lengths.select("conv_id", "n", first.alias("family"), h.alias("h"))
    firsts = lengths.select(F.col("conv_id").alias("family"), F.col("n").alias("n_family"))
    plan = own.join(firsts, "family", "left").withColumn("taken", F.least("h", F.coalesce("n_family", F.lit(0))))
    plan = shelf.put(plan.select("conv_id", "family", "n", "h", "taken"), "plan")
    openings = turns.where(F.col("at") < OPENINGS).withColumnRenamed("conv_id", "family")
    taken = plan.where("taken > 0").drop("n").join(openings, "family").where("at <= taken").select("conv_id", "at", "role", "text")
    rest = hot_join(turns, plan.select("conv_id", "n", "h", "taken"), "conv_id", "n", turns.count()).where("at > h")
    turns = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "role", "text").unionByName(taken)
    return turns, plan.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n"))


# --- the trie --------------------------------------------------------------------------------


def _key(sums: list[Column]) -> Column:
    low = [s.bitwiseAND(F.lit(_LOW)) for s in sums]
    return F.struct(F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("a"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("b"))


def prefixes(turns: DataFrame, shelf: Shelf, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, key, above (key of the prefix without its last turn), words of the last text."""
    md5 = F.md5(F.concat_ws(":", F.col("at").cast("string"), F.length("role").cast("string"), F.concat("role", "text")).cast("binary"))
    parts = [F.conv(F.substring(md5, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"v{k}") for k in range(4)]
    own = turns.select("conv_id", "at", F.floor((F.col("at") - 1) / block).alias("block"), F.size(F.regexp_extract_all("text", F.lit(WORD), 0)).cast("long").alias("words"), *parts)
    inner = Window.partitionBy("conv_id", "block").orderBy("at")
    own = shelf.put(own.select("conv_id", "at", "block", "words", *(f"v{k}" for k in range(4)), *(F.sum(f"v{k}").over(inner).alias(f"s{k}") for k in range(4))), "sums")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("conv_id", "block").agg(*(F.sum(f"v{k}").alias(f"t{k}") for k in range(4)))
    sums = sums.select("conv_id", "block", *(F.sum(f"t{k}").over(earlier).alias(f"t{k}") for k in range(4))).where("block > 0")
    own = own.join(sums, ["conv_id", "block"], "left")
    totals = [F.col(f"s{k}") + F.coalesce(f"t{k}", F.lit(0)) for k in range(4)]
    return own.select("conv_id", F.col("at").alias("depth"), _key(totals).alias("key"), _key([t - F.col(f"v{k}") for k, t in enumerate(totals)]).alias("above"), "words")


def nodes(found: DataFrame, lengths: DataFrame, shelf: Shelf) -> DataFrame:
    """id, key, conv_id, depth, parent, parent_conv_id, n_convs, n_children, words; the root's parent is null."""
    root_key = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    own = found.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("above").alias("above"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(root_key.alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("struct<a:long,b:long>").alias("above"), "n_convs", F.lit(0).cast("long").alias("words"))
    own = shelf.put(own.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    children = own.where("above is not null").groupBy("above").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("above", "key")
    own = shelf.put(own.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "counted")
    parents = own.where("n_children > 0").select(F.col("key").alias("above"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    below = hot_join(own.where("above is not null"), parents, "above", "weight", own.count()).drop("weight")
    top = own.where("above is null").withColumn("parent", F.lit(None).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return shelf.put(below.unionByName(top).drop("above"), "tree")


# --- contraction -----------------------------------------------------------------------------


def rake(alive: DataFrame, values: list[str]) -> DataFrame:
    """What is left when all leaves have given their values to their parents."""
    gains = alive.where("open = 0").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(v).alias(f"__{v}") for v in values))
    more = [(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]
    return alive.where("open > 0").join(gains, "id", "left").select("id", "parent", (F.col("open") - F.coalesce("__n", F.lit(0))).alias("open"), *more)


def spliced(alive: DataFrame, values: list[str], turn: int) -> DataFrame:
    """node, above, child and values of nodes with one child, no two of them next to each other, that go in this round."""
    unary = (F.col("open") == 1) & F.col("parent").isNotNull()
    upper = alive.where(unary).select(F.col("id").alias("node"), F.col("parent").alias("above"), *values)
    lower = alive.where("parent is not null").select(F.col("id").alias("child"), F.col("parent").alias("node"), unary.alias("goes_on"))
    links = upper.join(lower, "node")
    over = links.select(F.col("child").alias("node"), F.col("node").alias("over"))
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c))
    chosen = links.join(over, "node", "left").where((~F.col("goes_on") | (rank("node") > rank("child"))) & (F.col("over").isNull() | (rank("node") > rank("over"))))
    return chosen.select("node", "above", "child", *values)


def without(alive: DataFrame, gone: DataFrame, values: list[str]) -> DataFrame:
    """The tree without the chosen nodes: their values go up, their children hang on the nodes above them."""
    null, zeros = F.lit(None).cast("long"), [F.lit(0).cast("long").alias(v) for v in values]
    changes = gone.select(F.col("node").alias("id"), F.lit(1).alias("__gone"), null.alias("__parent"), *zeros)
    changes = changes.unionByName(gone.select(F.col("child").alias("id"), F.lit(0).alias("__gone"), F.col("above").alias("__parent"), *zeros))
    changes = changes.unionByName(gone.select(F.col("above").alias("id"), F.lit(0).alias("__gone"), null.alias("__parent"), *values))
    changes = changes.groupBy("id").agg(F.max("__gone").alias("__gone"), F.max("__parent").alias("__parent"), *(F.sum(v).alias(f"__{v}") for v in values))
    more = [(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]
    return alive.join(changes, "id", "left").where("coalesce(__gone, 0) = 0").select("id", F.coalesce("__parent", "parent").alias("parent"), "open", *more)


def contract(tree: DataFrame, values: list[str], shelf: Shelf) -> DataFrame:
    """id and, for each of ``values``, its sum over the subtree of the node, itself included.

    tree: id, parent (null for a root; there may be many), and long values. Leaves are nodes that are nobody's parent.
    """
    counts = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    alive = shelf.put(tree.select("id", "parent", *values).join(counts, "id", "left").withColumn("open", F.coalesce("open", F.lit(0))), "alive")
    rounds = []
    while not alive.where("open > 0").isEmpty():
        raked = alive.where("open = 0").select("id", *values)
        rest = shelf.put(rake(alive, values), "raked")
        gone = shelf.put(spliced(rest, values, len(rounds)), "spliced")
        is_any = not gone.isEmpty()
        alive = shelf.put(without(rest, gone, values), "alive") if is_any else rest
        rounds.append((raked, gone if is_any else None))
    totals = alive.select("id", *values)
    for raked, gone in reversed(rounds):
        again = raked
        if gone is not None:
            below = totals.select(F.col("id").alias("child"), *(F.col(v).alias(f"__{v}") for v in values))
            again = again.unionByName(gone.join(below, "child").select(F.col("node").alias("id"), *((F.col(v) + F.col(f"__{v}")).alias(v) for v in values)))
            totals = shelf.put(totals.unionByName(again), "totals")
        else:
            totals = totals.unionByName(again)
    return totals


# --- who ends where --------------------------------------------------------------------------


def joined_ids(ends: DataFrame) -> DataFrame:
    """key and the hash of its conversations' ids, ascending and comma-joined.

    Ids are joined to strings of up to IDS by ranges; a node's strings then pass its hash one after the other, as this
    hash must have them, and are never held together.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["a", "b", "conv_id"]
    dealt = ends.select("key.a", "key.b", "conv_id").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def strings(batches):
        key, own = None, []
        for batch in batches:
            rows, out = zip(*(c.to_pylist() for c in batch.columns)), []
            for a, b, conv in rows:
                if key != (a, b) or len(own) == IDS:
                    if own:
                        out.append((*key, own[0], ",".join(map(str, own))))
                    key, own = (a, b), []
                own.append(conv)
            if out:
                yield rowed(out)
        if own:
            yield rowed([(*key, own[0], ",".join(map(str, own)))])

    def rowed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "first", "ids"])

    def hashes(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == (a, b):
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256(ids.encode())
            if out:
                yield named(out)
        if key is not None:
            yield named([(*key, sha.hexdigest())])

    def named(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

    by_range = in_batches(dealt, strings, "a long, b long, first long, ids string")
    by_node = in_batches(by_range.repartition("a", "b").sortWithinPartitions("a", "b", "first"), hashes, "a long, b long, ends_sha256 string")
    return by_node.select(F.struct("a", "b").alias("key"), "ends_sha256")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node."""
    shelf = Shelf(conversations.sparkSession, "trie")
    turns, lengths = rebuilt(conversations, shelf)
    found, lengths = shelf.put(prefixes(turns, shelf, block), "prefixes"), shelf.put(lengths, "rebuilt-lengths")
    tree = nodes(found, lengths, shelf)
    values = tree.select("id", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = contract(values, ["n_leaves", "saved_tokens"], shelf)
    root_key = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    last = found.join(lengths.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]).select("key", "conv_id")
    ends = joined_ids(last.unionByName(lengths.where("n = 0").select(root_key.alias("key"), "conv_id")))
    out = tree.join(totals, "id").join(ends, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def trie_sql() -> str:
    """The same by plain SQL, as an oracle: prefixes as lists, and every pair of a node and one above it."""
    # bit by bit: a byte and seven zeros enter the register one after the other
    crc = "list_reduce(flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0])), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295::bigint)"
    return f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as at
  from conversations where conv_id is not null),
c as (select conv_id, count(*) as n from t group by conv_id),
h as (select conv_id, n, conv_id - conv_id % {FAMILY} as family, xor({crc}, 4294967295) % {OPENINGS} as h from c),
k as (
  select h.conv_id, h.family, h.n, case when h.family = h.conv_id then 0 else h.h end as h,
    case when h.family = h.conv_id then 0 else least(h.h, coalesce(f.n, 0)) end as taken
  from h left join c f on f.conv_id = h.family),
r as (
  select k.conv_id, t.at, t.role, t.text from k join t on t.conv_id = k.family and t.at <= k.taken
  union all
  select k.conv_id, t.at - k.h + k.taken, t.role, t.text from k join t on t.conv_id = k.conv_id and t.at > k.h),
p as (
  select conv_id, at as depth, list({{'role': role, 'text': text}}) over (partition by conv_id order by at) as seq, text from r
  union all select conv_id, 0, [], '' from c),
node as (
  select seq, depth, min(conv_id) as conv_id, count(*) as n_convs, len(regexp_extract_all(any_value(text), '{WORD}')) as words from p group by seq, depth),
m as (select p.conv_id as member, p.depth, node.conv_id from p join node on p.depth = node.depth and p.seq = node.seq),
family as (
  select n.conv_id, n.depth, n.n_convs, n.words, m.conv_id as parent_conv_id
  from node n left join m on m.member = n.conv_id and m.depth = n.depth - 1),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n from family where depth > 0 group by 1, 2),
one as (
  select family.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * words as saved
  from family left join kids on kids.conv_id = family.conv_id and kids.depth = family.depth),
below as (
  select m.conv_id, m.depth, count_if(one.n_children = 0) as n_leaves, sum(one.saved) as saved_tokens
  from one join m on m.member = one.conv_id and m.depth <= one.depth group by 1, 2),
e as (
  select m.conv_id, m.depth, sha256(string_agg(k.conv_id::varchar, ',' order by k.conv_id)) as ends_sha256
  from k join m on m.member = k.conv_id and m.depth = k.taken + greatest(0, k.n - k.h) group by 1, 2)
select one.conv_id, one.depth::bigint as depth, one.parent_conv_id, one.n_convs, one.n_children, below.n_leaves::bigint as n_leaves,
  below.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, '{EMPTY_SHA256}') as ends_sha256
from one join below on below.conv_id = one.conv_id and below.depth = one.depth
left join e on e.conv_id = one.conv_id and e.depth = one.depth"""
