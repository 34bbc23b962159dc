"""The prefix trie against a plain version over lists, and contraction against recursion on made trees."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.llm import queries, tries
from glasspane.llm.shared import Shelf

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Rows (conv_id, turn, role, text) to the trie's rows."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], t[2].encode(), t[3].encode()))] for c, ts in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        mine = own.get(abs(c) // 20 * 20 * (-1 if c < 0 else 1), [])[:h] + turns[h:]  # as SQL's remainder has it
        for d in range(len(mine) + 1):
            members[tuple(mine[:d])].append(c)
        ends[tuple(mine)].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * words
    for node, who in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        yield min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node], sha


def same(got, rows):
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == collections.Counter(plain(rows))


def test_query_like_plain_trie(spark, sf):
    got = queries.op11_trie(spark, sf)
    assert got.columns == COLUMNS
    same(got.collect(), [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    """Long, hot, short and absent conversations; ties, nulls, repeated rows; more turns than a block of running sums holds."""
    rng = np.random.default_rng(5)
    rows = [(k % 3 * 20 + k // 3 % 7, int(rng.integers(0, 3)), rng.choice(["user", "bot", None]), rng.choice(["a b", "a  b", "", None, "c\td e"])) for k in range(150)]
    rows += [(77, t, "user", f"turn {t % 5}") for t in range(60)] + [(78, t, "user", f"turn {t % 5}") for t in range(45)] + [(60, 1, "user", "turn 0")]
    rows += [(None, 1, "user", "nobody"), (9, None, None, None), (9, None, None, None), (-3, 5, "x", "y"), (2**61 + 1, 1, "ab", "c"), (2**61 + 2, 1, "a", "bc")]
    rows += [(400 + k, 1, "user", "same") for k in range(90)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    odd = frame.withColumns({c: F.lit(1) for c in ("at", "key", "id", "part", "__row", "n")}).repartition(5)
    same(tries.trie(odd, block=7).collect(), rows)
    assert tries.trie(frame.limit(0)).collect() == []


def recursive(parents):
    totals = {k: [1, k] for k in parents}
    depth = {}
    for k in sorted(parents, key=lambda k: -len(list(up(parents, k)))):
        depth[k] = 1
        if parents[k] is not None:
            for i in (0, 1):
                totals[parents[k]][i] += totals[k][i]
    return totals


def up(parents, k):
    while k is not None:
        yield k
        k = parents[k]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar", "forest"])
def test_contraction_of_made_trees(spark, shape):
    rng = np.random.default_rng(len(shape))
    n = 400
    parent = {"chain": lambda k: k - 1, "star": lambda k: 0, "random": lambda k: int(rng.integers(0, k)), "caterpillar": lambda k: k - 1 if k % 2 else max(0, k - 2), "forest": lambda k: None if k % 50 == 0 else k - 1 - int(rng.integers(0, min(k % 50, 3)))}[shape]
    parents = {0: None} | {k: parent(k) for k in range(1, n)}
    names = dict(enumerate(rng.permutation(n).tolist()))
    tree = spark.createDataFrame([(names[k], None if p is None else names[p], 1, k) for k, p in parents.items()], "id long, parent long, one long, sum long")
    shelf = Shelf(spark, "test")
    got = {r["id"]: [r["one"], r["sum"]] for r in tries.contract(tree, ["one", "sum"], shelf).collect()}
    assert got == {names[k]: v for k, v in recursive(parents).items()}
    assert shelf.count <= 60  # a chain of 400 takes some 13 rounds


def test_hash_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(tries, "IDS", 10)
    ends = spark.range(5000).select(F.struct(F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 7).cast("long").alias("a"), F.lit(2).cast("long").alias("b")).alias("key"), F.col("id").alias("conv_id"))
    want = collections.defaultdict(list)
    for k in range(5000):
        want[1 if k < 3000 else k % 7].append(str(k))
    got = {r["key"]["a"]: r["ends_sha256"] for r in tries.joined_ids(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
