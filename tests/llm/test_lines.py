"""The tree of line templates against a plain version of it, and lines with fields that vary without digits."""

import collections
import math
import random

from pyspark.sql import functions as F

from glasspane.llm import lines

UP = {c: c + 32 for c in range(65, 91)}
NAMES = "anna boris carla dmitri elena farid gita hugo ines jonas kemal lara milan nora otto pia quin rosa sven tara".split()


def plain_tree(texts: dict[int, str]) -> dict[int, str]:
    """What the operator's account says, line by line."""
    own = {d: [tuple(x.translate(UP).split()) for x in t.split("\n")] for d, t in texts.items()}
    docs = collections.defaultdict(set)
    for d, found in own.items():
        for line in found:
            if line:
                docs[line].add(d)
    field = lambda w: "*" if any(c.isdigit() for c in w) else w
    pairs = [(j, k) for j in range(1, 5) for k in range(j + 1, 5)]
    leaves = lambda line: [(len(line), j, k, field(line[0]), field(line[j]), field(line[k])) for j, k in pairs if len(line) > k]
    enough = lambda n, literal, fields: n * literal**2 >= lines.STRENGTH * (1 + lines.FIELD * fields)
    reached = collections.Counter(x for line in docs for x in leaves(line))
    keeper = {line: min(d) for line, d in docs.items() if len(d) > 1 and enough(len(d), len(line), 0)}
    leaf = {}
    for line in docs:
        real = [x for x in leaves(line) if reached[x] >= lines.LEAST]
        if real:
            best = max(reached[x] for x in real)
            leaf[line] = [x for x in real if reached[x] == best]
    # where leaves are equally large any will do; the texts of these tests are such that it makes no difference
    support = collections.Counter((x[0], k, w) for line, x in leaf.items() for k, w in enumerate(line))
    made = collections.defaultdict(set)
    for line, x in leaf.items():
        for p in range(1, max(1, int(math.log2(reached[x[0]]))) + 1):
            t = tuple(w if support[x[0], k, w] >= max(2, 2**p) else None for k, w in enumerate(line))
            if 2 * sum(w is not None for w in t) >= len(t) and None in t:
                made[x[0], t].add(line)
    for (_, t), members in made.items():
        first = {min(docs[m]) for m in members}
        literal = sum(w is not None for w in t)
        if len(first) >= lines.LEAST and enough(len(first), literal, len(t) - literal):
            for m in members:
                keeper[m] = min(keeper.get(m, min(first)), min(first))
    out = {}
    for d, t in texts.items():
        kept = [raw for raw, line in zip(t.split("\n"), own[d]) if not line or keeper.get(line, d) == d]
        if len(kept) == len(own[d]) or any(x.split() for x in kept):
            out[d] = "\n".join(kept)
    return out


def logs(n: int, seed: int) -> dict[int, str]:
    r = random.Random(seed)
    other = lambda: " ".join(r.choice("abcdefgh") + r.choice("ijklmnop") + r.choice("qrstuv") for _ in range(r.randint(3, 14)))
    made = (
        lambda: f"user {r.choice(NAMES)} logged in from host {r.choice(NAMES)} today ok",
        lambda: f"request for page {r.choice(NAMES)} of the public site was answered by worker {r.choice(NAMES)} in good time",
        lambda: f"job {r.randint(1, 99)} of queue main ended with code {r.randint(0, 3)} after all retries were used up",
        lambda: "this page was printed from the archive of the city",
        lambda: "next page please",
    )
    return {d: "\n".join([other(), *(m() for m in made if r.random() < 0.7), other()]) for d in range(n)}


def test_like_the_plain_tree(spark):
    for n, seed in ((40, 1), (90, 2)):
        texts = logs(n, seed)
        got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        want = plain_tree(texts)
        assert got == want
        left = collections.Counter(x.split()[0] for t in got.values() for x in t.split("\n") if x.split()[0] in ("user", "request", "job", "this"))
        assert all(v <= 2 for v in left.values())


def test_fields_without_digits(spark):
    """Twelve documents with a short line of two fields, and twelve with one of 16 words, by other names in each."""
    rows = [(k, f"text of its own {a}\nuser {a} logged in from host {b} today ok") for k, (a, b) in enumerate(zip(NAMES, NAMES[5:17]))]
    rows += [(20 + k, f"and here {a} writes\nrequest for page {a} of the public site was answered by worker {b} in good time") for k, (a, b) in enumerate(zip(NAMES, NAMES[5:17]))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: t if k in (0, 20) else t.split("\n")[0] for k, t in rows}


def test_shreds_go(spark):
    words = lambda k, n: " ".join(f"{k}w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    rows = [(1, f"{words('a', 30)}\n{words('b', 30)}\nlast one"), (2, f"{words('a', 30)}\n{words('b', 30)}\nlast two of"), (3, f"{words('a', 30)}\n{words('c', 30)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in lines.dedup(df).collect()} == {1, 2, 3}
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df, least_left=0.2).collect()} == {1: rows[0][1], 3: words("c", 30)}


def test_odd_rows(spark):
    line = "one line of eight words or a few more"
    rows = [(None, line), (1, None), (2, ""), (3, " \n\t\n"), (4, f"{line}\n\n{line}"), (4, f"{line}\n\n{line}"), (5, f"{line}\nown"), (6, line), (7, f"x\n{line.upper()}\n"), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "drop", "cut", "line", "which", "left")})
    for passages in (False, True):
        got = sorted(((r["doc_id"] or 0, r["text"]) for r in lines.dedup(df, passages).collect()), key=str)
        assert got == sorted([(0, line), (0, line), (1, None), (2, ""), (3, " \n\t\n"), rows[4], rows[5], (5, "own"), (7, "x\n")], key=str)


def test_hot_passages_are_found_alike(spark, monkeypatch):
    """Whether a posted run counts as hot makes no difference."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passages = [" ".join(word() for _ in range(70)) for _ in range(3)]
    rows = [(k, " ".join(word() for _ in range(r.randint(3, 40))) + f" {r.choice(passages)} " + " ".join(word() for _ in range(20)) + f"\n{r.choice(passages)} {word()}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cold = {x["doc_id"]: x["text"] for x in lines.dedup(df, passages=True).collect()}
    monkeypatch.setattr(lines, "HOT_LEAST", 0)
    monkeypatch.setattr(lines, "HOT_KEYS", 25)  # those with over a twenty-fifth of the posted runs
    assert {x["doc_id"]: x["text"] for x in lines.dedup(df, passages=True).collect()} == cold
    assert sum(len(t.split()) for t in cold.values()) < 0.55 * sum(len(t.split()) for _, t in rows)
