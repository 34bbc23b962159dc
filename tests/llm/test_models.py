"""Language and toxicity against plain versions, letter by letter."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from glasspane.llm import language, toxicity


def spelled(text: str) -> list[int]:
    """Letters as code points, all else as word ends, one at a time and one at either end."""
    out = [0]
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c))
        elif out[-1]:
            out.append(0)
    return out if out[-1] == 0 and len(out) > 1 else [*out, 0]


def plain_grams(text: str) -> collections.Counter:
    c = spelled(text)
    found = [x | 3 << 62 for x in c if x]
    found += [a | b << 21 | 1 << 63 for a, b in zip(c, c[1:]) if a or b]
    found += [a | b << 21 | d << 42 for a, b, d in zip(c, c[1:], c[2:]) if b]
    return collections.Counter(found)


def ranked(n: collections.Counter, places: int) -> dict[int, int]:
    return {g: k for k, g in enumerate(sorted(n, key=lambda g: (-n[g], g))[:places])}


def sayings(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    kinds = {"aa": ("ba", "do", "lem", "ti", "nor"), "bb": ("str", "eik", "unt", "zöl", "do"), "cc": ("çao", "ñe", "ti", "lla", "ou")}
    rows = []
    for k in range(n):
        lang = r.choice(sorted(kinds))
        word = lambda: "".join(r.choice(kinds[lang]) for _ in range(r.randint(1, 3)))
        rows.append((k, " ".join(word() for _ in range(r.randint(1, 60))) + r.choice(("", ".", " 12 !", "\U00010400x")), lang if r.random() < 0.9 else None))
    return [*rows, (n, "", "aa"), (n + 1, None, "bb"), (n + 2, "123 .", None), (n, "", "aa")]


def test_languages_by_plain_profiles(spark):
    rows, places = sayings(3, 150), 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = collections.defaultdict(collections.Counter)
    for r in docs.where(language.crc_fold(F.col("doc_id")) != 2).where("lang is not null and text is not null").collect():
        counts[r["lang"]].update(plain_grams(r["text"]))
    profiles = {x: ranked(n, places) for x, n in counts.items()}
    texts = {k: t for k, t, _ in rows}
    for r in language.cross_checked(docs, places=places).collect():
        own = ranked(plain_grams(texts[r["doc_id"]] or ""), places) if any(c.isalpha() for c in texts[r["doc_id"]] or "") else {}
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        distance = {x: sum(abs(k - p[g]) if g in p else places for g, k in own.items()) for x, p in profiles.items()}
        best = min(sorted(distance), key=lambda x: distance[x])
        assert r["lang_pred"] == best and math.isclose(r["score"], 1 - distance[best] / (len(own) * places))


def plain_places(text: str | None) -> set[int]:
    """Places of the n-grams of a text, whose inner signs are letters."""
    c = [0] + [ord(x) if x.isalpha() else 0 for x in (text or "").lower()] + [0]
    f, out = [int(x) for x in toxicity._FACTORS], set()
    for n in toxicity.ORDERS:
        for at in range(len(c) - n + 1):
            if all(c[at + 1 : at + n - 1]):
                h = (n + sum(c[at + k] * f[k] for k in range(n))) % 2**64
                out.add(((h ^ h >> 29) * f[7] % 2**64) >> (64 - toxicity.BITS))
    return out


def test_toxicity_by_plain_features(spark):
    rows = [(k, t) for k, t, _ in sayings(8, 120)]
    marks = [(k, int(bool(t) and "lem" in t)) for k, t in rows if k % 3]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    c = toxicity.learn(docs, labels, features=60)
    # the ratios by hand: the features are those that stand out most
    toxic, other = collections.Counter(), collections.Counter()
    label = {}
    for k, y in marks:
        label[k] = max(y, label.get(k, 0))
    n = [0, 0]
    for k, t in rows:
        if k in label:
            n[label[k]] += 1
            (toxic if label[k] else other).update(plain_places(t))
    standing = {}
    for p in {*toxic, *other}:
        a, b = toxic[p] + 0.5, other[p] + 0.5
        if toxic[p] + other[p] > 1:
            standing[p] = abs((math.log(a / (n[1] + 1)) - math.log(b / (n[0] + 1))) / math.sqrt(1 / a + 1 / b))
    best = sorted(standing.values(), reverse=True)[:60]
    assert np.allclose(sorted((standing[p] for p in c.places.tolist()), reverse=True), best)
    weight = dict(zip(c.places.tolist(), c.weights.tolist()))
    texts = dict(rows)
    for r in toxicity.score(docs, c).collect():
        z = c.intercept + sum(weight.get(p, 0.0) for p in plain_places(texts[r["doc_id"]]))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_the_fit_is_at_its_least(spark):
    rng = np.random.default_rng(2)
    x = rng.random((200, 5)) < 0.4
    y = (x @ np.array([2.0, -1, 0, 1, -2]) + rng.normal(0, 0.5, 200) > 0).astype(float)
    rows, columns = np.nonzero(x)
    w, b = toxicity.fit(rows, columns, np.ones(len(rows)), y, 5, rounds=3000)
    miss = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(np.append(x.T @ miss + w, miss.sum())).max() < 0.05
