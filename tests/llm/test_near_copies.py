"""A large group of near copies: the pairs that are compared grow with the group, not with its square."""

import random

import pytest

from glasspane.llm import minhash


def brute(rows, size, percent):
    sets = {k: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for k, w in ((k, t.split()) for k, t in rows)}
    least = {k: k for k in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("changes", [(0, 8), (3, 6)])
def test_copies_changed_in_their_own_places(spark, monkeypatch, changes):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(240):
        words = list(base)
        for place in rng.sample(range(150), rng.randint(*changes)):
            words[place] = rng.choice(("of", "in", f"own{k}", f"x{rng.randint(0, 40)}"))
        rows.append((k, " ".join(words[: rng.choice((150, 150, 150, 144))])))
    compared = []
    real = minhash.Linker.estimated
    monkeypatch.setattr(minhash.Linker, "estimated", lambda self, pairs: compared.append(pairs.count()) or real(self, pairs))
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == brute(rows, 4, 80)
    assert max(compared) < 30 * len(rows), compared


def test_shared_values_are_counted_by_differences(spark, monkeypatch):
    """Classes of a large group are told by what sets them apart from a hub, and only similar ones are compared late."""
    rng = random.Random(7)
    rows = []
    for k in range(320):
        words = [f"w{k}" for k in range(150)]
        for place in rng.sample(range(150), rng.randint(1, 10)):
            words[place] = f"own{k}x{place}"
        rows.append((k, " ".join(words)))
    counted, compared, put, real = [], [], minhash.Shelf.put, minhash.Linker.estimated

    def noted(self, frame, name):
        table = put(self, frame, name)
        if name == "values":
            counted.append(table.count())
        return table

    monkeypatch.setattr(minhash.Shelf, "put", noted)
    monkeypatch.setattr(minhash.Linker, "estimated", lambda self, pairs: compared.append(pairs.count()) or real(self, pairs))
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == brute(rows, 4, 80)
    assert counted and max(counted) < 147 * len(rows) / 2, counted
    assert compared[-1] < len(rows), compared
