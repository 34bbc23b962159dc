"""Spans against a plain scan, and rows that are odd."""

import random
import re

from pyspark.sql import functions as F

from glasspane.llm import licenses

UP = {c: c + 32 for c in range(65, 91)}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def told(own: list[str], label: str) -> set[int]:
    """Places of words that another label's template lacks, if it has four fifths of the words."""
    out = set()
    for other, theirs in licenses.TEMPLATES.items():
        missing = {q for q, x in enumerate(own) if x not in other.split()}
        if theirs != label and len(missing) <= 0.2 * len(own):
            out |= missing
    return out


def plain(text: str) -> list[tuple[str, int, int, float]]:
    """Spans by loops over all grams, template by template; then the best of those that overlap."""
    w, base, out = re.findall(WORD, text.translate(UP)), [], []
    for t, label in [*licenses.BASE.items(), *licenses.TEMPLATES.items()]:
        own = t.split()
        k = min(licenses.GRAM, len(own))
        votes: dict[int, set[int]] = {}
        for p in range(len(w) - k + 1):
            for q in range(len(own) - k + 1):
                if w[p : p + k] == own[q : q + k]:
                    votes.setdefault(p - q, set()).add(q)
        groups: list[list[int]] = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= 2 and t not in licenses.BASE:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            covered = {q + i for d in g for q in votes[d] for i in range(k)}
            first, last = min(d + min(votes[d]) for d in g), max(d + max(votes[d]) + k - 1 for d in g)
            share = 2 * len(covered) / (len(own) + max(len(covered), last - first + 1))
            if share >= 0.8 and (t in licenses.BASE or told(own, label) <= covered):
                (base if t in licenses.BASE else out).append((label, first, last, share))
    rank = lambda x: (x[3], x[2] - x[1])
    out = [x for x in out if not any(y[1] <= x[2] and x[1] <= y[2] and rank(y) > rank(x) for y in out)]
    return sorted(base + out, key=lambda x: (x[1], x[2], x[0]))


def labelled(spark, *texts):
    got = licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    return [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_siblings_are_told_apart(spark):
    """A notice has its own license and none of its siblings', whole or damaged; words strewn over a text have none."""
    notice = "this work is licensed under a creative commons attribution {} 4 0 international license"
    kinds = {"": "cc-by", "sharealike": "cc-by-sa", "noncommercial": "cc-by-nc", "noncommercial sharealike": "cc-by-nc-sa", "noderivatives": "cc-by-nd", "noncommercial noderivatives": "cc-by-nc-nd"}
    whole = [notice.format(k) for k in kinds]
    assert labelled(spark, *whole) == list(kinds.values())
    assert labelled(spark, *[f"some text before it. {t.title()}, and more." for t in whole]) == list(kinds.values())
    words = notice.format("").split()
    strewn = " ".join(x for k in range(0, len(words), 3) for x in [*words[k : k + 3], "foreign", "words"])
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
    damaged = notice.format("").replace("license", "licence").replace("licenced", "licensed")
    assert labelled(spark, strewn, damaged, lgpl, lgpl.replace("Lesser ", "")) == ["", "cc-by", "gpl,lgpl", "gpl"]


def test_ties_of_templates_both_stay(spark):
    """Two templates of one text: spans that are equally good are both kept, whatever their order."""
    docs = spark.createDataFrame([(1, "here: one two three four five six. bye")], "doc_id long, text string")
    for extra in ({"one two three four five six": "a", "two three four five six bye": "b"}, {"two three four five six bye": "b", "one two three four five six": "a"}):
        assert licenses.digest(licenses.scan(docs, extra)).first()["labels"] == "a,b"


def test_spans_like_a_plain_scan(spark):
    r, rows = random.Random(5), []
    notices = [*licenses.TEMPLATES, *licenses.BASE]
    for k in range(60):
        words = []
        for _ in range(r.randint(1, 4)):
            words += [f"w{r.randint(0, 50)}" for _ in range(r.randint(0, 12))]
            own = r.choice(notices).split()
            for _ in range(r.randint(0, max(1, len(own) // 10))):
                at = r.randrange(len(own))
                own[at : at + r.randint(0, 1)] = [f"x{r.randint(0, 9)}"] * r.randint(0, 1)
            words += own
        rows.append((k, " ".join(words).title()))
    got = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        assert [(a, b, c, round(d, 9)) for a, b, c, d in got[k]] == [(a, b, c, round(d, 9)) for a, b, c, d in plain(text)]


def test_odd_rows(spark):
    text = "Released under the MIT License. All rights reserved; all rights reserved"
    rows = [(1, text), (1, text), (1, "cc by"), (None, text), (2, None), (3, ""), (4, "all rights reserved " * 20_000), (5, "é" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("which", "place", "gram", "template", "label", "d")})
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in licenses.digest(licenses.scan(docs)).collect()), key=str)
    own = (11, 2, 5, 8, "reserved", "mit,reserved", 1.0)
    want = [(1, *own), (1, *own), (1, 2, 1, 0, 0, "cc-by", "cc-by", 1.0), (None, *own), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 60_000, 20_000, 0, 59_997, "reserved", "reserved", 1.0), (5, 1, 0, None, None, "", "", 0.0)]
    assert got == sorted(want, key=str)
    assert licenses.scan(docs.limit(0)).collect() == []
