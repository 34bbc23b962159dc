"""Quality rules as weak supervision: rules vote good or bad or abstain.

Every rule looks at measures of the whole text. The rules' accuracies (how often each votes what on good
and on bad documents) and the share of good documents are estimated by expectation maximisation from the counts
of vote patterns (at most 3 to the power of the number of rules, however large the table), and a document is kept
if the posterior probability of being good is at least ``keep_from``. Nothing but a prior of a thousandth of the
table's weight (HOLD) holds the accuracies; of the two kinds of documents that the estimate tells apart, the one
with more good votes is the good one. A rule that votes bad on good and bad documents alike so counts for nothing,
and one bad vote may be outvoted. The base rules fail a document whatever the others say, and what they fail is no
part of the estimate.

Null and empty texts have no words and fail the base rules. Repeated rows are judged each for itself
(and each counts in the estimate). An empty table gives no rows. Other columns are ignored.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Shelf

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of so many words which the text has twice or more."""

    def among(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)))

    def covered(sorted_: Column) -> Column:
        same = lambda x, i, d: F.coalesce(x["h"] == F.get(sorted_, i + d)["h"], F.lit(False))
        twice = F.transform(F.filter(sorted_, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])
        return let(F.array_sort(twice), lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(hashed, among))


#: Words that are frequent in prose of several languages (fixed values).
FREQUENT = "a an and as at be by das de del der des die du ein el en es et für il in is it la las le les los mit of on ou para par pas por pour que qui se sur that the this to un una und une von was with y zu".split()
_END = r"(?=[.,;:!?]?(?:[\x20\x09-\x0D]|\z))"
FREQUENT_WORD = r"(?<![^\x20\x09-\x0D])(?:" + "|".join(FREQUENT) + ")" + _END
CAPITAL_WORD = r"(?<![^\x20\x09-\x0D])\p{Lu}{2,}+(?!\p{L})"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("t", SPACES), lambda x: x != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"[.!?\"”:;]$"))).cast("long").alias("n_closed"),
        ),
    )
    n = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    symbols = (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long")
    digits = (F.length("t") - F.length(F.regexp_replace("t", r"[0-9]+", ""))).cast("long")
    found = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    others = (F.length("t") - F.length(F.regexp_replace("t", r"[^\p{L}\x20\x09-\x0D]+", ""))).cast("long")
    counts = [symbols.alias("n_symbols"), others.alias("n_others"), digits.alias("n_digits"), found("(?i)" + FREQUENT_WORD).alias("n_frequent"), found(CAPITAL_WORD).alias("n_capital")]
    return base.select("doc_id", m.alias("m"), n.alias("n"), *counts).select(
        "doc_id", "m.n_words", "m.word_chars", "n_symbols", "n.n_dup_lines", "m.n_repeat_words", "m.n_closed", "n_digits", "n.n_lines", "n_frequent", "n_capital", "n_others"
    )


def share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def between(value: Column, bad_below: float, good_from: float, good_to: float, bad_above: float) -> Column:
    """1 in the good range, -1 outside the outer limits, 0 (abstains) between."""
    return F.when((value < bad_below) | (value > bad_above), -1).when(value.between(good_from, good_to), 1).otherwise(0)


INF = float("inf")


def rules() -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "length": between(words, 30, 60, 50_000, 200_000),
        "word_length": between(share("word_chars", "n_words"), 2.5, 3.5, 9, 14),
        "symbols": between(share("n_symbols", "n_words"), -1, 0, 0.02, 0.1),
        "same_lines": between(share("n_dup_lines", "n_lines"), -1, 0, 0.05, 0.3),
        "repeats": between(share("n_repeat_words", "n_words"), -1, 0, 0.03, 0.15),
        "sentences": F.when(words < 20, 0).otherwise(between(share("n_closed", "n_words"), 0.005, 0.02, 0.4, 0.7)),
        "frequent": F.when(words < 20, 0).otherwise(between(share("n_frequent", "n_words"), 0.02, 0.06, 0.7, 0.9)),
        "letters": between(share("n_others", "word_chars"), -1, 0, 0.08, 0.14),
        "capitals": between(share("n_capital", "n_words"), -1, 0, 0.1, 0.4),
        "digits": between(share("n_digits", "word_chars"), -1, 0, 0.05, 0.25),
    }


#: What the estimate starts from, and is held to by HOLD of the table's weight: chances of the votes -1, 0, 1.
START = {True: (0.02, 0.08, 0.90), False: (0.35, 0.15, 0.50)}
HOLD, GOOD = 0.001, 0.8


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[dict[bool, tuple[float, ...]]]]:
    """Share of good documents and, for each rule, the chances of its votes on good and on bad documents."""
    if not patterns:
        return 0.5, []
    k, n_all = len(patterns[0][0]), sum(n for _, n in patterns)
    good, chances = GOOD, [dict(START) for _ in range(k)]
    hold = max(1.0, HOLD * n_all)
    for _ in range(rounds):
        weight = [{g: [hold * x for x in START[g]] for g in (True, False)} for _ in range(k)]
        goods, before = hold * GOOD, good
        for votes, n in patterns:
            p = posterior(votes, good, chances)
            goods += n * p
            for r, v in enumerate(votes):
                weight[r][True][v + 1] += n * p
                weight[r][False][v + 1] += n * (1 - p)
        good = goods / (n_all + hold)
        chances = [{g: tuple(x / sum(w[g]) for x in w[g]) for g in (True, False)} for w in weight]
        if abs(good - before) < 1e-9:
            break
    if sum(c[True][2] - c[True][0] for c in chances) < sum(c[False][2] - c[False][0] for c in chances):
        good, chances = 1 - good, [{g: c[not g] for g in (True, False)} for c in chances]
    return good, chances


def posterior(votes: tuple[int, ...], good: float, chances: list[dict[bool, tuple[float, ...]]]) -> float:
    z = math.log(good / (1 - good)) + sum(math.log(c[True][v + 1] / c[False][v + 1]) for v, c in zip(votes, chances))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def judge(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, the rules' votes, quality (posterior) and kept."""
    shelf = Shelf(docs.sparkSession, "quality")
    votes = rules()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    table = shelf.put(measured(docs).select("*", failed.alias("base_failed"), *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()]), "votes")
    names = [f"vote_{k}" for k in votes]
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in map(tuple, table.where("not base_failed").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()))  # at most 3 ** rules
    good, chances = estimate(patterns)
    z = F.lit(math.log(good / (1 - good)))
    for name, c in zip(names, chances):
        worth = [math.log(c[True][v] / c[False][v]) for v in range(3)]
        z = z + F.when(F.col(name) < 0, worth[0]).when(F.col(name) > 0, worth[2]).otherwise(worth[1])
    out = table.withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
