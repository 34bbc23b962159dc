"""Personal data by boosted trees over candidate spans.

Base kinds are found by fixed patterns and checks. Generators of high recall propose further spans:
addresses with an at sign, groups of digits, and long tokens of letters and digits. Boosted trees weigh
features of a candidate's format and of the words before it; candidates that reach the calibrated
threshold are added, unless a base span or a better candidate overlaps them. Base spans always stay.
Nothing bounds the length of a span or the number of spans of a text.

The trees are fitted to candidates in short texts generated here (``examples``, a fixed number of them);
three in four are for the trees, the rest calibrate the threshold: the smallest with so many of the
accepted candidates right. They then run as a column expression: only DataFrame functions are used.

Null text counts as empty (no spans). Repeated rows and ties are searched each for itself; a null doc_id
is carried along. An empty table gives no rows. Other columns are ignored. Positions are code points.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let, total

KINDS = ("email", "ip", "card", "phone", "secret", "number")

_LOCAL = "A-Za-z0-9._%+-"
#: Each matches what the plain pattern of its kind matches at the leftmost places, in time linear in the
#: text: a run of signs is entered at its first sign only, or where the match before it ended.
#: A domain goes on, sign by sign, to the first point that no label follows (a loop over groups would need a stack as deep as the labels).
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Generators of the method.
AT = rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@|\(at\)|\[at\])[A-Za-z0-9.-]{{2,}}+"
DIGITS = r"(?<![0-9A-Za-z])[(]?[0-9][0-9 ().-]{6,}[0-9](?![0-9A-Za-z])"
TOKEN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+"


def swept(items: Column, zero: Column, kind: str, step) -> Column:
    """struct(state, out): one pass over an array. step(state, item) is the next state and an array of ``kind`` to put out.

    An array that grows is copied each time, so items go in chunks of about the root of their number: what is copied
    grows as n to the power of 1.5 in single numbers, and seldom counts beside the rest.
    """
    none, many = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    state = lambda now, out: F.struct(now.alias("state"), out.alias("out"))

    def one(a: Column, x: Column) -> Column:
        now, out = step(a["state"], x)
        return state(now, F.concat(a["out"], out))

    each = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / each).cast("int")), lambda k: F.slice(items, k * each + 1, each))
    whole = F.aggregate(chunks, state(zero, many), lambda a, c: let(F.aggregate(c, state(a["state"], none), one), lambda s: state(s["state"], F.concat(a["out"], F.array(s["out"])))))
    return let(whole, lambda w: state(w["state"], F.flatten(w["out"])))


def pattern_spans(text: Column, pattern: str, contexts: bool = False) -> Column:
    """array of struct(start, end, body[, before, after]) of the matches, leftmost and not overlapping."""

    def placed(found: Column, rest: Column) -> Column:
        lengths = F.transform(found, lambda x, i: F.struct(F.length(F.get(rest, i)).alias("gap"), F.length(x).alias("own")))
        start = swept(lengths, F.lit(0), "int", lambda at, x: (at + x["gap"] + x["own"], F.array(at + x["gap"])))["out"]
        more = (lambda i: [F.lower(F.right(F.get(rest, i), F.lit(24))).alias("before"), F.left(F.get(rest, i + 1), F.lit(2)).alias("after")]) if contexts else lambda i: []
        return let(start, lambda s: F.transform(found, lambda x, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), x.alias("body"), *more(i))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern), lambda rest: placed(found, rest))))


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""

    def sign(i: Column) -> Column:
        d = F.substring(digits, -1 - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * d).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return total(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), sign)) % 10 == 0


def base_spans(text: Column) -> Column:
    """array of struct(start, kind, end) of the base kinds; kind is a place in KINDS."""
    digit = text.rlike("[0-9]")
    checks = (
        (EMAIL, text.contains("@"), lambda x: F.lit(True)),
        (IP, digit & text.contains("."), lambda x: F.forall(F.split(x, r"\."), lambda p: p.cast("double") <= 255)),
        (CARD, digit, lambda x: luhn(digits_of(x))),
        (PHONE, text.contains("+"), lambda x: F.length(digits_of(x)).between(10, 15)),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def of_kind(kind: int, pattern: str, there: Column, good) -> Column:
        right = F.filter(pattern_spans(text, pattern), lambda x: good(x["body"]))
        return F.coalesce(F.when(there, F.transform(right, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))), none)

    return F.array_sort(F.concat(*[of_kind(k, *check) for k, check in enumerate(checks)]))


#: Words before a candidate that speak for or against it (fixed values).
FOR_CONTACT = r"(tel|phone|call|fax|mobile|cell|contact|dial|text me|reach)[^a-z0-9]*(at|on|is|me|us|number|no)?[^a-z0-9]*$"
FOR_ACCOUNT = r"(ssn|social security|iban|account|acct|passport|card|tax id|member|license|licence|dob|born)[^a-z0-9]*(no|number|is|nr)?[^a-z0-9]*$"
FOR_SECRET = r"(token|key|secret|password|passwd|pwd|auth|bearer|credential|apikey)[^a-z0-9]*(is)?[^a-z0-9]*$"
AGAINST = r"(version|release|isbn|issn|doi|order|invoice|page|pages|chapter|figure|table|part|commit|sha|build|rev|revision|id|uuid|checksum|md5|between|from|years?)[^a-z0-9]*(no|number|is)?[^a-z0-9]*$"

#: What the candidate itself may look like.
SHAPES = (
    r"^\(?[0-9]{3}[)]?[ .-]+[0-9]{3}[ .-][0-9]{4}$",
    r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    r"^(19|20)[0-9]{2}[ .-]",
    r"^97[89][ -]?[0-9]",
    r"^[0-9a-f]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-",
    r"(_|-|/).*(_|-|/).*(_|-|/)",
    r"^(AKIA|ghp_|gho_|sk-|sk_|xox[bp]-|AIza|eyJ)",
    r"(\. | \.|  |--|\.\.)",
)


def features(gen: int, c: Column) -> list[Column]:
    body, n = c["body"], F.length(c["body"])
    d = F.length(digits_of(body))
    letters = F.length(F.regexp_replace(body, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(body, "[^A-Z]", ""))
    groups = F.size(F.split(body, "[^0-9]+"))
    given = lambda p: c["before"].rlike(p)
    values = [F.lit(gen), n, d, letters, upper, groups, given(FOR_CONTACT), given(FOR_ACCOUNT), given(FOR_SECRET), given(AGAINST), c["before"].rlike(r"[\"'=:]\s*$"), c["after"].rlike(r"^[\"']"), c["before"].rlike(r"[0-9%$€.,]\s?$"), *[body.rlike(s) for s in SHAPES]]
    return [v.cast("double") for v in values]


GENERATORS = ((AT, "email"), (DIGITS, "number"), (TOKEN, "secret"))


def candidates(text: Column) -> Column:
    """array of struct(start, end, gen, dot, f): what the generators propose, whether a point stands before it, and features."""
    none = F.array().cast("array<struct<start:int,end:int,gen:int,dot:boolean,f:array<double>>>")

    def proposed(gen: int, pattern: str) -> Column:
        there = text.rlike(r"@|at[)\]]") if gen == 0 else text.rlike("[0-9]")
        made = F.transform(pattern_spans(text, pattern, contexts=True), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(gen).alias("gen"), F.coalesce(c["before"].endswith("."), F.lit(False)).alias("dot"), F.array(*features(gen, c)).alias("f")))
        return F.coalesce(F.when(there, made), none)

    return F.concat(*[proposed(gen, pattern) for gen, (pattern, _) in enumerate(GENERATORS)])


# --- the trees ---------------------------------------------------------------------------------


def grow(x: list[list[float]], g: list[float], h: list[float], rows: list[int], depth: int):
    """A regression tree by second-order gain: (feature, limit, low, high), or a leaf's value."""
    total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
    best = (1e-3, None, None)
    if depth and len(rows) >= 8:
        for k in range(len(x[0])):
            order = sorted(rows, key=lambda i: x[i][k])
            low_g = low_h = 0.0
            for a, b in zip(order, order[1:]):
                low_g, low_h = low_g + g[a], low_h + h[a]
                if x[a][k] == x[b][k]:
                    continue
                gain = low_g**2 / (low_h + 1) + (total_g - low_g) ** 2 / (total_h - low_h + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, k, (x[a][k] + x[b][k]) / 2)
    _, k, limit = best
    if k is None:
        return -total_g / (total_h + 1)
    low, high = [i for i in rows if x[i][k] <= limit], [i for i in rows if x[i][k] > limit]
    return k, limit, grow(x, g, h, low, depth - 1), grow(x, g, h, high, depth - 1)


def leaf(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(x: list[list[float]], y: list[int], trees: int = 16, depth: int = 3, rate: float = 0.4) -> list:
    z, out = [0.0] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in z]
        tree = grow(x, [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], list(range(len(y))), depth)
        out.append(tree)
        z = [v + rate * leaf(tree, r) for v, r in zip(z, x)]
    return out


def tree_column(tree, f: Column, rate: float = 0.4) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(rate * tree)
    k, limit, low, high = tree
    return F.when(F.get(f, F.lit(k)) <= limit, tree_column(low, f, rate)).otherwise(tree_column(high, f, rate))


def examples(n: int = 900, seed: int = 11) -> list[tuple[str, int, int]]:
    """Texts with one marked stretch each: (text, start of a private span or -1, its end)."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    any_of = lambda signs, k: "".join(r.choice(signs) for _ in range(k))
    hexes, mixed_ = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    private = (
        lambda: ("", r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(number(3), number(3), number(4))),
        lambda: (r.choice(("call ", "phone: ", "tel. ", "Reach me at ", "fax ")), r.choice(("({}) {}-{}", "{}-{}-{}", "0{} {} {}")).format(number(3), number(3), number(4))),
        lambda: (r.choice(("SSN ", "social security number ", "", "ssn: ")), f"{number(3)}-{number(2)}-{number(4)}"),
        lambda: (r.choice(("account ", "account no. ", "passport number ", "acct: ")), number(r.randint(8, 12))),
        lambda: (r.choice(('token = "', "api_key=", "secret: ", 'password = "', "Bearer ", 'key = "')), any_of(r.choice((hexes, mixed_)), r.choice((20, 24, 32, 40, 48)))),
        lambda: ("", r.choice(("AKIA", "ghp_", "sk-")) + any_of(mixed_, 24)),
        lambda: ("", f"{word()}.{number(2)}@{word()}"),
        lambda: ("", f"{word()}(at){word()}.com"),
    )
    public = (
        lambda: (r.choice(("version ", "release ", "build ")), f"{number(1)}.{number(2)}.{number(3)}.{number(2)}"),
        lambda: (r.choice(("", "on ")), f"20{number(2)}-0{r.randint(1, 9)}-1{number(1)}"),
        lambda: (r.choice(("from ", "between ", "")), f"19{number(2)} - 20{number(2)}"),
        lambda: (r.choice(("order ", "invoice no. ", "id ", "part ")), number(r.randint(8, 12))),
        lambda: (r.choice(("ISBN ", "isbn: ", "")), f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}"),
        lambda: ("", " ".join(number(r.randint(1, 2)) for _ in range(r.randint(4, 9)))),
        lambda: (r.choice(("commit ", "sha: ", "md5 ", "revision ")), any_of(hexes, r.choice((32, 40)))),
        lambda: (r.choice(("uuid ", "id ", "")), f"{any_of(hexes, 8)}-{any_of(hexes, 4)}-4{any_of(hexes, 3)}-a{any_of(hexes, 3)}-{any_of(hexes, 12)}"),
        lambda: ("", "_".join(word() for _ in range(4)) + number(1)),
        lambda: ("", f"{word()}/{word()}/{number(4)}/{word()}-{word()}"),
        lambda: (r.choice(("$", "sum ", "€ ")), f"{number(1)}{number(2)} {number(3)} {number(3)}.{number(2)}"),
        lambda: ("", f"{number(1)}. {number(2)}. {number(3)}. {number(2)}."),
    )
    made = []
    for k in range(n):
        lead, body = r.choice(private if k % 2 else public)()
        start = " ".join(word() for _ in range(r.randint(0, 5)))
        start += " " * bool(start) + lead
        end = ('"' if lead.endswith('"') else "") + r.choice(("", ".", ",", " ")) + " " + " ".join(word() for _ in range(3))
        made.append((start + body + end, len(start) if k % 2 else -1, len(start + body)))
    return made


def trained(spark: SparkSession, right: float = 0.97) -> tuple[list, float]:
    """The trees, and the smallest score at which so many accepted calibration candidates are right."""
    made = examples()
    quoted = ", ".join("(%d, '%s')" % (k, t.replace("\\", "\\\\").replace("'", "\\'")) for k, (t, _, _) in enumerate(made))
    table = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(k, text)").select("k", F.explode(candidates(F.col("text"))).alias("c")).select("k", "c.*").orderBy("k", "start", "gen")
    sets: tuple[tuple[list, list], tuple[list, list]] = ([], []), ([], [])
    for row in table.collect():  # candidates of the generated texts
        _, start, end = made[row["k"]]
        x, y = sets[row["k"] // 2 % 4 == 3]
        x.append(list(row["f"]))
        y.append(int(start >= 0 and row["start"] <= start + 1 and row["end"] >= end - 1))
    trees = boost(*sets[0])
    scored = sorted(((0.4 * sum(leaf(t, x) for t in trees), y) for x, y in zip(*sets[1])), reverse=True)
    limit, hits = 0.0, 0
    for k, (z, y) in enumerate(scored, 1):
        hits += y
        if hits >= right * k:
            limit = z
    return trees, max(limit - 1e-6, 0.0)


def undisputed(spans: Column) -> Column:
    """Of spans (start, kind, end, dot, z) in order those that no other one of a higher z overlaps (of equal z, no earlier one); infinite z stays.

    One sweep: spans of one pattern do not overlap each other, so never more are open than there are patterns.
    """
    span = "struct<start:int,kind:int,end:int,dot:boolean,z:double,beaten:boolean>"
    names = ("start", "kind", "end", "dot")
    marked = lambda x, beaten: F.struct(*[x[k].alias(k) for k in (*names, "z")], beaten.alias("beaten"))

    def step(open_: Column, y: Column) -> tuple[Column, Column]:
        over = F.filter(open_, lambda o: o["end"] <= y["start"])
        there = F.filter(open_, lambda o: o["end"] > y["start"])
        now = F.transform(there, lambda o: marked(o, o["beaten"] | (o["z"] < y["z"])))
        own = marked(y, F.exists(there, lambda o: o["z"] >= y["z"]))
        return F.concat(now, F.array(own)), over

    every = let(swept(spans, F.array().cast(f"array<{span}>"), span, step), lambda w: F.concat(w["out"], w["state"]))
    kept = F.filter(every, lambda x: ~x["beaten"] | (x["z"] == float("inf")))
    return F.array_sort(F.transform(kept, lambda x: F.struct(*[x[k].alias(k) for k in names])))


def dotted(spans: Column) -> Column:
    """struct(start, kind, end); secrets with nothing but a point between them, as signed tokens are written, are one span."""
    secret, span = KINDS.index("secret"), "struct<start:int,kind:int,end:int>"
    plain = lambda x, start=None: F.struct((x["start"] if start is None else start).alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        tied = F.coalesce(x["dot"] & (x["kind"] == secret) & (last["kind"] == secret) & (last["end"] + 1 == x["start"]), F.lit(False))
        nothing = F.array().cast(f"array<{span}>")
        return F.when(tied, plain(x, last["start"])).otherwise(plain(x)), F.when(tied | last.isNull(), nothing).otherwise(F.array(last))

    joined = let(swept(spans, F.lit(None).cast(span), span, step), lambda w: F.concat(w["out"], F.filter(F.array(w["state"]), lambda x: x.isNotNull())))
    twice = F.size(F.filter(spans, lambda x: x["kind"] == secret)) > 1
    return F.when(twice, joined).otherwise(F.transform(spans, lambda x: plain(x)))


def search(docs: DataFrame, model: tuple[list, float] | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of struct(start, kind, end), kind as a place in KINDS, both in order."""
    trees, limit = model or trained(docs.sparkSession)
    place = {gen: KINDS.index(kind) for gen, (_, kind) in enumerate(GENERATORS)}

    def accepted(text: Column) -> Column:
        def weighed(c: Column) -> Column:
            z = tree_column(trees[0], c["f"])
            for t in trees[1:]:
                z = z + tree_column(t, c["f"])
            kind = F.lit(place[0])
            for gen in range(1, len(GENERATORS)):
                kind = F.when(c["gen"] == gen, place[gen]).otherwise(kind)
            return F.struct(c["start"].alias("start"), kind.alias("kind"), c["end"].alias("end"), c["dot"].alias("dot"), z.alias("z"))

        return F.filter(F.transform(candidates(text), weighed), lambda x: x["z"] >= limit)

    def joined(base: Column, found: Column) -> Column:
        everything = F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(False).alias("dot"), F.lit(float("inf")).alias("z"))), found))
        return let(undisputed(everything), dotted)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worth = F.col("__t").rlike(r"[0-9@]|at[)\]]")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("__t"))
    both = let(base_spans(F.col("__t")), lambda b: F.struct(b.alias("base"), let(accepted(F.col("__t")), lambda c: F.when(F.size(c) == 0, b).otherwise(joined(b, c))).alias("spans")))
    found = F.coalesce(F.when(worth, both), F.struct(none.alias("base"), none.alias("spans")))
    return rows.select("doc_id", found.alias("x")).select("doc_id", "x.base", "x.spans")


def named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from the spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text: each span of a text replaced by the name of its kind in brackets."""
    names = F.array(*map(F.lit, KINDS))
    joined = docs.select("doc_id", "text").join(found.select("doc_id", "spans"), "doc_id")
    # pieces are cut from the signs as an array: finding a place in a text takes as long as all before it
    cut = lambda signs, at, end: F.array_join(F.slice(signs, at + 1, F.greatest(end - at, F.lit(0))), "")
    step = lambda at, x: (F.greatest(at, x["end"]), F.array(F.struct(at.alias("at"), x["start"].alias("end"), F.get(names, x["kind"]).alias("kind"))))
    swept_ = lambda: swept(F.col("spans"), F.lit(0), "struct<at:int,end:int,kind:string>", step)
    whole = lambda signs, w: F.concat(F.array_join(F.transform(w["out"], lambda x: F.concat(cut(signs, x["at"], x["end"]), F.lit("["), x["kind"], F.lit("]"))), ""), cut(signs, w["state"], F.size(signs)))
    done = let(F.split("text", ""), lambda signs: let(swept_(), lambda w: whole(signs, w)))
    return joined.select("doc_id", done.alias("text"))
