"""Operators against brute force, round trips and held-out labels, on the small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspane.llm import decontaminate, licenses, lines, minhash, packing, pii, quality, queries, urls
from glasspane.llm.words import ALPHANUMERIC, UNSPACED, Words

UP = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_word_hashes_tell_words_apart():
    texts = ["Ab ab\tAB  b", "", "é-É x9", "ab"]
    for kind, pattern in ((UNSPACED, r"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words([t.encode() for t in texts], kind)
        want = [re.findall(pattern, t.translate(UP)) for t in texts]
        assert np.diff(w.first).tolist() == list(map(len, want))
        flat = sum(want, [])
        assert len(set(w.hashes.tolist())) == len(set(flat))
        assert [w.hashes.tolist().index(h) for h in w.hashes.tolist()] == [flat.index(x) for x in flat]


def test_packing(spark, sf, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out = queries.op9_packing(spark, sf).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert sum(r["length"] for r in pieces) == len(ids) and all(r["length"] == 2048 for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_bin) <= 1.02 * sum(r["length"] for r in out) / 2048 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_pack_every_length(seed):
    rng = np.random.default_rng(seed)
    histogram = collections.Counter(rng.integers(1, rng.integers(2, 2049), 500).tolist())
    p = packing.plan(dict(histogram), groups=20, small_up_to=int(rng.integers(50, 1000)))
    room, placed = collections.Counter(), collections.Counter()
    ends = {}
    for k in range(len(p["length"])):
        length, rank = int(p["length"][k]), int(p["rank"][k])
        following = [int(p["rank"][j]) for j in range(len(p["length"])) if p["length"][j] == length and p["rank"][j] > rank]
        n = (min(following) if following else histogram[length]) - rank
        placed[length] += n
        for past in range(n):
            room[int(p["bin"][k]) + past // int(p["each"][k])] += length
    assert placed == histogram and max(room.values()) <= 2048 and not ends
    assert len(room) == int(p["bins"][0])


def test_plain_words_encode_as_whole_texts():
    encoder = packing.Encoder(queries.tokenizer_path())
    for t in ["I'm  here\n\n  x '' 'S don't  ", "a\tb", "été ñ  12ab3's ²", " <|endoftext|> q", "x" * 5000, "a \n b", "  ", "\n"]:
        assert encoder(t) == encoder.whole(t)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(sets, percent=80):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_near_duplicates(spark, sf, texts):
    sets = {k: shingles(t, 4) for k, t in texts.items()}
    want = components(sets)
    for r in queries.op7_minhash(spark, sf).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_one_large_family(spark):
    """Copies with a few words changed, more than any short list holds, and texts that share one passage."""
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(0, 5000))
    base, passage, rows = [word() for _ in range(150)], [word() for _ in range(40)], []
    for k in range(120):
        own = list(base)
        for p in rng.integers(0, 150, rng.integers(0, 9)):
            own[p] = word()
        rows.append((k, " ".join(own)))
    long_ = [word() for _ in range(500)]
    for k in range(200, 280):
        own = list(long_)
        for p in rng.integers(0, 500, rng.integers(0, 25)):
            own[p] = word()
        rows.append((k, " ".join(own)))
    rows += [(k, " ".join(passage + [word() for _ in range(rng.integers(5, 30))])) for k in range(400, 460)]
    sets = {k: shingles(t, 5) for k, t in rows}
    want = components(sets)
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_sizes_around_what_is_posted(spark):
    """Pairs at or just under the limit, one of which is a part of the other, at sizes where posting changes."""
    rng, rows, doc = np.random.default_rng(8), [], 0
    for n in (40, 48, 50, 51, 52, 56, 60, 63, 64, 65, 80, 100, 128, 205, 256, 300):
        for extra in (n // 4 - 1, n // 4, n // 4 + 1):
            words = ["v" + str(x) for x in rng.integers(0, 10**9, n + extra + 4)]
            rows += [(doc, " ".join(words[: n + 4])), (doc + 1, " ".join(words[: n + extra + 4]))]
            doc += 2
    sets = {k: shingles(t, 5) for k, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - 1 if k % 2 and 100 * len(sets[k - 1]) >= 80 * len(sets[k]) else k for k in sets}


def test_components_of_paths_and_stars(spark):
    from glasspane.llm.shared import Shelf

    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 301), (301, 300), (302, 302)]
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long"), Shelf(spark, "t")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}


def test_quality_measures(spark, sf, texts):
    for r in queries.op5_quality(spark, sf).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        worded = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen, covered = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                covered.update(range(i, i + 8))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(worded) - len(set(worded)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["kept"] and r["base_failed"])


def test_estimate_finds_the_telling_rule():
    patterns = [((1, 1, 1), 900), ((1, -1, 1), 60), ((1, 1, 0), 40)]
    good, chances = quality.estimate(patterns)
    assert quality.posterior((1, 1, 1), good, chances) > 0.9 > 0.5 > quality.posterior((1, -1, 1), good, chances)


def test_licenses(spark, sf, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for r in queries.op2_licenses(spark, sf).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(UP))
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}


def test_license_with_changed_words(spark):
    changed = "Permission is hereby granted, free of cost, to any person obtaining one copy of this software and its associated documentation files"
    rows = [(1, "x y " + changed + " z"), (2, "permission is granted to nobody of this software"), (3, "Released under the MIT License.")]
    got = {r["doc_id"]: r["labels"] for r in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "mit", 2: "", 3: "mit"}


def test_urls_like_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(tuple, c.execute(urls.verdicts_sql()).fetchall()))
    got = sorted(tuple(r) for r in queries.op4_urls(spark, sf).collect())
    assert got == want


def test_url_parts_and_templates(spark):
    rows = [(k, f"http://a.org/es/{k}") for k in range(20)] + [(100, "https://X.Example.com/en/7a?q"), (101, "nothing"), (102, None), (103, "ftp://b.net/de/1#x://y"), (104, "http://a.org/news/x")]
    got = {r["page_id"]: r for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0]["verdict"] == "block" and got[0]["rule"] == "org/es/"
    assert (got[100]["host"], got[100]["path"], got[100]["rule"], got[100]["verdict"]) == ("x.example.com", "/en/7a", "example.com/en/7", "allow")
    assert (got[101]["host"], got[101]["path"], got[102]["verdict"]) == ("", "", "allow") and got[103]["path"] == "/de/1" and got[104]["verdict"] == "allow"


def base_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(x):
        q = [int(c) for c in reversed(x)]
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(q)) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


def test_personal_data(spark, sf):
    made = "a@b.c.d_x@y.zz q 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111, +1 (377) 555-0271 é 4111-1111-1111-1111-1 +12 345 67890- u@v"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, made), (-2, "+1+1+1+1234567890 and 1.2.3.4 " * 300), (-3, "1 " * 20_000)], "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in pii.digest(pii.search(rows)).collect():
        base = base_spans(text[r["doc_id"]])
        named = [f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r["spans"].split(",")) and (r["n_email"], r["n_ip"]) == (sum(k == 0 for _, k, _ in base), sum(k == 1 for _, k, _ in base))


def test_personal_data_beyond_the_base(spark):
    rows = [(1, "call (974) 555-3436 now"), (2, 'token = "ede43f42c939b6405768150e0411590525cf889e"'), (3, "version 1.22.333.44 of 2021-03-11"), (4, "see report_of_the_annual_meeting1 and isbn 978-3-161484-1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.search(docs)
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(found).collect()}
    assert spans[1] == "number:5:19" and spans[2] == "secret:9:49" and spans[3] == "" and spans[4] == ""
    assert {r["doc_id"]: r["text"] for r in pii.redacted(docs, found).collect()}[1] == "call [number] now"


def test_personal_data_without_digits_and_long_secrets(spark):
    secret = "aB3" * 400
    late = "x" * 300 + "4" + "Yz" * 20
    rows = [(1, "write to john(at)example.com soon"), (2, f'token = "{secret}" end'), (3, f'token = "{late}" end'), (4, "nothing at) all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ([1.0 / 0.4], 0.0)  # every candidate counts
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.search(docs, model)).collect()}
    assert got == {1: "email:9:28", 2: f"secret:9:{9 + len(secret)}", 3: f"secret:9:{9 + len(late)}", 4: ""}
    assert {r["doc_id"]: r["spans"] for r in pii.digest(pii.search(docs)).collect()}[1] == "email:9:28"


def test_line_templates(spark):
    boiler = "Copyright notice of page {} shown to all of our readers on this day {} by the desk of news and more"
    passage = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(k, f"own line of text number {chr(97 + k)} alpha beta gamma\n{boiler.format(k, k * 7)}\n" + (passage if k < 2 else "")) for k in range(5)]
    rows += [(10, "a clean text\nof two lines"), (11, f"{passage}")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 10}  # 11 held nothing but the passage
    assert got[0] == rows[0][1] and got[10] == rows[5][1]
    assert all("Copyright" not in got[k] and "own line" in got[k] for k in range(1, 5)) and passage not in got[1]


def test_line_templates_by_brute_force(spark, sf, texts):
    """No line of eight words stands in two documents afterwards, and lines that stand in one only stay, unless templates are alike."""
    got = {r["doc_id"]: r["text"] for r in queries.op3_lines(spark, sf).collect()}
    own = lambda t: {x for x in t.split("\n") if len(x.split()) >= 8}
    after = collections.Counter(x for t in got.values() for x in own(t))
    assert max(after.values()) == 1
    before = {x for t in texts.values() for x in own(t)}
    assert len(before - set(after)) < 0.01 * len(before)
    for doc, t in got.items():
        kept = t.split("\n")
        rest = iter(texts[doc].split("\n"))
        assert all(x in rest for x in kept)


def test_tables_of_numbers_are_no_repeats(spark):
    """Rows of numbers recur only with their values; so do lines of few literal words, until many documents have them."""
    table = lambda k, n: "\n".join(" ".join(str(k * 1000 + 37 * i + j) for j in range(n)) for i in range(6))
    rows = [(k, f"{table(k, 9)}\n{table(k, 5)}\n{table(k, 20)}") for k in range(12)]
    rows += [(20 + k, f"text {chr(97 + k)} of it\ntotal of {k} items was {k + 7} and {k * 3} {k * 5} sold\nsame row " + " ".join(map(str, range(8)))) for k in range(3)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = "\nsame row " + " ".join(map(str, range(8)))
    assert got == dict(rows[:13]) | {k: t.removesuffix(same) for k, t in rows[13:]}


def test_passages_within_lines(spark):
    """A passage goes where other text stands around it, over other line ends too; 49 words of it, or few different words, stay."""
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55)]
    said, few = " ".join(words), " ".join(["ab", "cd"] * 30)
    rows = [(1, f"first of all {said} and so on\nlast line here"), (2, f"quite another start\nhere {said.upper()} with a tail\nend of it"), (3, "wrapped " + "\n".join(" ".join(words[k : k + 6]) for k in range(0, 55, 6)) + "\nmore to say")]
    rows += [(4, "too short " + " ".join(words[:49]) + " for a passage"), (5, f"x {few} y"), (6, f"z {few} q r"), (7, said)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()}
    assert got == dict(rows[:1] + rows[3:6]) | {2: "quite another start\nhere with a tail\nend of it", 3: "wrapped\nmore to say"}


def test_passages_by_brute_force(spark, sf, texts):
    """After lines, exactly the words of 50-word runs that an earlier document has go."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    only_lines, got = ({r["doc_id"]: r["text"].translate(UP).split() for r in lines.dedup(df, passages=p).collect()} for p in (False, True))
    runs = lambda w: [(k, tuple(w[k : k + 50])) for k in range(len(w) - 49) if len(set(w[k : k + 50])) >= 20]
    owners = collections.defaultdict(list)
    for doc, t in texts.items():
        for x in {x for _, x in runs(t.translate(UP).split())}:
            owners[x].append(doc)
    cut = {doc: {k + i for k, x in runs(t.translate(UP).split()) if min(owners[x]) < doc for i in range(50)} for doc, t in texts.items()}
    assert any(cut.values())
    for doc, t in texts.items():
        w = t.translate(UP).split()
        kept = [x for k, x in enumerate(w) if k not in cut[doc]]
        if only_lines.get(doc) == w:
            assert got.get(doc, []) == kept
        assert not collections.Counter(got.get(doc, [])) - collections.Counter(kept)
    assert max(collections.Counter(x for w in got.values() for x in {x for _, x in runs(w)}).values()) == 1


def test_leaks(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    grams = collections.defaultdict(set)
    for i, t in items.items():
        w = re.findall(r"\S+", t.lower())
        for k in range(len(w) - 9):
            grams[tuple(w[k : k + 10])].add(i)
    want = {(d, i) for d, t in texts.items() for w in [re.findall(r"\S+", t.lower())] for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, sf).collect()} == want


def test_leaks_with_other_values(spark):
    item = "If Mary buys 5 apples at the market for 2 dollars each and Mary sells 5 of them to Tom tomorrow, how much?"
    rows = [(1, "Filler. If Anna buys 12 apples at the market for 3 dollars each and Anna sells 12 of them to Bob tomorrow, how much? ok"), (2, "If Anna buys 12 apples at the market for 3 dollars each and Kim sells 99 of them to Bob tomorrow, how much?"), (3, "apples at the market are for sale")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["same_slots"]) for r in got] == [(1, 7, False)]


def test_leaks_after_a_look_alike(spark):
    item = "If Mary buys 5 apples at the market for 2 dollars each and Mary sells 5 of them to Tom tomorrow, how much?"
    alike = "If Anna buys 12 apples at the market for 3 dollars each. She goes home. "
    rows = [(1, alike + item), (3, item.replace("each and Mary", "each and every Mary") + " " + alike)]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["first_word"], r["same_slots"]) for r in got) == [(1, 15, True), (3, 0, True)]


def test_leaks_of_short_and_placeholder_items(spark):
    items = [(1, "Where did the king hide all of his gold"), (2, "Add 12 , 15 , 18 , 1.5 , 24 , 27 and 30 now"), (3, "Sum 3 4 5 6 7")]
    rows = [(1, "She asks Where did the king hide all of his gold today"), (2, "so add 12 , 15 , 18 , 1.5 , 24 , 27 and 30 now"), (3, "so add 12 , 15 , 18 , 105 , 24 , 27 and 30 now"), (4, "the sum 3 4 5 6 7 is"), (5, "the sum 3 4 5 6 8 is")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"], r["same_slots"]) for r in got) == [(1, 1, 1.0, True), (2, 2, 1.0, True), (4, 3, 1.0, True)]


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = queries.op6_language(spark, sf).join(docs, "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_toxic_words_are_learned(spark):
    from glasspane.llm import toxicity

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows, marks = [], []
    for k in range(400):
        own = [word() for _ in range(60)]
        if k % 5 == 0:
            own[7:7] = ["zorkish", "vexling"]
        rows.append((k, " ".join(own)))
        marks.append((k, int(k % 5 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    for r in toxicity.cross_checked(docs, labels).where("held_out").collect():
        assert r["predicted"] == int(r["doc_id"] % 5 == 0)


def test_pipeline_stages_follow_each_other(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    leaks = {r["doc_id"] for r in queries.op10_decontamination(spark, sf).collect()}
    assert kept and not kept & leaks and len(kept & toxic) <= 0.2 * len(toxic)


def test_near_duplicates_of_common_passages(spark):
    """Texts of nothing but common passages share many values and few windows; copies of them with few changes are linked."""
    rng = np.random.default_rng(12)
    word = lambda: "w" + str(rng.integers(0, 10**6))
    passages = [" ".join(word() for _ in range(30)) for _ in range(12)]
    rows = [(k, " ".join(passages[j] for j in rng.choice(12, 5, replace=False))) for k in range(150)]
    for k in range(150, 200):
        own = rows[int(rng.integers(0, 150))][1].split()
        for p in rng.integers(0, len(own), rng.integers(1, 7)):
            own[p] = word()
        rows.append((k, " ".join(own)))
    sets = {k: shingles(t, 5) for k, t in rows}
    for percent in (80, 60):
        got = {r["doc_id"]: r["component_id"] for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
        assert got == components(sets, percent)
