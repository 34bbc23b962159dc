"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glasspane.llm import decontaminate, language, licenses, lines, minhash, packing, pii, quality, toxicity, urls
from glasspane.llm.queries import tokenizer_path
from glasspane.llm.shared import crc_fold

CLASHES = "key long, start long, length long, n long, h int, x int, t string, node long, value double, score double, label string, kept boolean, drop string, place int, `a b` string"


def odd_docs(spark):
    long_ = "word " * 60_000
    rows = [(1, "one two three four five six."), (1, "one two three four five six."), (2, None), (3, ""), (4, " \n\n \t"), (None, "one two three four five six."), (5, long_), (6, "x" * 300_000), (7, "é ñ ß 漢字 \U0001f600 ´´"), (8, "1 " * 30_000), (9, None), (None, None), (10, "a@" + "b." * 400 + "c +1 222 333 4444")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    for f in CLASHES.split(", "):
        name, kind = f.rsplit(" ", 1)
        df = df.withColumn(name.strip("`"), F.lit(None).cast(kind))
    return df


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six."), (None, "one two three four five six."), (2, None), (3, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (7, 0), (7, 1), (None, 1), (8, None)], "doc_id long, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.cross_checked(d, labels(s)),
    "licenses": lambda s, d: licenses.digest(licenses.scan(d)),
    "lines": lambda s, d: lines.dedup(d),
    "quality": lambda s, d: quality.judge(d),
    "language": lambda s, d: language.cross_checked(d),
    "minhash": lambda s, d: minhash.link(d),
    "pii": lambda s, d: pii.digest(pii.search(d)),
    "packing": lambda s, d: packing.pack(d, tokenizer_path()),
    "decontaminate": lambda s, d: decontaminate.leaks(d, bench(s)),
    "clean": lambda s, d: decontaminate.clean(d, bench(s)),
    "accepted": lambda s, d: toxicity.accepted(d, toxicity.learn(d, labels(s))),
    "urls": lambda s, d: urls.verdicts(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), *d.columns[2:])),
}
ROWWISE = {"toxicity", "licenses", "quality", "language", "minhash", "pii", "urls"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = odd_docs(spark)
    out = OPERATORS[name](spark, docs).collect()
    if name in ROWWISE:
        key = "page_id" if name == "urls" else "doc_id"
        assert sorted(map(str, (r[key] for r in out))) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, odd_docs(spark).limit(0)).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(spark, tmp_path, k):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_docs(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns


def test_values_of_odd_rows(spark):
    docs = odd_docs(spark)
    found = {r["doc_id"]: r for r in minhash.link(docs).where("doc_id is not null").collect()}
    assert found[2]["n_shingles"] == 0 and found[2]["component_id"] == 2 and found[2]["kept"]
    assert found[1]["component_id"] == 1 and found[5]["n_shingles"] == 1
    null = minhash.link(docs).where("doc_id is null").collect()
    assert all(r["component_id"] is None and r["kept"] for r in null)
    und = {r["doc_id"]: r["lang_pred"] for r in language.cross_checked(docs).where("doc_id in (2, 3, 4, 8)").collect()}
    assert set(und.values()) == {"und"}
    q = {r["doc_id"]: r for r in quality.judge(docs).where("doc_id is not null").collect()}
    assert q[2]["n_words"] == 0 and not q[2]["kept"] and q[8]["base_failed"] and q[8]["n_repeat_words"] == 30_000
    assert {r["doc_id"] for r in decontaminate.leaks(docs, bench(spark)).collect()} == {1}
    assert toxicity.cross_checked(docs.where("doc_id = 2"), labels(spark).limit(0)).first()["score"] == 0.0


def test_folds(spark):
    import zlib

    for r in spark.range(50).select("id", crc_fold(F.col("id")).alias("f")).collect():
        assert r["f"] == zlib.crc32(str(r["id"]).encode()) % 4
