"""The url tree against its SQL, and what it says where no rule fits or a rule is not shown to it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glasspane.llm import urls


def like_sql(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(str(tmp_path / "pages"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in urls.verdicts(spark.read.parquet(str(tmp_path / "pages"))).collect()), key=key)
    assert got == sorted(c.execute(urls.verdicts_sql()).fetchall(), key=key)
    return {r[0]: r for r in got}


def made():
    rows = [f"https://{h}/{a}/{k}" for h in ("a.com", "b.net", "c.org") for a in ("en", "de", "es", "fr") for k in range(12)]
    rows += [f"https://d.com/{a}/{b}/x{k}/tail/{c}" for a in ("en", "shop") for b in ("one", "two", "three-4") for k in range(5) for c in ("end", "stop", "")]
    rows += [f"https://e.org/news/{w}" for w in "alpha beta gamma delta".split()] + ["https://e.org/", "https://e.org/es/1", "http://f.net/de/8/1/2/3/4/5/6/7/8/9/10", "http://f.net/de/8/a/b/c/d/e/f/g/h/i"]
    rows += [None, "", "no url", "x://", "https://g.com?en", "https://G.COM/en//7//#x"]
    return rows


def test_like_sql_on_made_pages(spark, tmp_path):
    rows = [*enumerate(made()), (None, "https://a.com/en/3"), (3, "https://a.com/en/3")]
    clash = {c: F.lit(1) for c in ("node", "leaf", "l", "b", "verdict", "host", "segments")}
    got = like_sql(spark, tmp_path, spark.createDataFrame(rows, "page_id long, url string").withColumns(clash))
    at = {u: k for k, u in enumerate(made())}
    assert got[at["https://a.com/en/3"]][4] == "block" and got[at["https://a.com/en/7"]][4] == "block"
    # no rule fits: what stands beside blocked pages of a host goes with them
    assert got[at["https://a.com/fr/3"]][3:5] == (None, "block") and got[at["https://c.org/fr/3"]][3:5] == (None, "block")
    assert got[at["https://b.net/fr/3"]][3:5] == (None, "allow") and got[at["https://e.org/news/beta"]][3:5] == (None, "allow")
    assert got[at["https://a.com/fr/3"]][5] == "*/*" and got[at["http://f.net/de/8/a/b/c/d/e/f/g/h/i"]][5].count("/") == 10
    for k in range(at[None], len(made()) - 2):
        assert got[k][1:5] == ("", "", None, "allow")


def test_like_sql(spark, sf, tmp_path):
    like_sql(spark, tmp_path, spark.read.parquet(f"{sf}/pages.parquet"))


def test_empty_table(spark):
    assert urls.verdicts(spark.createDataFrame([], "page_id long, url string")).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.1"])
def test_hidden_labels(spark, sf_dir):
    """Of urls whose label the tree has not seen, it blocks those that a rule blocks more surely than their share."""
    hidden = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = urls.verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), hidden=hidden).where(hidden & F.col("rule").isNotNull())
    n, base, given, right = out.select(F.count(F.lit(1)), F.count_if(F.col("verdict") == "block"), F.count_if(F.col("method") == "block"), F.count_if((F.col("method") == "block") & (F.col("verdict") == "block"))).first()
    assert right / given > base / n and right / base > 0.5
