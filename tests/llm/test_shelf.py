"""Tables of line dedup that nothing reads any more do not stay on the disk."""

from glasspane.llm import lines, shared


def test_dedup_leaves_only_what_it_reads(spark, monkeypatch):
    shelves, put = [], shared.Shelf.__init__
    monkeypatch.setattr(shared.Shelf, "__init__", lambda self, *a: (put(self, *a), shelves.append(self))[0])
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(k, f"own{k} line{k} here{k}\nthe same line in all of them\n{words} own{k}") for k in range(12)]
    left = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), passages=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(shelves[0].root)
    there = {s.getPath().getName().split("-")[1] for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    assert there == {"marked", "cuts"}
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert got[0] == rows[0][1] and "the same line" not in got[5] and "w40" not in got[5] and "own5 line5 here5" in got[5]
