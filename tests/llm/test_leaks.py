"""Questions asked again with names of another length and numbers in words; rows that are odd."""

from pyspark.sql import functions as F

from glasspane.llm import decontaminate

ITEM = "A shop sells pens for 3 dollars each and on Monday John Smith buys 12 of them there and pays with a bill of 50 dollars, how much does he get back?"


def found(spark, rows, items):
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted((r["doc_id"], r["item_id"], r["same_slots"]) for r in got)


def test_other_names_and_number_words(spark):
    one = ITEM.replace("John Smith", "Maria").replace("Monday", "Friday").replace("12", "twenty").replace("50", "ninety")
    two = ITEM.replace("John Smith", "Anna Maria Lopez Garcia").replace(" 3 ", " four ")
    other = "Yesterday we bought pens for 3 dollars each and went home to rest before the long week began again for all of us."
    assert found(spark, [(1, f"so then. {one} end"), (2, two), (3, other), (4, ITEM)], [(7, ITEM)]) == [(1, 7, False), (2, 7, False), (4, 7, True)]


def test_ties_repeats_and_odd_rows(spark):
    rows = [(1, ITEM), (1, ITEM), (2, f"{ITEM} {ITEM}"), (None, ITEM), (3, None), (4, ""), (5, "x " * 100_000 + ITEM), (6, "nothing of the kind")]
    items = [(7, ITEM), (8, ITEM), (None, ITEM), (9, None), (10, "")]
    assert found(spark, rows, items) == [(d, i, True) for d in (1, 2, 5) for i in (7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("hash", "size", "plain", "place", "item_id", "word")})
    left = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "6", "None"]
    assert decontaminate.leaks(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
