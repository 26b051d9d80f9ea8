"""A document that holds one item several times, with different values."""

from atlasforge.llm import decontam

ITEM = "if Maria buys 12 apples for 3.50 dollars and walks 5km to Berlin, how many apples does Maria have left today?"


def test_copies_are_judged_by_themselves(spark):
    other = ITEM.replace("Maria", "Peter").replace("12", "99").replace("3.50", "8").replace("5km", "7 km").replace("Berlin", "Rome")
    third = ITEM.replace("Maria", "Clara").replace("12", "31").replace("3.50", "6").replace("5km", "2 km").replace("Berlin", "Oslo")
    between = " and then some quite unrelated words follow here until the next question is asked so "
    rows = [(1, "well, " + ITEM + between + other), (2, "well, " + other + between + third), (3, "well, " + ITEM + between + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, "say, " + ITEM)], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.leaks(docs, items).collect()}
    assert set(found) == {1, 2, 3} and found[1].changed and found[2].changed and not found[3].changed
    assert all(r.n_consistent == r.n_values > 0 for r in found.values())
