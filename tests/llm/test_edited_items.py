"""Benchmark items that were edited on their way into a document."""

from ferryline.llm.decontaminate import contaminated

ITEMS = [
    (1, "a slow brown heron waits beside the wide old river until the silver evening tide turns home"),
    (2, "a baker sold 3 loaves in the morning and then sold 4 loaves in the long evening before going home"),
    (3, "the old mill grinds 20 sacks of wheat before noon while the new mill near the quiet harbour grinds 20 sacks of rye after dark"),
    (4, "name the red planet"),
    (5, "compute 12 34 56 78 90 11 13 15"),
]
DOCS = [
    (1, "he said that a slow brown heron waits beside the wide and old river until the silver evening tide turns home again", {1}),  # a word put in
    (2, "he said that a slow brown heron waits beside the wide river until the silver evening tide turns home again", {1}),  # a word left out
    (3, "so a baker sold 5 loaves in the morning and then sold 5 loaves in the long evening before going home", {2}),  # two values become equal
    (4, "so the old mill grinds 20 sacks of wheat before noon while the new mill near the quiet harbour grinds 21 sacks of rye after dark", {3}),  # one of two equal values changed
    (5, "now please name the red planet for me", {4}),
    (6, "now please name the blue planet for me", set()),
    (7, "please compute 12 34 56 78 90 11 13 15 now", {5}),
    (8, "please compute 12 34 56 78 90 11 13 16 now", set()),
    (None, "a slow brown heron waits beside the wide old river until the silver evening tide turns home", {1}),
    (None, "nothing of the kind is here", set()),
    (9, None, set()),
]


def test_edited_items(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([d[:2] for d in DOCS], "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(d, i) for d, _, items in DOCS for i in items}
