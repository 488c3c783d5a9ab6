"""Null and repeated ids in the pipeline's stages."""

import corpus_pipeline

ITEM = "a slow brown heron waits beside the wide river until the evening tide brings small silver fish towards the bank"
TEXTS = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_copies_of_null_and_repeated_ids(spark):
    near = TEXTS[5] + " more"
    rows = [(None, TEXTS[0]), (None, TEXTS[1]), (None, TEXTS[1]), (7, TEXTS[2]), (7, TEXTS[3]), (7, TEXTS[3]), (8, TEXTS[4]), (None, TEXTS[4]), (9, TEXTS[5]), (9, near), (None, None), (None, None)]
    got = pairs(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), ""))
    five = [p for p in got if p[1] in (TEXTS[5], near)]
    assert len(five) == 1 and five[0][0] == 9
    assert [p for p in got if p not in five] == sorted([(None, TEXTS[0]), (None, TEXTS[1]), (7, TEXTS[2]), (7, TEXTS[3]), (8, TEXTS[4]), (None, None)], key=repr)


def test_leaks_of_null_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "x " + ITEM), (None, TEXTS[0]), (3, ITEM), (3, TEXTS[1]), (4, TEXTS[2]), (4, TEXTS[2]), (None, None), (5, "")]
    got = pairs(corpus_pipeline.drop_leaks(spark, frame(spark, rows), str(tmp_path)))
    assert got == sorted([r for r in rows if ITEM not in (r[1] or "")], key=repr)
