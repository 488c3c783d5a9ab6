"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferryline.llm.chat_format import chat_format
from ferryline.llm.decontaminate import contaminated
from ferryline.llm.near_copies import near_groups
from ferryline.llm.quality_model import Quality
from ferryline.llm.quality_rules import quality_rules
from ferryline.llm.toxicity import Toxicity
from ferryline.llm.url_filters import url_filter

#: Names that the operators use inside, and those of other inputs.
CLASH = ["key", "n", "id", "did", "th", "fp", "root", "anchor", "path", "item", "page", "tokens", "bad", "host", "rule", "conv", "rank", "before", "range", "p", "y", "k", "t", "z", "_id", "_text", "_url", "_t", "_y", "score", "turns", "items", "spans", "h", "g", "shard"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "a slow brown heron waits beside the wide old river until the silver evening tide turns home"


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH) if c not in df.columns})


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts of over two million characters: of one word, of many words, and with an item at the far end."""
    rng = random.Random(1)
    words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(250_000))
    rows = [(1, "x" * 2_000_000), (2, words), (3, words + " " + ITEM), (4, None), (5, ""), (5, ""), (None, ITEM)]
    return clashing(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)).repartition(2)


def test_toxicity(spark, long_texts):
    rows = [(i, f"what a {'stupid idiot' if i % 2 else 'quiet garden'} number{i}", i % 2) for i in range(60)]
    labelled = clashing(spark.createDataFrame([*rows, *rows[:10], (None, "stupid", 1), (99, None, 0)], "doc_id long, text string, toxic int"))
    model = Toxicity.fit(labelled)
    got = model.score(long_texts, "doc_id", "n").collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and all(r.score < 0.5 for r in got if r.doc_id in (4, 5))
    far = spark.createDataFrame([("w " * 400_000 + "you stupid idiot",), ("you stupid idiot",)], "text string")
    assert [r.score >= 0.5 for r in model.score(far).collect()] == [True, True]
    assert model.score(long_texts.filter("false"), "doc_id").count() == 0


def test_quality(spark, long_texts):
    docs = clashing(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), "doc_id"))
    model = Quality.fit(docs)
    assert all(0 <= r.score <= 1 for r in model.score(long_texts, ["doc_id"]).collect())
    twice = model.score(long_texts.filter("doc_id = 5"), ["doc_id"]).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert model.score(long_texts.filter("false"), ["doc_id"]).count() == 0
    for rows in (docs.filter("false"), docs.filter("quality = 1")):
        assert all(0 <= r.score <= 1 for r in Quality.fit(rows).score(long_texts, ["doc_id"]).collect())


def test_quality_rules(spark, long_texts):
    got = quality_rules(long_texts).collect()
    assert len(got) == 7 and {r.n_words for r in got} == {1, 250_000, 250_017, 0, 17}
    same = [tuple(r) for r in got if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1] and not same[0][-1]


def test_decontamination(spark, long_texts):
    items = clashing(spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, "name the red planet")], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in contaminated(long_texts, items).collect()}
    assert got == {(3, 1), (None, 1)}
    named = spark.createDataFrame([("a", ITEM), ("b", "other words")], "doc_id string, text string")
    assert [r.doc_id for r in contaminated(named, items).collect()] == ["a"]


def test_urls(spark):
    urls = [None, "", "http://e.org/" + "/".join(f"t{i % 50}" for i in range(200_000)), "http://bad7.net/x", "http://bad7.net/x", "://", "http://", "HTTPS://A.COM:80/DE/?q=1#f", "http://bad7.net/x/good9/y"]
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    labels = [("http://bad7.net/x", True)] * 60 + [("http://fine.net/y", False)] * 60 + [(None, True), ("http://bad7.net/x", None)]
    # good9 and bad7 are equally sure where they meet
    labels += [("http://z.net/good9", False)] * 60
    got = url_filter(pages, clashing(spark.createDataFrame(labels, "url string, bad boolean")), [("block", "a.com:80", "/DE/")]).collect()
    verdict = {r.page_id: r.verdict for r in got}
    assert len(got) == len(urls) and verdict == {0: "allow", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "block"}
    assert url_filter(pages.filter("false"), spark.createDataFrame(labels, "url string, bad boolean"), []).count() == 0


def test_long_labelled_urls_lose_no_tokens(spark):
    """A pair of tokens far apart in URLs of forty frequent tokens is found, and found exactly."""
    rng, rows = random.Random(2), []
    for i in range(300):
        rest = [f"c{j}" for j in range(38) if rng.random() < 0.7]
        bad = i % 2 == 0
        tokens = ["first"] * (bad or i % 4 == 1) + rest + ["zlast"] * (bad or i % 4 == 3)
        rows.append(("http://h.net/" + "/".join(tokens), bad))
    pages = spark.createDataFrame([(1, "http://h.net/first/q/zlast"), (2, "http://h.net/first/q"), (3, "http://h.net/zlast")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter(pages, spark.createDataFrame(rows, "url string, bad boolean"), [], least=60, confidence=0.9).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_chats(spark):
    rows = [("c", 0, "user", "a" * 3_000_000), ("c", 0, "user", "a" * 3_000_000), ("c", 0, "assistant", None), (None, None, None, None), ("d", -5, "user", "x"), ("e", -5, "user", "x")]
    turns = clashing(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    got = {r.conv_id: r.n_turns for r in chat_format(turns).collect()}
    assert got == {"c": 3, None: 1, "d": 1}
    assert chat_format(spark.createDataFrame([("a", "one", "user", "t")], "conv_id string, turn string, role string, text string")).count() == 1


def test_pipeline_stages(spark, long_texts, tmp_path):
    """The columns of documents come out, in their order, whatever else is there; empty tables give empty results."""
    for name, df in (("documents", long_texts), ("labels", spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, ITEM)], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
    empty = docs.filter("false")
    assert [step(spark, empty, str(tmp_path)).count() for _, step in corpus_pipeline.STAGES] == [0] * 5
    near = {r.root for r in near_groups(docs).collect()}
    assert len(near) == 4  # one word; many words with and without the item; the item; no words
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [1, 2, 4]


def test_toxicity_stage_drops_planted_insults_alone(spark, tmp_path):
    """Against brute force: a text goes if one of the insults stands in it, with a letter put in or not."""
    rng, rows, labels = random.Random(5), [], []
    word = lambda: "".join(rng.choice("bdfgklmnprtv") + rng.choice("aeiou") for _ in range(3))
    for i in range(400):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            for x in rng.sample(["stupid", "worthless", "pathetic"], 2):
                if i % 8 == 0 and i >= 300:
                    x = x[:2] + "x" + x[2:]
                words[rng.randrange(40)] = x
        rows.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, int(i % 4 == 0)))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert len(left & set(range(0, 400, 4))) <= 3 and len(left) >= 297
