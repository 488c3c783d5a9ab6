"""Training-data operators: edge cases, and brute force on small fixtures."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ferryline.llm import queries as Q
from ferryline.llm.bpe_tokens import bpe_encode
from ferryline.llm.chat_format import chat_format
from ferryline.llm.decontaminate import canonical, contaminated
from ferryline.llm.quality_model import Quality
from ferryline.llm.quality_rules import quality_rules
from ferryline.llm.sharding import shard_documents
from ferryline.llm.simhash_dedup import components, simhash_dedup
from ferryline.llm.substring_dedup import substring_dedup
from ferryline.llm.toxicity import Toxicity
from ferryline.llm.url_filters import url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, path string, id int, key string, th long, _t string, h long, slot int"
PASSAGE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, blanks, repeated rows, equal texts, a long text, columns whose names clash with internal ones."""
    texts = [None, "", " \n\t", "one", "Same text here now", "Same text here now", f"a {PASSAGE} b", f"c {PASSAGE} d", "x" * 5000, "word " * 3000, "ünï cödé 漢字 " * 40, None]
    rows = [(None if i == 11 else i, t, "en", "s", 0, "k", "p", 1, "k", 1, "t", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[6]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(rows, window):
    """Brute force: kept words of each text."""
    words = [(t or "").encode().split() for t in rows]
    grams = {}
    for w in words:
        for i in range(len(w) - window + 1):
            g = b" ".join(w[i : i + window])
            grams[g] = grams.get(g, 0) + 1
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if grams[b" ".join(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("window", [3, 35])
def test_substring_dedup(odd, window):
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup(odd, window).collect())
    assert got == removed([r.text for r in odd.collect()], window)


def test_simhash(odd, spark):
    got = simhash_dedup(odd, leaf=2).collect()
    assert len(got) == odd.count()
    docs = {(r.doc_id, r.text) for r in odd.collect()}

    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        ones = sum(np.array([(xxhash.xxh64_intdigest(x, 42) >> (63 - b)) & 1 for b in range(64)]) for x in sh)
        return int("".join("1" if 2 * v > len(sh) else "0" for v in ones), 2)

    want = {d: fp(t) for d, t in docs}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == want
    assert {r.component_id for r in got if r.fp == 0} == {0}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def test_sharding(odd):
    got = shard_documents(odd, 3).collect()
    assert len(got) == odd.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.size for r in got if r.doc_id in (0, 1)} == {1}


def test_bpe_round_trip(odd):
    import tiktoken

    path, pattern = Q.tokenizer()
    from ferryline.llm.bpe_tokens import _encoding

    enc: tiktoken.Encoding = _encoding(path, pattern)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for chunk, overlap in ((100, 90), (32768, 512)):
        got = bpe_encode(odd, path, pattern, chunk=chunk, overlap=overlap).collect()
        assert len(got) == odd.count()
        for r in got:
            ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
            assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == (len(ids), ids.tobytes(), texts[r.doc_id].encode())


def test_models_and_rules_on_odd_rows(odd, empty, spark):
    labelled = spark.createDataFrame([(i, f"what a {'stupid' if i % 4 == 1 else 'idiot'} thing number{i}" if i % 2 else f"what a {'fine' if i % 4 else 'quiet'} thing number{i}", i % 2) for i in range(60)], "doc_id long, text string, toxic int")
    model = Toxicity.fit(labelled)
    probe = spark.createDataFrame([(1, "what an idxiot"), (2, "a fine book"), (3, "s-t-u-p-i-d day")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in model.score(probe, "doc_id").collect()}
    assert score[1] > score[2] and score[3] > 0.5 > score[2]
    assert model.score(odd, "doc_id").count() == odd.count()
    for m in (Toxicity.fit(labelled.filter("false")), Toxicity.fit(labelled.filter("toxic = 1"))):
        assert all(0 <= r.score <= 1 for r in m.score(odd, "doc_id").collect())
    q = Quality.fit(labelled.withColumnRenamed("toxic", "quality"))
    assert all(0 <= r.score <= 1 for r in q.score(odd, ["doc_id"]).collect())
    assert quality_rules(odd).count() == odd.count() and not [r for r in quality_rules(odd).collect() if r.n_words < 10 and r.kept]
    assert quality_rules(empty).count() == 0 and model.score(empty, "doc_id").count() == 0


def test_decontamination(odd, spark, empty):
    bench = spark.createDataFrame([(1, "A train leaves Boston at 30 km per hour and then meets Anna after 30 minutes on the long road home today"), (2, None), (3, "short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x. A train leaves Denver at 45 km per hour and then meets Maria after 45 minutes on the long road home today"), (2, "A train leaves Denver at 45 km per hour and then meets Maria after 99 minutes on the long road home today"), (3, "nothing of the kind is in here at all, not even a number")], "doc_id long, text string")
    got = contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and got[0].n_changed == 3
    assert contaminated(odd, bench).count() == 0 and contaminated(empty, bench).count() == 0 and contaminated(docs, bench.filter("false")).count() == 0
    token = lambda w: [x[1] for x in canonical(w, False)]
    assert token("42,") == token("seven") == token("twenty-one") and token("100kg") == token("$5") == token("5%") and len(token("100kg")) == 2 and token("...") == []


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/1?x=1", "https://a.example.org/en/12", "https://a.com/fr/x", "http://com/de/", "http://x.net", "ftp://b.spam.biz/buy?ref=1", "http://e.net/" + "/".join("abcdefghijklmnop") + "/buy"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(f"ftp://b{i}.spam.biz/buy", True) for i in range(60)] + [(f"http://c{i}.good.net/", False) for i in range(60)], "url string, bad boolean")
    got = {r.page_id: r for r in url_filter(pages, labels, Q.URL_RULES).collect()}
    assert [got[i].rule for i in range(10)] == [None, None, None, "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None]
    assert got[3].host == "www.example.org" and got[3].path == "/es/1" and got[8].verdict == "block" and got[7].verdict == "allow" and got[2].verdict == "allow"
    assert got[9].verdict == "block"  # by its last token
    assert url_filter(pages, labels.filter("false"), Q.URL_RULES).count() == 10


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (4, 0, None, None), (None, 0, "user", "lost"), (5, None, "user", "x"), (5, 600, "user", "far")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format(turns).collect()
    assert sorted((r.conv_id if r.conv_id is not None else -1, r.part) for r in got) == [(-1, 0), (2, 0), (4, 0), (5, 0)]
    assert [r.rendered for r in got if r.conv_id == 2] == ["<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"]
    assert chat_format(turns.filter("false")).count() == 0


def test_empty_tables(empty):
    path, pattern = Q.tokenizer()
    for df in (substring_dedup(empty), simhash_dedup(empty), shard_documents(empty), bpe_encode(empty, path, pattern)):
        assert df.count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < len(out) <= docs and len({r.doc_id for r in out}) == len(out)
    assert all(len(bytes(r.ids)) == 4 * r.n_tokens for r in out)
    assert hashlib.sha256(b"").hexdigest() not in {r.decoded_sha256 for r in out if r.n_tokens}
