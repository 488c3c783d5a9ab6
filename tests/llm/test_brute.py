"""Training-data operators against brute force, and planted cases of known answer."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferryline.llm import queries as Q
from ferryline.llm.chat_format import chat_format
from ferryline.llm.decontaminate import contaminated
from ferryline.llm.quality_model import Quality, statistics
from ferryline.llm.quality_rules import RULES, estimate, quality_rules
from ferryline.llm.sharding import shard_documents
from ferryline.llm.simhash_dedup import _least, components, links, trie_pairs
from ferryline.llm.substring_dedup import substring_dedup
from ferryline.llm.textstats import with_counts
from ferryline.llm.toxicity import DECAY, FLOOR, LOOSE, POWER, SPAN, Kernel, Toxicity
from ferryline.llm.url_filters import match_rules, mine_rules, url_filter

SF = "/root/testdata/sf0.1"


# ---- toxicity


def likeness(a, b):
    """Brute force: gapped three-letter subsequences of two words."""

    def phi(w):
        out = {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < SPAN:
                out.setdefault((w[i], w[j], w[k]), []).append(DECAY ** (k - i + 1))
        return out

    x, y = phi(a), phi(b)
    size = lambda p: math.sqrt(sum(v * v for vs in p.values() for v in vs))
    # of the landmark, what stands in several places is one feature
    dot = sum(sum(vs) * sum(y[k]) for k, vs in x.items() if k in y)
    whole = math.sqrt(sum(sum(v) ** 2 for v in y.values()))
    return min(dot / whole / max(LOOSE * size(x), whole), 1) if x and y else 0


def test_kernel_equals_brute_force():
    marks, words = ["stupid", "worthless", "banana"], ["stupid", "sxtuxpid", "stuuupid", "worthles", "wrong", "ab", "bananas", "x" * 24]
    near, value = Kernel(marks)(words)
    got = {int(k): v for k, v in zip(near, value)}
    for i, w in enumerate(words):
        want = [likeness(w, m) for m in marks]
        want = [x**POWER if x > FLOOR else 0 for x in want]
        assert np.allclose(got.get(i, np.zeros(3)), want, atol=1e-3), w


def with_inserted(rng, word, n):
    out = list(word)
    for _ in range(n):
        out.insert(rng.randrange(1, len(out)), rng.choice("xzqvy"))
    return "".join(out)


def test_toxic_texts_of_held_out_rows_and_inserted_letters(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = Toxicity.fit(docs, Q.known_labels(labels, "toxic", 5, 0))
    held = docs.join(labels.filter("toxic is not null"), "doc_id").filter(Q.fold_of(F.col("doc_id"), 5) == 0)
    rows = model.score(held, "lang", "toxic").collect()
    for lang in (None, "en", "de", "fr", "es"):
        mine = [r for r in rows if lang in (None, r.lang)]
        hit, bad = sum(r.toxic and r.score >= 0.5 for r in mine), sum(r.toxic for r in mine)
        # six of the 97 toxic texts hold no insult at all
        assert hit >= (0.9 if lang is None else 0.85) * bad
        assert hit >= (0.95 if lang is None else 0.85) * sum(r.score >= 0.5 for r in mine)
    rng, clean = random.Random(4), [r.text for r in held.filter("toxic = 0 and lang = 'en'").limit(60).collect()]
    insults, texts = ["stupid", "worthless", "pathetic", "disgusting", "idiot", "moron"], []
    for n in (0, 1, 2):
        for i in range(60):
            words = clean[i].split()[:120]
            for w in rng.sample(insults, 3):
                words.insert(rng.randrange(len(words) + 1), with_inserted(rng, w, n))
            texts.append((n, " ".join(words)))
    texts += [(-1, " ".join(t.split()[:120])) for t in clean]
    got = model.score(spark.createDataFrame(texts, "n int, text string"), "n").groupBy("n").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("share")).collect()
    share = {r.n: r.share for r in got}
    assert share[0] >= 0.95 and share[1] >= 0.9 and share[2] >= 0.8 and share[-1] <= 0.02, share


# ---- sharding


def test_shards_hold_equal_bytes_and_whole_groups(spark):
    rng = random.Random(2)
    texts = ["x" * rng.randrange(400) for _ in range(3000)] + ["hot copy of a text"] * 3000 + [f"pair {i // 2}" for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = shard_documents(docs, 8).collect()
    total = sum(r.size for r in got)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert abs(sum(r.size for r in mine) - total / 8) <= 0.02 * total / 8 + 400
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    at = {}
    for r in got:
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for t, s in at.items() if t.startswith("pair"))


# ---- quality classifier


def test_discriminant_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").filter("quality is not null")
    model = Quality.fit(rows)
    x = with_counts(rows, "text", ["doc_id", "quality"]).select("doc_id", "quality", *[c.alias(k) for k, c in statistics().items()]).toPandas()
    names = list(statistics())
    y, m = x.quality.to_numpy(), x[names].to_numpy(float)
    cov = [np.cov(m[y == k].T, bias=True) for k in (0, 1)]
    n = [(y == k).sum() for k in (0, 1)]
    pooled = np.diag(np.diag((n[0] * cov[0] + n[1] * cov[1]) / sum(n)) + 1e-4)
    odds = np.full(len(m), math.log((n[1] + 0.5) / (n[0] + 0.5)))
    for k, sign in ((0, 0.5), (1, -0.5)):
        c = 0.9 * cov[k] + 0.1 * pooled
        d = m - m[y == k].mean(axis=0)
        odds += sign * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
    want = dict(zip(x.doc_id, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))))
    got = {r.doc_id: r.score for r in model.score(rows, ["doc_id"]).collect()}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert np.mean([(want[i] >= 0.5) == q for i, q in zip(x.doc_id, y)]) > 0.9


# ---- URL rules


def test_rules_equal_brute_force(spark):
    rng, rows = random.Random(9), []
    for _ in range(1500):
        tokens = {f"h:{rng.choice('abc')}", f"p:{rng.choice('defg1')}", *(f"q:{x}" for x in "rstuvwxyzklmno" if rng.random() < 0.4)}
        bad = rng.random() < (0.95 if {"h:a", "p:d"} <= tokens else 0.9 if "p:1" in tokens else 0.3)
        rows.append((sorted(tokens), bad))
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    count = {}
    for tokens, bad in rows:
        for k in (1, 2, 3):
            for c in combinations(tokens, k):
                a = count.setdefault(c, [0, 0])
                a[0] += 1
                a[1] += bad
    count = {c: v for c, v in count.items() if v[0] >= 25}
    kl = lambda x, y: x * math.log(x / y) if x else 0
    good = {}
    for c, (m, b) in count.items():
        for bad, of, rate in ((True, b, base), (False, m - b, 1 - base)):
            p = of / m
            if p >= 0.6 and p > rate and m * (kl(p, rate) + kl(1 - p, 1 - rate)) >= math.log(2 * len(count) / 0.01):
                good[c, bad] = p
    want = {(c, bad) for (c, bad), p in good.items() if not any(good.get((d, bad), -1) >= p for k in range(1, len(c)) for d in combinations(c, k))}
    found = mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean").repartition(3))
    got = {(tuple(r.tokens), r.bad): r for r in found.collect()}
    assert set(got) == want and {(("h:a", "p:d"), True), (("p:1",), True)} <= want
    for (c, bad), r in got.items():
        assert r.n == count[c][0] and abs(r.confidence - good[c, bad]) < 1e-9
    pages = [(f"u{i}", t) for i, (t, _) in enumerate(rows[:200])]
    hit = {r.page: r.bad for r in match_rules(spark.createDataFrame(pages, "page string, tokens array<string>"), found).collect()}
    for u, t in pages:
        fits = [(r.confidence, bad) for (c, bad), r in got.items() if set(c) <= set(t)]
        assert hit.get(u) == (max(fits)[1] if fits else None)


def test_no_rule_without_significance(spark):
    """Labels by lot block nothing; planted hosts do, and rightly on rows that weren't learned from."""
    rng = random.Random(3)
    lot = [(f"http://{rng.choice(['a', 'b', 'c'])}.net/{rng.choice(['x', 'y', 'z'])}/{i}", rng.random() < 0.3) for i in range(2000)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(lot)], "page_id long, url string")
    known = spark.createDataFrame(lot, "url string, bad boolean")
    assert {r.verdict for r in url_filter(pages, known, []).collect()} == {"allow"}
    planted = [(f"http://{'casino777' if i % 4 == 0 else rng.choice(['a', 'b', 'c'])}.net/{rng.choice(['x', 'y', 'z'])}/{i}", i % 4 == 0 if rng.random() < 0.95 else i % 4 != 0) for i in range(2000)]
    known = spark.createDataFrame(planted[:1000], "url string, bad boolean")
    rest = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(planted[1000:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter(rest, known, []).collect()}
    blocked = [i for i, v in got.items() if v == "block"]
    assert len(blocked) == 250 and sum(planted[1000 + i][1] for i in blocked) >= 0.9 * len(blocked)


# ---- quality rules


def test_accuracies_of_planted_votes(spark):
    rng, names = random.Random(1), list(RULES)
    truth = {k: (0.8 + 0.02 * i, 0.3 + 0.06 * i) for i, k in enumerate(names)}  # on good texts, on bad texts
    rows = []
    for _ in range(20000):
        good = rng.random() < 0.35  # most texts are bad
        vote = lambda k: None if rng.random() < 0.1 else int(good) if rng.random() < truth[k][0 if good else 1] else int(not good)  # noqa: B023, E731
        rows.append(tuple(vote(k) for k in names))
    votes = spark.createDataFrame(rows, ", ".join(f"v_{k} int" for k in names))
    prior, got = estimate(votes.groupBy(*votes.columns).agg(F.count("*").alias("n")), belief=0.001)
    assert abs(prior - 0.35) < 0.08
    for k in names:
        assert abs(got[k][0] - truth[k][0]) < 0.08 and abs(got[k][1] - truth[k][1]) < 0.08, k


def test_base_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, "a\na\n\na b", None), (-2, None, None), (-3, "w " * 30, None), (-4, "#a *\n#a *\n|", None)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(odd)
    got = {r.doc_id: r for r in quality_rules(rows).collect()}
    for r in rows.collect():
        t = r.text or ""
        words = t.encode().split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        repeated = {i + k for i, g in enumerate(grams) if g in often for k in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), dup, len(repeated))
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, r.doc_id
        assert x.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (x.kept and x.base_failed)
    assert len(got) == rows.count()


# ---- decontamination

NAMES = ["Anna", "Boris", "Clara", "Omar", "Priya", "Ohio", "Norway", "Lima", "New York", "San Marino"]


def question(rng):
    """A template with slots (number, unit, name) among literals of its own."""
    w = ["".join(rng.choice("bdfglmnprstv") + rng.choice("aeiou") for _ in range(3)) for _ in range(20)]
    return f"{w[0]} {w[1]} the {w[2]} {{name}} {w[3]} {{num}} {w[4]} of {w[5]} {w[6]} {w[7]} {{num2}} {{unit}} while {w[8]} {w[9]} {{num}} {w[10]} near the {w[11]} {w[12]} so how many {w[13]} remain {w[14]} {w[15]}"


def filled(rng, template):
    num = lambda: rng.choice([str(rng.randrange(2, 900)), "twenty", "two hundred", "1,250", "3.5"])
    return template.format(name=rng.choice(NAMES), num=num(), num2=num(), unit=rng.choice(["kg", "pounds", "grams", "tons"]))


def test_questions_asked_again_with_other_values(spark):
    rng = random.Random(11)
    templates = [question(rng) for _ in range(60)]
    items = [(i, filled(rng, t)) for i, t in enumerate(templates)]
    filler = lambda n: " ".join(rng.choice(["stone", "cloud", "a", "in", "paper", "m", "seven", "green", "window", "Paris"]) + str(rng.randrange(50)) for _ in range(n))
    docs = [(i, f"{filler(30)} {filled(rng, t)} {filler(30)}") for i, t in enumerate(templates)]
    docs += [(1000 + i, filler(80)) for i in range(60)]
    # the same words in another order, and with articles in place of units, are other texts
    docs += [(2000 + i, " ".join(rng.sample(x.split(), len(x.split())))) for i, x in items]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    right = {(i, i) for i in range(60)}
    assert len(got & right) >= 0.9 * len(right) and not [d for d, _ in got if d >= 1000]
    assert not got - right


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_many_benchmark_windows_give_the_same(spark, monkeypatch, few):
    import ferryline.llm.decontaminate as D

    monkeypatch.setattr(D, "FEW_WINDOWS", few)
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(400)
    got = sorted(tuple(r) for r in contaminated(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect())
    assert test_many_benchmark_windows_give_the_same.__dict__.setdefault("first", got) == got and got


def test_articles_are_no_units(spark):
    items = [(1, "the cook takes a pan in the kitchen and puts a spoon in the pan before noon arrives")]
    docs = [(1, "the cook takes m pan s the kitchen and puts h spoon v the pan before noon arrives")]
    assert contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# ---- chats


def test_long_conversations_are_cut_by_rows_and_bytes(spark):
    rows = [(None, None, "user", "same")] * 1500 + [("a", i, "user", f"t{i}") for i in range(600)] + [("b", -1, "user", "x" * (9 << 20)), ("b", 0, "user", "y" * (9 << 20)), ("b", 1, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(3).withColumns({"conv": F.lit("clash"), "n": F.lit(1), "rank": F.lit(2)})
    got = sorted(((r.conv_id or "", r.part, r.n_turns) for r in chat_format(turns).drop("rendered").collect()))
    assert got == [("", 0, 512), ("", 1, 512), ("", 2, 476), ("a", 0, 512), ("a", 1, 88), ("b", 0, 2), ("b", 1, 1)]
    first = [r.rendered for r in chat_format(turns).filter("conv_id = 'a' and part = 1").collect()]
    assert first == ["".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(512, 600))]


# ---- fingerprints


def fingerprint_sample(rng):
    """Dense regions, chains of near fingerprints, and far ones."""
    keys = set()
    for _ in range(12):
        k = rng.getrandbits(64)
        for _ in range(40):
            keys.add(k)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                k ^= 1 << b
    centre = rng.getrandbits(64)
    for _ in range(300):
        k = centre
        for b in rng.sample(range(20), rng.randrange(0, 4)):
            k ^= 1 << b
        keys.add(k)
    keys |= {rng.getrandbits(64) for _ in range(200)}
    return np.array(sorted(keys), np.uint64)


def brute_groups(keys, budget):
    u, v = np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= budget, 1))
    return _least(len(keys), u, v)


@pytest.mark.parametrize("leaf", [1024, 24])
def test_links_equal_brute_force(spark, leaf):
    keys = fingerprint_sample(random.Random(7))
    want = brute_groups(keys, 4)
    fps = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long").repartition(3)
    root = {r.node: r.root for r in components(links(fps, 4, leaf)).collect()}
    seen = {}
    for k, w in zip(keys.view(np.int64).tolist(), want.tolist()):
        assert seen.setdefault(w, root.get(k, k)) == root.get(k, k)
    assert len(set(seen.values())) == len(seen)


def test_trie_walk_gives_all_pairs_of_each_trie():
    rng = random.Random(8)
    own = [np.sort(fingerprint_sample(rng)[:200]) for _ in range(3)]
    keys, size = np.concatenate(own), np.array([len(x) for x in own])
    stop = np.cumsum(size)
    u, v = trie_pairs(keys, stop - size, stop, 63)  # so wide a budget prunes no prefix wrongly
    pack = np.repeat(np.arange(3), size)
    assert (pack[u] == pack[v]).all() and len(set(zip(u.tolist(), v.tolist()))) == len(u)
    assert (np.bitwise_count(keys[u] ^ keys[v]) <= 63).all()


# ---- substring dedup


def test_hot_passages_and_any_ids(spark):
    """Above and below the hot share, text ids, many equal rows without an id."""
    rng = random.Random(6)
    hot = " ".join(f"h{i}" for i in range(50))
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [f"{' '.join(word() for _ in range(45))} {hot} {' '.join(word() for _ in range(45))}" for _ in range(300)]
    texts += [" ".join(word() for _ in range(60)) for _ in range(200)] + [texts[0]] * 400
    for _ in range(40):  # passages that begin and end differently
        p = [word() for _ in range(80)]
        texts += [" ".join(p), " ".join(p[3:70]), " ".join([word(), *p[10:60], word()])]
    rows = [(None if i >= 500 and i < 900 else f"id-{i}", t) for i, t in enumerate(texts)]
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect())
    from test_llm import removed

    assert got == removed(texts, 35)
