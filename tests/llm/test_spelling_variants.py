"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

from ferryline.llm.spelling_variants import near_words, pivots, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, spoil=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % spoil == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}
    links = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {}
    for w, others in links.items():
        top = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = top if top and n[top] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(links[w]), n[form[w]] if form[w] else None) for w in n}


def words(rng):
    """Few letters, repeated bigrams, chains of variants."""
    out = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "abababa", "bababab", "éaéaéaé", "straßen", "strassen", "strasse"]
    for k in range(120):
        w = "".join(rng.choices("abé" if k % 2 else "abcdefghij", k=rng.randrange(5, 11)))
        out.append(w)
        for _ in range(3):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]])
            out.append(w)
    return sorted(set(out))


def test_pairs_equal_brute_force(spark):
    own = [w for w in words(random.Random(2)) if len(w) >= 4]
    got = near_words(spark.createDataFrame([(w,) for w in own], "word string").repartition(3)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == {(a, b) for a, b in combinations(own, 2) if near(a, b)}


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    own = words(rng)
    weight = [rng.choice([1, 3, 30, 300]) for _ in own]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(own, weight, k=300)) + "! 12-" * (i % 3)) for i in range(60)]
    rows += [(None, "aaaaaa " * 4000), (7, None), (8, ""), (9, "ÀÉÎÕÜß " * 9), (9, "z" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", df_lit()).withColumn("n", df_lit())
    for spoil in (199, 3):
        got = {r.word: tuple(r)[1:] for r in spelling_variants(df.repartition(3), spoil=spoil).collect()}
        want = brute(rows, spoil=spoil)
        assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 20 and any(r != f and f for f, r, *_ in want.values())


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_no_words(spark):
    df = spark.createDataFrame([(1, "short"), (2, None), (3, "123456 789")], "doc_id int, text string")
    assert spelling_variants(df).count() == 0 and spelling_variants(df.limit(0)).count() == 0


def test_pivots_are_disjoint_and_lightest():
    rng = random.Random(1)
    for _ in range(500):
        places = sorted(rng.sample(range(8), rng.randrange(3, 6)))
        grams = [(p, rng.randrange(9)) for p in places]
        weight = dict(grams)
        want = min(weight[a] + weight[b] for a, b in combinations(places, 2) if b - a >= 2)
        a, b = pivots(grams)
        assert b - a >= 2 and weight[a] + weight[b] == want
