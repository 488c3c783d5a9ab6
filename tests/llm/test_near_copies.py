"""Near copies of the pipeline against brute force."""

import random
from itertools import combinations

import corpus_pipeline
from ferryline.llm.near_copies import near_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Group of each text: links at 0.8 of the shingles, closed."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if both >= 0.8 * all_:
            root[max(up(i), up(j))] = min(up(i), up(j))
    return [up(i) for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


def planted():
    rng, texts = random.Random(5), []
    for size in (4, 9, 30, 100, 300):
        for _ in range(8):
            words = [f"v{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for part in (0.005, 0.01, 0.02, 0.03, 0.06):
                words_ = edited(rng, words, max(1, round(size * part)))
                texts.append(" ".join(words_))
            texts += [" ".join(words).upper(), " ".join(words[: size - size // 6])]
        chain = [f"c{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(12):
            texts.append(" ".join(chain))
            chain = edited(rng, chain, max(1, size // 60))
    return [*texts, "", None, " ", "one", "One", "two words"]


def test_groups_equal_brute_force(spark):
    texts = planted()
    got = {r.th: r.root for r in near_groups(frame(spark, enumerate(texts))).collect()}
    th = [r.h for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").selectExpr("i", "xxhash64(text) h").orderBy("i").collect()]
    want, seen = brute(texts), {}
    for i, w in enumerate(want):
        assert seen.setdefault(w, got[th[i]]) == got[th[i]]
    assert len(set(seen.values())) == len(seen)
    assert near_groups(frame(spark, [])).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    texts = planted()
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, enumerate(texts)), "").collect()
    assert sorted(r.doc_id for r in out) == sorted(set(brute(texts)))
