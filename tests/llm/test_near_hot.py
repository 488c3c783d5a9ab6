"""One large group of near copies: all are found, by pairs in proportion to their number."""

import random

import pytest

from ferryline.llm import near_copies


def copies(rng, n):
    """Copies of one text of 150 words with one to four words changed: many pairs of them are under 0.8, all have near ones."""
    words = [f"b{k}" for k in range(150)]
    for _ in range(n):
        out = list(words)
        for p in rng.sample(range(len(out)), rng.choice([1, 2, 2, 3, 3, 4])):
            out[p] = f"e{rng.randrange(10**9)}"
        yield " ".join(out)


@pytest.mark.parametrize("n", [500, 1000])
def test_pairs_follow_the_group(spark, monkeypatch, n):
    rng, made, stage = random.Random(7), [], near_copies.stage

    def counted(df, name):
        out = stage(df, name)
        if name == "compared":
            made.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "stage", counted)
    texts = list(copies(rng, n))
    got = near_copies.near_groups(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(n))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[up(i)] = up(j)
    assert len({up(i) for i in range(n)}) == len({r.root for r in got})
    print("compared", n, made)
    assert sum(made[1:]) <= 20 * n  # the first are those of the tries
