"""The pipeline's near copies come from the walk of SimHash tries: fingerprints by brute force, and recall by similarity."""

import random

import numpy as np
import pytest

from ferryline.llm.near_copies import LANES, SPEND, near_groups, simhashes
from ferryline.llm.simhash_dedup import lane_links
from ferryline.llm.substring_dedup import _mix


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    n = np.array([1, 4, 5, 255, 256, 1000])
    code = rng.integers(0, 1 << 63, n.sum(), np.uint64)
    start = np.cumsum(n) - n
    got = simhashes(code, start, n)
    for lane in range(LANES):
        h = _mix(code, np.full(1, lane + 2, np.uint64))
        for k, (a, m) in enumerate(zip(start, n)):
            for bit in range(64):
                ones = int(((h[a : a + m] >> np.uint64(bit)) & np.uint64(1)).sum())
                assert (int(got[lane, k]) >> bit) & 1 == (ones * 2 > m)


def pair(rng, i, size, low, high):
    """Two texts whose five-word shingles share between ``low`` and ``high``, by words changed at random places."""
    while True:
        x = [f"w{i}x{rng.randrange(10**6)}" for _ in range(size)]
        y = list(x)
        for p in rng.sample(range(size), rng.randint(1, max(1, size // 30))):
            y[p] = f"y{i}x{rng.randrange(10**6)}"
        a, b = ({tuple(t[k : k + 5]) for k in range(size - 4)} for t in (x, y))
        if low <= len(a & b) / len(a | b) < high:
            return [" ".join(x), " ".join(y)]


@pytest.mark.parametrize(("low", "high", "least"), [(0.8, 0.82, 0.95), (0.82, 0.9, 0.99), (0.9, 1.0, 0.995)])
def test_recall_of_the_walk(spark, low, high, least):
    rng = random.Random(11)
    texts = [t for i in range(300) for t in pair(rng, i, rng.choice([60, 100, 200, 300]), low, high)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for leaf in (1024, 16):  # small leaves take the walk through Spark
        roots = [r.root for r in near_groups(rows, leaf=leaf).collect()]
        found = len(roots) - len(set(roots))
        print("recall", low, leaf, found / 300)
        assert least * 300 <= found <= 300


def test_far_fingerprints_do_not_meet(spark):
    fps = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 5000).tolist()
    got = lane_links(spark.createDataFrame([(i % LANES, f) for i, f in enumerate(fps)], "lane int, fp long"), SPEND).collect()
    assert len(got) <= 5
