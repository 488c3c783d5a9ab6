"""The conversation trie against a brute-force trie, with blocks of any size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from ferryline.llm import conversation_trie as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, group=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        full = tuple(own.get(c - c % group, [])[:h] + ts[h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        ends[full].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def words(p):
        return len(WORD.findall(p[-1][1])) if p else 0

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * words(p) + sum(saved[k] for k in kids[p])
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def talks(rng, n):
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, turn or None, rng.choice(["user", None, ""]), rng.choice(["a b", "a b", "c", "", None, "d  e\tf"])))
    for c in range(n, n + 60):  # copies of one conversation, some longer
        rows += [(c * 20, k, "user", f"same {k}") for k in range(3 + (c % 7 == 0))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 15])
def test_trie_equals_brute_force(spark, monkeypatch, size):
    """Blocks of a few conversations: most nodes reach over several."""
    monkeypatch.setattr(T, "BLOCK_ROWS", size)
    rows = talks(random.Random(size), 130)
    rng = random.Random(1)
    assert got(T.shared_beginnings(frame(spark, rng.sample(rows, len(rows))).repartition(4))) == brute(rows)


def test_hot_and_long_conversations(spark):
    rows = [(c, 1, "user", "hello there") for c in range(3000)] + [(5000, k, "bot", f"turn {k}") for k in range(2000)] + [(5040, k, "bot", f"turn {k}") for k in range(1500)]
    rows += [(6000, 1, "user", "w " * 100_000)]
    assert got(T.shared_beginnings(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (7, 1, None, None), (7, 2, "user", "x"), (-3, None, "a", "b"), (3, 1, "u", "only")]
    df = frame(spark, rows).selectExpr("*", "1 AS h", "'x' AS turns", "2 AS part")
    whole = got(T.prefix_trie(T.with_leads(T.conversation_digests(df), group=1, most=1)))
    assert sum(r[1] == 0 for r in whole) == 1 and max(r[1] for r in whole) == 2 and [r[3] for r in whole if r[1] == 0] == [3]
    assert T.shared_beginnings(df.limit(0)).count() == 0
    # repeated rows are turns like any, in order of their digests
    assert max(r[1] for r in got(T.prefix_trie(T.conversation_digests(df.unionByName(df).filter("conv_id = 7"))))) == 4
