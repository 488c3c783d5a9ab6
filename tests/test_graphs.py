"""Waves and cycles: long chains and rings, many small parts, and random graphs against brute force."""

import random
import time
from pathlib import Path

import pytest

from ferryline.operators.graphs import cycle_members, dependency_waves, strong_parts
from ferryline.operators.staging import drop_written, run_folder, written


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long")


def reach(edges, nodes):
    """Nodes that each node leads to in one step or more."""
    out = {n: set() for n in nodes}
    for a, b in edges:
        out[a].add(b)
    full = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        full[n] = seen
    return full


def brute_waves(nodes, edges):
    need = {n: {b for a, b in edges if a == n and b != n and b in nodes} for n in nodes}
    wave = {}
    while True:
        ready = [n for n in nodes if n not in wave and all(m in wave for m in need[n])]
        if not ready:
            return {n: wave.get(n) for n in nodes}
        wave.update({n: 1 + max((wave[m] for m in need[n]), default=-1) for n in ready})


def shapes():
    rng = random.Random(3)
    for n, m in ((12, 14), (30, 45), (40, 60)):
        yield [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    dense = [(a, b) for k in range(4) for a in range(k * 5, k * 5 + 5) for b in range(k * 5, k * 5 + 5) if a != b]
    yield [*dense, (0, 5), (6, 10), (12, 15), (1, 16)]  # parts without chains, in a row
    yield [(a, b) for a in range(25) for b in (a + 1, a + 5) if b < 30]  # layers, no cycle
    ring = [(i, (i + 1) % 30) for i in range(30)]
    yield [*ring, (4, 17), (9, 31), (31, 32), (33, 3), (32, 34)]  # a chord, ways out and in


@pytest.mark.parametrize("edges", list(shapes()))
def test_random_graphs(spark, edges):
    nodes = sorted({x for e in edges for x in e})
    n, e = frames(spark, nodes, edges)
    full = reach(edges, nodes)
    assert {r.node: r.self_loop for r in cycle_members(e).collect()} == {x: (x, x) in edges for x in nodes if x in full[x]}
    part = {r.node: r.part for r in strong_parts(e).collect()}
    assert set(part) == {x for x in nodes if any(y != x and x in full[y] for y in full[x])}
    assert all((part[x] == part[y]) == (y in full[x] and x in full[y]) for x in part for y in part if x != y)
    assert {r.node: r.wave for r in dependency_waves(n, e).collect()} == brute_waves(nodes, edges)


def timed(limit, f):
    start = time.time()
    out = f()
    assert time.time() - start < limit
    return out


def test_many_cycles_a_ring_and_a_chain(spark):
    """Rounds don't grow with the number of cycles, nor with a ring's or a chain's length."""
    pairs = [(2 * i + d, 2 * i + 1 - d) for i in range(1000) for d in (0, 1)]
    ring = [(10_000 + i, 10_000 + (i + 1) % 2000) for i in range(2000)]
    chain = [(20_000 + i + 1, 20_000 + i) for i in range(2000)]
    n, e = frames(spark, sorted({x for s in (pairs, ring, chain) for p in s for x in p}), [*pairs, *ring, *chain])
    got = timed(90, lambda: {r.node for r in cycle_members(e).collect()})
    assert got == {x for s in (pairs, ring) for p in s for x in p}
    waves = timed(90, lambda: {r.node: r.wave for r in dependency_waves(n, e).collect()})
    assert all(waves[20_000 + i] == i for i in range(2001)) and sum(w is None for w in waves.values()) == 4000


def test_odd_rows(spark):
    e = spark.createDataFrame([("a", None), (None, "a"), ("a", "b"), ("a", "b"), ("b", "b"), ("x", "gone")], "src string, dst string")
    n = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("x",)], "node string")
    assert {r.node: r.wave for r in dependency_waves(n, e).collect()} == {"a": 1, "b": 0, None: 0, "x": 0}
    assert [tuple(r) for r in cycle_members(e).collect()] == [("b", True)]
    assert dependency_waves(n.limit(0), e).count() == 0 and cycle_members(e.limit(0)).count() == 0


def test_written_tables_can_be_dropped(spark):
    folder = Path(run_folder(spark).removeprefix("file:"))
    assert written(spark.range(3)).count() == 3 and list(folder.glob("table-*"))
    drop_written(spark)
    assert not folder.exists()
