"""Waves of a chain, beyond any bound, and of a cycle."""

import inspect

from ferryline.operators.migrate import dependency_waves


def test_waves(spark):
    assert list(inspect.signature(dependency_waves).parameters) == ["nodes", "edges"]  # no bound
    edges = [(str(i + 1), str(i)) for i in range(4)] + [("a", "b"), ("b", "a"), ("c", "a")]
    nodes = spark.createDataFrame([(x,) for x in {y for e in edges for y in e}], "node string")
    got = {r.node: r.wave for r in dependency_waves(nodes, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {**{str(i): i for i in range(5)}, "a": None, "b": None, "c": None}
