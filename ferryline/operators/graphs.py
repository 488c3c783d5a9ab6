"""Order and cycles of a directed graph, in rounds that long chains, rings and many small parts don't add to.

Both operators hang every node that has a single way on under the node it
leads to, and jump: each round doubles the length of the jumps, so a chain or
ring of n nodes takes log2(n) rounds, all of them in the graph at once. What is
left is a smaller graph of nodes with several ways on; the rounds repeat on it,
at most once for each layer of that core.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.operators.staging import Appended, written


def _jumps(f: DataFrame) -> list[DataFrame]:
    """``f``: node, to, w, b, one row a node, where value(node) is the larger of b and value(to) + w.

    Tables of node, to, done, least, w, b: after the k-th, ``to`` is 2^k steps on,
    or the end of the way (done). The last table's rows that aren't done lead
    into rings: their ``to`` are exactly the nodes of rings, and ``least`` of a
    ring's node is the smallest of its ring.
    """
    known = f.select(F.col("node").alias("to"), F.lit(False).alias("done"))
    tables = [written(f.join(known, "to", "left").select("node", "to", F.coalesce("done", F.lit(True)).alias("done"), F.col("node").alias("least"), "w", "b"))]
    state = None
    while True:
        t = tables[-1]
        now = t.filter("not done").agg(F.count("*").alias("n"), F.count_distinct("to").alias("image"), F.sum(F.xxhash64("node", "least").cast("decimal(38,0)")).alias("least")).first()
        if not now.n or now == state:
            return tables
        state = now
        on = t.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"), F.col("least").alias("least2"), F.col("w").alias("w2"), F.col("b").alias("b2"))
        further = t.filter("not done").join(on, "to").select("node", F.col("to2").alias("to"), F.col("done2").alias("done"), F.least("least", "least2").alias("least"), (F.col("w") + F.col("w2")).alias("w"), F.greatest("b", F.col("b2") + F.col("w")).alias("b"))
        tables.append(written(t.filter("done").unionByName(further)))


def dependency_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes``: node; ``edges``: src needs dst. node and wave, from 0; null for nodes in or behind a cycle.

    Self-edges, unknown names, repeated rows and nulls in edges are ignored; a
    null node has wave 0. Nodes with one need left jump along their chains;
    nodes with none give their wave to those that need them. Rounds follow the
    layers of what has several needs, not the number of waves.
    """
    own = nodes.select("node").distinct()
    at = lambda c: own.filter("node is not null").withColumnRenamed("node", c)
    kind = nodes.schema["node"].dataType
    e = edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).filter("src != dst")
    e = e.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst").distinct()
    left, e = written(own.select("node", F.lit(0).cast("long").alias("low"))), written(e.withColumn("w", F.lit(1).cast("long")))
    done, hung = Appended(own.select("node", F.lit(0).cast("long").alias("wave"))), []
    while True:
        needs = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to"), F.min("w").alias("w"))
        state = written(left.join(needs, "node", "left"))
        ready = state.filter("n is null").select("node", F.col("low").alias("wave"))
        chained = _jumps(state.filter("n = 1").select("node", "to", "w", F.col("low").alias("b")))[-1].filter("done")
        more, under = not ready.isEmpty(), not chained.isEmpty()
        if not (more or under):
            break
        if under:
            hung.append(chained)
        done.add(ready)
        # edges to hung nodes go to what those hang on; edges to ready nodes are met
        moved = e.join(chained.select(F.col("node").alias("src")), "src", "left_anti").join(chained.select(F.col("node").alias("dst"), F.col("to"), F.col("w").alias("w2"), F.col("b")), "dst", "left")
        moved = moved.select("src", F.coalesce("to", "dst").alias("dst"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), (F.col("b") + F.col("w")).alias("low"))
        moved = written(moved.join(ready.select(F.col("node").alias("dst"), "wave"), "dst", "left"))
        low = moved.groupBy(F.col("src").alias("node")).agg(F.max(F.greatest("low", F.col("wave") + F.col("w"))).alias("low2"))
        rest = state.filter("n is not null").join(chained.select("node"), "node", "left_anti").join(low, "node", "left")
        left = written(rest.select("node", F.greatest("low", "low2").alias("low")))
        e = written(moved.filter("wave is null").groupBy("src", "dst").agg(F.max("w").alias("w")))
    out = done.read()
    for chained in reversed(hung):
        waves = chained.join(out.select(F.col("node").alias("to"), "wave"), "to").select("node", F.greatest("b", F.col("wave") + F.col("w")).alias("wave"))
        done.add(waves)
        out = done.read()
    same = F.col("node").eqNullSafe(F.col("_n"))
    return own.join(out.select(F.col("node").alias("_n"), "wave"), same, "left").select("node", F.col("wave").cast("int").alias("wave"))


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose ends have a way in and a way out."""
    into, out_of = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
    return e.join(into, "src", "left_semi").join(out_of, "dst", "left_semi")


def _turned(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _coloured(e: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round of colouring on a graph without chains: node and part of the strongly connected parts found, and the edges left.

    Every node takes the largest mark that reaches it, all at once; a node that
    keeps its own mark is the root of its colour, and what reaches it inside the
    colour is its part. Marks are hashes, so of k parts in a row about half go
    each round. Steps follow the core's diameter.
    """
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    own = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("root"))
    marks = Appended(nodes.select("node", own.alias("mark")))
    front = marks.add(nodes.select("node", own.alias("mark")))
    while not front.isEmpty():
        step = front.join(e, front["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("mark").alias("mark"))
        best = marks.read().groupBy("node").agg(F.max("mark").alias("best"))
        front = marks.add(step.join(best, "node").filter("mark > best").select("node", "mark"))
    colour = written(marks.read().groupBy("node").agg(F.max("mark").alias("m")).select("node", F.col("m.root").alias("root")))
    ends = lambda c: colour.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
    inner = written(e.join(ends("src"), "src").join(ends("dst"), "dst").filter("r_src = r_dst").select("src", "dst", F.col("r_src").alias("part")))
    start = colour.filter("node = root").select("node", F.col("root").alias("part"))
    seen = Appended(start)
    front = seen.add(start)
    while not front.isEmpty():
        step = front.select(F.col("node").alias("dst"), "part").join(inner, ["dst", "part"]).select(F.col("src").alias("node"), "part").distinct()
        front = seen.add(step.join(seen.read(), ["node", "part"], "left_anti"))
    found = written(seen.read())
    gone = lambda c: found.select(F.col("node").alias(c))
    rest = written(inner.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"))
    several = found.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part")
    return found.join(several, "part").select("node", "part"), rest


def strong_parts(edges: DataFrame) -> DataFrame:
    """``edges``: src, dst. node and part of every node in a strongly connected part of two nodes or more; ``part`` is one of its nodes.

    Nodes with one way in hang under the node they come from (rings of such
    nodes are parts at once), then nodes with one way out under the one they
    lead to, until neither is left; the core is coloured. Going back up, a hung
    node belongs to its root's part if a way from it or from what hangs below it
    leads back into that part.
    """
    e = written(edges.filter("src != dst").select("src", "dst").distinct())
    back, turn, idle = [], 0, 0
    found = Appended(e.select(F.col("src").alias("node"), F.col("src").alias("part")))
    while not e.isEmpty():
        if idle == 2:
            parts, e = _coloured(e, turn)
            back.append((None, parts, None))
            turn, idle = turn + 1, 0
            continue
        ways = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("to")).filter("n = 1")
        tables = _jumps(ways.select("node", "to", F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("b")))
        last = tables[-1]
        idle = idle + 1 if last.isEmpty() else 0
        ring = last.filter("not done").select(F.col("to").alias("node")).distinct().join(last, "node").select("node", F.col("least").alias("part"))
        # what comes out of a ring, or hangs on one, has no way back; ways into single nodes are their own chains
        ends = last.select(F.col("node").alias("src"), F.col("to").alias("root"), "done")
        kept = e.join(last.select(F.col("node").alias("dst")), "dst", "left_anti").join(ends, "src", "left").filter("done or done is null")
        kept = written(kept.select("src", F.coalesce("root", "src").alias("root"), "dst"))
        loops = kept.filter("root = dst").select(F.col("dst").alias("node")).distinct()
        back.append((tables, ring, (kept, loops)))
        e = written(_turned(_trimmed(kept.filter("root != dst").select(F.col("root").alias("src"), "dst").distinct())))
    for tables, parts, ways in reversed(back):
        if tables is not None:
            kept, loops = ways
            have = found.read()
            found.add(loops.join(have, "node", "left_anti").select("node", F.col("node").alias("part")))
            have = found.read()
            of = lambda c: have.select(F.col("node").alias(c), F.col("part").alias(f"p_{c}"))  # noqa: E731, B023
            hit = kept.filter("src != root").join(of("root"), "root").join(of("dst"), "dst").filter("p_root = p_dst").select(F.col("src").alias("node")).distinct()
            for t in tables:  # marks go up to all above: jumps of 1, 2, 4, ...
                hit = hit.join(t.select("node", "to"), "node", "left").select(F.explode(F.array_compact(F.array("node", "to"))).alias("node")).distinct()
            found.add(hit.join(tables[-1].select("node", F.col("to").alias("root")), "node").join(of("root"), "root").select("node", F.col("p_root").alias("part")))
        found.add(parts)
    return found.read()


def cycle_members(edges: DataFrame) -> DataFrame:
    """node and self_loop of every node on a cycle; nulls are no nodes, repeated edges count once."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    on = loops.union(strong_parts(edges).select("node")).distinct()
    return on.join(loops.withColumn("self_loop", F.lit(True)), "node", "left").fillna(False, ["self_loop"])
