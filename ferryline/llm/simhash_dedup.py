"""SimHash near-dedup: a binary trie joined with itself.

Fingerprints (64 bits, from word shingles) link at ``budget`` or fewer
differing bits. The trie is walked by pairs of nodes: a pair carries the bits
in which its two prefixes differ, and goes no further once they exceed what
the prefix may spend. Five tries are walked, each over the bits turned by
another fifth of the word: if two fingerprints differ in at most b bits, then
in one of five turnings every prefix of j fifths differs in at most j * b / 5
bits. So the first fifth must agree, and the pairs of nodes stay few.

The walk starts at the roots. In Spark it goes down to nodes of at most ``leaf``
fingerprints, so no task gets more than two leaves of a pair however many texts
look alike; inside a task it goes on bit by bit over all pairs of leaves
together, until nodes are so small that their keys are compared. Linked
fingerprints are reduced to a spanning forest there; the components over all
tasks come from min-label rounds in Spark. Equal fingerprints are one node from
the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import met_by_count, stage

BITS, TURNS, STEP = 64, 5, 4
#: First bit of each turning. A prefix up to bound j of REACH lies within j fifths in every turning.
STARTS = [0, 13, 26, 39, 52]
REACH = [0, 12, 25, 38, 51, 64]
#: Pairs of keys up to which two nodes are compared key by key; packs of keys that a task walks together, and their pairs of keys.
FEW, PACKS, AT_ONCE = 16, 256, 4_000_000


def fifths(budget: int) -> list[tuple[int, int]]:
    """Bits that prefixes may differ in, (depth, bits): each up to its bound. No pair within the budget is lost."""
    return [(d, budget * j // TURNS) for j, d in enumerate(REACH)]


def _bits(words: list[bytes], shingle: int) -> bytes:
    """Fingerprint of a word sequence: majority of the shingles' hash bits."""
    if not words:
        return bytes(8)
    text, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size)
    start = (stop - size)[:n].tolist()
    stop = (stop - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(text[a:b], 42) for a, b in zip(start, stop)])
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp (long) for each row: A-Z lower-cased words, XXH64 with seed 42; no words: 0."""

    def run(batches):
        for batch in batches:
            fps = b"".join([_bits((t.as_py() or "").encode().lower().split(), shingle) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fps, ">u8").astype(np.uint64).view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _prefix(column: str, depth: int):
    if not depth:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(column, BITS - depth) if depth < BITS else F.col(column)


def turnings(fps: DataFrame) -> DataFrame:
    """turn and key (the turned bits) of each fingerprint, five rows each; ``lane``, where given, numbers fingerprints by other hashes, whose turns are their own."""
    turned = [F.expr(f"shiftleft(fp, {b}) | shiftrightunsigned(fp, {BITS - b})") if b else F.col("fp") for b in STARTS]
    lane = F.col("lane").cast("int") if "lane" in fps.columns else F.lit(0)
    return fps.select(lane.alias("lane"), F.posexplode(F.array(*turned)).alias("turn", "key")).select((F.col("lane") * TURNS + F.col("turn")).alias("turn"), "key")


def trie_leaves(fps: DataFrame, spend: list[tuple[int, int]], leaf: int) -> tuple[DataFrame, DataFrame]:
    """Walk the tries of all turns by node pairs, from the roots as deep as nodes hold more than ``leaf`` keys; ``spend`` as of ``fifths``.

    Returns the leaves' keys (turn, depth, node, key) and the pairs of
    different leaves that are left to compare (turn, da, a, db, b).
    """
    rows, depth, first = turnings(fps), 0, next(d for d, _ in spend if d)
    nodes = stage(rows.groupBy("turn", _prefix("key", depth).alias("node")).agg(F.count("*").alias("n")).withColumn("big", F.col("n") > leaf), "nodes")
    pairs = nodes.select("turn", *[c for s in "ab" for c in (F.lit(depth).alias(f"d{s}"), F.col("node").alias(s), F.col("big").alias(f"big_{s}"))])
    keys, met = [], []
    while True:
        here = rows.withColumn("node", _prefix("key", depth)).join(nodes, ["turn", "node"])
        keys.append(here.filter("not big").select("turn", F.lit(depth).alias("depth"), "node", "key"))
        met.append(pairs.filter("not big_a and not big_b and (da != db or a != b)").drop("big_a", "big_b"))
        if nodes.filter("big").isEmpty():
            break
        rows, deeper = stage(here.filter("big").select("turn", "key"), "keys"), min(depth + STEP, BITS) if depth else first
        nodes = stage(rows.groupBy("turn", _prefix("key", deeper).alias("node")).agg(F.count("*").alias("n")).withColumn("big", (F.col("n") > leaf) & F.lit(deeper < BITS)), "nodes")
        walk = pairs.filter("big_a or big_b")
        for s in "ab":
            child = nodes.select("turn", F.shiftrightunsigned("node", deeper - depth).alias(s), F.lit(deeper).alias("d_"), F.col("node").alias("n_"), F.col("big").alias("b_"))
            split = walk.filter(f"big_{s}").join(child, ["turn", s]).withColumns({s: F.col("n_"), f"d{s}": F.col("d_"), f"big_{s}": F.col("b_")})
            walk = split.select(*pairs.columns).unionByName(walk.filter(f"not big_{s}"))
        differ = F.expr("bit_count(shiftrightunsigned(a, da - least(da, db)) ^ shiftrightunsigned(b, db - least(da, db)))")
        most = F.coalesce(*[F.when(F.least("da", "db") <= d, F.lit(bits)) for d, bits in spend])
        pairs, depth = stage(walk.filter("da != db or a <= b").filter(differ <= most), "pairs"), deeper
    every, left = keys[0], met[0]
    for x, y in zip(keys[1:], met[1:]):
        every, left = every.unionByName(x), left.unionByName(y)
    return every, left


def _spend(depth: int, spend: list[tuple[int, int]]) -> int:
    """Bits that two prefixes of this depth may differ in."""
    return next(bits for d, bits in spend if depth <= d)


def trie_pairs(keys: np.ndarray, start: np.ndarray, stop: np.ndarray, budget: int, spend: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that differ in at most ``budget`` bits and whose prefixes spend no more than they may.

    ``keys``: ascending in each range [start, stop), a trie of its own. Node
    pairs of all tries go down together, one bit in a round.
    """
    spend = spend or fifths(budget)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # a pair: keys [a0, a1) and [b0, b1), bits that differ so far
    a0, a1, b0, b1, diff = start, stop, start, stop, np.zeros(len(start), np.int64)
    for depth in range(BITS + 1):
        few = ((a1 - a0) * (b1 - b0) <= FEW) | (depth == BITS)
        if few.any():
            x0, y0, ny = a0[few], b0[few], (b1 - b0)[few]
            n = (a1 - a0)[few] * ny
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            u, v = x0[row] + k // ny[row], y0[row] + k % ny[row]
            near = (u < v) & (np.bitwise_count(keys[u] ^ keys[v]) <= budget)
            us.append(u[near])
            vs.append(v[near])
            a0, a1, b0, b1, diff = (x[~few] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0  # a node with itself has its mixed child pair once
        c = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), tuple(x[other] for x in (am, a1, b0, bm, diff + 1))]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*c))
        on = (a1 > a0) & (b1 > b0) & (diff <= _spend(depth + 1, spend))
        a0, a1, b0, b1, diff = (x[on] for x in (a0, a1, b0, b1, diff))
    return np.concatenate(us), np.concatenate(vs)


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of the n places that links (u, v) reach from each."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        on = label[u] != label[v]
        u, v = u[on], v[on]
    while (label[label] != label).any():
        label = label[label]
    return label


def _packed(sizes: list[int]):
    """Ranges of neighbouring packs that are walked together."""
    lo = pairs = 0
    for hi, n in enumerate(sizes):
        if hi > lo and (hi - lo >= PACKS or pairs + n * n > AT_ONCE):
            yield lo, hi
            lo, pairs = hi, 0
        pairs += n * n
    if sizes:
        yield lo, len(sizes)


def lane_links(fps: DataFrame, spend: list[tuple[int, int]], leaf: int = 1024) -> DataFrame:
    """``fps``: distinct fp (and lane). Links (lane, u, v) that connect whatever the tries' pairs connect; ``spend`` as of ``fifths``, the last bound for whole fingerprints."""
    keys, pairs = trie_leaves(fps, spend, leaf)
    packs = keys.groupBy("turn", "depth", "node").agg(F.collect_list("key").alias("keys"))  # at most leaf keys
    packs = stage(packs, "leaves") if not pairs.isEmpty() else packs
    side = {s: packs.select("turn", F.col("depth").alias(f"d{s}"), F.col("node").alias(s), F.col("keys").alias(f"keys_{s}")) for s in "ab"}
    cross = pairs.join(side["a"], ["turn", "da", "a"]).join(side["b"], ["turn", "db", "b"]).select("turn", F.concat("keys_a", "keys_b").alias("keys"))
    todo = packs.filter(F.size("keys") > 1).select("turn", "keys").unionByName(cross)

    def compare(batches):
        for whole in batches:
            for lo, hi in _packed(np.diff(whole.column("keys").offsets.to_numpy()).tolist()):
                batch = whole.slice(lo, hi - lo)
                lists = batch.column("keys")
                own = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                size = np.diff(lists.offsets.to_numpy())
                pack = np.repeat(np.arange(len(size)), size)
                own = own[np.lexsort((own, pack))]
                stop = np.cumsum(size)
                label = _least(len(own), *trie_pairs(own, stop - size, stop, spend[-1][1], spend))
                turn = batch.column("turn").to_numpy()[pack]
                back = np.array(STARTS, np.uint64)[turn % TURNS]
                own = np.where(back > 0, (own >> back) | (own << ((np.uint64(BITS) - back) % np.uint64(BITS))), own)
                v = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array((turn[v] // TURNS).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (own[label[v]], own[v]))], ["lane", "u", "v"])

    return todo.mapInArrow(compare, "lane int, u long, v long")


def links(fps: DataFrame, budget: int = 4, leaf: int = 1024) -> DataFrame:
    """``fps``: distinct fp. Links (u, v) that connect whatever pairs within the budget connect."""
    return lane_links(fps.select("fp"), fifths(budget), leaf).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): the smallest node of each component, by alternating star rounds.

    Large star: every node hands its larger neighbours to its smallest one;
    small star: it links its smaller neighbours to the smallest. Each round is
    one grouped minimum and a join, so hot nodes are never collected.
    """
    edges = stage(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = stage(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, last = nxt, state


def simhash_dedup(docs: DataFrame, budget: int = 4, shingle: int = 4, leaf: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and near-duplicate group of every row.

    Returns id_col, fp (long) and component_id (the smallest id that links
    reach; null ids never are). Texts without words, null ones too, have
    fingerprint 0 and link like others; texts shorter than a shingle are one
    shingle. Repeated rows get equal rows. Other columns don't pass, whatever
    their names. An empty table gives an empty result.
    """
    rows = stage(fingerprints(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    each = stage(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")), "distinct")
    roots = components(links(each.select("fp"), budget, leaf))
    each = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = each.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(each.join(groups, "root").select("fp", "n", "component_id"), "groups")
    return met_by_count(rows, named, ["fp"], rows.count()).select(F.col("id").alias(id_col), "fp", "component_id")
