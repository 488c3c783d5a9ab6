"""Conversation prefix trie: every distinct beginning of a conversation, and who shares it.

Conversations are sequences of turn digests, sorted; a node of the trie is an
interval of that order. Tasks cut the order into blocks. With the lengths of
the common prefixes of neighbours (LCPs) in a sparse table of range minima,
each candidate prefix of a block finds the left and right end of its interval
by two binary searches of its own; what a node needs is then a range minimum or
a difference of running sums. No stack is kept, and candidates don't wait for
each other.

An interval that reaches over a block's edge belongs to a prefix of the block's
first or last conversation. Such parts, one for each block and depth at most,
are added up by the prefix's digest in Spark: what is counted (first members of
new nodes, last members of leaves, words) is counted at one place of the order,
for which a block needs to know its LCPs with its neighbours only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.common import WORD, met_by_count, stage

#: Bytes of a turn's digest; bytes of digests, and conversations, of a block.
WIDTH, BLOCK_BYTES, BLOCK_ROWS = 16, 1 << 20, 1 << 15


def conversation_digests(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (h, w) in order: digest of role and text, and number of words.

    Turns are ordered by number, null first, then digest. Null roles and texts
    are empty; rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", F.unhex(digest).alias("h"), F.regexp_count(text, F.lit(WORD)).alias("w")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))  # 20 bytes a turn of one conversation
    return own.select("conv_id", F.transform("ts", lambda t: F.struct(t["h"].alias("h"), t["w"].alias("w"))).alias("turns"))


def with_leads(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c, rebuilt: the first h turns of c - c % ``group``, then its own after its first h, where h is crc32(c) % ``most``."""
    lead = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(lead, "base", "left")
    first = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.array().cast(convs.schema["turns"].dataType))
    return own.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _packed(batches):
    """Sorted (conv_id, key, w) to blocks of them, numbered in order."""
    part, no, size, held = TaskContext.get().partitionId(), 0, 0, []

    def out(held, no):
        ids, keys, words = zip(*held)
        lens = np.fromiter((len(k) // WIDTH for k in keys), np.int32, len(keys))
        cols = [[part], [no], [np.array(ids, np.int64).tobytes()], [lens.tobytes()], [b"".join(keys)], [np.concatenate(words).astype(np.int32).tobytes()], [keys[0]], [keys[-1]]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), *[pa.binary()] * 6])], ["part", "no", "ids", "lens", "keys", "words", "first", "last"])

    for batch in batches:
        words = batch.column(2)
        for i, (c, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            held.append((c, k, words[i].values.to_numpy(zero_copy_only=False) if words[i].is_valid else np.zeros(0, np.int32)))
            size += len(k) + 8
            if size >= BLOCK_BYTES or len(held) >= BLOCK_ROWS:
                yield out(held, no)
                no, size, held = no + 1, 0, []
    if held:
        yield out(held, no)


def _common(a: bytes, b: bytes) -> int:
    """Digests at the beginning that two keys share."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(v, np.dtype((np.void, WIDTH)), n) for v in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def _edges(batches):
    """(part, no, first, last, before, after) to the LCPs with the neighbours: -1 where there is none."""
    for batch in batches:
        part, no, first, last, before, after = (c.to_pylist() for c in batch.columns)
        left = [-1 if b is None else _common(b, f) for b, f in zip(before, first)]
        right = [-1 if a is None else _common(z, a) for a, z in zip(after, last)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(no, pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32())], ["part", "no", "left", "right"])


class _Minima:
    """Sparse table of range minima: level k holds the minima of 2^k values from each place."""

    def __init__(self, values: np.ndarray):
        self.levels, k = [values], 1
        while 2 * k <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo:hi], none empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k, table in enumerate(self.levels):
            on = level == k
            out[on] = np.minimum(table[lo[on]], table[hi[on] - (1 << k)])
        return out

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """From each start, the first place whose value is under depth, or the end."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            fits = at < len(table)
            go = np.zeros(len(at), bool)
            go[fits] = table[at[fits]] >= depth[fits]
            at[go] += 1 << k
        return at

    def left(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """From each start backwards, the last place up to there whose value is under depth; 0 if there is none."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            lo = at - (1 << k) + 1
            fits = lo >= 1
            go = np.zeros(len(at), bool)
            go[fits] = self.levels[k][lo[fits]] >= depth[fits]
            at[go] -= 1 << k
        return at


def block_nodes(ids: np.ndarray, lens: np.ndarray, keys: np.ndarray, words: np.ndarray, left: int, right: int) -> dict[str, list]:
    """The nodes of a block, ``left`` and ``right``: its LCPs with its neighbours.

    Nodes inside the block are whole. Parts of nodes that reach further have
    ``open``, their prefix's digest, and what they add to the node; ``ends`` are
    their members' ids. ``up`` is the digest of a parent that reaches further.
    """
    n, lens = len(ids), lens.astype(np.int64)
    off = np.concatenate([[0], np.cumsum(lens)])
    code = np.unique(keys, return_inverse=True)[1] if len(keys) else np.zeros(0, np.int64)
    both = np.minimum(lens[1:], lens[:-1])
    row = np.repeat(np.arange(n - 1), both)
    k = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    same = code[off[row + 1] + k] == code[off[row] + k]
    lcp = np.concatenate([[left], both])
    np.minimum.at(lcp, row[~same] + 1, k[~same])
    after = np.concatenate([lcp[1:], [right]])
    run = np.concatenate([[0], np.cumsum(words.astype(np.int64))])
    total = run[off[1:]] - run[off[:-1]]
    # running sums over the order: members' words, words of nodes that begin there, leaves that end there
    fresh = total - (run[off[:-1] + np.maximum(lcp, 0)] - run[off[:-1]])
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (total, fresh, (after < lens).astype(np.int64))]
    # candidates: the prefixes that begin at each place; those of the first place all, begun there or before
    begin = np.where(np.arange(n) == 0, 0, lcp + 1)
    count = lens - begin + 1
    base = np.cumsum(count) - count
    p = np.repeat(np.arange(n), count)
    d = np.arange(len(p)) - base[p] + begin[p]
    minima = _Minima(np.maximum(lcp, -1))
    hi = minima.right(p + 1, d)
    lo = minima.left(p, d)  # its own place, as it begins there; parents need the search
    goes_on = (lo == 0) & (d <= left)
    open_ = goes_on | ((hi == n) & (d <= right))
    up_lo = minima.left(p, d - 1)
    up = np.where(d > 0, base[up_lo] + (d - 1) - begin[up_lo], -1)
    before = run[off[lo] + np.maximum(d - 1, 0)] - run[off[lo]]  # words above the node's own
    members = hi - lo
    once = np.where(goes_on, sums[1][hi] - sums[1][lo], sums[1][hi] - sums[1][np.minimum(lo + 1, hi)] + total[lo] - before)
    saved = sums[0][hi] - sums[0][lo] - members * before - once
    leaves = sums[2][hi] - sums[2][lo]
    children = np.bincount(up[(up >= 0) & ~goes_on], minlength=len(p))
    least = _Minima(ids).least(lo, hi)
    # members that end at the node come first in its interval
    alike = (lcp[1:] == lens[1:]) & (lens[1:] == lens[:-1])
    stop = np.concatenate([np.flatnonzero(~alike) + 1, [n]])
    ends = np.where(lens[lo] == d, stop[np.searchsorted(stop, lo, "right")] - lo, 0)
    digest = {}
    for key_of, depth in ((0, max(left, right if n == 1 else left)), (n - 1, right)):
        h, own = hashlib.blake2b(digest_size=WIDTH), keys[off[key_of] : off[key_of + 1]]
        for j in range(min(depth, len(own)) + 1):
            digest[key_of, j] = h.digest()
            if j < len(own):
                h.update(own[j].tobytes())
    name = lambda i: digest[0, d[i]] if goes_on[i] or (n - 1, d[i]) not in digest else digest[n - 1, d[i]]
    empty = hashlib.sha256(b"").hexdigest()
    out = {k: [] for k in ("open", "up", "parent", "sha", "ends")}
    for i, (o, u, a, m) in enumerate(zip(open_.tolist(), up.tolist(), lo.tolist(), ends.tolist())):
        text = ",".join(map(str, ids[a : a + m].tolist())) if m else None
        out["open"].append(name(i) if o else None)
        out["up"].append(name(u) if u >= 0 and open_[u] else None)
        out["parent"].append(int(least[u]) if u >= 0 and not open_[u] else None)
        out["sha"].append(None if o else hashlib.sha256(text.encode()).hexdigest() if m else empty)
        out["ends"].append(text if o else None)
    return out | {"conv_id": least, "depth": d, "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}


#: Columns of ``block_nodes``, as they travel.
_KINDS = {"open": ("binary", pa.binary()), "up": ("binary", pa.binary()), "parent": ("long", pa.int64()), "sha": ("string", pa.string()), "ends": ("string", pa.string()), **{c: ("long", pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")}}


def _nodes(batches):
    for batch in batches:
        for part, no, left, right, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            ids, lens, keys, words = (np.frombuffer(v, t) for v, t in zip(packed, (np.int64, np.int32, np.dtype((np.void, WIDTH)), np.int32)))
            found = block_nodes(ids, lens, keys, words, left, right)
            n = len(found["open"])
            cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, no, np.int32)), *(pa.array(found[c], k) for c, (_, k) in _KINDS.items())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "no", *_KINDS])


def _hashed(batches):
    """(open, ends) sorted by open and place to open and the SHA-256 of all its ends; one hash at a time is kept."""
    at, h = None, None
    for batch in batches:
        done = []
        for o, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if o != at:
                if h is not None:
                    done.append((at, h.hexdigest()))
                at, h, sep = o, hashlib.sha256(), b""
            h.update(sep + text.encode())
            sep = b","
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.binary(), pa.string()))], ["open", "sha"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()])], ["open", "sha"])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """``convs``: conv_id (whole number, each once) and turns (see ``conversation_digests``). One row for each node of their trie.

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Conversations without turns are members of the root. Without conversations
    there is no node. A conversation's digests, 16 bytes a turn, travel in one
    row. Turns with equal role and text are equal (128-bit digests).
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["h"])), ""))
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), key.alias("key"), F.transform("turns", lambda t: t["w"].cast("int")).alias("w"))
    # equal conversations are told apart by their ids, so a hot one spreads over many tasks
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = stage(ordered.mapInArrow(_packed, "part int, no int, ids binary, lens binary, keys binary, words binary, first binary, last binary"), "blocks")
    # one row for each block; all a block needs of its neighbours are two numbers
    line = Window.orderBy("part", "no")
    edges = blocks.select("part", "no", "first", "last").select("*", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    edges = stage(edges.mapInArrow(_edges, "part int, no int, left int, right int"), "edges")
    nodes = blocks.join(edges, ["part", "no"]).select("part", "no", "left", "right", "ids", "lens", "keys", "words")
    nodes = stage(nodes.mapInArrow(_nodes, "part int, no int, " + ", ".join(f"{c} {k}" for c, (k, _) in _KINDS.items())), "nodes")
    parts = nodes.filter("open is not null")
    wide = parts.groupBy("open").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    chunks = parts.filter("ends is not null").repartition("open").sortWithinPartitions("open", "part", "no").select("open", "ends")
    sha = chunks.mapInArrow(_hashed, "open binary, sha string")
    wide = stage(wide.join(sha, "open", "left").withColumn("sha", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))), "wide")
    own = ["conv_id", "depth", "parent", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha"]
    every = nodes.filter("open is null").select(*own).unionByName(wide.withColumn("parent", F.lit(None).cast("long")).select(*own))
    # nodes under one that reaches over blocks learn its smallest member; as many as it has children
    below = every.filter("up is not null")
    facts = wide.select(F.col("open").alias("up"), F.col("conv_id").alias("top"), F.col("n_children").alias("n"))
    named = met_by_count(below, facts, ["up"], below.count()).withColumn("parent", F.col("top"))
    out = every.filter("up is null").select(*own).unionByName(named.select(*own))
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("sha").alias("ends_sha256"))


def shared_beginnings(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) that are rebuilt on the beginnings of others, see ``with_leads``."""
    return prefix_trie(with_leads(stage(conversation_digests(turns), "digests"), group, most))


#: The same by grouping every prefix as text; crc32 from its definition.
TRIE_SQL = r"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(unicode(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
          lambda s, x: xor(xor(s, x) >> 1, 3988292384::BIGINT * (xor(s, x) & 1))), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    b AS (SELECT c.conv_id, 0 AS own, r, role, text FROM c JOIN t ON t.conv_id = base AND r <= h UNION ALL SELECT c.conv_id, 1, r, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND r > h),
    o AS (SELECT conv_id, row_number() OVER w AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, strlen(role) || ':' || role || text AS turn FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, r)),
    p AS (SELECT conv_id, 0 AS d, 0 AS words, '' AS prefix FROM c UNION ALL SELECT conv_id, d, words, string_agg(strlen(turn) || ';' || turn, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) FROM o),
    e AS (SELECT *, lead(d) OVER w IS NULL AS last, lag(prefix) OVER w AS parent FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
    n AS (SELECT d, prefix, any_value(parent) AS parent, any_value(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM e GROUP BY d, prefix),
    k AS (SELECT parent AS prefix, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
    s AS (SELECT v.d, v.prefix, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (k.prefix IS NULL) AS n_leaves FROM n LEFT JOIN k ON k.d = n.d AND k.prefix = n.prefix JOIN p v ON v.conv_id = n.conv_id AND v.d <= n.d GROUP BY ALL)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
    FROM n JOIN s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN k ON k.d = n.d AND k.prefix = n.prefix LEFT JOIN n u ON u.d = n.d - 1 AND u.prefix = n.parent"""
