"""Substring dedup by De Bruijn compaction.

Every window of ``window`` consecutive words is an edge of a De Bruijn graph.
The edges that lie around the same anchor (the smallest hash among the
``ANCHOR``-word grams inside the window) are a path of that graph: at most
``window - ANCHOR + 1`` edges, one row instead of one row per word. Equal paths
have equal anchors, so Spark groups and joins by anchor:

1. a path whose anchor occurs once in the corpus cannot hold a repeated edge;
2. a path that occurs twice or more with the same words is nonbranching as far
   as it goes: it compacts to one edge, repeated as a whole;
3. where several different paths meet in one anchor the graph branches: one
   copy of each path is taken apart into its edges, which are counted. Their
   words are read again at the source coordinates of the copy.

Last, the verdicts go back to the source coordinates of every path, and
touching edges make the maximal repeated spans. Paths and edges are compared by
64-bit hashes of the very words that stand at their coordinates, and only where
the 64-bit hashes of their anchors agree too.

Hot texts are safe: whatever is grouped is counted map-side first, no group is
collected, and verdicts on hot anchors and hot paths travel to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import met_by_count, stage

#: Words of an anchor gram.
ANCHOR = 8
#: Words hashed together in one go inside a task.
SLICE = 80_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M1) ^ ((b + _M2) * _M3)
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbours, from runs of powers of two."""
    done, out, power, width = 0, None, h, 1
    while True:
        if size & width:
            n = len(h) - done - width + 1
            if n <= 0:
                return h[:0]
            part = power[done : done + n]
            out = part if out is None else _mix(out[:n], part)
            done += width
        width *= 2
        if width > size:
            return out
        power = _mix(power[: -(width // 2)], power[width // 2 :]) if len(power) > width // 2 else power[:0]


def first_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value among each ``width`` neighbours."""
    pos, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        left, right = pos[: len(pos) - step], pos[step:]
        pos, have = np.where(v[right] < v[left], right, left), have + step
    return pos


def word_ends(words: list[bytes]) -> np.ndarray:
    """Where each word begins in the words joined by one space, and where one more would."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])


def digests(words: list[bytes], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of the exact words of each range [start, stop)."""
    text, at = b" ".join(words), word_ends(words)
    found = [xxhash.xxh3_64_intdigest(text[x:y]) for x, y in zip(at[start].tolist(), (at[stop] - 1).tolist())]
    return np.array(found, np.uint64).view(np.int64)


def paths(h: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts (``ends``: last word of its text, for each word): start, edges and anchor of each path."""
    anchor = min(ANCHOR, window)
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    grams = gram_hashes(h, anchor)
    at = first_minima(grams, window - anchor + 1)
    ok = np.arange(n) + (window - 1) <= ends[:n]
    new = ok.copy()
    new[1:] &= ~(ok[:-1] & (at[1:] == at[:-1]))
    start = np.flatnonzero(new)
    stop = np.flatnonzero(ok & ~np.append(ok[1:] & ~new[1:], False))
    return start, stop - start + 1, grams[at[start]].view(np.int64)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in groups of about SLICE words, texts last and cut into words."""
    rows, total = [], 0
    for batch in batches:
        cols = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            *rest, text = (c[i].as_py() for c in cols)
            words = text.encode().split() if text else []
            rows.append((*rest, words))
            total += len(words)
            if total >= SLICE:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def _joined(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, the first word of each row, the last word of its row for each word."""
    n = np.array([len(r[-1]) for r in rows])
    first = np.concatenate([[0], np.cumsum(n)])
    return word_hashes([w for r in rows for w in r[-1]]), first, np.repeat(first[1:] - 1, n)


def repeated_runs(docs: DataFrame, window: int) -> DataFrame:
    """``docs``: id, did, th, text. Paths with a repeated edge, for each did and th: did, th, spans array of (start, edges, mask).

    ``mask`` has a bit for each repeated edge of the path, the first edge lowest.
    """

    def cut(batches):
        for rows in _sliced(batches):
            h, first, ends = _joined(rows)
            start, n, anchor = paths(h, ends, window)
            path = digests([w for r in rows for w in r[-1]], start, start + n + window - 1)
            row = np.searchsorted(first, start, "right") - 1
            did, th = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did[row], th[row], (start - first[row]).astype(np.int32), n.astype(np.int32), anchor, path)], ["did", "th", "start", "edges", "anchor", "path"])

    found = stage(docs.select("did", "th", "text").mapInArrow(cut, "did long, th long, start int, edges int, anchor long, path long"), "paths")
    total = found.count()
    twice = stage(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    found = stage(met_by_count(found, twice, ["anchor"], total), "paths-met")

    kinds = stage(found.groupBy("anchor", "path").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "start", "edges")).alias("at")), "kinds")
    branch = stage(kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "branches")
    open_ = met_by_count(kinds.withColumnRenamed("n", "copies"), branch, ["anchor"], total).select("anchor", "path", "copies", "at.*")

    def edges(batches):
        for batch in batches:
            for text, items in zip(batch.column("text"), batch.column("items")):
                items, words = items.as_py(), text.as_py().encode().split()
                n = np.array([x["edges"] for x in items])
                which = np.repeat(np.arange(len(items)), n)
                off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = np.array([x["start"] for x in items])[which] + off
                # paths of one text seldom overlap, but equal rows repeat them
                place, back = np.unique(at, return_inverse=True)
                edge = digests(words, place, place + window)[back]
                cols = [np.array([x[k] for x in items], np.int64)[which] for k in ("anchor", "path")]
                once = np.array([x["copies"] == 1 for x in items])[which]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, once, off.astype(np.int32), edge)], ["anchor", "path", "once", "off", "edge"])

    per_doc = open_.groupBy("did", "th").agg(F.collect_list(F.struct("anchor", "path", "copies", "start", "edges")).alias("items"))
    # the id goes along so that this exchange of the texts is the one that strip reads again
    apart = docs.join(per_doc, ["did", "th"]).select("id", "text", "items").mapInArrow(edges, "anchor long, path long, once boolean, off int, edge long")
    # equal rows give the same copy more than once: a path counts once for each edge
    shared = apart.groupBy("anchor", "edge").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).filter("lo != hi").select("anchor", "edge")
    partly = apart.filter("once").join(shared, ["anchor", "edge"]).groupBy("anchor", "path").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))
    # a path that occurs once has its own mask, others are repeated as a whole
    verdict = partly.select("anchor", "path", "mask", F.lit(1).cast("long").alias("n")).unionByName(kinds.filter("n > 1").select("anchor", "path", F.lit(-1).cast("long").alias("mask"), "n"))
    spans = met_by_count(found, verdict, ["anchor", "path"], total).select("did", "th", "start", "edges", "mask")
    # rows with one id and text, however many, have the same spans: they are listed once
    return spans.distinct().groupBy("did", "th").agg(F.collect_list(F.struct("start", "edges", "mask")).alias("spans"))


def covered(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Flags of the words that repeated edges cover."""
    step = np.zeros(n_words + 1, np.int64)
    for s in spans:
        edges = s["start"] + np.flatnonzero((s["mask"] >> np.arange(s["edges"])) & 1)
        np.add.at(step, edges, 1)
        np.add.at(step, edges + window, -1)
    return np.cumsum(step[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, respace: bool = True) -> DataFrame:
    """Every row of ``docs`` with what is left of it when repeated spans go.

    Returns id_col, the columns ``carry``, n_words, n_removed, kept (the kept
    words, joined by one space; with ``respace`` off, texts that lose nothing
    stay as they are) and spans (array of word ranges [start, stop) that were
    removed). Null and empty texts have no words. Texts shorter than ``window``
    keep all words. Repeated rows are occurrences of their own: they lose all
    they share. Other columns don't pass. An empty table gives an empty result.
    ``window``: 2 to 71 words.
    """
    if not 2 <= window <= 64 + ANCHOR - 1:
        raise ValueError("window must be 2 to 71 words")
    names = [id_col, *(carry or [])]
    slim = docs.select(F.struct(*names).alias("id"), F.xxhash64(id_col).alias("did"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def strip(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                text = text.as_py() or ""
                words = text.encode().split()
                gone = covered(len(words), spans.as_py() or [], window)
                some = bool(gone.any())
                kept = text if not some and not respace else b" ".join(words if not some else [words[i] for i in np.flatnonzero(~gone)]).decode()
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out.append((len(words), int(gone.sum()), kept, [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), span)))], ["id", "n_words", "n_removed", "kept", "spans"])

    joined = slim.join(repeated_runs(slim, window), ["did", "th"], "left").select("id", "text", "spans")
    kind = slim.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(strip, f"id {kind}, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>")
    return out.select(*[F.col("id").getField(c).alias(c) for c in names], "n_words", "n_removed", "kept", "spans")
