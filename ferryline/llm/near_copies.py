"""Near copies: texts whose shingle sets are alike, by SimHash fingerprints in binary tries and exact verification.

Two sets of similarity 0.8 differ in 0.15 of a fingerprint's bits, so a single
fingerprint of 64 bits would need a budget that lets a tenth of all pairs pass
its first bits. Instead each set has ``LANES`` fingerprints by independent hashes,
and each trie of their turnings (five a lane) is walked with a narrow profile:
the first ten bits agree, later ones may differ in few. A pair at 0.8 passes one
walk with a probability of about 0.1, and one of the 40 walks with about 0.99;
at 0.9 it is 0.9999. Two random sets hardly pass any. Whatever meets in a
trie is a bucket, and is compared by its whole sets:

1. texts with equal sets are one class from the start;
2. each class is compared with one of its own fingerprint in each lane, and
   those with one of their bucket, so that many copies are linked in one go;
3. in buckets that the links so far leave apart, texts meet at rare
   shingles: each text's shingles stand in one order, rare ones first, and a
   pair that shares 0.8 must share one of its first fifth. Where these lists
   would make more pairs than they have rows, texts are first compared with
   some of each of their lists, in turns, which links large groups by about as
   many pairs as the lists have rows; then all pairs of texts that are still
   apart are made. Where lengths, and the places at which they meet, rule a pair out, it
   is not made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import met_by_count, stage
from ferryline.llm.simhash_dedup import BITS, components, lane_links
from ferryline.llm.substring_dedup import _joined, _mix, _sliced, gram_hashes
from ferryline.llm.url_filters import AZ, az

#: Fingerprints of a set, and the bits (depth, bits) that prefixes of two may differ in.
LANES = 8
SPEND = [(10, 0), (14, 1), (18, 2), (22, 3), (26, 4), (38, 7), (51, 9), (64, 11)]
#: Every eighth bit, and how many shingles can be added up in such bytes.
_EIGHTH, _MOST = np.uint64(0x0101010101010101), 255
#: Texts of a list that others are compared with in a turn, at most. Turns go on while each leaves at most this share of the pairs that the lists would make.
HEADS, FALLS = 64, 0.75


def simhashes(code: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints (lane, set) of sets of shingle hashes, ``n`` from ``start`` on: a bit is 1 if it is set in over half of them."""
    parts = -(-n // _MOST)  # bytes hold the sums of so many shingles only
    of = np.repeat(np.arange(len(n)), parts)
    lo = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * _MOST
    first, out = np.cumsum(parts) - parts, np.zeros((LANES, len(n)), np.uint64)
    for lane in range(LANES):
        h = _mix(code, np.full(1, lane + 2, np.uint64))
        for k in range(BITS // 8):
            sums = np.add.reduceat((h >> np.uint64(k)) & _EIGHTH, lo)
            ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            bits = (ones * 2 > n[:, None]).astype(np.uint8)
            out[lane] |= np.ascontiguousarray(bits).view(np.uint64)[:, 0] << np.uint64(k)
    return out


def shingle_sets(h: np.ndarray, first: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Of concatenated word hashes (``first``: first word of each text): text number and hash of each distinct shingle, in order.

    A text under ``shingle`` words is one shingle; one without words has none.
    """
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    grams = gram_hashes(h, shingle)
    inside = row[: len(grams)] == row[len(h) - len(grams) :]
    short = np.flatnonzero((size > 0) & (size < shingle))
    whole = [gram_hashes(h[first[k] : first[k + 1]], int(size[k]))[:1] for k in short]
    which = np.concatenate([row[: len(grams)][inside], short])
    code = np.concatenate([grams[inside], *whole])
    order = np.lexsort((code, which))
    which, code = which[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (which[1:] != which[:-1]) | (code[1:] != code[:-1])
    return which[new], code[new]


def _sketches(shingle: int, share: float):
    """(th, text) to th, two sums and the size of the text's set, and its fingerprints if another set can be near."""

    def run(batches):
        for rows in _sliced(batches):
            h, first, _ = _joined(rows)
            which, code = shingle_sets(h, first, shingle)
            n = np.bincount(which, minlength=len(rows))
            some = np.flatnonzero(n)
            start = (np.cumsum(n) - n)[some]
            sums, prints = np.zeros((2, len(rows)), np.uint64), np.zeros((LANES, len(rows)), np.uint64)
            if len(some):
                for k in range(2):
                    sums[k, some] = np.add.reduceat(_mix(code, np.full(1, k, np.uint64)), start)
                prints[:, some] = simhashes(code, start, n[some])
            fps = [f if c and c / (c + 1) >= share else [] for f, c in zip(prints.T.view(np.int64).tolist(), n.tolist())]
            cols = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array(s.view(np.int64)) for s in sums), pa.array(n, pa.int64()), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["th", "c1", "c2", "n", "fps"])

    return run


def _sets(shingle: int):
    """(th, text) to th and the set's hashes, ascending."""

    def run(batches):
        for rows in _sliced(batches):
            h, first, _ = _joined(rows)
            which, code = shingle_sets(h, first, shingle)
            cut = np.searchsorted(which, np.arange(len(rows) + 1))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([code[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["th", "s"])

    return run


def _shingles(batches):
    """(th, s) to th and h, a row for each shingle."""
    for batch in batches:
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
        if sets:
            th = np.repeat(batch.column(0).to_numpy(), [len(v) for v in sets])
            yield pa.RecordBatch.from_arrays([pa.array(th), pa.array(np.concatenate(sets))], ["th", "h"])


def _alike(share: float):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= share * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _both(n_x, n_y, share: float):
    """Shingles that two sets of these sizes must share."""
    return F.ceil((n_x + n_y) * (share / (1 + share)) - 1e-9)


def rare_lists(sets: DataFrame, share: float) -> DataFrame:
    """The shingles h at which a text of ``sets`` (th, n, s) must meet those that it can share ``share`` of its shingles with.

    Returns h, th, n, alone (shingles that no other set holds), rest (how many
    of those that others hold follow, h included) and even (whether that is
    enough for a set of its own size). The order of shingles is by the number
    of sets that hold them, then hash. A shingle of one set alone meets
    nothing, but takes its place in the order.
    """
    rows = stage(sets.select("th", "s").mapInArrow(_shingles, "th long, h long"), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    often = stage(often.withColumn("df", F.col("n")), "common")
    common = met_by_count(rows, often, ["h"], rows.count()).groupBy("th").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))  # one text's shingles
    own = common.join(sets.select("th", "n"), "th").withColumn("alone", F.col("n") - F.size("hs"))
    first = F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1 - F.col("alone")
    own = own.filter(first > 0).select("th", "n", "alone", F.posexplode(F.slice("hs", 1, F.greatest(first, F.lit(1)).cast("int"))).alias("i", "x"))
    own = own.select(F.col("x.h").alias("h"), "th", "n", "alone", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"))
    return stage(own.withColumn("even", F.col("rest") >= _both(F.col("n"), F.col("n"), share)), "rare")


def mixed_lists(posted: DataFrame) -> DataFrame:
    """h of each list of ``posted`` (as of ``rare_lists``, with root) that holds several roots, its largest root (most), its rows n, and its even rows in all and outside that root (evens, odd)."""
    each = posted.groupBy("h", "root").agg(F.count("*").alias("m"), F.count_if("even").alias("e"))
    by = each.groupBy("h").agg(F.count("*").alias("roots"), F.sum("m").alias("n"), F.sum("e").alias("evens"), F.max(F.struct("m", "root", "e")).alias("top")).filter("roots > 1")
    return stage(by.select("h", F.col("top.root").alias("most"), "n", "evens", (F.col("evens") - F.col("top.e")).alias("odd")), "lists")


def _meet(x: DataFrame, y: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of texts that stand in one list under different roots, and can share ``share`` by their sizes and by what follows in both."""
    x, y = (df.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("th", "n", "root", "rest")]) for k, df in (("x", x), ("y", y)))
    can = (F.col("root_x") != F.col("root_y")) & (F.least("rest_x", "rest_y") >= _both(F.col("n_x"), F.col("n_y"), share))
    return x.join(y, (x["h"] == y["h"]) & can).select(F.least("th_x", "th_y").alias("a"), F.greatest("th_x", "th_y").alias("b")).distinct()


def head_pairs(posted: DataFrame, lists: DataFrame, heads: int, turn: int, share: float) -> DataFrame:
    """Pairs (a, b) of the texts outside the largest root of each of ``lists`` with some of the list's texts, ``heads`` at most.

    Those are of the list's parts by hash, in each turn others, and from each
    part the text with the fewest shingles of its own: many copies are near it.
    """
    posted = posted.filter("even").join(lists.select("h", "most"), "h")
    part = F.pmod(F.xxhash64("th", F.lit(turn)), F.lit(heads))
    head = posted.groupBy("h", part.alias("part")).agg(F.min(F.struct("alone", "th", "n", "root", "rest")).alias("head")).select("h", "head.*")
    return _meet(posted.filter("root != most"), head, share)


def rare_pairs(posted: DataFrame, lists: DataFrame, share: float) -> DataFrame:
    """All pairs (a, b) of ``posted`` under different roots that can share ``share`` of their shingles; none that does is left out."""
    # in each list, texts outside its largest group meet all others: what links already connect is not tried again
    return _meet(posted.join(lists.select("h", "most"), "h").filter("root != most"), posted, share)


def near_groups(docs: DataFrame, share: float = 0.8, shingle: int = 5, text_col: str = "text", leaf: int = 1024) -> DataFrame:
    """th, root and copies of each distinct text: its hash, the smallest hash that links of at least ``share`` reach, and how many rows have the text.

    The share of two texts is that of their distinct shingles (A-Z
    lower-cased words) which both hold. Texts without words, null ones too, are
    equal; texts shorter than a shingle are one shingle. An empty table gives
    an empty result.
    """
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.translate(text_col, AZ, az).alias("text"))
    slim = stage(texts.mapInArrow(_sketches(shingle, share), "th long, c1 long, c2 long, n long, fps array<long>"), "sketches")
    same = ["c1", "c2", "n"]
    classes = stage(slim.groupBy(*same).agg(F.min("th").alias("rep"), F.first("fps").alias("fps")), "classes")
    rows = classes.select("rep", "n", F.posexplode("fps").alias("lane", "fp"))
    # m classes have a fingerprint; the head is another one in each lane
    heads = stage(rows.groupBy("lane", "fp").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("rep", "lane").alias("k"), F.col("rep").alias("head"), F.col("n").alias("head_n"))).alias("h")).select("lane", "fp", "m", "h.head", "h.head_n"), "heads")
    linked = stage(lane_links(heads.select("lane", "fp"), SPEND, leaf).distinct(), "trie-links")
    member = linked.select("lane", F.col("u").alias("bucket"), F.col("v").alias("fp")).unionByName(linked.select("lane", F.col("u").alias("bucket"), F.col("u").alias("fp")).distinct())
    several = member.select("lane", "fp").unionByName(heads.filter("m > 1").select("lane", "fp")).distinct()
    met = stage(rows.join(heads.join(several, ["lane", "fp"]), ["lane", "fp"]), "buckets")
    fits = lambda x, y: F.least(x, y) >= share * F.greatest(x, y) - 1e-9
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    of = lambda k: heads.select("lane", F.col("fp").alias(k), F.col("head").alias(f"rep_{k}"), F.col("head_n").alias(f"n_{k}"))
    near = linked.join(of("u"), ["lane", "u"]).join(of("v"), ["lane", "v"]).filter((F.col("rep_u") != F.col("rep_v")) & fits("n_u", "n_v")).select(*ends("rep_u", "rep_v"))
    tried = stage(met.filter((F.col("rep") != F.col("head")) & fits("n", "head_n")).select(*ends("rep", "head")).unionByName(near).distinct(), "compared")
    copies = slim.groupBy("th").agg(F.count("*").alias("copies"))
    wanted = stage(met.select(F.col("rep").alias("th"), F.col("n").alias("size")).distinct().join(copies.withColumnRenamed("copies", "n"), "th"), "wanted")
    held = met_by_count(texts, wanted, ["th"], slim.count())
    sets = held.select("th", "text").mapInArrow(_sets(shingle), "th long, s binary").groupBy("th").agg(F.first("s").alias("s"))
    sets = stage(sets.join(wanted.select("th", F.col("size").alias("n")), "th"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("th").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("th").alias("b"), F.col("s").alias("sb")), "b")
        return stage(both.mapInArrow(_alike(share), "u long, v long"), "alike")

    links = verified(tried)
    roots = components(links)
    met = stage(met.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("lane", "fp", "rep", F.coalesce("root", "rep").alias("root")), "buckets")
    spread = stage(met.groupBy("lane", "fp").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")), "spread")
    # a bucket of two has been compared; where more are not all linked, pairs besides the heads' may be near
    split = member.join(spread, ["lane", "fp"]).groupBy("lane", "bucket").agg(F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("m > 2 and lo != hi").select("lane", "bucket")
    apart = member.join(split, ["lane", "bucket"]).select("lane", "fp").unionByName(spread.filter("m > 2 and lo != hi").select("lane", "fp")).distinct()
    left = stage(met.join(apart, ["lane", "fp"]).select(F.col("rep").alias("th")).distinct(), "left")
    posted = rare_lists(sets.join(left, "th", "left_semi"), share)
    total, turn, before = posted.count(), 0, None
    while True:
        now = stage(posted.join(roots.withColumnRenamed("node", "th"), "th", "left").withColumn("root", F.coalesce("root", "th")), "rooted")
        lists = mixed_lists(now)
        odd, pairs = lists.agg(F.sum("odd"), F.sum(F.col("odd").cast("double") * F.col("evens"))).first()
        if (pairs or 0) <= total or before and pairs > before * FALLS:
            break
        some = stage(head_pairs(now, lists, min(max(total // odd, 1), HEADS), turn, share).join(tried, ["a", "b"], "left_anti"), "compared")
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(verified(some)))
        tried, turn, before = tried.unionByName(some), turn + 1, pairs
    rest = stage(rare_pairs(now, lists, share).join(tried, ["a", "b"], "left_anti"), "compared")
    if not rest.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(verified(rest)))
    group = classes.select(*same, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("root"))
    each = slim.groupBy("th", *same).agg(F.count("*").alias("copies"))
    return each.join(group, same).select("th", "root", "copies")
