"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Two words are alike by the three-letter subsequences they share, gaps allowed
and paid for, so insults with letters put in or left out stay near the
original. The square of that tells near words from chance. A text and a landmark are alike by the sum over the text's different
words, taken as log(1 + sum). A text's map is its likeness to all landmarks,
whitened by the landmarks' own likenesses (Nyström), and a linear machine with
squared hinge loss is trained on it; margins of folds it hasn't seen choose its
cost and become probabilities by Platt's method.

Landmarks are words and beginnings of words that tell the labelled texts of
the two classes apart, from both classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import SPACES, stage

#: Letters that a subsequence of three may span, and its places after the first.
SPAN = 7
SHAPES = list(combinations(range(1, SPAN), 2))
DECAY, TABLE, POWER = 0.85, 1 << 20, 2
#: How much of a word's own size counts against it: less than 1, so that letters put in dilute a match less.
LOOSE = 0.85
#: Likeness of words up to this is taken as 0: that much comes about by chance.
FLOOR = 0.42
#: Words compared with the landmarks in one go, and words that a task remembers.
BLOCK, REMEMBERED = 512, 150_000
#: Texts mapped in one go.
TEXTS = 100
#: Partitions of the rows learned from.
PARTS = 24
#: Words with more letters are compared by the first ones of each half-overlapping part of this length.
LONGEST = 24
#: Letters of a word's beginning that can be a landmark.
PREFIX = range(4, 9)
#: Costs to choose from, and folds that choose.
COSTS, FOLDS = (0.03, 0.3, 3.0), 3
#: Signs that stand for letters.
LOOKS = str.maketrans("013457@$", "oieastas")
_NO_LETTER = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\w)(?:\w[\s.\-_*]{1,2}){3,24}\w(?!\w)")


def normal(word: str) -> str:
    """Lower-cased letters of a word, look-alike signs read as letters (unless it has no letters)."""
    low = word.strip(".,;:!?").lower()
    if not low.isalpha():
        low = _NO_LETTER.sub("", low.translate(LOOKS) if any(c.isalpha() for c in low) else low)
    return low


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, feature code and weight of each subsequence of all words."""
    text = "".join(words)
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    own = np.repeat(np.arange(len(words)), [len(w) for w in words])
    who, code, weight = [], [], []
    for i, j in SHAPES:
        n = len(c) - j
        if n <= 0:
            continue
        ok = own[:n] == own[j:]
        x = c[:n] * 0x9E3779B1 ^ c[i : i + n] * 0x85EBCA77 ^ c[j:] * 0xC2B2AE3D
        who.append(own[:n][ok])
        code.append(((x ^ x >> 15) & (TABLE - 1))[ok])
        weight.append(np.full(int(ok.sum()), DECAY ** (j + 1), np.float32))
    if not who:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
    who, code, weight = (np.concatenate(x) for x in (who, code, weight))
    return who, code, weight


class Kernel:
    """Likeness of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        m = len(landmarks)
        who, code, weight = features(landmarks)
        codes, row = np.unique(code, return_inverse=True)
        matrix = np.zeros((len(codes) + 1, m), np.float32)
        np.add.at(matrix, (row, who), weight)
        self.size = np.maximum(np.sqrt((matrix**2).sum(axis=0)), 1e-9)
        matrix /= self.size
        self.landmarks = m
        self.place = np.full(TABLE, len(codes), np.int32)
        self.place[codes] = np.arange(len(codes))
        row, self.column = np.nonzero(matrix)
        self.cell, self.start = matrix[row, self.column], np.searchsorted(row, np.arange(len(matrix) + 1))
        self.most = matrix.max(axis=1, initial=0)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are over FLOOR with a landmark, and their likeness to all."""
        none = np.zeros(0, int), np.zeros((0, self.landmarks), np.float32)
        who, code, weight = features(words)
        if not len(who):
            return none
        size = np.sqrt(np.maximum(np.bincount(who, weight**2, len(words)), 1e-12))
        at = self.place[code]
        near = np.flatnonzero(np.bincount(who, weight * self.most[at], len(words)) > FLOOR * LOOSE * size)
        chosen = np.zeros(len(words), bool)
        chosen[near] = True
        take = chosen[who] & (at < len(self.start) - 2)
        who, at, weight = np.searchsorted(near, who[take]), at[take], weight[take]
        # a subsequence stands in few landmarks: only their cells are added up
        n, m = self.start[at + 1] - self.start[at], self.landmarks
        row = np.repeat(np.arange(len(at)), n)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.start[at][row]
        value = np.bincount(who[row] * m + self.column[cell], self.cell[cell] * weight[row], len(near) * m).reshape(len(near), m)
        value = np.minimum(value / np.maximum(LOOSE * size[near, None], self.size), 1)
        some = np.flatnonzero(value.max(axis=1, initial=0) > FLOOR)
        value = value[some]
        return near[some], np.where(value > FLOOR, value, 0).astype(np.float32) ** POWER


class _Memory:
    """Words and the rows of their likenesses; row 0 is none. Emptied when full."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.clear()

    def clear(self) -> None:
        self.raw: dict[str, int] = {}
        self.normal: dict[str, int] = {}
        self.rows, self.used = np.zeros((256, self.kernel.landmarks), np.float32), 1

    def add(self, words: list[str]) -> None:
        """``words``: normalised, not known yet."""
        flat, owner = [], []
        for k, p in enumerate(words):
            for cut in range(0, max(len(p) - LONGEST // 2, 1), LONGEST // 2):
                flat.append(p[cut : cut + LONGEST])
                owner.append(k)
        self.normal.update(dict.fromkeys(words, 0))
        for lo in range(0, len(flat), BLOCK):
            hit, value = self.kernel(flat[lo : lo + BLOCK])
            for k, v in zip(hit.tolist(), value):
                word = words[owner[lo + k]]
                n = self.normal[word]
                if n:  # another part of the same word
                    self.rows[n] = np.maximum(self.rows[n], v)
                    continue
                if self.used == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[self.used] = v
                self.normal[word] = self.used
                self.used += 1

    def map(self, texts: list[str]) -> np.ndarray:
        """log(1 + sum of the likenesses of a text's different words), for each text."""
        if len(self.raw) > REMEMBERED or self.used > REMEMBERED // 4:
            self.clear()
        sets = [{*t.split(), *(_NO_LETTER.sub("", x) for x in _SPELLED.findall(t))} for t in texts]
        new = list(set().union(*sets).difference(self.raw))
        for lo in range(0, len(new), REMEMBERED):
            part = new[lo : lo + REMEMBERED]
            low = [normal(w) for w in part]
            self.add(list({w for w in low if w not in self.normal}))
            self.raw.update(zip(part, map(self.normal.__getitem__, low)))
        z = np.zeros((len(texts), self.kernel.landmarks), np.float32)
        for k, words in enumerate(sets):
            rows = {*map(self.raw.__getitem__, words)}  # a word in two spellings counts once
            rows.discard(0)
            if rows:
                z[k] = self.rows[list(rows)].sum(axis=0)
        return np.log1p(z)


def _mapped(landmarks: list[str], then, name: str):
    """Batches of (..., text) to the other columns and what ``then`` makes of the texts' maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(Kernel(landmarks))
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                z = memory.map([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], then(z)], [*part.schema.names[:-1], name])

    return run


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Weights and offset (last) of a squared-hinge machine by Newton steps."""
    sign = np.where(y > 0, 1.0, -1.0)
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag(np.append(np.ones(x.shape[1]), 1e-6))
    w = np.zeros(a.shape[1])
    for _ in range(30):
        act = sign * (a @ w) < 1
        b = a[act] * weight[act, None]
        new = np.linalg.solve(ridge + 2 * cost * b.T @ a[act], 2 * cost * b.T @ sign[act])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def _platt(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins probabilities."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * f + ab[1], -30, 30)))
        d, r = (p - goal) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        g = np.array([(d * f).sum(), d.sum()])
        h = np.array([[(r * f * f).sum(), (r * f).sum()], [(r * f).sum(), r.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        ab = ab - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return max(float(ab[0]), 1e-3), float(ab[1])


def _trained(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The machine, with the cost of least loss on held-out folds, and the slope and offset of its probabilities there."""
    best = None
    for cost in COSTS:
        f = np.zeros(len(y))
        for k in range(FOLDS):
            some = fold != k
            if len(set(y[some])) < 2:
                some = np.ones(len(y), bool)
            w = _machine(x[some], y[some], weight[some], cost)
            f[fold == k] = x[fold == k] @ w[:-1] + w[-1]
        slope, shift = _platt(f, y, weight)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * f + shift, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(weight * np.where(y > 0, np.log(p), np.log(1 - p))).sum()
        if best is None or loss < best[0] - 1e-9:
            best = loss, cost, slope, shift
    return _machine(x, y, weight, best[1]), best[2], best[3]


def _unlike(rows: list, most: int) -> list[str]:
    """The first words of rows (w, n) by their order, without those that begin another chosen one, or continue it, at nearly the same count."""
    chosen: dict[str, int] = {}
    for r in rows:
        kin = [r.w[:k] for k in range(3, len(r.w))]
        near = any(k in chosen and chosen[k] <= 1.2 * r.n for k in kin) or any(c.startswith(r.w) and n >= 0.8 * r.n for c, n in chosen.items())
        if not near:
            chosen[r.w] = r.n
        if len(chosen) == most:
            break
    return list(chosen)


class Toxicity:
    """A trained scorer."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, offset: float, slope: float, shift: float):
        self.landmarks, self.weights, self.offset, self.slope, self.shift = landmarks, weights, offset, slope, shift

    @classmethod
    def fit(cls, rows: DataFrame, labels: DataFrame | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", landmarks: int = 192, fit_rows: int = 4000) -> Toxicity:
        """Learn from the texts of ``rows`` that ``labels`` (by default ``rows`` itself) marks 0 or 1.

        At most ``fit_rows`` ids of each class are learned from, in the order of
        their hashes; each class counts as much as it has rows. They are chosen
        before any text is read; of an id's repeated labels the largest counts,
        of its texts the smallest. Null ids and null labels are left out.
        Without rows of both classes every text gets the share of toxic rows
        (0.5 without rows). A quarter of the ``landmarks`` at most come from
        the texts marked 0.
        """
        y = F.col(label_col).cast("int")
        marked = (rows if labels is None else labels).filter(y.isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(y).alias("y"))
        texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        known = stage(marked.join(texts.select("id"), "id", "left_semi").withColumn("k", F.xxhash64("id")), "labelled")
        count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        part = lambda v: known.filter((F.col("y") == v) & (F.col("k") / 2.0**64 + 0.5 <= (1.5 * fit_rows + 1000) / count.get(v, 1))).orderBy("k", "id").limit(fit_rows)
        chosen = stage(part(1).unionByName(part(0)), "chosen")  # 2 * fit_rows rows at most
        sample = stage(texts.join(F.broadcast(chosen), "id").groupBy("id", "k", "y").agg(F.min("t").alias("t")).repartition(PARTS, "k"), "sample")
        found = {x.y: x.n for x in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n1, n0 = found.get(1, 0), found.get(0, 0)
        if not n1 or not n0:
            share = 0.5 if not n1 + n0 else (n1 + 0.5) / (n1 + n0 + 1)
            return cls([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
        words = sample.select("y", F.explode(F.array_distinct(F.split(F.lower("t"), SPACES))).alias("w"))
        words = words.withColumn("w", F.regexp_replace("w", r"[^\p{L}]+", "")).filter(F.length("w").between(3, LONGEST))
        words = words.groupBy("w").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
        starts = F.filter(F.array(F.col("w"), *[F.left("w", F.lit(k)) for k in PREFIX]), lambda x: F.length(x) >= 3)
        counts = stage(words.select("n1", "n0", F.explode(F.array_distinct(starts)).alias("w")).groupBy("w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter("n1 + n0 > 2"), "beginnings")
        marks: list[str] = []
        for mine, other, n, m, most in (("n1", "n0", n1, n0, landmarks - landmarks // 4), ("n0", "n1", n0, n1, landmarks // 4)):
            here, there = (F.col(mine) + 0.5) / (n + 1), (F.col(other) + 0.5) / (m + 1)
            gain = F.sqrt(F.col(mine)) * F.log(here / there)  # telling, and seldom by chance
            best = counts.filter((F.col(mine) > 2) & (here >= 2 * there)).select("w", F.col(mine).alias("n"), gain.alias("g")).orderBy(F.desc("g"), F.desc(F.length("w")), "w").limit(20 * most).collect()
            marks += [w for w in _unlike(best, most) if w not in marks]
        if not marks:
            return cls([], np.zeros(0), 0.0, 1.0, float(np.log(n1 / n0)))
        asis = _mapped(marks, lambda z: pa.array([v.tobytes() for v in z], pa.binary()), "z")
        got = sample.select("y", "k", "t").mapInArrow(asis, "y int, k long, z binary").collect()  # 2 * fit_rows short rows at most
        z = np.array([np.frombuffer(x.z, np.float32) for x in got], float)
        y = np.array([x.y for x in got])
        near, value = Kernel(marks)(marks)
        gram = np.zeros((len(marks), len(marks)))
        gram[near] = np.log1p(value)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
        weight = np.where(y > 0, count[1] / n1, count[0] / n0) * len(y) / (count[1] + count[0])
        w, slope, shift = _trained(z @ root, y, weight, np.array([x.k % FOLDS for x in got]))
        return cls(marks, root @ w[:-1], float(w[-1]), slope, shift)

    def score(self, docs: DataFrame, *keep: str | Column, text_col: str = "text") -> DataFrame:
        """The columns ``keep`` and score (0 to 1) of every row, from its whole text alone.

        Null and empty texts get the score of a text without any known word;
        repeated rows equal scores; an empty table gives an empty result.
        Columns that aren't kept don't matter, whatever their names.
        """
        rows = docs.select(*keep, F.col(text_col).alias("_text"))
        kinds = rows.drop("_text").schema
        w, offset, slope, shift = self.weights, self.offset, self.slope, self.shift

        def probability(z):
            f = z.astype(float) @ w + offset if len(w) else np.zeros(len(z))
            return pa.array(1 / (1 + np.exp(-np.clip(slope * f + shift, -30, 30))))

        return rows.mapInArrow(_mapped(self.landmarks or ["xxx"], probability, "score"), kinds.add("score", "double"))
