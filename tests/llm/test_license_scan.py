"""License scans against a brute-force version that compares every block with every template."""

import random

from ferryline.llm import license_scan as L
from ferryline.llm.license_scan import license_scan


def brute(text, share=0.8):
    words = [w.decode() for w in L.words_in(text)]
    places, base = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    more, best = set(), 0.0
    for label, text_, must in L.TEMPLATES:
        t = [w.decode() for w in L.words_in(text_)]
        own, m = set(t) | {w.decode() for w in L.words_in(must)}, 4
        while m < len(t):
            m *= 2
        for lo in range(0, max(1, len(words)), m):
            block = set(words[lo : lo + 2 * m])
            if len(own & block) >= share * len(set(t)) - 1e-9 and set(must.split()) <= block:
                more.add(label)
                best = max(best, len(own & block) / len(own))
    row = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)))
    return (*row, 1.0 if base else best)


def texts():
    rng, out = random.Random(9), ["", None, "...", "MIT", "Under the MIT License. under the mit-license", "cc by nc 4.0", "x" * 5000 + " all rights reserved", "é under the mit license ñ"]
    pool = sorted({w.decode() for _, t, _ in L.TEMPLATES for w in L.words_in(t)}) + [f"w{i}" for i in range(60)]
    for _, text, _ in L.TEMPLATES:
        for drop in range(4):
            words = text.split()
            for _ in range(min(drop, len(words) - 1)):
                words[rng.randrange(len(words))] = rng.choice(["never", ""])
            out.append(" ".join([*rng.choices(pool, k=rng.randrange(40)), *words, *rng.choices(pool, k=rng.randrange(40))]))
    return out + [" ".join(rng.choices(pool, k=rng.choice([5, 50, 500]))) for _ in range(150)] + ["Licensed under the Apache License, Version 2.0.\n" * 4000]


def test_labels_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in license_scan(df).collect()}
    want = {i: brute(t) for i, t in enumerate(rows)}
    assert {i: r[:-1] for i, r in got.items()} == {i: r[:-1] for i, r in want.items()}
    assert all(abs(got[i][-1] - want[i][-1]) < 1e-12 for i in want)
    assert sum(bool(r[5]) for r in want.values()) > 40


def test_like_notices_are_told_apart(spark):
    rows = [("GNU General Public License, version 3, licensed under the", "gpl-3"), ("Licensed under CC BY-SA 4.0", "cc-by-sa"), ("Released under the BSD License", ""), ("the work is licensed under the\nGNU General Public License version 2", "gpl-2")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    assert [r.labels for r in license_scan(df).orderBy("doc_id").collect()] == [w for _, w in rows]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "under the mit license", 1), (None, "under the mit license", 2), ("a", None, 3), ("a", "all rights reserved", 4)], "id string, body string, n_words int")
    df = df.withColumnsRenamed({"id": "rid", "body": "tokens"})
    got = sorted((r.rid or "", r.labels, r.n_base, r.first_word) for r in license_scan(df, id_col="rid", text_col="tokens").collect())
    assert got == [("", "mit", 1, 0), ("", "mit", 1, 0), ("a", "", 0, None), ("a", "reserved", 0, None)]
    assert license_scan(df.limit(0), id_col="rid", text_col="tokens").count() == 0
    assert {r.labels for r in license_scan(df, [], id_col="rid", text_col="tokens").collect()} == {"mit", ""}
