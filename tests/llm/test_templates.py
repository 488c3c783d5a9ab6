"""Template search against brute force, and what is found of short items by their length."""

import random

from ferryline.llm import decontaminate as D
from ferryline.llm.decontaminate import canonical, contaminated


def template(text):
    """(kind, token, value) of a text's tokens, read word by word."""
    out, start = [], True
    for word in (text or "").split():
        for kind, token, value in canonical(word, start):
            if kind == D._MAYBE:
                kind, token = (D._UNIT, D.UNIT) if out and out[-1][0] == D._NUM else (D._LITERAL, token)
            if out and kind == out[-1][0] and kind in (D._NUM, D._NAME):
                out[-1] = (kind, token, f"{out[-1][2]} {value}")
            else:
                out.append((kind, token, value))
        start = word[-1] in ".!?:|"
    return out


def brute(docs, items):
    found = set()
    for i, text in items:
        t = template(text)
        n = len(t)
        literal = lambda w: sum(x[0] == D._LITERAL for x in w)
        spans = [(p, 8) for p in range(n - 7) if literal(t[p : p + 8]) >= 4] + [(p, 5) for p in range(n - 4) if n < 20 and literal(t[p : p + 5]) >= 3]
        whole = not spans
        spans = spans or [(0, n)]
        for d, doc in docs:
            u, windows = template(doc), []
            for p, size in spans:
                for at in range(len(u) - size + 1):
                    a, b = t[p : p + size], u[at : at + size]
                    if [x[1] for x in a] == [x[1] for x in b] and (not whole or literal(a) >= 4 or [x[2] for x in a] == [x[2] for x in b]):
                        windows.append((at, p, size, [((x[1], x[2]), y[2], x[2] != y[2]) for x, y in zip(a, b) if x[1].startswith("\x01")]))
            wide = [w for w in windows if w[2] != 5 or n <= 5]
            cover = D.best_cover(wide, n)[0] if wide else 0
            every = D.best_cover(windows, n)[0] if windows else 0
            if n and (cover >= 13 or cover >= 0.6 * n - 1e-9 or every >= 0.8 * n - 1e-9):
                found.add((d, i))
    return found


def sentence(rng, n):
    words = [rng.choice("stone cloud paper river window garden slow brown heron waits beside wide old silver evening tide turns home".split()) + rng.choice(["", "s", "er"]) for _ in range(n)]
    for k in range(2, n, 6):
        words[k] = rng.choice([str(rng.randrange(2, 900)), "Paris", "Oslo", "seven"])
    return " ".join(words)


def changed(rng, text, edits):
    words = text.split()
    now = {w: str(rng.randrange(2, 900)) if w.isdigit() else {"Paris": "Rome", "Oslo": "Kyiv"}.get(w, w) for w in words}  # one counterpart each
    words = [now[w] for w in words]
    for _ in range(edits if len(words) > edits else 0):
        k = rng.randrange(len(words) // 3, max(2 * len(words) // 3, len(words) // 3 + 1))
        words[k : k + 1] = rng.choice([[], ["another"], [words[k], "very"]])
    return " ".join(words)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, n)) for i, n in enumerate([1, 3, 5, 6, 8, 9, 11, 13, 15, 19, 20, 24, 40] * 2)] + [(90, "12 13 14"), (91, ""), (92, None)]
    docs = []
    for k in range(60):
        own = [changed(rng, rng.choice(items)[1] or "", rng.randrange(3)) for _ in range(2)]
        docs.append((k, f"{sentence(rng, 20)} {own[0]} {sentence(rng, 9)} {own[1]}"))
    got = {(r.doc_id, r.item_id) for r in contaminated(*frames(spark, docs, items)).collect()}
    assert got == brute(docs, items) and len(got) > 40


def test_short_items_with_an_edit_in_the_middle(spark):
    """Found by length: with one edit from 13 tokens on, unedited always; clean documents never."""
    rng, rows = random.Random(5), []
    for n in (6, 8, 10, 11, 12, 13, 14, 15, 16, 18, 20, 25):
        for _ in range(12):
            rows.append((n, sentence(rng, n)))
    items = [(i, text) for i, (_, text) in enumerate(rows)]
    filler = lambda: " ".join(f"{rng.choice(['grey', 'tall', 'deep'])}{rng.randrange(99)}" for _ in range(25))
    docs = [(i, f"{filler()} {changed(rng, text, 1)} {filler()}") for i, (_, text) in enumerate(rows)]
    docs += [(1000 + i, f"{filler()} {changed(rng, text, 0)} {filler()}") for i, (_, text) in enumerate(rows)]
    docs += [(5000 + i, filler() + filler()) for i in range(30)]
    got = {(r.doc_id, r.item_id) for r in contaminated(*frames(spark, docs, items)).collect()}
    rate = {n: sum((i, i) in got for i, (m, _) in enumerate(rows) if m == n) / 12 for n in {m for m, _ in rows}}
    assert all(r >= 0.9 for n, r in rate.items() if n >= 13), rate
    assert sum((1000 + i, i) in got for i in range(len(rows))) >= 0.95 * len(rows)
    assert not [d for d, _ in got if d >= 5000]
