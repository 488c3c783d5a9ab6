"""License scans: which texts hold a license notice, by an exact set-similarity join.

A text block is a window of 2m words, one every m words, for each size class m
(powers of two) that templates fall in: a passage of up to m words lies whole
in some block. A block meets a template when it holds at least ``share`` of the
template's different words. The join that finds all such pairs:

* words stand in one global order, by their number in the corpus, rare ones first;
* a template's prefix is as long as what it may miss, plus one word; a block's
  prefix is as long as what it may have besides the least that a template of
  its class asks for, plus one: a pair that meets the threshold shares a word
  of both prefixes;
* at that word, what is left of both must suffice for the rest (positions), and
  blocks with too few template words are no candidates at all (lengths);
* what is left is verified on the whole sets, and on the words that tell a
  template from others (the version of a license, say).

Words that no template has come first in the order and match nothing, so blocks
carry the others alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import stage

#: Fixed values of the contract: phrase, label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Label, a notice as licenses are usually named or granted, and the words that tell it from like notices.
TEMPLATES = [
    ("mit", "released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ""),
    ("apache-2", "licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org", "apache"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("gpl-3", "licensed under the GNU General Public License, version 3", "gnu 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2", "gnu 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "gnu lesser"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "commons attribution"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", "cc0"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("reserved", "all rights reserved", ""),
]
#: A-Z lower-cased, what separates words becomes a space.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


def _class(words: int) -> int:
    return 1 << max(2, (words - 1).bit_length())


def template_rows(templates: list[tuple[str, str, str]], share: float) -> list[tuple]:
    """label, template number, size class, least overlap, different words, and those that must be there, of each template; templates without words have none."""
    split = [(label, words_in(text), sorted({w.decode() for w in words_in(must)})) for label, text, must in templates]
    return [(label, k, _class(len(w)), math.ceil(len(set(w)) * share - 1e-9), sorted({x.decode() for x in w} | set(must)), must) for k, (label, w, must) in enumerate(split) if w]


def _hits(vocabulary: list[str], phrases: list[list[str]]):
    """(text, ...) to n_words, places and numbers of vocabulary words, and first places and number of each phrase's; other columns pass."""
    number = {w.encode(): i for i, w in enumerate(vocabulary)}
    wanted = [[number[w.encode()] for w in p] for p in phrases]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):  # a few texts at a time
                batch = whole.slice(lo, 64)
                rows = []
                for text in batch.column(0):
                    words = words_in(text.as_py())
                    ids = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                    found = []
                    for p in wanted:
                        on = np.ones(max(0, len(ids) - len(p) + 1), bool)
                        for j, w in enumerate(p):
                            on &= ids[j : len(ids) - len(p) + 1 + j] == w
                        found.append(np.flatnonzero(on))
                    at = np.flatnonzero(ids >= 0)
                    every = np.concatenate(found) if found else at[:0]
                    rows.append((len(words), len(every), *((int(every.min()), int(every.max())) if len(every) else (None, None)), [k for k, f in enumerate(found) if len(f)], at.astype(np.int32), ids[at]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], "n_words", "n_base", "first_word", "last_word", "phrases", "places", "tokens"])

    return run


def _blocks(rank: np.ndarray, least: dict[int, int]):
    """(rid, places, tokens) to the blocks that hold enough template words: rid, m, block, and the words' ranks in ascending order."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                for rid, places, tokens in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    place, token = places.values.to_numpy().astype(np.int64), rank[tokens.values.to_numpy()]
                    for m, few in least.items():
                        k = place // m
                        # a word stands in the block that begins with its m words, and in the one before
                        block, own = np.concatenate([k, k[k > 0] - 1]), np.concatenate([token, token[k > 0]])
                        pair = np.unique((block << 32) | own)
                        block, own = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32)
                        cut = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(block) else np.zeros(1, np.int64)
                        size = np.diff(cut)
                        keep = np.flatnonzero(size >= few)
                        if len(keep):
                            lists = pa.array([own[cut[j] : cut[j + 1]] for j in keep], pa.list_(pa.int32()))
                            cols = [pa.array(np.full(len(keep), rid, np.int64)), pa.array(np.full(len(keep), m, np.int32)), pa.array(block[cut[keep]]), lists]
                            yield pa.RecordBatch.from_arrays(cols, ["rid", "m", "block", "words"])

    return run


def license_scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License labels of every row.

    Returns id_col, n_words, n_base (places of ``phrases``), first_word and
    last_word (smallest and largest of them), base_labels, labels (the
    templates' too) and score: the largest share of a template that a block
    holds, from ``share`` up; 1 with a phrase; 0 without either. Labels are
    sorted and joined by commas. Null texts are empty: no words, no labels.
    Repeated rows get equal rows, null ids are ids like any. Other columns don't
    pass, whatever their names. An empty table gives an empty result, no
    template no further labels. ``templates`` and ``phrases`` are parameters
    (label, text, words that must be there; and phrase, label), small enough for the driver.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    rows = template_rows(TEMPLATES if templates is None else templates, share)
    split = [[w.decode() for w in words_in(p)] for p, _ in phrases]
    vocabulary = sorted({w for r in rows for w in r[4]} | {w for p in split for w in p})
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"rid long, id {kind}, n_words long, n_base long, first_word long, last_word long, phrases array<int>, places array<int>, tokens array<int>"
    # the row's number is written with the rest, so it stays what it is
    seen = docs.select(F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"))
    seen = stage(seen.mapInArrow(_hits(vocabulary, split), shape), "licenses")
    # one row for each template word
    counts = {r.t: r.n for r in seen.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(len(vocabulary)), key=lambda i: (counts.get(i, 0), vocabulary[i]))
    rank = np.zeros(max(1, len(vocabulary)), np.int64)
    rank[order] = np.arange(len(order))
    at = {w: int(rank[i]) for i, w in enumerate(vocabulary)}
    posted, least = [], {}
    for label, k, m, alpha, words, must in rows:
        own = sorted(at[w] for w in words)
        least[m] = min(least.get(m, alpha), alpha)
        posted += [(label, k, m, alpha, own, [at[w] for w in must], word, len(own) - i) for i, word in enumerate(own[: len(own) - alpha + 1])]
    posting = spark.createDataFrame(posted, "label string, template int, m int, alpha int, whole array<int>, must array<int>, word int, t_rest int")
    blocks = seen.select("rid", "places", "tokens").mapInArrow(_blocks(rank, least), "rid long, m int, block long, words array<int>")
    fewest = F.coalesce(*[F.when(F.col("m") == m, F.lit(a)) for m, a in least.items()], F.lit(1))
    first = blocks.withColumn("n", F.size("words")).select("*", F.posexplode(F.slice("words", F.lit(1), F.col("n") - fewest + 1)).alias("i", "word"))
    # one row for each prefix word of a template: a parameter's size, not the data's
    met = first.join(F.broadcast(posting), ["m", "word"]).filter(F.least(F.col("n") - F.col("i"), F.col("t_rest")) >= F.col("alpha"))
    both = F.size(F.array_intersect("words", "whole"))
    hits = met.filter((both >= F.col("alpha")) & (F.size(F.array_except("must", "words")) == 0)).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max(both / F.size("whole")).alias("best"))  # as many labels as templates have
    names = F.array(*[F.lit(label) for _, label in phrases]).cast("array<string>")
    base = F.array_sort(F.array_distinct(F.transform("phrases", lambda k: F.get(names, k))))
    own = seen.select("rid", "id", "n_words", "n_base", "first_word", "last_word", base.alias("base")).join(hits, "rid", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return own.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def license_sql(share: float = 0.8) -> str:
    """The same by comparing every block with every template."""
    rows = template_rows(TEMPLATES, share)
    texts = ", ".join(f"({k}, '{label}', {m}, {alpha}, {len(words)}, {len(must)}, {w in must}, '{w}')" for label, k, m, alpha, words, must in rows for w in words)
    phrases = ", ".join(f"('{label}', {[w.decode() for w in words_in(p)]})" for p, label in PHRASES)
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        t AS (SELECT * FROM (VALUES {texts}) AS v(template, label, m, alpha, size, n_must, must, word)),
        p AS (SELECT * FROM (VALUES {phrases}) AS v(label, ph)),
        w AS (SELECT doc_id, ws, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
        b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM w JOIN p ON word = ph[1] AND ws[i + 1:i + len(ph)] = ph GROUP BY doc_id),
        h AS (SELECT doc_id, i, t.* FROM (SELECT doc_id, word, i FROM w) JOIN t USING (word)),
        k AS (SELECT doc_id, template, label, alpha, size, n_must, must, word, i // m AS block FROM h UNION ALL SELECT doc_id, template, label, alpha, size, n_must, must, word, i // m - 1 FROM h WHERE i >= m),
        c AS (SELECT doc_id, label, count(DISTINCT word) / any_value(size) AS share FROM k GROUP BY doc_id, template, label, block HAVING count(DISTINCT word) >= any_value(alpha) AND count(DISTINCT word) FILTER (must) = any_value(n_must)),
        m AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS best FROM c GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""
