"""Spelling variants: words one edit from another word that stands at least five times as often, by pivotal bigrams.

Bigrams stand in one global order, rare ones first. A word's prefix is its
three rarest bigrams (and those that tie with the last); two disjoint ones of
them are its pivots, chosen by dynamic programming for the fewest words that
hold them. One edit spoils one of two disjoint bigrams at most. So of two words
one edit apart, the one whose prefix ends first in the order has a pivot in the
prefix of the other: pivots are joined with prefixes.

Position limits: an untouched bigram has the edit on its right (then it has the
same place in both words, and the same letters before it) or on its left (the
same place from the end, and the same letters after it). Likewise the edit is in
one half of the word, and the other half is the same. So pivots meet prefixes by
bigram, place, length (one more, less or the same) and all letters that must
then agree, half the word at least; what meets is verified at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import stage
from ferryline.llm.url_filters import AZ, az

#: Fixed value of the contract: runs of letters, after A-Z are lower-cased. With its 90 letters there are 8,100 bigrams at most.
RUN = "[a-zÀ-ÿ]+"
MOST_GRAMS = 8100


def word_counts(docs: DataFrame, least: int = 5, shortest: int = 6, spoil: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the words of all texts with at least ``shortest`` letters that stand ``least`` times or more.

    Every ``spoil``-th pair of id and word, by crc32, loses a letter first. Null
    texts have no words, a null id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, AZ, az), F.lit(f"({RUN})"))).alias("run"))
    h, k = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (F.col("h") % k).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, k))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % spoil == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def pivots(grams: list[tuple[int, int]], q: int = 2, count: int = 2) -> list[int]:
    """``grams``: place and weight, by place. The places of ``count`` grams that don't overlap, of least total weight."""
    best = [[(0, ())] * (len(grams) + 1)] + [[None] * (len(grams) + 1) for _ in range(count)]
    for k in range(1, count + 1):
        for i, (place, weight) in enumerate(grams, 1):
            before = i - 1
            while before and grams[before - 1][0] > place - q:
                before -= 1
            took = best[k - 1][before]
            choices = [best[k][i - 1], took and (took[0] + weight, (*took[1], place))]
            best[k][i] = min((c for c in choices if c), default=None)
    return list(best[count][-1][1])


def _prefixes(rank: dict[str, int], weight: dict[str, int]):
    """(word) to a row for each bigram of its prefix: word, size, pivot, gram, place."""

    def run(batches):
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                grams = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))
                last = grams[min(2, len(grams) - 1)][0]
                prefix = [(i, g) for g, i in grams if g <= last]
                chosen = set(pivots(sorted((i, weight[word[i : i + 2]]) for i, _ in prefix)))
                rows += [(word, len(word), i in chosen, g, i) for i, g in prefix]
            kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "size", "pivot", "gram", "place"])

    return run


def _agreeing(size: Column) -> Column:
    """For a bigram of a word, and the other word's ``size``: structs of case, place and hash of the letters that agree, one for each place the edit may have."""
    word, place = F.col("word"), F.col("place")
    end = F.length(word) - place - 2
    half = F.floor(size / 2).cast("int")
    one = lambda case, at, *letters: F.struct(F.lit(case).alias("case"), at.cast("int").alias("at"), F.xxhash64(*letters).alias("letters"))
    right_half = one(0, place, F.left(word, F.greatest(half, place + 2)))
    right_of_it = F.when(place + 2 <= half, one(1, place, F.left(word, place + 2), F.right(word, size - half)))
    left_half = one(2, end, F.right(word, F.greatest(size - half, end + 2)))
    left_of_it = F.when(size - end - 2 >= half, one(3, end, F.right(word, end + 2), F.left(word, half)))
    return F.array_compact(F.array(right_half, right_of_it, left_half, left_of_it))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b), a before b, of different words of at least four letters that are one edit apart."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("g"))
    counts = {r.g: r.n for r in grams.groupBy("g").agg(F.count("*").alias("n")).limit(MOST_GRAMS + 1).collect()}
    if len(counts) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} bigrams: not words of {RUN}")
    rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    grams = stage(words.select("word").mapInArrow(_prefixes(rank, counts), "word string, size int, pivot boolean, gram int, place int"), "grams")
    on = ["gram", "size", "case", "at", "letters"]
    keys = grams.select("word", "gram", "size", F.inline(_agreeing(F.col("size"))))
    asked = grams.filter("pivot").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    asked = asked.select(F.col("word").alias("word_"), "gram", "size", F.inline(_agreeing(F.col("size"))))
    both = [asked[c] == keys[c] for c in on] + [F.levenshtein("word_", "word", 1) == 1]
    met = asked.join(keys, both)
    return met.select(F.least("word", "word_").alias("a"), F.greatest("word", "word_").alias("b")).distinct()


def spelling_variants(docs: DataFrame, least: int = 5, shortest: int = 6, times: int = 5, spoil: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (see ``word_counts``).

    n_near: how many other words are one edit away. form: the most frequent of
    them (of equals the first in code-point order), if it stands at least
    ``times`` times as often; root: where forms of forms lead; the word itself
    if it has none. Repeated rows count each time. No words, or an empty table,
    give an empty result. Other columns don't matter, whatever their names.
    """
    if shortest < 4:
        raise ValueError("two disjoint bigrams need four letters")
    words = stage(word_counts(docs, least, shortest, spoil, id_col, text_col), "words")
    pairs = stage(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    near = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("top"))
    found = words.join(best, "word", "left")
    above = -F.col("top.minus") >= F.col("n") * times
    found = stage(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(above, F.col("top.form")).alias("form"), F.when(above, -F.col("top.minus")).alias("form_n")), "forms")
    # each round doubles the way to the root; counts grow fivefold on each step, so ways are short
    ways = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = stage(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ways = nxt.select("word", "root")
        if nxt.filter("moved").isEmpty():
            break
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same by the strings that deletions of a letter leave; crc32 from its definition.
SPELLING_SQL = """
    WITH o AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
    u AS (SELECT doc_id, run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] ELSE [192 + unicode(c) // 64, 0, 0, 0, 0, 0, 0, 0, 128 + unicode(c) % 64, 0, 0, 0, 0, 0, 0, 0] END)) AS bits FROM o),
    h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda s, x: xor(xor(s, x) >> 1, 3988292384::BIGINT * (xor(s, x) & 1))), 4294967295::BIGINT) AS h FROM u),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
    v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (SELECT DISTINCT a.word AS word, b.word AS other FROM x a JOIN x b ON a.s = b.s AND a.word != b.word AND length(a.word) = length(b.word) AND a.i = b.i
          UNION SELECT x.word, v.word FROM x JOIN v ON x.s = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.s = v.word),
    b AS (SELECT p.word, count(*) AS n_near, arg_min(other, (-n, other)) AS top, max(n) AS top_n FROM p JOIN v ON v.word = other GROUP BY p.word),
    f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n FROM v LEFT JOIN b USING (word)),
    c AS (WITH RECURSIVE c AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN c USING (word)"""
