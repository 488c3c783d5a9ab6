"""Quality rules by weak supervision: rules vote good, bad or abstain; expectation-maximisation
estimates how far each rule is to be trusted; the posterior probability decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import stage
from ferryline.llm.textstats import with_counts


def _rate(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: name: (measure, (good from, good to), (bad below, bad above)); between them a rule abstains.
RULES = {
    "symbols": (lambda: _rate("n_symbols", "word_chars"), (0.0, 0.01), (-1.0, 0.04)),
    "word_length": (lambda: _rate("word_chars", "n_words"), (2.5, 9.0), (1.8, 13.0)),
    "upper": (lambda: _rate("n_upper", "n_letters"), (0.0, 0.12), (-1.0, 0.4)),
    "bangs": (lambda: _rate("n_bangs", "n_words"), (0.0, 0.05), (-1.0, 0.3)),
    "pipes": (lambda: _rate("n_pipes", "n_words"), (0.0, 0.02), (-1.0, 0.15)),
    "dup_lines": (lambda: _rate("n_dup_lines", "n_lines"), (0.0, 0.1), (-1.0, 0.3)),
    "repeats": (lambda: _rate("n_repeat_words", "n_words"), (0.0, 0.05), (-1.0, 0.2)),
    "letters": (lambda: _rate("n_letters", "word_chars"), (0.88, 1.0), (0.8, 1.1)),
    "digits": (lambda: _rate("n_digits", "word_chars"), (0.0, 0.08), (-1.0, 0.3)),
}


def votes() -> list[Column]:
    """1 good, 0 bad, null abstains."""
    out = []
    for name, (measure, good, bad) in RULES.items():
        m = measure()
        out.append(F.when((m < bad[0]) | (m > bad[1]), 0).when((m >= good[0]) & (m <= good[1]), 1).alias(f"v_{name}"))
    return out


def _posterior(prior: float, accuracy: dict[str, tuple[float, float]]) -> Column:
    """P(good | votes); accuracy: P(votes good | good), P(votes bad | bad), given that the rule votes."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (a, b) in accuracy.items():
        v = F.col(f"v_{name}")
        odds = odds + F.when(v == 1, math.log(a / (1 - b))).when(v == 0, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


#: What is believed at the start: share of good texts; of votes on good texts the good ones, of votes on bad texts the bad ones.
START = (0.85, 0.98, 0.5)


def estimate(patterns: DataFrame, belief: float = 0.02, tolerance: float = 1e-4) -> tuple[float, dict[str, tuple[float, float]]]:
    """``patterns``: votes and their count n (at most 3 ** rules rows). Prior and accuracies by expectation-maximisation.

    Rounds go on until no estimate moves by over ``tolerance``. Each estimate is
    that of the votes and of the start, which counts like the share ``belief``
    of all rows: enough to keep the two classes from changing places, too
    little to hold an estimate anywhere. So a rule that hardly votes stays near
    its start, and results are alike at every size.
    """
    prior, good, bad = START
    accuracy = {k: (good, bad) for k in RULES}
    held = lambda x: min(1 - 1e-6, max(1e-6, x))  # noqa: E731  odds stay finite
    while True:
        w, n = F.col("p") * F.col("n"), F.col("n")
        sums = [F.sum(w).alias("good"), F.sum(n).alias("all")]
        for k in RULES:
            v = F.col(f"v_{k}")
            sums += [F.sum(F.when(v == 1, w)).alias(f"gg_{k}"), F.sum(F.when(v.isNotNull(), w)).alias(f"g_{k}"), F.sum(F.when(v == 0, n - w)).alias(f"bb_{k}"), F.sum(F.when(v.isNotNull(), n - w)).alias(f"b_{k}")]
        s = patterns.withColumn("p", _posterior(prior, accuracy)).agg(*sums).first()
        if not s["all"]:
            return prior, accuracy
        more = 1 + belief * s["all"]
        share = lambda part, whole, start: held(((s[part] or 0) + start * more) / ((s[whole] or 0) + more))  # noqa: B023, E731
        last = [prior, *(x for ab in accuracy.values() for x in ab)]
        prior = share("good", "all", START[0])
        accuracy = {k: (share(f"gg_{k}", f"g_{k}", good), share(f"bb_{k}", f"b_{k}", bad)) for k in RULES}
        if max(abs(x - y) for x, y in zip(last, [prior, *(x for ab in accuracy.values() for x in ab)])) <= tolerance:
            return prior, accuracy


def quality_rules(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, votes and verdict of every row.

    Returns id_col, the base counts, base_failed, p_good and kept. Texts with
    fewer than ten words (null and empty ones too), or with over a fifth of
    their words in repeated five-word windows, fail the base rules and are not
    kept; all others are kept if p_good >= ``threshold``. Repeated rows get
    equal verdicts. Other columns don't pass, whatever their names; an empty
    table gives an empty result.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = with_counts(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", ["_id"])
    rows = stage(rows.select("_id", *base, failed.alias("base_failed"), *votes()), "votes")
    names = [f"v_{k}" for k in RULES]
    prior, accuracy = estimate(stage(rows.groupBy(*names).agg(F.count("*").alias("n")), "patterns"))
    p = _posterior(prior, accuracy)
    return rows.select(F.col("_id").alias(id_col), *base, "base_failed", p.alias("p_good"), (~F.col("base_failed") & (p >= threshold)).alias("kept"))
