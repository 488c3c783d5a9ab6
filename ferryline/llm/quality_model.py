"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over all labelled rows. Each
covariance is shrunk towards the pooled diagonal; its Cholesky factor is kept,
and the Mahalanobis distances are sums of squares of a triangular solve,
written out as column expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.textstats import with_counts


def statistics() -> dict[str, Column]:
    """Transformed counts; all finite for every text."""
    rate = lambda a, b: F.log(F.lit(0.01) + F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "words": F.log1p(F.col("n_words")),
        "length": rate("word_chars", "n_words"),
        "symbols": rate("n_symbols", "word_chars"),
        "letters": rate("n_letters", "word_chars"),
        "upper": rate("n_upper", "n_letters"),
        "bangs": rate("n_bangs", "n_words"),
        "pipes": rate("n_pipes", "n_words"),
        "stops": rate("n_stops", "n_words"),
        "digits": rate("n_digits", "word_chars"),
        "lines": rate("n_dup_lines", "n_lines"),
        "repeats": rate("n_repeat_words", "n_words"),
        "distinct": rate("n_distinct", "n_words"),
    }


class Quality:
    """A trained discriminant: prior log odds, and (mean, inverse Cholesky factor, log determinant) of classes 0 and 1."""

    def __init__(self, odds: float, classes: list[tuple[np.ndarray, np.ndarray, float]]):
        self.odds, self.classes = odds, classes

    @classmethod
    def fit(cls, rows: DataFrame, label_col: str = "quality", text_col: str = "text", shrink: float = 0.1) -> Quality:
        """Learn from all labelled rows by one aggregation. Without rows of both classes all get the prior."""
        return cls.fit_counts(with_counts(rows, text_col, [label_col]), label_col, shrink)

    @classmethod
    def fit_counts(cls, counts: DataFrame, label_col: str = "quality", shrink: float = 0.1) -> Quality:
        """``fit``, from counts of ``with_counts`` and the label."""
        names = list(statistics())
        x = counts.filter(F.col(label_col).isin(0, 1)).select(F.col(label_col).alias("_y"), *[c.alias(k) for k, c in statistics().items()])
        sums = [F.count("*").alias("n"), *[F.sum(a).alias(a) for a in names]]
        sums += [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
        got = {r["_y"]: r for r in x.groupBy("_y").agg(*sums).collect()}
        n0, n1 = (got[k]["n"] if k in got else 0 for k in (0, 1))
        odds = math.log((n1 + 0.5) / (n0 + 0.5))
        if not n0 or not n1:
            return cls(odds, [])
        mean, cov = {}, {}
        for k, r in got.items():
            mean[k] = np.array([r[a] for a in names]) / r["n"]
            second = np.array([[r[f"{a}_{b}" if i >= j else f"{b}_{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)]) / r["n"]
            cov[k] = second - np.outer(mean[k], mean[k])
        pooled = np.diag(np.diag((n0 * cov[0] + n1 * cov[1]) / (n0 + n1)) + 1e-4)
        classes = []
        for k in (0, 1):
            low = np.linalg.cholesky((1 - shrink) * cov[k] + shrink * pooled)
            classes.append((mean[k], np.linalg.inv(low), 2 * float(np.log(np.diag(low)).sum())))
        return cls(odds, classes)

    def probability(self) -> Column:
        """P(label 1), from the columns of ``statistics``."""
        odds = F.lit(self.odds)
        x = [F.col(k) for k in statistics()]
        for sign, (mean, inverse, logdet) in zip((1, -1), self.classes):
            distance = F.lit(logdet)
            for i in range(len(x)):
                z = F.lit(float(-(inverse[i, : i + 1] @ mean[: i + 1])))
                for j in range(i + 1):
                    z = z + x[j] * float(inverse[i, j])
                distance = distance + F.pow(z, 2)
            odds = odds + distance * (sign * 0.5)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))

    def score(self, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """The columns ``keep`` and score (0 to 1) of every row, from its whole text alone.

        Null and empty texts have all counts 0 and are scored like any; repeated
        rows get equal scores; an empty table gives an empty result.
        """
        return self.score_counts(with_counts(docs, text_col, keep), keep)

    def score_counts(self, counts: DataFrame, keep: list[str]) -> DataFrame:
        """``score``, from counts of ``with_counts``."""
        rows = counts.select(*keep, *[c.alias(k) for k, c in statistics().items()])
        return rows.select(*keep, self.probability().alias("score"))
