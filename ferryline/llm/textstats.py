"""Counts of a text as columns, all by built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import SPACES, WORD

SYMBOLS = "#*$%&|<>"


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and, for each row, counts of its whole text.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct,
    n_upper, n_digits, n_bangs, n_pipes, n_stops, n_letters. Null and empty texts: all 0.
    Windows of five words are compared by 64-bit hashes within a text.
    """
    keep = keep or []
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*keep, t.alias("_t"))
    out = out.withColumn("_w", F.array_remove(F.split("_t", SPACES), ""))
    out = out.withColumns({"n_words": F.size("_w").cast("long"), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))})
    # a window is the array's elements i to i + 4; only texts that repeat one need their places sorted
    out = out.withColumn("_h", F.expr("case when n_words < 5 then array() else transform(sequence(0, cast(n_words as int) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4])) end"))
    out = out.withColumn("_s", F.expr("case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (h, i) -> struct(h, i))) else array() end"))
    out = out.withColumn("_d", F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 and x.h = _s[k - 1].h) or (k + 1 < size(_s) and x.h = _s[k + 1].h)), x -> x.i))"))
    # what is neither a letter nor white space is little of most texts, and counted apart
    out = out.withColumns({"word_chars": F.length(F.array_join("_w", "")), "_r": F.regexp_replace("_t", r"[\p{L}\x20\x09-\x0D]+", "")})
    fewer = lambda chars: F.length("_r") - F.length(F.translate("_r", chars, ""))
    counts = {
        "word_chars": F.col("word_chars"),
        "n_symbols": fewer(SYMBOLS),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.expr("aggregate(transform(_d, (p, k) -> case when k + 1 < size(_d) then least(5, _d[k + 1] - p) else 5 end), 0, (a, x) -> a + x)"),
        "n_distinct": F.size(F.array_distinct("_w")),
        "n_upper": F.length(F.regexp_replace("_t", r"\P{Lu}+", "")),
        "n_letters": F.col("word_chars") - F.length("_r"),
        "n_digits": fewer("0123456789"),
        "n_bangs": fewer("!"),
        "n_pipes": fewer("|"),
        "n_stops": fewer(".,;:?"),
    }
    return out.select(*keep, "n_words", *[c.cast("long").alias(k) for k, c in counts.items()])
