"""URL filters: fixed host and path rules, then association rules mined from labelled URLs.

URLs are sets of tokens (host labels, path words, query keys). FP-growth finds
the token combinations of up to ``RULE_TOKENS`` that labelled URLs share; they
are counted again exactly, and stay if enough URLs bear them out and the label
rate is beyond chance. A page's tokens look the rules up in an inverted index
of the rules' rarest tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import met_by_count, stage

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens of a rule at most. A longer URL is mined in sets of RULE_TOKENS blocks of BLOCK tokens, all of them, so that no combination is lost.
RULE_TOKENS, BLOCK = 3, 4


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), AZ, az)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct typed tokens: host labels, path words, query keys."""
    typed = lambda kind, words: F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    host = F.reverse(F.split(host_of(url), r"\."))
    return F.array_distinct(F.concat(typed("h:", host), typed("p:", F.split(path_of(url), "[/._-]+")), typed("q:", keys)))


def token_groups(tokens: Column) -> Column:
    """Sets of tokens that hold every combination of ``RULE_TOKENS`` of them: of a few tokens one set, of more all sets of RULE_TOKENS blocks."""
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(tokens) / BLOCK).cast("int") - 1), lambda i: F.slice(tokens, i * BLOCK + 1, BLOCK))
    places = F.sequence(F.lit(0), F.size(cut) - 1)
    after = lambda i: F.filter(places, lambda j: j > i)
    sets = F.transform(places, lambda i: F.transform(after(i), lambda j: F.transform(after(j), lambda k: F.concat(F.get(cut, i), F.get(cut, j), F.get(cut, k)))))
    return F.when(F.size(tokens) <= RULE_TOKENS * BLOCK, F.array(tokens)).otherwise(F.flatten(F.flatten(sets)))


def mine_rules(labelled: DataFrame, least: int = 25, confidence: float = 0.6, chance: float = 0.01) -> DataFrame:
    """``labelled``: tokens, bad (boolean). Rules: rule_id, tokens, key (the rarest of them), bad, n, confidence.

    A rule has the same label on at least ``confidence`` of the URLs that have
    its tokens, ``least`` of them at least; by chance (the overall rate, and
    all combinations tried) that comes about with a probability under
    ``chance``. It goes if fewer of its tokens give the label as surely. If
    all rows have one label, nothing can beat the overall rate: there are no
    rules. Without a rule beyond chance there are none either.
    """
    labelled = stage(labelled.filter(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    total = labelled.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    empty = labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, key string, bad boolean, n long, confidence double")
    if total.n < least or total.bad in (0, total.n):
        return empty
    many = labelled.select("row", F.explode("tokens").alias("token"))
    common = stage(many.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "common-tokens")
    # rare tokens are in no rule
    known = stage(met_by_count(many, common, ["token"], many.count()).groupBy("row").agg(F.sort_array(F.collect_list("token")).alias("tokens")).join(labelled.select("row", "bad"), "row"), "common-urls")
    sets = known.select(F.explode(token_groups(F.col("tokens"))).alias("items"))
    size = sets.count()
    if not size:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size), minConfidence=1.0).fit(sets)
    met = model.freqItemsets.filter(F.size("items") <= RULE_TOKENS).select(F.array_sort("items").alias("tokens"), F.explode("items").alias("token"))
    met = met.join(common, "token").groupBy("tokens").agg(F.min(F.struct("n", "token")).getField("token").alias("key"))
    met = stage(met.withColumn("rule_id", F.xxhash64("tokens")), "combinations")
    tried = met.count()
    # groups count what stands in several of them more than once: this is the exact count
    hits = known.select("bad", F.col("tokens").alias("own"), F.explode("tokens").alias("key")).join(met, "key").filter(F.size(F.array_except("tokens", "own")) == 0)
    c = hits.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("b")).filter(F.col("n") >= least)
    sides = F.explode(F.array(F.struct(F.lit(True).alias("bad"), F.col("b").alias("of"), F.lit(total.bad / total.n).alias("rate")), F.struct(F.lit(False).alias("bad"), (F.col("n") - F.col("b")).alias("of"), F.lit(1 - total.bad / total.n).alias("rate"))))
    r = c.select("rule_id", "n", sides.alias("s")).select("rule_id", "n", "s.*").withColumn("confidence", F.col("of") / F.col("n"))
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    beyond = F.col("n") * (part(F.col("confidence"), F.col("rate")) + part(1 - F.col("confidence"), 1 - F.col("rate")))  # Chernoff's bound of the binomial tail
    r = r.filter((F.col("confidence") >= confidence) & (F.col("confidence") > F.col("rate")) & (beyond >= F.log(F.lit(2 * tried / chance))))
    rules = stage(r.join(met, "rule_id").select("rule_id", "tokens", "key", "bad", "n", "confidence"), "rules")
    fewer = rules.select(F.col("tokens").alias("some"), F.col("bad").alias("same"), F.col("confidence").alias("sure"), F.element_at("tokens", 1).alias("token"))
    inside = (F.col("bad") == F.col("same")) & (F.size("some") < F.size("tokens")) & (F.size(F.array_except("some", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))
    near = rules.withColumn("token", F.explode("tokens")).join(fewer, "token").filter(inside).select("rule_id", "bad").distinct()
    return rules.join(near, ["rule_id", "bad"], "left_anti").select(*empty.columns)


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages``: page, tokens (both of a kind once). page and bad of the surest rule whose tokens a page has all of (of equal ones bad); other pages are absent."""
    hits = pages.select("page", F.col("tokens").alias("own"), F.explode("tokens").alias("key")).join(rules, "key").filter(F.size(F.array_except("tokens", "own")) == 0)
    return hits.groupBy("page").agg(F.max(F.struct("confidence", "bad")).getField("bad").alias("bad"))


def url_filter(pages: DataFrame, labelled: DataFrame, fixed: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", least: int = 25, confidence: float = 0.6) -> DataFrame:
    """Host, path, fixed rule and verdict of every page.

    ``fixed``: (verdict, host, path); a rule fits its host and all subdomains
    if the path starts with the rule's; the longest wins. ``labelled``: url,
    bad; the method's rules are mined from it, rows without url or label left
    out. Where two mined rules fit, the surer one decides, bad if they tie.
    Pages that no rule fits, null and odd URLs too, are allowed. Repeated rows
    get equal verdicts. Other columns don't pass, whatever their names; an
    empty table gives an empty result; without labels only fixed rules block.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(url_col, F.lit("")).alias("page"))
    rules = mine_rules(labelled.filter("url is not null and bad is not null").select(tokens_of(F.col("url")).alias("tokens"), "bad"), least, confidence)
    urls = rows.groupBy("page").agg(F.count("*").alias("n"))
    found = match_rules(urls.select("page", tokens_of(F.col("page")).alias("tokens")), rules)
    judged = met_by_count(rows, stage(urls.join(found, "page", "left"), "judged-urls"), ["page"], rows.count())
    judged = judged.select("_id", "bad", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(fixed, key=lambda x: len(x[1] + x[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    mined = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))
