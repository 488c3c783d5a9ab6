"""The queries of the training-data operators, on the supplied tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.llm.bpe_tokens import bpe_encode
from ferryline.llm.chat_format import chat_format
from ferryline.llm.common import fold_of, stage, table
from ferryline.llm.conversation_trie import TRIE_SQL, shared_beginnings
from ferryline.llm.decontaminate import contaminated
from ferryline.llm.license_scan import license_scan, license_sql
from ferryline.llm.quality_model import Quality
from ferryline.llm.quality_rules import quality_rules
from ferryline.llm.sharding import shard_documents
from ferryline.llm.simhash_dedup import simhash_dedup
from ferryline.llm.spelling_variants import SPELLING_SQL, spelling_variants
from ferryline.llm.substring_dedup import substring_dedup
from ferryline.llm.textstats import with_counts
from ferryline.llm.toxicity import Toxicity
from ferryline.llm.url_filters import path_of, url_filter

#: verdict, host, path: fixed values of the contract.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer() -> tuple[str, str]:
    """Path of the ranks, and the pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def known_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id and label of the labels outside the held-out fold."""
    return labels.filter(fold_of(F.col("doc_id"), folds) != held_out).select("doc_id", label)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = Toxicity.fit(docs, known_labels(table(spark, sf_dir, "labels"), "toxic", 5, 0))
    out = model.score(docs, "doc_id")
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels are joined to the counts, so that texts are read once and never shuffled
    counts = stage(with_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"]), "counts")
    model = Quality.fit_counts(counts.join(known_labels(table(spark, sf_dir, "labels"), "quality", 3, 1), "doc_id"))
    out = model.score_counts(counts, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(table(spark, sf_dir, "documents"), *tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the first number of its path, so it has that document's labels."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    shown = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})", 1).try_cast("long")
    known = pages.select(shown.alias("doc_id"), "url").join(labels.select("doc_id", bad.alias("bad")).filter("bad is not null"), "doc_id").select("url", "bad")
    return url_filter(pages, known, URL_RULES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_beginnings(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_toxicity, op3_sharding, op4_quality_model, op5_bpe_tokens, op6_url_filters, op7_quality_rules, op8_decontamination, op9_chat_format, op10_simhash_dedup, op11_conversation_trie, op12_spelling_variants, op13_license_scan)
}

ORACLE = {
    "op11_conversation_trie": TRIE_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_license_scan": license_sql(),
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
        r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
        s AS (SELECT doc_id, i FROM g SEMI JOIN r USING (g)),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
        f AS (SELECT w.doc_id, w.i, word, max(CASE WHEN s.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
              FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.i = w.i),
        k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM f GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op9_chat_format": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        p AS (SELECT conv_id, turn, string_agg(turn || chr(31) || role || chr(31) || text, chr(30)) OVER w AS prefix, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT min(conv_id) AS conv_id FROM p WHERE last AND prefix NOT IN (SELECT prefix FROM p WHERE NOT last) GROUP BY prefix),
        k AS (SELECT *, row_number() OVER w - 1 AS rank, coalesce(sum(strlen(role) + strlen(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM t SEMI JOIN m USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, CAST(rank // 512 + before // 16777216 AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_turns,
               string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
        FROM k GROUP BY 1, 2""",
}
