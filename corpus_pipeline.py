"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of ``documents``; the last returns tokens. Null and
empty texts pass all filters (of equal ones, near dedup keeps one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.llm.bpe_tokens import bpe_encode
from ferryline.llm.common import met_by_count, stage, table
from ferryline.llm.decontaminate import contaminated
from ferryline.llm.near_copies import near_groups
from ferryline.llm.queries import known_labels, tokenizer
from ferryline.llm.substring_dedup import substring_dedup
from ferryline.llm.toxicity import Toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model of the labelled ones among them."""
    model = Toxicity.fit(docs, known_labels(table(spark, sf_dir, "labels"), "toxic", 5, 0))
    rest = [c for c in COLUMNS if c != "text"]
    return model.score(docs, *rest, "text").filter("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of their five-word shingles: that with the smallest doc_id, then text hash.

    Texts meet in the walk of SimHash tries (op10's, with fingerprints for 0.8) and are verified exactly. A row is named by its id and the hash of its text; of identical rows one stays.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_th"))
    ids = rows.groupBy("doc_id", "_th").agg(F.count("*").alias("same"))
    groups = stage(near_groups(docs).withColumnsRenamed({"th": "_th", "copies": "n"}), "groups")
    named = met_by_count(ids, groups, ["_th"], rows.count()).withColumnRenamed("same", "n")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_th", "n")
    keep = stage(named.groupBy("root").agg(F.min(first).alias("k")).select("k.*"), "kept")
    rows = rows.withColumnRenamed("doc_id", "_id").withColumnRenamed("_th", "_h").join(keep, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("_th")))
    # only identical rows are grouped again
    once = rows.filter("n = 1").select(*COLUMNS)
    return once.unionByName(rows.filter("n > 1").dropDuplicates(["doc_id", "_th"]).select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that stand elsewhere too."""
    out = substring_dedup(docs, carry=["lang", "source"], respace=False)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item. Rows are named by the hash of their text, which alone decides: ids may be null or repeated."""
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_th"))
    # written first: where they are few, Spark sees it and sends them to the rows instead of shuffling all texts
    leaks = stage(contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="_th").select("_th").distinct(), "leaks")
    return rows.join(leaks, "_th", "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), and the hash of the decoded bytes."""
    out = bpe_encode(docs, *tokenizer())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", drop_repeated_passages), ("decontamination", drop_leaks), ("tokens", tokenize)]
#: Trained models, sketches and tokens have no SQL form. tests/llm holds the stages against brute force or planted cases: toxicity (insults with letters put
#: in), near_dedup (all pairs), substring_dedup (all windows), decontamination (edited and re-asked items), tokens (the library), and all on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
