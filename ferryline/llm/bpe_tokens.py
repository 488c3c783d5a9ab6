"""Byte-level BPE by overlapping chunks.

Long texts are cut into chunks that overlap. Every chunk is split into
pre-tokens on its own, from its first character; where two neighbours put a
pre-token boundary at the same place inside their overlap, they agree from
there on, for a boundary depends on nothing to its left. Cutting there gives
pieces that hold whole pre-tokens, and pieces are encoded in parallel.
Neighbours without a common boundary are joined to one piece.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 32_768, 512
#: SHA-256 of a text.
_KEY = "string"


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _vocabulary(enc) -> list[bytes]:
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


def encode_pieces(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """``pieces``: key, no, text. key, no, n (ids) and ids (little-endian unsigned 32-bit), each piece by itself."""

    def run(batches):
        enc = _encoding(path, pattern)
        for batch in batches:
            ids = [enc.encode_to_numpy(t.as_py(), disallowed_special=()).astype("<u4") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["key", "no", "n", "ids"])

    return pieces.mapInArrow(run, f"key {_KEY}, no int, n long, ids binary")


def joined(rows: DataFrame, path: str, pattern: str, pieces_col: str = "pieces") -> DataFrame:
    """``rows``: ..., pieces (array of (no, ids), in order). The other columns, ids (all pieces' ids), and decoded (binary): their bytes, one after the other."""
    schema = StructType([f for f in rows.schema.fields if f.name != pieces_col] + [StructField("ids", BinaryType()), StructField("decoded", BinaryType())])

    def run(batches):
        words = _vocabulary(_encoding(path, pattern))
        for batch in batches:
            at = batch.schema.get_field_index(pieces_col)
            ids = [b"".join([x["ids"] for x in p.as_py()]) for p in batch.column(at)]
            out = [b"".join([words[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids]
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary()), pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def pieces_of(texts: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``texts``: key, text. Pieces (key, no, text) that end where neighbouring chunks agree on a boundary."""
    n = F.greatest(F.ceil(F.length("text") / chunk), F.lit(1))
    chunks = texts.withColumn("n", n).select("key", "n", F.explode(F.expr("sequence(0, cast(n as int) - 1)")).alias("no"), F.col("text").alias("_t"))
    chunks = chunks.select("key", "no", "n", F.expr(f"substring(_t, no * {chunk} + 1, {chunk + overlap})").alias("text"))

    def bounds(batches):
        import regex

        find = regex.compile(pattern).finditer
        for batch in batches:
            head, tail = [], []
            for no, n, t in zip(batch.column("no").to_pylist(), batch.column("n").to_pylist(), batch.column("text").to_pylist()):
                # the last boundaries of a chunk may be cut short by its end
                head.append([m.start() for m in find(t[: 2 * overlap]) if m.start() < overlap] if no else [])
                tail.append([m.start() - chunk for m in find(t) if m.start() >= chunk] if no + 1 < n else [])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), *(pa.array(x, pa.list_(pa.int32())) for x in (head, tail))], ["key", "no", "head", "tail"])

    long_ = chunks.filter("n > 1")
    marks = long_.mapInArrow(bounds, f"key {_KEY}, no int, head array<int>, tail array<int>")
    w = Window.partitionBy("key").orderBy("no")
    # the overlap's last 64 characters are left out: a match there may have been cut by the chunk's end
    seam = F.expr(f"try_element_at(filter(array_intersect(head, before), x -> x < {overlap - 64}), 1)")
    seams = marks.withColumn("before", F.lag("tail").over(w)).select("key", "no", seam.alias("seam"))
    cut = long_.select("key", "no", "text").join(seams, ["key", "no"]).withColumn("next", F.lead("seam").over(w)).withColumn("last", F.lead("no").over(w).isNull())
    # a chunk without a seam goes on with the piece before it
    cut = cut.withColumn("piece", F.sum(F.when((F.col("no") == 0) | F.col("seam").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    own = F.expr(f"case when last then substring(text, coalesce(seam, 0) + 1) else substring(text, coalesce(seam, 0) + 1, {chunk} + coalesce(next, 0) - coalesce(seam, 0)) end")
    joined = cut.withColumn("own", own).groupBy("key", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "own"))), lambda x: x.own), "").alias("text"))
    short = chunks.filter("n = 1").select("key", "no", "text")
    return short.unionByName(joined.select("key", F.col("piece").alias("no"), "text"))


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token ids of every row, as one sequence, and their bytes again.

    Returns id_col, n_tokens, ids (binary, little-endian unsigned 32-bit) and
    decoded (binary). Null texts are encoded like empty ones: no ids. Texts of
    any length are cut; the ids are those of the whole text. Repeated rows get
    rows of their own. Other columns don't pass, whatever their names; an empty
    table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    kind = docs.schema[id_col].dataType.simpleString()

    def direct(batches):
        enc = _encoding(path, pattern)
        words = _vocabulary(enc)
        for batch in batches:
            ids = [enc.encode_to_numpy(t.as_py(), disallowed_special=()).astype("<u4") for t in batch.column(1)]
            back = [b"".join([words[i] for i in x.tolist()]) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(back, pa.binary())], [id_col, "n_tokens", "ids", "decoded"])

    short = slim.filter(~is_long).mapInArrow(direct, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
    long_ = slim.filter(is_long)
    # equal texts have equal ids: a text is named by its SHA-256 and encoded once, however many copies it has
    key = F.sha2(F.col("text").cast("binary"), 256)
    texts = long_.select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    ids = encode_pieces(pieces_of(texts, pattern, chunk, overlap), path, pattern)
    whole = ids.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("pieces"))
    out = joined(long_.select(F.col("_id").alias(id_col), key.alias("key")).join(whole, "key").select(F.col(id_col), "n_tokens", "pieces"), path, pattern)
    return short.unionByName(out)
