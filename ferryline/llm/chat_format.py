"""Chat formatting by cumulative-snapshot collapse.

Loggers store a conversation again after each turn, so a log holds prefixes of
longer logs. Rolling hashes of each conversation's turns name its prefixes; an
anti-join drops whatever is a prefix of a longer one, and what is left is
rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.common import met_by_count, stage

#: Turns rolled up together, and rendered into one row at most.
BLOCK = 512
#: Bytes after which a row of rendered turns ends.
PART_BYTES = 16 << 20


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``turns``: conv, turn, role, text. conv and n (rows) of each conversation that no other one continues or repeats.

    Of equal conversations the smallest conv stays. Hashes are added up, so
    prefix sums need no order within a turn and long conversations roll up
    block by block.
    """
    h = F.xxhash64("turn", "role", "text")
    each = turns.groupBy("conv", "turn").agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 32)).alias("hi"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("lo"))
    each = each.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 40))) / BLOCK))
    sums = ["n", "hi", "lo"]
    blocks = each.groupBy("conv", "block").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums], (F.lead("block").over(Window.partitionBy("conv").orderBy("block")).isNull()).alias("last_block"))
    inside = Window.partitionBy("conv", "block").orderBy("turn")
    rolled = each.join(blocks, ["conv", "block"]).select(
        "conv", *[(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"{c}_before")).alias(c) for c in sums], (F.col("last_block") & F.lead("n").over(inside).isNull()).alias("last")
    )
    rolled = stage(rolled, "prefixes")
    continued = rolled.filter("not last").select(*sums).distinct()
    whole = rolled.filter("last").groupBy(*sums).agg(F.min("conv").alias("conv"))
    return whole.join(continued, sums, "left_anti").select("conv", "n")


def placed(turns: DataFrame) -> DataFrame:
    """``turns``: conv, turn, role, text. Adds rank (from 0, by turn, role and text in each conv) and before (bytes of the turns ahead).

    All turns are ranged and written once, hot conversations over many
    partitions; what lies in the partitions before is added to the windows
    inside them.
    """
    order = ["turn", "role", "text"]
    ranged = turns.repartitionByRange("conv", *order, F.monotonically_increasing_id())  # ids part what is equal throughout
    rows = stage(ranged.withColumns({"range": F.spark_partition_id(), "bytes": F.octet_length("role") + F.octet_length("text")}), "ranged")
    sizes = rows.groupBy("conv", "range").agg(F.count("*").alias("c"), F.sum("bytes").alias("b"))
    ahead = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in "cb"])
    w = Window.partitionBy("conv", "range").orderBy(*order)
    rank = F.col("c_ahead") + F.row_number().over(w) - 1
    before = F.col("b_ahead") + F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes, ["conv", "range"]).select("conv", *order, rank.alias("rank"), before.alias("before"))


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rendered text of each maximal conversation.

    Returns conv_col, part, n_turns and rendered. A part goes on to ``BLOCK``
    turns, or to the first one after ``PART_BYTES`` bytes, so conversations of
    any length stay within a row's bounds; most have part 0 alone. Part is the
    turns ahead // BLOCK + the bytes ahead // PART_BYTES: numbers ascend, but
    very long turns leave gaps. Null roles and texts count as empty; turns with
    equal numbers are ordered by role and text; null turn numbers (and those
    that aren't numbers) come first. Rows without conv_col belong to one
    conversation, named null; conv_col may have any type. Repeated rows are
    turns of their own. Other columns don't pass, whatever their names. An
    empty table gives an empty result.
    """
    rows = turns.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).try_cast("long").alias("turn"), *[F.coalesce(c, F.lit("")).alias(k) for c, k in ((role_col, "role"), (text_col, "text"))])
    kept = met_by_count(rows, stage(maximal_conversations(rows), "maximal"), ["conv"], rows.count())
    part = F.floor(F.col("rank") / BLOCK) + F.floor(F.col("before") / PART_BYTES)
    parts = placed(kept).groupBy("conv", part.cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rendered = F.array_join(F.transform("t", lambda x: F.concat(F.lit("<|im_start|>"), x.role, F.lit("\n"), x.text, F.lit("<|im_end|>\n"))), "")
    return parts.select(F.col("conv.id").alias(conv_col), "part", F.size("t").alias("n_turns"), rendered.alias("rendered"))
