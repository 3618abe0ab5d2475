"""Chat formatting: cumulative snapshots collapse to the longest logged conversations before rendering.

DataFrame operations only. A turn's hash is placed by its ordinal and summed, so the running
sum after turn i identifies the first i turns. Sums are kept as two 38-bit halves, which
cannot overflow below 2^25 turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage, release

HALF = (1 << 38) - 1
#: Turns of a conversation that one window holds; longer ones go on in the next.
TURNS = 4096
#: A conversation and its lots as keys without nulls, so that windows and joins share one dealing out.
CONV, LOT = ["c", "c_null"], ["c", "c_null", "lot"]


def conversation(turns: DataFrame) -> tuple[Column, Column]:
    """c and c_null: the id, a zero of its own type in place of null, and whether it is null."""
    kind = turns.select("conv_id").schema[0].dataType
    return F.coalesce("conv_id", F.lit("0").cast(kind)).alias("c"), F.col("conv_id").isNull().alias("c_null")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """c, c_null (the conversation's id, and whether it is null), n (ordinal from 1) and h1, h2, the hash of its first n turns.

    Texts are shuffled once, to be put in order within lots of TURNS turn numbers; what
    follows has a hash for each turn. Null turn numbers are a lot of their own, the first.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    lot = F.coalesce(F.expr(f"turn div {TURNS}"), F.lit(-(1 << 62)).cast("long"))
    dealt = turns.select(*conversation(turns), lot.alias("lot"), "turn", "role", "text")
    own = F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    placed = cut_lineage(dealt.select(*LOT, F.row_number().over(Window.partitionBy(*LOT).orderBy(*order)).alias("i"), own.alias("own")))
    over = Window.partitionBy(*CONV).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(*LOT).agg(F.count("*").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(over), F.lit(0)))
    h = F.xxhash64("n", "own")
    numbered = placed.join(bases, LOT).withColumn("n", F.col("base") + F.col("i"))
    numbered = cut_lineage(numbered.select(*LOT, "n", h.bitwiseAND(F.lit(HALF)).alias("p1"), F.shiftrightunsigned(h, 26).alias("p2")), placed)
    sums = numbered.groupBy(*LOT).agg(F.sum("p1").alias("s1"), F.sum("p2").alias("s2"))
    before = sums.select(*LOT, F.coalesce(F.sum("s1").over(over), F.lit(0)).alias("b1"), F.coalesce(F.sum("s2").over(over), F.lit(0)).alias("b2"))
    running = Window.partitionBy(*LOT).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    summed = numbered.withColumns({"r1": F.sum("p1").over(running), "r2": F.sum("p2").over(running)}).join(before, LOT)
    return cut_lineage(summed.select(*CONV, "n", (F.col("r1") + F.col("b1")).alias("h1"), (F.col("r2") + F.col("b2")).alias("h2")), numbered)


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """c, c_null, n_turns, snapshots: conversations whose turns are no proper prefix of another's.

    Of equal conversations the smallest id stays, a null one last; snapshots counts the ids
    that it stands for. A prefix that more conversations have than end there has a longer
    one. Both sides of the anti-join have one row per hash, so a first turn or a
    conversation that very many share costs one row.
    """
    ends = hashed.groupBy(*CONV).agg(F.max_by(F.struct("h1", "h2"), "n").alias("h"), F.max("n").alias("n_turns"))
    ends = ends.groupBy("n_turns", "h.h1", "h.h2").agg(F.min(F.struct("c_null", "c")).alias("first"), F.count("*").alias("snapshots"))
    ends = cut_lineage(ends.select("n_turns", "h1", "h2", "first.c", "first.c_null", "snapshots"))
    had = hashed.select(F.col("n").alias("n_turns"), "h1", "h2", F.lit(1).cast("long").alias("had")).unionByName(ends.select("n_turns", "h1", "h2", (-F.col("snapshots")).alias("had")))
    longer = had.groupBy("n_turns", "h1", "h2").agg(F.sum("had").alias("had")).where("had > 0")
    kept = ends.join(longer, ["n_turns", "h1", "h2"], "left_anti").select(*CONV, "n_turns", "snapshots")
    return cut_lineage(kept, ends)


def rendered_turn(role: Column, text: Column) -> Column:
    """<|im_start|>role, line feed, text, <|im_end|>, line feed; null role or text is empty."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, snapshots, rendered of the maximal conversations.

    Turns go by turn number, nulls first, then role and text; turns that repeat stay
    repeated. Ids are numbers or strings; rows of null conv_id form one conversation. A maximal conversation is
    rendered in one row, so it must fit in memory. Extra columns are ignored, and an empty
    table gives no rows.
    """
    hashed = prefix_hashes(turns)
    kept = maximal_conversations(hashed)
    release(hashed)
    keyed = turns.select(*conversation(turns), "conv_id", "turn", "role", "text").join(kept, CONV)
    nulls_first = [x for name in ("turn", "role", "text") for x in (F.col(name).isNotNull().alias(f"has_{name}"), F.col(name))]
    whole = keyed.groupBy("conv_id", "n_turns", "snapshots").agg(F.array_sort(F.collect_list(F.struct(*nulls_first))).alias("pieces"))
    return whole.select("conv_id", "n_turns", "snapshots", F.array_join(F.transform("pieces", lambda p: rendered_turn(p["role"], p["text"])), "").alias("rendered"))
