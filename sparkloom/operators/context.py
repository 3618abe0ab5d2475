"""Packing ranked pieces into a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import render
from sparkloom.functions.text import item_limit

#: Defaults of the blocks' texts.
TAG = "memory"
RECALL_HEAD = "Recalled from this project's memory. Older notes may be outdated: check dates and marks before relying on them."
BRIEF_HEAD = "Memory is active for this project: {live} memory atoms."
RECENT_HEAD = "Recent notes and decisions (last two weeks):"


def pack_prefix(items: DataFrame, group: str, order: list[str], text: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose lines, each with its line end, fit the budget."""
    w = Window.partitionBy(group).orderBy(*order)
    used = items.withColumn("used", F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return used.where(F.col("used") <= budget)


def take_within(items: DataFrame, group: str, order: list[str], file: str, size: str, budget: int, per_file: int, most: int) -> DataFrame:
    """group, item ids that are taken, in order: an item that breaks a rule is skipped, later ones go on.

    Rules: per_file items of a file, budget in all, most items. The fold runs in one
    aggregate over each group's sorted array; group sizes are candidate lists (top-k).
    """
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, file, size))).alias("_rows"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<f:string,i:bigint>>)").alias("taken"))

    def step(acc, row):
        fits = (acc["used"] + row[size] <= budget) & (F.size(acc["taken"]) < most) & (F.size(F.filter(acc["taken"], lambda t: t["f"] == row[file])) < per_file)
        new = F.struct((acc["used"] + row[size]).cast("long").alias("used"), F.concat(acc["taken"], F.array(F.struct(row[file].alias("f"), row[order[-1]].cast("long").alias("i")))).alias("taken"))
        return F.when(fits, new).otherwise(acc)

    folded = rows.select(group, F.aggregate("_rows", empty, step).alias("_a"))
    return folded.select(group, F.col("_a.used").alias("used"), F.transform("_a.taken", lambda t: t["i"]).alias("items"))


def pack_blocks(items: DataFrame, groups: DataFrame, group: str, order: list[str], line: str, top: list[str], bottom: str, budget: int) -> DataFrame:
    """group, block, shown: top lines, the longest prefix of a group's lines that fits the budget, the bottom line.

    groups has each group once; one with lines of which not even the first fits has the empty
    block, and so has one without lines whose top and bottom don't fit.
    """
    frame = len("\n".join([*top, bottom]))
    w = Window.partitionBy(group).orderBy(*order)
    used = items.withColumn("_used", F.sum(F.length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) + frame)
    held = used.groupBy(group).agg(F.count("*").alias("_all"), F.array_sort(F.collect_list(F.when(F.col("_used") <= budget, F.struct("_used", line)))).alias("_lines"))
    lines = F.transform("_lines", lambda x: x[line])
    some = F.array_join(F.concat(F.array(*map(F.lit, top)), lines, F.array(F.lit(bottom))), "\n")
    bare = F.lit("\n".join([*top, bottom]) if frame <= budget else "")
    joined = groups.select(group).join(held, group, "left")
    block = F.when(F.col("_all").isNull(), bare).when(F.size("_lines") == 0, F.lit("")).otherwise(some)
    return joined.select(group, block.alias("block"), F.coalesce(F.size("_lines"), F.lit(0)).alias("shown"))


def render_recall(cards: DataFrame, group: str, order: list[str], budget: int, tag: str = TAG, head: str = RECALL_HEAD) -> DataFrame:
    """group, block, shown: the recall block of each group's cards (day, file, score, text, notes) in order.

    Cards are numbered from 1; a text may take an even share of the budget; a null score
    shows as 0.00. A group without a card that fits has no row.
    """
    top = [f"<{tag}>", head]
    w = Window.partitionBy(group)
    numbered = cards.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "_of": F.count("*").over(w)})
    limit = item_limit(F.lit(budget), F.lit(len("\n".join(top))), F.col("_of"))
    line = render.recall_item(F.col("_n"), F.col("day"), F.col("file"), F.coalesce("score", F.lit(0.0)), F.col("text"), F.col("notes"), limit)
    lines = numbered.select(group, "_n", line.alias("_line"))
    return pack_blocks(lines, lines.select(group).distinct(), group, ["_n"], "_line", top, f"</{tag}>", budget).where("shown > 0")


def render_brief(live: int, notes: DataFrame, max_chars: int, tag: str = TAG, head: str = BRIEF_HEAD, recent_head: str = RECENT_HEAD) -> DataFrame:
    """One row, block: the brief of a session's start, with the first 5 notes (place, day, file, text) if any fits.

    Notes that don't fit go from the end; without any the recent heading goes too; if even
    the head doesn't fit the block is empty.
    """
    one = notes.sparkSession.range(1).select(F.lit(0).alias("g"))
    lines = notes.where("place <= 5").select(F.lit(0).alias("g"), "place", render.recent_line(F.col("day"), F.col("file"), F.col("text")).alias("_line"))
    top, bottom = [f"<{tag}>", head.format(live=live)], f"</{tag}>"
    full = pack_blocks(lines, one, "g", ["place"], "_line", [*top, recent_head], bottom, max_chars).where("shown > 0")
    bare = pack_blocks(lines.limit(0), one, "g", ["place"], "_line", top, bottom, max_chars).withColumnRenamed("block", "bare").drop("shown")
    return bare.join(full, "g", "left").select(F.coalesce("block", "bare").alias("block"))


def assemble(pieces: DataFrame, group: str, order: list[str], budget: int) -> DataFrame:
    """group, block: '[kind ref] text' lines of the longest prefix whose lines, each with its line end, fit the budget."""
    line = F.concat(F.lit("["), F.col("kind"), F.lit(" "), F.col("ref"), F.lit("] "), F.col("text")).alias("_line")
    kept = pack_prefix(pieces.select(group, *order, line), group, order, "_line", budget)
    return kept.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("used", "_line"))), lambda x: x["_line"]), "\n").alias("block"))


def entropy(weight: Column) -> Column:
    """Aggregate: Shannon entropy (nats) of weights as shares of their sum, from sums alone."""
    total = F.sum(weight)
    return F.when(total > 0, F.ln(total) - F.sum(F.when(weight > 0, weight * F.ln(weight)).otherwise(0.0)) / total).otherwise(F.lit(0.0))
