"""Places in a whole order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage


def numbered(rows: DataFrame, *order: Column | str, into: str = "seq") -> DataFrame:
    """rows with `into`, their place in the order from 1; ties in the order of the rows as they come.

    Rows are dealt by ranges of the order, equal ones too, and written; a row's place is that
    within its range behind the rows of the ranges before. The driver sees one count a range.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*columns).sortWithinPartitions(*columns)
    dealt = cut_lineage(dealt.withColumn("_tie", F.monotonically_increasing_id()))
    part = F.shiftright("_tie", 33)
    counts = sorted((r.p, r.n) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a task
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    known = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    place = F.col("_before") + F.col("_tie").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("_part", part).join(F.broadcast(known), "_part").withColumn(into, place).select(*rows.columns, into)


def places_of(rows: DataFrame, group: str, value: str, places: dict[str, str]) -> DataFrame:
    """group, n, and for each name the value at that place (an expression of n, from 0) in rising order.

    Groups may be of any size: rows are numbered in the order of group and value, and a place
    is looked up by its number.
    """
    known = numbered(rows.select(group, value), group, value, into="_seq")
    spans = known.groupBy(group).agg(F.min("_seq").alias("_first"), F.count("*").alias("n"))
    wanted = F.explode(F.create_map(*(x for name, e in places.items() for x in (F.lit(name), F.expr(e).cast("long")))))
    asked = spans.select(F.col(group), "n", "_first", wanted.alias("_name", "_place")).withColumn("_seq", F.col("_first") + F.col("_place"))
    found = asked.join(known.select("_seq", F.col(value).alias("_value")), "_seq", "left").where("_place < n")
    return found.groupBy(group, "n").agg(*(F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in places))


def places_by_steps(rows: DataFrame, group: str, value: str, places: dict[str, str], step: Column) -> DataFrame:
    """The same for many rows of rounded values: step never falls as the value rises, and has few results of few values each.

    Rows are counted by value, counts are summed by step, and only the steps that hold a wanted
    place are looked into; so no row is numbered, and a task orders the steps of one group or
    the values of one step.
    """
    counts = cut_lineage(rows.groupBy(group, step.alias("_step"), value).agg(F.count("*").alias("_k")))
    before = lambda *order: F.coalesce(F.sum("_k").over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.groupBy(group, "_step").agg(F.sum("_k").alias("_k")).withColumns({"_before": before(group, "_step"), "n": F.sum("_k").over(Window.partitionBy(group))})
    wanted = F.explode(F.create_map(*(x for name, e in places.items() for x in (F.lit(name), F.expr(e).cast("long")))))
    asked = steps.select(F.col(group).alias("_g"), F.col("_step").alias("_s"), "n", "_before", "_k", wanted.alias("_name", "_place")).where("_before <= _place AND _place < _before + _k").drop("_k")
    held = counts.join(asked.select("_g", "_s").distinct(), F.col(group).eqNullSafe(F.col("_g")) & F.col("_step").eqNullSafe(F.col("_s")), "left_semi")
    seen = held.withColumn("_from", before(group, "_step", value))
    at = F.col("_place") - F.col("_before") - F.col("_from")
    found = seen.join(asked, F.col(group).eqNullSafe(F.col("_g")) & F.col("_step").eqNullSafe(F.col("_s"))).where((at >= 0) & (at < F.col("_k")))
    return found.groupBy(group, "n").agg(*(F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in places))
