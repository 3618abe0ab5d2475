"""Filters and DISTINCT-like operators whose winner is fixed by an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last duplicate's values at the first duplicate's position; one aggregation, no window."""
    rest = [c for c in df.columns if c not in (key, seq)]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_v"), F.min(seq).alias(seq))
    return out.select(key, seq, *[F.col(f"_v.{c}").alias(c) for c in rest])


def in_window(hits: DataFrame, query: str, score: str, least: float, window: float) -> DataFrame:
    """Hits of each query within window of its best, and at least `least`."""
    best = F.max(score).over(Window.partitionBy(query))
    return hits.withColumn("_b", best).where(F.col(score) >= F.greatest(F.lit(least), F.col("_b") - window)).drop("_b")


def shortlist(hits: DataFrame, digest: str, rank: list[Column], k: int) -> DataFrame:
    """The first hit of each content in rank order, k in all."""
    return first_per(hits, [digest], rank).orderBy(*rank).limit(k)


def admit(cards: DataFrame, words: DataFrame, least: float, window: float, max_items: int) -> DataFrame:
    """Cards (query_id, id, score, place) that a query may show.

    A query is silent unless its best cosine reaches `least`; then a card passes within
    `window` of the best, or if it is among the query's first max_items lexical hits
    (words: query_id, id, place).
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    top = words.where(F.col("place") <= max_items).select("query_id", "id", F.lit(True).alias("_w"))
    judged = cards.withColumn("_b", best).join(top, ["query_id", "id"], "left")
    near = F.col("score") >= F.greatest(F.lit(least), F.col("_b") - window)
    return judged.where((F.col("_b") >= least) & (near | F.col("_w").isNotNull())).drop("_b", "_w")
