"""Mixing sources to target weights: blocks, multinomial shard counts, permuted indexes, a join by index.

DataFrame operations only. Each source's documents, in hashed order, are one stream of words
that is cut into blocks of BLOCK words. Every output shard draws multinomial source counts;
a source's n-th slot takes block perm(n mod blocks) of that source, where perm is a keyed
swap-or-not permutation, so a block comes again only when every other block has come.
Draws beyond a source's quota are void and what is then missing fills closing shards, so
the totals are exact: the last slot of a source is cut to the word that meets its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, word_count
from sparkloom.operators.lineage import cut_lineage

BLOCK = 256
SHARD_SLOTS = 8192
ROUNDS = 24
#: Sources up to this number are broadcast (some 100 bytes each); beyond it joins are salted.
BROADCAST_SOURCES = 10_000
SALTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, src (rank by code point, null last), source_size, target of each source.

    Weights repeat over the ranks. A target stops at `most` times its source's size; the
    excess goes to the others by weight until none is above: the level at which the capped
    targets meet the total is the largest of (total - caps before) / (weights from here on)
    over the sources in order of cap / weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("src", F.lit(len(weights))) + 1).cast("int"))
    everything = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before, after = everything.rowsBetween(Window.unboundedPreceding, -1), everything.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        by_source.withColumn("src", rank)
        .withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most)), "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(Window.partitionBy()))
        .select("source", "src", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(math.inf)) * F.col("weight")).alias("target"))
    )


def _permute(index: Column, size: Column, key: Column, seed: int, back: bool = False) -> Column:
    """Swap-or-not shuffle of [0, size): each round is an involution, so `back` runs them reversed."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, r), size) - x, size)
        swap = F.xxhash64(F.lit(seed + 1), key, r, F.greatest(x, other)).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, index.cast("long"), step)


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int, on: str | list[str], null_safe: bool = False) -> DataFrame:
    """rows joined to the sources' table: broadcast if it is small, else on (key, salt) so that no hot source meets in one task."""
    if null_safe:  # the flag and the text are the key, as null is a source too
        keyed = lambda d: d.withColumns({"_null": F.col(on).isNull(), "_key": F.coalesce(on, F.lit(""))})
        out = _with_sources(keyed(rows), keyed(sources).drop(on), n_sources, ["_null", "_key"])
        return out.drop("_null", "_key")
    keys = [on] if isinstance(on, str) else on
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), keys)
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 11, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(items, spans) of the mix of docs with columns doc_id, source and text.

    items: doc_id, text_hash, copy, source, size, source_size, target; one row per row of
    docs, where rows that repeat doc_id, source and text are told apart by copy. spans:
    doc_id, text_hash, copy, source, shard, slot, epoch, block, start, words: the words
    start .. start + words - 1 of the document that this slot of the shard takes.
    Null or wordless texts have size 0 and no spans; a null source is a source of its own,
    the last; null ids are ordinary ids. Without any word no target is above 0. Equal
    inputs give equal results in any partitioning; an empty table gives empty results.
    """
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    items = sizes.groupBy("doc_id", "source", "text_hash", "size").count().withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).drop("count")
    items = cut_lineage(items)
    n_docs = items.count()
    sources = cut_lineage(
        source_targets(items, weights, share, most)
        .withColumns({"blocks": F.ceil(F.col("source_size") / block), "words": F.round("target").cast("long")})
        .withColumn("words", F.least("words", (F.col("source_size") * most).cast("long")))
        .withColumns({"passes": F.coalesce(F.expr("words div nullif(source_size, 0)"), F.lit(0)), "last": F.col("source_size") - (F.col("blocks") - 1) * block})
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn("spot", F.when(F.col("blocks") > 0, _permute(F.col("blocks") - 1, F.col("blocks"), F.col("src"), seed, back=True)))
        # slots of the pass that stays incomplete: whole blocks up to the short one's spot, that one, whole blocks again
        .withColumn("extra", F.expr(f"CASE WHEN rest <= spot * {block} THEN ceil(rest / {block}) WHEN rest <= spot * {block} + last THEN spot + 1 ELSE spot + 1 + ceil((rest - spot * {block} - last) / {block}) END"))
        .withColumn("cut", F.expr(f"rest - CASE WHEN extra <= spot + 1 THEN (extra - 1) * {block} ELSE (extra - 2) * {block} + last END"))
        .withColumn("slots", F.coalesce(F.col("passes") * F.col("blocks") + F.col("extra"), F.lit(0)).cast("long"))
    )
    n_sources, total = sources.select(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    items = _with_sources(items, sources.select("source", "src", "source_size", "target"), n_sources, "source", null_safe=True)
    slots = _slots(items.sparkSession, sources, n_sources, total, seed, shard_slots)
    placed = slots.select("src", "shard", "slot", "epoch", _permute(F.col("place"), F.col("blocks"), F.col("src"), seed).alias("block"), "words")
    spans = placed.join(_pieces(items, n_docs, block), ["src", "block"])
    taken = F.least(F.col("piece_words"), F.col("words") - F.col("in_block"))
    spans = spans.withColumn("taken", taken).where(F.col("taken") > 0)
    return items.drop("src"), spans.select("doc_id", "text_hash", "copy", "source", "shard", "slot", "epoch", "block", "start", F.col("taken").alias("words"))


def _slots(spark, sources: DataFrame, n_sources: int, total: int, seed: int, shard_slots: int) -> DataFrame:
    """src, shard, slot (the source's within the shard), epoch, place, words of every slot of the mix."""
    cells = max(64, 4 * n_sources)
    running = Window.orderBy("src")
    share = F.col("slots") / F.lit(float(max(total, 1)))
    reach = sources.where("slots > 0").withColumn("high", F.sum(share).over(running)).withColumn("low", F.coalesce(F.lag("high").over(running), F.lit(0.0)))
    reach = reach.withColumn("high", F.when(F.col("src") == F.max("src").over(Window.partitionBy()), F.lit(1.0)).otherwise(F.col("high")))
    reach = reach.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "id"), 11) / F.lit(float(1 << 53))).alias("u")
    draws = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), draw).withColumn("cell", F.floor(F.col("u") * cells))
    counts = draws.join(reach.select("cell", "src", "low", "high"), "cell").where("u >= low AND u < high").groupBy("src", "shard").agg(F.count("*").alias("drawn"))
    counts = _with_sources(counts, sources.select("src", "slots"), n_sources, "src")
    past = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("drawn").over(past), F.lit(0)))
    granted = counts.withColumn("n", F.least("drawn", F.col("slots") - F.col("before"))).where("n > 0").select("src", "shard", "before", "n")
    # what draws left of the quotas fills closing shards
    drawn = sources.select("src", "slots").join(granted.groupBy("src").agg(F.sum("n").alias("before")), "src", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    rest = drawn.withColumn("lot", F.explode(F.expr(f"CASE WHEN slots > before THEN sequence(0, (slots - before - 1) div {shard_slots}) END")))
    closing = rest.select("src", (F.lit(-(-total // shard_slots)) + F.col("lot")).alias("shard"), (F.col("before") + F.col("lot") * shard_slots).alias("before"), F.least(F.lit(shard_slots), F.col("slots") - F.col("before") - F.col("lot") * shard_slots).alias("n"))
    # a source's grants come from one window; its slots are dealt out before they are made
    dealt = granted.unionByName(closing).repartition(max(16, total // 50_000), "src", "shard")
    each = dealt.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = _with_sources(each, sources.select("src", "blocks", "slots", "rest", "cut"), n_sources, "src").withColumn("nth", F.col("before") + F.col("slot"))
    return each.select("src", "shard", "slot", F.expr("nth div blocks").alias("epoch"), F.expr("nth % blocks").alias("place"), "blocks", F.when((F.col("nth") == F.col("slots") - 1) & (F.col("rest") > 0), F.col("cut")).otherwise(F.lit(1 << 40)).alias("words"))


def _pieces(items: DataFrame, n_docs: int, block: int) -> DataFrame:
    """Each document's part in each block of its source: start (word of the document), in_block, piece_words.

    A source's running word count has two levels, documents within hashed chunks and the
    chunks, each of about the square root of the documents, so a hot source has no long window.
    """
    chunks = max(1, math.isqrt(n_docs))
    dealt = items.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)))
    order = Window.partitionBy("src", "chunk").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("offset", F.coalesce(F.sum("size").over(order), F.lit(0)))
    chunk_order = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("src", "chunk").agg(F.sum("size").alias("n")).select("src", "chunk", F.coalesce(F.sum("n").over(chunk_order), F.lit(0)).alias("base"))
    at = inner.join(starts, ["src", "chunk"]).withColumn("offset", F.col("offset") + F.col("base"))
    at = at.withColumn("block", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")))
    first = F.greatest(F.col("offset"), F.col("block") * block)
    return at.select("src", "block", "doc_id", "text_hash", "copy", "source", (first - F.col("offset")).alias("start"), (first - F.col("block") * block).alias("in_block"), (F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - first).alias("piece_words"))


def words_taken(items: DataFrame, spans: DataFrame) -> DataFrame:
    """items plus taken: the words that the mix takes of each row, repeats counted."""
    keys = ["doc_id", "text_hash", "copy", "source"]
    taken = spans.groupBy(*keys).agg(F.sum("words").alias("taken"))
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return items.alias("i").join(taken.alias("t"), same, "left").select("i.*", F.coalesce("t.taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as rows like those of docs: a row for each pass in which a document is taken.

    A document that a pass takes whole keeps its text; of one taken in part the row has the
    taken words in order, joined by blanks. n_chars, where docs has it, follows the text.
    Rows that repeat doc_id, source and text come as often as they stand, each with the
    other columns of one of them. Columns of any name keep their values.
    """
    _, spans = mix_sources(docs, **params)
    parts = spans.groupBy("doc_id", "text_hash", "copy", "source", "epoch").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("parts"), F.sum("words").alias("part_words"))
    keys = ["doc_id", "source", "text_hash"]
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row")).dropDuplicates(keys)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    joined = keyed.alias("d").join(parts.alias("p"), same).select("d.row", "p.parts", "p.part_words")
    whole = F.col("row.text")
    joined = joined.withColumn("words", F.when(F.col("part_words") < word_count(whole), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("words"), p["start"].cast("int") + 1, p["words"].cast("int")))), " ")
    out = joined.select("row", F.when(F.col("words").isNull(), whole).otherwise(some).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
