"""A corpus from documents: toxicity, language, near-duplicates, source mix, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language_id, mixing, ngram_join, packing, toxicity
from sparkloom.llm.queries import packing_input
from sparkloom.operators.lineage import written


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """The rows of docs that keep admits after judge; judge sees the text alone, so no column of docs can clash."""
    others = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row")
    judged = judge(docs.select("text", others)).where(keep(lambda c: F.col("row").getField(c)))
    return judged.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays below one half, and those that no example speaks against.

    Null, empty and very long texts are judged as by score_toxicity; repeated rows are judged
    alike; an empty table stays empty; all columns stay as they are, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    return _kept(docs, lambda d: toxicity.score_toxicity(d, model), lambda row: F.expr("predicted = 0 OR size(evidence) = 0"))


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that agrees with their lang column.

    Those without text or without a letter go, and those whose text is surely (score of
    0.99 or more) in another language than lang says; a null lang says nothing. Repeated
    rows are judged alike; an empty table stays empty; all columns stay as they are.
    """
    model = language_id.fit_languages(docs)
    other = lambda row: F.coalesce((F.col("lang_pred") != row("lang")) & (F.col("score") >= 0.99), F.lit(False))
    return _kept(docs, lambda d: language_id.identify(d, model), lambda row: (F.col("lang_pred") != language_id.UNDETERMINED) & ~other(row))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates, as by one_of_each_group: texts without words stay."""
    return ngram_join.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole or in part, as often as their source's target weight takes them.

    Null and wordless texts have no words to take and give no row; a null source is a
    source; repeated rows are documents each; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' words in fixed-length sequences, as by pack; texts without words give no row."""
    return packing.pack(packing_input(docs))


STAGES = [("toxicity", drop_toxic), ("language_id", drop_undetermined), ("ngram_jaccard_join", drop_near_copies), ("mixing", mix), ("best_fit_packing", pack)]

#: Learned decisions and seeded draws are no SQL; tests/llm holds each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before is written once and read by the next, then deleted."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for _, stage in STAGES[:-1]:
        docs, place = written(stage(spark, docs, sf_dir), *spent)
        spent = (place,)
    return STAGES[-1][1](spark, docs, sf_dir)
