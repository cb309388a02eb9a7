"""Corpus pipeline: stages that turn raw documents into packed training sequences."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalforge.llm import packing, quality, queries, setjoin, suffix, toxicity
from signalforge.llm.common import documents, dropped, owned, stored
from signalforge.session import ship


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Results of stages that were called by themselves, and the tables that each reads.
_HELD: list[tuple[weakref.ref, list[str]]] = []


def staged(stage: Stage) -> Stage:
    """A stage whose stored tables live as long as its result.

    A result reads tables that the stage stored for itself. Write it, or keep it, before another
    stage is called: that call deletes the tables of results that nothing holds any more.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gone = [h for h in _HELD if h[0]() is None]
        for h in gone:
            dropped(spark, h[1])
            _HELD.remove(h)
        with owned() as paths:
            out = stage(spark, docs, sf_dir)
        _HELD.append((weakref.ref(out), paths))
        return out

    return run


@staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this corpus's labels, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))  # so that no column can clash
    return toxicity.classify(whole, labels).filter(F.col("predicted") == 0).select("_row.*")


@staged
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie near their language's references."""
    whole = docs.select("text", "lang", F.struct(*docs.columns).alias("_row"))
    return quality.judge(whole).filter("kept").select("_row.*")


#: Words of a shingle and least similarity, in percent, of near duplicates in the pipeline.
SHINGLE, PERCENT = 5, 80


@staged
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of least doc_id, rows without an id last.

    Repeated rows of one id are copies like any others. Rows without words are groups of their own.
    """
    ship(spark)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_at"), F.struct(*docs.columns).alias("_row")))
    with owned() as within:
        links = setjoin.link(rows.select(F.col("_at").alias("doc_id"), F.col("_row.text").alias("text")), SHINGLE, PERCENT)
        groups = rows.select("_at", "_row.doc_id").join(links.select(F.col("doc_id").alias("_at"), "component_id"), "_at")
        first = groups.groupBy("component_id").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_at")).alias("first")
        )
    kept = stored(first.select(F.col("first._at").alias("_at")))
    dropped(spark, within)
    return rows.join(kept, "_at", "left_semi").select("_row.*")


@staged
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one holds; n_chars follows the text."""
    ship(spark)
    rows = suffix.remove_repeats(docs).withColumnRenamed("kept_text", "text")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    ship(spark)
    added = packing.added_tokens(public_tokenizers.path(queries.TOKENIZER))
    return packing.pack_documents(docs, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN, added)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", remove_repeated_passages),
    ("best-fit packing", pack),
]

#: The stages train a classifier and remove bytes, which SQL can't express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before it kept, each written as Parquet and read again.

    A stage's own tables, and its input, go when its result has been written. What run returns
    is a table of its own, which no other run touches; it stays until the shared folder is cleared.
    """
    docs, before = documents(spark, sf_dir), []
    for _, stage in STAGES:
        with owned() as own:
            out = stage.__wrapped__(spark, docs, sf_dir)
        with owned() as result:
            docs = stored(out)
        dropped(spark, [*own, *before])
        before = result
    return docs
