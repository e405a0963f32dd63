"""A training corpus from raw documents, in five stages.

Every stage takes what its predecessor kept and hands on documents with their
columns; the last one returns the packed pieces. Between stages the rows are
written to the shared folder and read again, so each stage starts from files.

Defined cases: null, empty and blank texts have no toxic words and stay in the
first stage; the empty and null ones are copies of each other for the second,
blank ones of nothing else; none is a near duplicate; they have no words, so the
mix takes none of them. Very long texts are never cut. Ties and repeated rows:
of rows with equal texts that with the largest doc_id stays, a null doc_id being
the smallest; rows without an id are no near duplicates; the mix takes rows that
share an id equally often. Empty tables give empty tables. Columns of any name
are handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import boxed, materialise, read, unboxed
from tidewater.llm.exact_dedup import drop_exact_copies
from tidewater.llm.mixing import mix_sources
from tidewater.llm.near_dedup import drop_near_copies
from tidewater.llm.packing import pack_documents
from tidewater.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels of the raw table, lets pass."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"), training=read(spark, sf_dir, "documents"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole time.

    Documents without words are in no mix and go. Only the one document per
    source in which a target ends is rounded.
    """
    taken = mix_sources(docs).where("taken > 0").select(
        F.col("doc_id").alias("__tw_id"), F.round(F.col("taken") / F.col("size")).cast("int").alias("__tw_times")
    )
    # Rows that repeat an id have one number of times: that of all of them together, shared evenly.
    times = taken.groupBy("__tw_id").agg(F.round(F.avg("__tw_times")).cast("int").alias("__tw_times")).where("__tw_times > 0")
    met = boxed(docs, "doc_id").join(times, F.col("doc_id").eqNullSafe(F.col("__tw_id")))
    return unboxed(met.withColumn("__tw_n", F.explode(F.sequence(F.lit(1), F.col("__tw_times")))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Models, sketches and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
