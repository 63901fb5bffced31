"""The corpus pipeline: toxicity, near-duplicates, repeated passages, source mixing, packing.

Every stage reads all that the one before it kept; ``run`` writes each result
to the shared checkpoint folder and reads it again as the next one's input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.llm import mixing, packing, simhash, substring, toxicity
from geomill.session import checkpoint_dir, cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model, trained on all labels, scores below 0.5; rows of one doc_id, or of none, are each judged by their own text."""
    own = docs.select(*COLUMNS, F.col("text").alias("_read"))
    scored = toxicity.score_rows(own, toxicity.train(docs, table(spark, sf_dir, "labels")), "_read")
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; of rows repeated in doc_id and text one stays.

    Rows that a filter knows to be neither dropped nor repeated stay where they are; only the others are shuffled.
    """
    key = ["_id", "_none", "_hash"]  # without nulls, so that the rows dealt for the join are dealt for their repeats too
    keyed = lambda hashed: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_id"), F.col("doc_id").isNull().alias("_none"), hashed.alias("_hash")]
    marks = simhash.similar_documents(docs).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    touched = cut(marks.filter("NOT kept OR n > 1"))
    own = docs.select(*COLUMNS, *keyed(simhash.text_hash()))
    own = simhash.maybe_among(own, simhash.row_name("doc_id", "_hash"), touched.select(simhash.row_name()), touched.count(), "_touched")
    dropped = touched.filter("NOT kept").select(*keyed(F.col("text_hash")))
    others = own.filter("_touched").join(dropped, key, "left_anti").dropDuplicates(key)
    return own.filter("NOT _touched").select(*COLUMNS).union(others.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; those left without a word go."""
    kept = substring.remove_repeats(docs.select(*COLUMNS), keep=("lang", "source", "n_chars")).filter("n_removed < n_words OR n_words = 0")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, up to twice, as their weights have it."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, fingerprints and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
