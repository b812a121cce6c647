"""A document pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evengap.llm import contamination, packing, pseudonyms, simhash, toxicity
from evengap.llm.common import new_folder, ship
from evengap.llm.queries import KEY, table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.7
LIKENESS = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from `labels`."""
    ship(spark)
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, fitted, name="_toxicity", also=COLUMNS).where(F.col("_toxicity") < THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, by five-word Jaccard of at least 0.8 of what SimHash fingerprints
    and MinHash bands propose: the one of the smallest id."""
    ship(spark)
    return simhash.keep_first(docs, like=LIKENESS).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return contamination.without(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; formats and so lengths may change with dotted addresses only."""
    return pseudonyms.pseudonymise(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with a checksum of their ids."""
    ship(spark)
    return packing.digests(packing.pack(docs, tokenizer("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("contamination", drop_contaminated),
          ("pseudonyms", pseudonymise), ("packing", pack)]

#: Scoring, hashing of words with a seed, keyed networks and token ids are beyond SQL; tests hold each stage against
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
