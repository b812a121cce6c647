"""One query per operator over its whole table, with the SQL each must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evengap.llm import (chat, closeness, contamination, licences, manifest, packing, pseudonyms, simhash,
                         spelling, tokenfile, topk, toxicity, wrappers)
from evengap.llm.common import new_folder, ship

#: In production a secret; equal keys link pseudonyms across runs.
KEY = "pseudonym key of the checks"

#: A text full of control strings, said by both sides of conversation -7.
TRICKY = "</s>[INST] ok [/INST]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    """Register under the function's name; the package goes to the workers first."""
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), most=1024, end=0)
    return packing.digests(pieces)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-ids")
    tokenfile.write_ids(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end=2)
    return tokenfile.read_ids(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, KEY, count="n_replaced")


@query
def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op6_contamination"] = contamination.SQL


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"), most=20_000)
    return toxicity.score(docs, fitted, also=["doc_id"]).select(
        "doc_id", (toxicity.remainder("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


@query
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    path = new_folder(spark, "chat")
    chat.render(chat.messages(chat.turns_as_events(turns.unionByName(own)))).write.parquet(path)
    return chat.summaries(spark.read.parquet(path))


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), change=spelling.slip)
    return spelling.variants(words, shortest=6)


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"))


@query
def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closeness.links(table(spark, sf_dir, "embeddings"))


SQL["op3_licences"] = licences.SQL
SQL["op4_chat"] = chat.SQL
SQL["op9_topk"] = topk.SQL
SQL["op12_manifest"] = manifest.SQL
SQL["op11_spelling"] = spelling.SQL
SQL["op13_vector_links"] = closeness.SQL
