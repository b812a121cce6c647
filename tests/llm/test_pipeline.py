"""The pipeline's stages one after the other, and every query with SQL against DuckDB, at the smallest scale."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evengap.llm import contamination, likeness, simhash
from evengap.llm.queries import QUERIES, SQL, table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert after.columns == docs.columns
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        if name == "near_copies":
            assert simhash.near_copies(after).groupBy("component_id").count().where("count > 1").count() == 0
        if name == "contamination":
            assert contamination.contained(after, table(spark, SF, "benchmark")).count() == 0
        if name == "pseudonyms":
            assert after.count() == docs.count()
        docs, before = after, docs
    assert docs.select("doc_id").distinct().count() == before.count()
    want = sorted((r.doc_id, r.start, r.ids_crc32) for r in docs.collect())
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    answer = con.sql(SQL[name])
    order = [answer.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(
        repr(tuple(r[i] for i in order)) for r in answer.fetchall())


def test_no_texts_of_jaccard_above_the_threshold_stay(spark):
    def grams(text):
        words = text.encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(4, 300))]
        rows.append((len(rows), " ".join(words), "en", "x", 0))
        for changes in (1, 2, 3, 6):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy), "en", "x", 0))
    rows += [(900, "", "en", "x", 0), (901, None, "en", "x", 0), (902, rows[0][1], "en", "x", 0)]
    sets = [grams(r[1] or "") for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = sorted(min(r[0] for r, x in zip(rows, root) if x == own) for own in set(root))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert len(want) < len(rows) and sorted(r.doc_id for r in got.collect()) == want


def test_fingerprints_propose_near_copies(spark):
    """Without any band, the links of SimHash fingerprints still find a near copy; the shingles decide on them."""
    words = [f"w{i * i % 997}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "new"]), " ".join(words[:40]), "", None]
    sets = likeness.sets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), "text", ["id"])
    sets = sets.withColumn("keys", F.array().cast("array<long>")).cache()
    a, b = sorted(r.fp for r in sets.where("id < 2").collect())
    pairs = simhash.candidates(sets)
    assert likeness.links(sets).count() == 0
    assert [tuple(r) for r in likeness.links(sets, candidates=pairs).collect()] == [(a, b)]
    assert likeness.links(sets, 0.999, candidates=pairs).count() == 0
