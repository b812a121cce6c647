"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on the shingles themselves.

Items are grouped by size (powers of two of their number of shingles). An item's sketch is its k smallest shingle
hashes, with k chosen for its size class so that an item contained to the threshold misses fewer than k of its
shingles: some of its sketch is then in the document, whatever the document's length, and a bound on how much of it
tells candidates. All columns are Spark's own; documents are never shuffled by a shingle while the sketches are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evengap.llm.common import stored

BROADCAST_ROWS = 2_000_000  # rows of two longs, about 64 MB; beyond it the join is shuffled
SLACK = 4


def words(text: str) -> Column:
    """Runs of letters and digits in lower case."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.split(F.trim(plain), " ")


def shingles(all_words: Column, width: int, hashed: bool) -> Column:
    """Every run of `width` words, as a hash or as text; null for fewer words."""
    def one(i: Column) -> Column:
        run = [F.get(all_words, i + j) for j in range(width)]
        return F.xxhash64(*run) if hashed else F.concat_ws(" ", *run)

    return F.when(F.size(all_words) >= width, F.transform(F.sequence(F.lit(0), F.size(all_words) - width), one))


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows allow it; else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, width: int, item: str, text: str) -> DataFrame:
    """(item_id, g, n): the distinct shingles of each item, and their number. Fewer words than `width` are one shingle."""
    w = F.col("w")
    whole = F.array_remove(F.array(F.concat_ws(" ", w)), "")
    rows = (items.select(F.col(item).alias("item_id"), words(text).alias("w"))
            .select("item_id", F.explode(F.coalesce(shingles(w, width, hashed=False), whole)).alias("g")).distinct())
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def runs(all_words: Column, widths: list[int], hashed: bool) -> Column:
    """The shingles of every width that items have, in one array."""
    found = [shingles(all_words, k, hashed) for k in widths]
    if len(found) == 1:
        return found[0]
    none = F.array().cast("array<bigint>" if hashed else "array<string>")
    return F.concat(*[F.coalesce(one, none) for one in found])


def sketches(parts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(item_id, h, need): the k smallest hashes of each item, and how many of them a containing document has at least."""
    top = F.pow(2, F.floor(F.log2("n")) + 1) - 1  # the largest size of the class
    k = F.least(F.col("n"), (F.floor(top * (1 - threshold) + 1e-9) + SLACK).cast("long"))
    miss = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)
    order = Window.partitionBy("item_id").orderBy("h")
    # a word that a short item lacks is null, which the hash passes over
    hashed = parts.select("item_id", "n", F.xxhash64(*[F.get(F.split("g", " "), i) for i in range(width)]).alias("h"))
    return (hashed.withColumn("k", k).withColumn("rank", F.row_number().over(order)).where("rank <= k")
            .select("item_id", "h", F.greatest(F.lit(1), F.col("k") - miss).alias("need")))


def contained(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id",
              item_text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment) of every pair whose containment reaches the threshold.

    Containment is the share of an item's distinct `width`-word shingles that occur in the document. Words are runs of
    letters and digits in lower case. An item of fewer than `width` words has one shingle, all its words in their order,
    and documents are searched for runs of that length too. Texts that are null or hold no word match nothing. Rows with one id count as one document or item; rows without an id match nothing. Other columns are
    ignored, and empty tables give no rows. Items are read twice, and documents once plus once for those with candidates.
    """
    parts = item_shingles(items.where(F.col(item).isNotNull()), width, item, item_text)
    parts = stored(parts, "items")
    sketch = sketches(parts, width, threshold)
    docs = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    n = parts.count()
    widths = sorted(r.k for r in parts.select(F.size(F.split("g", " ")).alias("k")).distinct().collect())  # at most `width`
    widths = widths or [width]
    met = (docs.select("doc_id", words("text").alias("w"))
           .select("doc_id", F.explode(runs(F.col("w"), widths, hashed=True)).alias("h"))
           .join(small_enough(sketch, n), "h"))
    pairs = stored(met.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("hits"), F.max("need").alias("need"))
                   .where("hits >= need").select("doc_id", "item_id"), "candidates")
    chosen = docs.join(small_enough(pairs.select("doc_id").distinct(), pairs.count()), "doc_id", "left_semi")
    whole = (chosen.select("doc_id", words("text").alias("w"))
             .select("doc_id", F.explode(runs(F.col("w"), widths, hashed=False)).alias("g"))
             .join(small_enough(parts, n), "g"))
    return (whole.join(pairs, ["doc_id", "item_id"], "left_semi")
            .groupBy("doc_id", "item_id").agg(F.count_distinct("g").alias("shared"), F.max("n").alias("shingles"))
            .withColumn("containment", F.col("shared") / F.col("shingles"))
            .where(F.col("containment") >= threshold - 1e-12))


def without(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item; rows without an id stay."""
    found = contained(docs, items, id=id, **options).select(F.col("doc_id").alias(id)).distinct()
    return docs.join(found, id, "left_anti")


SQL = """
WITH dw AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL),
iw AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE item_id IS NOT NULL),
ks AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
       FROM dw JOIN ks ON len(w) >= k),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
       FROM (SELECT *, least(len(w), 5) AS k FROM iw) WHERE k > 0),
sizes AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS shingles, count(*) / any_value(n)::DOUBLE AS containment
FROM dg JOIN ig USING (g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(n)::DOUBLE >= 0.8 - 1e-12
"""
