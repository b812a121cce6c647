"""Near copies by SimHash fingerprints and covering locality-sensitive hashing.

Every table of the covering family masks the bits of one half of the positions' codes; the masks are built so that for
any pair within the radius some table masks all bits in which the pair differs. So no pair is lost and none is guessed.
Copies share a fingerprint and are counted once before anything is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.llm import likeness
from evengap.llm.common import free_names, stored
from evengap.llm.graph import components
from evengap.llm.wordids import forget_all

BITS = 64


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of a text's word shingles. No words: zero."""
    import xxhash

    words = data.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) < width:
        return h64(b" ".join(words), seed)
    count, at = np.zeros(BITS, np.int64), 0
    total = len(words) - width + 1
    while at < total:  # long texts in parts, so that the bits of few shingles are in memory at once
        part = words[at:at + 50_000 + width - 1]
        hashes = [h64(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(width)))]
        one = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(one, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += len(hashes)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42,
                 also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns `also`, fp): the fingerprint of every row's whole text as a signed long. A null text has no words."""
    kept = docs.select(F.col(id).alias("doc_id"), *also, F.col(text).cast("string").alias("_text"))
    schema = kept.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def hashed(batches):
        forget_all()
        for batch in batches:
            fps = [fingerprint((t or "").encode(), width, seed) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64))], names=schema.names)

    return kept.mapInArrow(hashed, schema)


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks of kept bits. Every bit has a code of radius + 1 digits; mask v keeps the bits whose code
    has an odd product with v. The codes of `radius` bits never span all directions, so some v has an even product with
    each of them, and its mask keeps none of them.
    """
    rng = np.random.default_rng(seed)
    codes = rng.permutation(np.resize(np.arange(1 << (radius + 1)), BITS))
    return [sum(1 << i for i, c in enumerate(codes.tolist()) if (c & v).bit_count() % 2 == 1)
            for v in range(1, 1 << (radius + 1))]


def close_pairs(fps: np.ndarray, radius: int, free: np.ndarray | None = None, most: int = 1024) -> tuple:
    """A spanning forest of the links within the radius among distinct fingerprints, as two index arrays.

    Up to `most` are compared directly. More are split by parts of the bits in which they differ: a pair within the
    radius agrees on one of radius + 1 parts, so no link is lost, and every part is split again until it is small.
    """
    if len(fps) <= most:
        root = np.arange(len(fps))
        left, right = [], []
        for i in range(len(fps) - 1):
            near = np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= radius) + i + 1
            near = near[root[near] != root[i]]
            while len(near):
                j = near[0]
                left.append(i), right.append(j)
                root[root == root[j]] = root[i]
                near = near[root[near] != root[i]]
        return np.array(left, np.int64), np.array(right, np.int64)
    if free is None:
        free = np.arange(BITS)
    vary = np.bitwise_or.reduce(fps ^ fps[0])
    free = free[(vary >> free.astype(np.uint64)) & np.uint64(1) == 1]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part in np.array_split(free, radius + 1):
        mask = np.bitwise_or.reduce(np.left_shift(np.uint64(1), part.astype(np.uint64)))
        key = fps & mask
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rest = np.setdiff1d(free, part)
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                a, b = close_pairs(fps[rows], radius, rest, most)
                left.append(rows[a]), right.append(rows[b])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `fp` within the radius, without emitting all pairs of a group."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(signed)])
    buckets = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")

    def linked(batches):
        held = np.empty((0, 3), np.int64)

        def pairs(rows: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(axis=1)) + 1
            begin, end = np.concatenate([[0], change]), np.concatenate([change, [len(rows)]])
            out = [np.empty((0, 2), np.int64)]
            two = begin[end - begin == 2]
            x, y = rows[two, 2], rows[two + 1, 2]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            out.append(np.stack([x[near], y[near]], axis=1))
            for i in np.flatnonzero(end - begin > 2):
                fps = np.unique(rows[begin[i]:end[i], 2]).view(np.uint64)
                a, b = close_pairs(fps, radius)
                out.append(np.stack([fps[a].view(np.int64), fps[b].view(np.int64)], axis=1))
            ab = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for batch in batches:
            new = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            held = np.concatenate([held, new])
            last = held[-1, :2] if len(held) else None
            cut = len(held) and int(np.flatnonzero((held[:, :2] != last).any(axis=1))[-1:].sum())
            if cut:  # the last bucket may go on in the next batch
                yield pairs(held[:cut + 1])
                held = held[cut + 1:]
        if len(held):
            yield pairs(held)

    return (buckets.repartition("t", "key").sortWithinPartitions("t", "key")
            .mapInArrow(linked, "a long, b long"))


def rooted(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) of every distinct fingerprint: its smallest doc_id, and the fingerprint that names its component."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42,
                radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links of at most `radius` bits reach.

    Null and empty texts have fingerprint zero and are linked like others. Rows with one id are nodes of their own that
    share it; a null id belongs to its component but never names one, unless all its ids are null. Other columns are
    ignored, and an empty table gives no rows. Fingerprints are written once; a fingerprint's copies are one node.
    """
    fps = stored(fingerprints(docs, id=id, text=text, width=width, seed=seed), "fingerprints")
    named = rooted(fps, radius)
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(heads, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def candidates(found: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of shingle sets, given with their texts as (text, fp), whose SimHash fingerprints connect them: each set
    of a fingerprint with the smallest one, and the smallest ones along the links within the radius."""
    texts = found.select(F.lit(None).cast("long").alias("id"), "text", F.col("fp").alias("shingles"))
    prints = stored(fingerprints(texts, id="id", also=("shingles",)).select("shingles", "fp").distinct(), "fingerprints")
    heads = prints.groupBy("fp").agg(F.min("shingles").alias("head"))
    first, second = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    across = links(heads.select("fp"), radius).join(first, "a").join(second, "b").select("head_a", "head_b")
    pairs = prints.join(heads, "fp").select("shingles", "head").union(across).toDF("a", "b").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_first(docs: DataFrame, *, id: str = "doc_id", text: str = "text", radius: int = 3, like: float | None = None) -> DataFrame:
    """One row of each component: that of the smallest id, and of several such rows the one of the smallest text hash.

    like: link texts whose five-word shingles have at least this Jaccard likeness. Candidates are the links of fingerprints
    within the radius and MinHash bands; the shingles themselves decide on both.
    Rows without an id are compared too, but stay only where their component has no id at all. Of rows that are alike in
    id and text any one stays. All columns are kept; an empty table gives no rows.
    """
    name, own = free_names(docs, "name", "own")
    marked = docs.withColumns({name: F.coalesce(F.col(id).cast("string"), F.lit("")),
                               own: F.xxhash64(F.col(text), F.col(id).isNull())})
    if like is None:
        fps = stored(fingerprints(marked, id=id, text=text, also=(name, own)), "fingerprints")
        roots = rooted(fps, radius).select("fp", "root")
    else:
        whole = marked.select(F.col(id).alias("doc_id"), name, own, F.col(text).alias("text"))
        fps = stored(likeness.sets(whole, "text", ["doc_id", name, own]), "sets")
        roots = components(likeness.links(fps, like, candidates=candidates(fps, radius))).withColumnRenamed("node", "fp")
    # equal rows, then equal fingerprints, are summed before the components meet them
    rows = fps.groupBy("fp", "doc_id", name, own).agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", own, name, "n")).alias("x")
    firsts = rows.groupBy("fp").agg(least).select("fp", "x.*")
    keep = stored(firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).groupBy("root").agg(least)
                  .select(f"x.{name}", f"x.{own}", "x.n"), "firsts")
    once = marked.join(keep.where("n = 1"), [name, own], "left_semi")
    repeated = marked.join(keep.where("n > 1"), [name, own], "left_semi").dropDuplicates([name, own])
    return once.unionByName(repeated).select(*docs.columns)
