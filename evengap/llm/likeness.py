"""Near copies by the Jaccard likeness of word shingles: MinHash bands find candidates, the shingles themselves decide.

The bits of two SimHash fingerprints differ in about 15 % of their places where five-word Jaccard is 0.8, some ten of 64,
and covering masks for that many are too many. Texts of one shingle set are one node. Nodes that share a band are held
against the smallest of it, then nodes of a band that are not connected yet against each other, in tasks that give out a
spanning forest of links and no pairs. A byte of each of 96 minima tells first whether two sets can be alike at all; only
pairs that can are compared shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.llm.common import stored
from evengap.llm.graph import components
from evengap.llm.wordids import forget_all, slices

WIDTH, LIKE = 5, 0.8
#: 24 bands of 4 minima: a pair of Jaccard 0.8 shares no band with a chance of (1 - 0.8^4)^24, about 3 in a million.
BANDS, ROWS = 24, 4
_RNG = np.random.default_rng(11)
TURN = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
ODD = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
#: Partners of a set in one task; nodes of a band in one part, and about how many shingles they have.
PARTNERS, PART, SHINGLES = 200, 2048, 1_000_000
#: Shingles whose bits are counted at once.
COLUMNS = 8192
STEP, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * END
    return x ^ (x >> np.uint64(29))


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; fewer words are one shingle, and no words none."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    total = np.full(n, min(width, len(h)), np.uint64)
    for i in range(min(width, len(h))):
        total = total * STEP + h[i:i + n]
    return np.unique(mixed(total))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each set, none of which is empty."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
    whole = np.concatenate(sets)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat((whole ^ TURN[i]) * ODD[i], begin)
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """Band keys of rows of minima."""
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(found), axis=0)
    for i in range(BANDS * ROWS):
        keys[:, i // ROWS] = mixed(keys[:, i // ROWS] * STEP + found[:, i])
    return keys


def marks(found: np.ndarray) -> np.ndarray:
    """A byte of every minimum, mixed so that it depends on all its bits."""
    return (mixed(found * STEP) >> np.uint64(40)).astype(np.uint8)


def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many marks the rows of x share with those of y, as a matrix."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for i in range(x.shape[1]):
        out += x[:, i, None] == y[None, :, i]
    return out


def sets(docs: DataFrame, text: str, also: list[str], width: int = WIDTH) -> DataFrame:
    """The columns `also` and the text of every row (null: empty), and of its shingles the hash fp, number, marks and band keys."""
    import xxhash

    kept = docs.select(*also, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = kept.select("*", F.lit(0).cast("long").alias("fp"), F.lit(0).alias("size"), F.lit(b"").alias("marks"),
                         F.array().cast("array<long>").alias("keys")).schema

    def hashed(batches):
        forget_all()
        for batch in batches:
            texts = [t.encode() for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in slices([len(t) for t in texts], 1_000_000):
                found = [shingles(t, width) for t in texts[a:b]]
                full = [i for i, s in enumerate(found) if len(s)]
                keys: list = [np.empty(0, np.int64)] * len(found)
                own: list = [b""] * len(found)
                if full:
                    least = minima([found[i] for i in full])
                    for i, k, m in zip(full, bands(least), marks(least)):
                        keys[i], own[i] = k.view(np.int64), m.tobytes()
                fps = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
                out = [pa.array(fps), pa.array([len(s) for s in found], pa.int32()), pa.array(own, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *out], names=schema.names)

    return kept.mapInArrow(hashed, schema)


def fits(a: str, b: str, like: float):
    """Sizes that such a likeness allows."""
    return F.least(a, b) >= like * F.greatest(a, b) - 1e-9


def possible(pairs: DataFrame, nodes: DataFrame, like: float) -> DataFrame:
    """Those pairs (a, b) whose marks agree often enough."""
    least = least_agreement(like)

    def kept(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            some = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some)], names=["a", "b"])

    own = nodes.where("size > 0").select("fp", "marks")
    both = (pairs.join(own.withColumnsRenamed({"fp": "a", "marks": "x"}), "a").join(own.withColumnsRenamed({"fp": "b", "marks": "y"}), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(kept, "a long, b long")


def least_agreement(like: float) -> int:
    """Marks that agree in a pair of that likeness, but for a chance of one in a million: five deviations below the mean."""
    n = BANDS * ROWS
    return math.floor(n * like - 5 * math.sqrt(n * like * (1 - like)))


def verified(pairs: DataFrame, found: DataFrame, like: float, width: int) -> DataFrame:
    """Those pairs (a, b) whose shingle sets are alike to the threshold.

    Every a is sent to its partners' tasks once for some hundred of them, so a hot one is shared out; every partner is
    sent once a pair. A task holds one set of shingles, and compares what streams by.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    pairs = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    held = stored(found.select("fp", "text").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text")), "texts")
    heads = pairs.select("a", "part").distinct().join(held.withColumnRenamed("fp", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    sent = heads.unionByName(pairs.join(held.withColumnRenamed("fp", "b"), "b").select("a", "part", "b", "text"))

    def compared(batches):
        forget_all()
        own: np.ndarray = np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                other = shingles(text.encode(), width)
                if b is None:
                    own = other
                    continue
                shared = np.intersect1d(own, other, assume_unique=True).size
                if shared >= like * (len(own) + len(other) - shared) - 1e-9:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return (sent.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
            .mapInArrow(compared, "a long, b long"))


def runs(batches, names: int) -> Iterator[pa.Table]:
    """Neighbouring rows that agree in their first columns; what a batch ends with may go on in the next."""
    held, last = [], None
    for batch in batches:
        if batch.num_rows:
            heads = np.stack([batch.column(i).to_numpy() for i in range(names)], axis=1)
            cuts = [0, *(np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                head = heads[a].tolist()
                if held and head != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = head
    if held:
        yield pa.Table.from_batches(held)


def alike(cell: pa.Table, like: float, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of a cell's pairs whose sizes and marks agree often enough, some hundred i at a time.

    Pairs of one value of `apart`, which may change between the steps, are left out, and so are pairs that share a band
    before this one, whose cell has them.
    """
    key, first = cell.column(0)[0].as_py(), cell.column(1)[0].as_py()
    n, cut, least = cell.num_rows, 0, least_agreement(like)
    if first != cell.column(2)[0].as_py():
        cut = int((cell.column(3).to_numpy() == first).sum())
        if cut in (0, n):
            return
    size = cell.column("size").to_numpy()
    own = np.frombuffer(b"".join(cell.column("marks").to_pylist()), np.uint8).reshape(n, -1)
    keys = cell.column("keys").combine_chunks().flatten().to_numpy().reshape(n, -1)
    for at in range(0, cut or n, 256):
        left = slice(at, min(at + 256, cut or n))
        right = slice(cut or at, None)
        small, large = np.minimum(size[left, None], size[right]), np.maximum(size[left, None], size[right])
        ok = (apart[left, None] != apart[right]) & (small >= like * large - 1e-9)
        if not cut:
            ok &= np.arange(ok.shape[0])[:, None] < np.arange(ok.shape[1])
        if ok.any():
            i, j = np.nonzero(ok & (agree(own[left], own[right]) >= least))
            i, j = i + left.start, j + right.start
            common = keys[i] == keys[j]
            here = keys[i, common.argmax(axis=1)] == key
            yield i[here], j[here]


def shared(sets: list[np.ndarray]):
    """A function of places (i, j) that counts what sets i and j have in common, by bits of what several sets hold."""
    whole, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = n > 1
    kept, number = several[place], np.cumsum(several) - 1
    owner, place = owner[kept], number[place[kept]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]

    def counted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for at in range(0, int(several.sum()), COLUMNS):
            a, b = np.searchsorted(place, [at, at + COLUMNS])
            bits = np.zeros((len(sets), COLUMNS), bool)
            bits[owner[a:b], place[a:b] - at] = True
            words = np.packbits(bits, axis=1).view(np.uint64)
            for c in range(0, len(i), 20_000):
                d = slice(c, c + 20_000)
                out[d] += np.bitwise_count(words[i[d]] & words[j[d]]).sum(axis=1, dtype=np.int64)
        return out

    return counted


def unconnected(rows: DataFrame, nodes: DataFrame, found: DataFrame, like: float, width: int) -> DataFrame:
    """Links (a, b) that connect those nodes of a band that are alike and have different roots; rows: (key, fp, size, root).

    A band of many nodes is cut into parts, and each pair of parts is a task's work. The marks tell which nodes may be alike
    to any other there, and only these are sent again, with their texts. All their pairs that may be alike are compared by
    shingles where they meet, and only a spanning forest of the links leaves the task, so no row is made for a pair.
    """
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / SHINGLES)).cast("int")
    bounds = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), parts.alias("parts"))
    rows = rows.drop("size").join(bounds.where("low < high").select("key", "parts"), "key")
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
        F.least("part", j).alias("i"), F.greatest("part", j).alias("j"))))
    dealt = (rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("cell", cell)
             .join(nodes.select("fp", "size", "marks", "keys"), "fp")
             .select("key", "cell.i", "cell.j", "part", "fp", "root", "size", "marks", "keys"))

    def together(df: DataFrame) -> DataFrame:
        return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "part", "fp")

    def promising(batches):
        ready, n = [], 0
        for cell in runs(batches, 3):
            some = np.zeros(cell.num_rows, bool)
            for i, j in alike(cell, like, cell.column("root").to_numpy()):
                some[i] = some[j] = True
            if some.any():
                ready.append(cell.filter(pa.array(some)))
                n += ready[-1].num_rows
            if n >= 1000:
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready, n = [], 0
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    def linked(batches):
        forget_all()
        for cell in runs(batches, 3):
            fp, root = cell.column("fp").to_numpy(), cell.column("root").to_numpy().copy()
            own = [shingles(t.encode(), width) for t in cell.column("text").to_pylist()]
            size, common, out = np.array([len(s) for s in own]), shared(own), []
            for i, j in alike(cell, like, root):
                both = common(i, j)
                close = both >= like * (size[i] + size[j] - both) - 1e-9
                i, j = i[close], j[close]
                for x, ys in zip(*grouped(i, j)):
                    ys = ys[root[ys] != root[x]]
                    while len(ys):
                        out.append((min(fp[x], fp[ys[0]]), max(fp[x], fp[ys[0]])))
                        root[root == root[ys[0]]] = root[x]
                        ys = ys[root[ys] != root[x]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    some = stored(together(dealt).mapInArrow(promising, dealt.schema), "promising")
    texts = found.select("fp", "text").join(some.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text"))
    return together(some.join(texts, "fp").select(*some.columns, "text")).mapInArrow(linked, "a long, b long").distinct()


def grouped(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different values of a sorted i, and the j of each."""
    values, begin = np.unique(i, return_index=True)
    return values, np.split(j, begin[1:])


def links(found: DataFrame, like: float = LIKE, width: int = WIDTH, candidates: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints whose sets share a band, or are candidates, and are alike to the threshold.

    First all nodes of a band are held against its smallest fingerprint, so a large group of near copies costs a few pairs
    a node, and candidates (a, b) from elsewhere against each other. Then the other nodes of a band that are not connected
    meet in tasks of their own.
    """
    nodes = stored(found.groupBy("fp").agg(F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("marks").alias("marks")), "nodes")
    rows = nodes.select("fp", "size", F.explode("keys").alias("key"))
    ends = (rows.groupBy("key").agg(F.min(F.struct("fp", "size")).alias("low"), F.max("fp").alias("high"))
            .where("low.fp < high").select("key", F.col("low.fp").alias("c"), F.col("low.size").alias("s")))
    rows = stored(rows.join(ends, "key"), "banded").where("fp <> c")
    stars = rows.where(fits("size", "s", like)).select(F.col("c").alias("a"), F.col("fp").alias("b")).distinct()
    if candidates is not None:
        stars = stars.unionByName(candidates).distinct()
    near = stored(verified(stored(possible(stars, nodes, like), "stars"), found, like, width), "near")
    roots = components(near).withColumnRenamed("node", "fp")
    placed = rows.select("key", "fp", "size").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stored(near.unionByName(unconnected(placed, nodes, found, like, width)), "near")
