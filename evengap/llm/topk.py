"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into 1, 4, then 16 segments. Segment means and deviations bound an inner product from above: by the means'
product, plus the product of the norms of what deviates. Coarse bounds discard most candidates, finer ones more, and
exact products are computed for the survivors only. Query blocks meet candidate blocks; a task keeps k results a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 4, 16)
BLOCK = 4096
QUERIES = 512
NONE = -(1 << 62)


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment: the mean times the root of its length, and the norm of the deviations."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)) if x.shape[1] else np.array([0])
    mean, rest = [np.zeros(len(x))], [np.zeros(len(x))]
    for a, b in zip(cuts, cuts[1:]):
        part = x[:, a:b]
        m = part.mean(axis=1)
        mean.append(m * np.sqrt(b - a))
        rest.append(np.sqrt(((part - m[:, None]) ** 2).sum(axis=1)))
    return np.stack(mean, axis=1), np.stack(rest, axis=1)


def bound(q: tuple, c: tuple) -> np.ndarray:
    """Upper bounds of all inner products; a little is added for rounding."""
    top = q[0] @ c[0].T + q[1] @ c[1].T
    return top + 1e-9 * np.abs(top) + 1e-6


class Best:
    """The k best candidates so far of every query of a block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.float = values.astype(np.float64)
        self.stats = [statistics(self.float, n) for n in LEVELS]
        self.score = np.full((len(ids), k), NONE, np.int64)
        self.found = np.zeros((len(ids), k), np.int64)

    def meet(self, ids: np.ndarray, values: np.ndarray, stats: list) -> None:
        keep = np.arange(len(ids))
        least = self.score[:, -1:]
        for own, other in zip(self.stats, stats):
            keep = keep[(bound(own, (other[0][keep], other[1][keep])) >= least).any(axis=0)]
        if not len(keep):
            return
        ids, values = ids[keep], values[keep]
        largest = float(np.abs(self.values).max(initial=0)) * float(np.abs(values).max(initial=0)) * max(1, values.shape[1])
        exact = (self.float @ values.astype(np.float64).T).astype(np.int64) if largest < 2**53 else self.values @ values.T
        exact[ids[None, :] == self.ids[:, None]] = NONE
        score = np.concatenate([self.score, exact], axis=1)
        found = np.concatenate([self.found, np.broadcast_to(ids, exact.shape)], axis=1)
        last = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
        for i in range(len(score)):
            some = np.flatnonzero(score[i] >= last[i])
            order = some[np.lexsort((found[i, some], -score[i, some]))[:self.k]]
            self.score[i], self.found[i] = score[i, order], found[i, order]

    def rows(self) -> pa.RecordBatch:
        some = self.score.ravel() > NONE
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(self.ids, self.k)[some]), pa.array(self.found.ravel()[some]),
            pa.array(self.score.ravel()[some])], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, dim, v): whole numbers floor(1024 x) of the vectors without null or non-finite components."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite)
            .select(F.col(id).cast("long").alias("vec_id"), F.size(vector).alias("dim"),
                    F.transform(vector, lambda x: F.floor(F.lit(1024.0) * x.cast("double"))).alias("v")))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(dim, n, ids, data): up to `size` rows of one dimension packed into one."""
    def packed(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                ids, data = some.column(0).to_numpy(), some.column(2).flatten().to_numpy().reshape(len(some), -1)
                for a in range(0, len(ids), size):
                    part = ids[a:a + size]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([dim], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([part.astype("<i8").tobytes()]),
                        pa.array([data[a:a + size].astype("<i8").tobytes()])], names=["dim", "n", "ids", "data"])

    return rows.mapInArrow(packed, "dim int, n int, ids binary, data binary")


def search(vectors: DataFrame, queries: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = 10,
           tasks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller id.

    Queries are rows of the same form; a query's own id is no candidate of it. Null ids and vectors that are null or
    hold null or non-finite components take no part; vectors of another dimension are no candidates. Rows that share an
    id are candidates each by itself, and queries that share an id are searched once, by the smallest vector. Other
    columns are ignored; an empty table gives no rows. Scores have to fit into a long.

    tasks: cells of a grid of query groups and candidate slots; by default they grow with the candidates. The grid is as
    wide as makes the copies of queries (one a slot) and of candidates (one a group) together the fewest. Only k rows a
    query leave a cell.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n_queries, n_vectors = queries.count(), vectors.count()
    tasks = tasks or max(8, math.ceil(n_vectors / (16 * BLOCK)))
    groups = min(tasks, max(1, round(math.sqrt(tasks * n_queries / max(1, n_vectors)))))
    slots = math.ceil(tasks / groups)
    mine = usable(queries, id, vector).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    asked = (blocks(mine, QUERIES).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                                          F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"),
                                          F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")))
    held = (blocks(usable(vectors, id, vector), BLOCK)
            .withColumns({"slot": F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"),
                          "group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))}))

    def met(batches):
        best: dict[tuple[int, bytes], Best] = {}
        for batch in batches:
            for dim, q_ids, q_data, ids, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                key = dim, q_ids
                if key not in best:
                    if len(best) == 64:
                        for b in best.values():
                            yield b.rows()
                        best.clear()
                    own = np.frombuffer(q_ids, "<i8")
                    best[key] = Best(own, np.frombuffer(q_data, "<i8").reshape(len(own), -1), k)
                other = np.frombuffer(ids, "<i8")
                values = np.frombuffer(data, "<i8").reshape(len(other), -1)
                float_values = values.astype(np.float64)
                best[key].meet(other, values, [statistics(float_values, n) for n in LEVELS])
        for b in best.values():
            yield b.rows()

    pairs = asked.join(held, ["dim", "group", "slot"]).select("dim", "q_ids", "q_data", "ids", "data")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (pairs.mapInArrow(met, "query_id long, vec_id long, score long").withColumn("rank", rank)
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
