"""Links between vectors of high cosine, by int8 tile products with rigorous bounds of the quantisation error.

Equal vectors are one node with a weight. Nodes are dealt to the nearest of a few pivots and, in order of their angle to
it, packed into tiles of up to a mebibyte. A tile knows the range of its angles to every pivot. By the triangle
inequality, a pair of tiles has no link if two ranges lie further apart than the threshold's angle, and all links if both
lie close enough around their pivot; neither is multiplied. For the others, vectors are rounded to int8 with a scale each,
so that products are exact whole numbers. The norms of what rounding took off bound the error of every cosine: pairs surely
above or below the threshold are decided by that, and only the rest is computed again in double precision.

Nothing is lost: pruning and bounds are exact. A pair of tiles hands on sums and a spanning forest of its links, never all
pairs. Where the angles to the pivots say nothing, as with vectors of no structure, all pairs of tiles are multiplied, and
the work grows with the square of the different vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evengap.llm.common import stored
from evengap.llm.graph import components
from evengap.llm.manifest import numbered

TILE_BYTES, TILE_ROWS = 1 << 20, 4096
#: Vectors from which pivots are chosen, by a hash of the vector; most pivots.
SAMPLE, PIVOTS = 2048, 64
#: Angles and cosines in double precision are taken to be right to this.
ANGLE_SLACK, SLACK = 1e-6, 1e-11
#: Rows of a tile that are multiplied at once; pairs computed again at once.
STRIP, AGAIN = 512, 65_536
#: Tiles that meet a tile in one task.
GUESTS = 32


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def choose_pivots(u: np.ndarray, most: int, within: float) -> np.ndarray:
    """First the vectors that cover most others within an angle, then those furthest from all chosen."""
    if len(u) <= 1 or most <= 1:
        return u[:1]
    near = u @ u.T >= math.cos(within)
    left, chosen = np.ones(len(u), bool), []
    while len(chosen) < most:
        covered = near @ left.astype(np.float32)
        best = int(np.argmax(covered))
        if covered[best] < max(8, len(u) // 256):
            break
        chosen.append(best)
        left &= ~near[best]
    top = (u @ u[chosen].T).max(axis=1) if chosen else np.full(len(u), -1.0)
    while len(chosen) < min(most, len(u)):
        chosen.append(int(np.argmin(top)))
        top = np.maximum(top, u @ u[chosen[-1]])
    return u[chosen]


class Tile(NamedTuple):
    """Vectors of a tile: their int8 forms (as float32, which holds all their products), scales, and error bounds."""
    nodes: np.ndarray
    weights: np.ndarray
    unit: np.ndarray
    small: np.ndarray
    scale: np.ndarray
    length: np.ndarray
    error: np.ndarray


def quantise(nodes: np.ndarray, weights: np.ndarray, unit: np.ndarray) -> Tile:
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None])
    rounded = small * scale[:, None]
    error = np.sqrt(((unit - rounded) ** 2).sum(axis=1))
    # sums of up to 1,040 products of int8 are exact in float32
    kind = np.float32 if unit.shape[1] <= 1040 else np.float64
    return Tile(nodes, weights, unit, small.astype(np.int8).astype(kind), scale, np.sqrt((rounded ** 2).sum(axis=1)), error)


def linked(a: Tile, b: Tile, least: float) -> np.ndarray:
    """Which pairs have a cosine of at least `least`, as a matrix.

    |x.y - x'.y'| <= |x'| |y - y'| + |x - x'| |y| for the rounded x' and y', with |y| = 1.
    """
    out = np.empty((len(a.nodes), len(b.nodes)), bool)
    for begin in range(0, len(a.nodes), STRIP):
        s = slice(begin, begin + STRIP)
        cosine = (a.small[s] @ b.small.T).astype(np.float64)
        cosine *= a.scale[s, None]
        cosine *= b.scale
        bound = a.length[s, None] * b.error
        bound += a.error[s, None] + SLACK
        out[s] = cosine - bound >= least
        i, j = np.nonzero((cosine + bound >= least) & ~out[s])
        for at in range(0, len(i), AGAIN):
            p, q = i[at:at + AGAIN] + begin, j[at:at + AGAIN]
            out[p, q] = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= least
    return out


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect all that the links connect; at most one for each row and column."""
    if np.count_nonzero(link) <= sum(link.shape):
        return np.nonzero(link)
    turned = np.ascontiguousarray(link.T)
    new_row, new_column = link.any(axis=1), link.any(axis=0)
    rows, columns = [], []
    for start in np.flatnonzero(new_row):
        if not new_row[start]:
            continue
        new_row[start], reached = False, [start]
        while reached:
            step = []
            for i in reached:
                found = np.flatnonzero(link[i] & new_column)
                new_column[found] = False
                rows.append(np.full(len(found), i))
                columns.append(found)
                step.extend(found)
            reached = []
            for j in step:
                found = np.flatnonzero(turned[j] & new_row)
                new_row[found] = False
                rows.append(found)
                columns.append(np.full(len(found), j))
                reached.extend(found)
    return np.concatenate(rows), np.concatenate(columns)


def pivots_of(nodes: DataFrame, total: int, within: float, tile_rows: int) -> dict[int, np.ndarray]:
    """Pivots for every number of dimensions that the sample holds: one for four full tiles, up to `PIVOTS`."""
    most = max(1, min(PIVOTS, total // (4 * tile_rows)))
    some: dict[int, list] = {}
    for row in nodes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toLocalIterator():
        some.setdefault(len(row.v), []).append(row.v)
    return {d: choose_pivots(units(np.array(x)), most, within) for d, x in some.items()}


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def placed(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(node, grp, angle): the nearest pivot of every node, and the angle to it."""
    def near(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                cell, angle = np.zeros(len(some), int), np.zeros(len(some))
                if d in pivots:
                    all_angles = angles(units(matrix(some.column(2), d)), pivots[d])
                    cell = all_angles.argmin(axis=1)
                    angle = all_angles[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([f"{d}:{c}" for c in cell]), pa.array(angle)],
                                                 names=["node", "grp", "angle"])

    return nodes.select("node", "dim", "v").mapInArrow(near, "node long, grp string, angle double")


TILE = "tile string, dim int, cell int, n int, low array<double>, high array<double>, nodes binary, weights binary, data binary"


def tiles(nodes: DataFrame, pivots: dict[int, np.ndarray], tile_rows: int) -> DataFrame:
    """Nodes packed in order of their angle; low and high are the angles to all pivots."""
    kind = "<f4" if nodes.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    size = F.greatest(F.lit(4), F.least(F.lit(tile_rows), F.floor(F.lit(TILE_BYTES // int(kind[2])) / F.col("dim"))))
    places = numbered(placed(nodes, pivots), ["angle"]).select("node", "grp", "place")
    rows = (nodes.join(places, "node").withColumn("tile", F.concat_ws("/", "grp", F.floor(F.col("place") / size)))
            .select("tile", "node", "weight", "dim", "v").repartition("tile").sortWithinPartitions("tile"))

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        name, d = table["tile"][0].as_py(), table["dim"][0].as_py()
        x = np.concatenate([matrix(c, d) for c in table["v"].chunks]).astype(kind)
        spread = angles(units(x), pivots[d]) if d in pivots else np.zeros((len(x), 1))
        return pa.RecordBatch.from_arrays([
            pa.array([name]), pa.array([d], pa.int32()), pa.array([int(name.split("/")[0].split(":")[1])], pa.int32()), pa.array([len(x)], pa.int32()),
            pa.array([spread.min(axis=0).tolist()]), pa.array([spread.max(axis=0).tolist()]),
            *(pa.array([b]) for b in (table["node"].to_numpy().astype("<i8").tobytes(), table["weight"].to_numpy().astype("<i8").tobytes(), x.tobytes()))],
            names=["tile", "dim", "cell", "n", "low", "high", "nodes", "weights", "data"])

    def pack(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != names[a]:
                    yield packed(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(held)

    return rows.mapInArrow(pack, TILE)


def pairs(marks: DataFrame, count: int, within: float) -> DataFrame:
    """(a, b, sure): pairs of tiles, a <= b, that may hold links; sure: every pair of their vectors is one."""
    parts = max(1, math.ceil(math.sqrt(count) / 8))
    share = F.pmod(F.xxhash64("tile"), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def side(x: str) -> DataFrame:
        own = marks.select(F.col("tile").alias(x), "dim", F.col("cell").alias(f"{x}_cell"), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"),
                           share.alias("_mine"))
        i, j = (F.col("_mine").cast("int").alias("i"), every.alias("j")) if x == "a" else (every.alias("i"), F.col("_mine").cast("int").alias("j"))
        return own.select("*", i, j).drop("_mine")

    apart = F.exists(F.zip_with("a_low", "b_high", lambda x, y: x - y), lambda g: g > within + ANGLE_SLACK) | F.exists(
        F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda g: g > within + ANGLE_SLACK)
    far = F.element_at("a_high", F.col("a_cell") + 1) + F.element_at("b_high", F.col("b_cell") + 1)
    together = (F.col("a_cell") == F.col("b_cell")) & (far <= within - ANGLE_SLACK) & (F.size("a_high") > 0)
    return side("a").join(side("b"), ["dim", "i", "j"]).where((F.col("a") <= F.col("b")) & ~apart).select("a", "b", together.alias("sure"))


def products(work: DataFrame, held: DataFrame, count: int, least: float, kind: str) -> DataFrame:
    """(a, b, n): for b null, n linked rows more for node a; else a link of a spanning forest."""
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    chunks = max(1, count // GUESTS)
    work = work.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("guest"),
                       F.pmod(F.xxhash64("b", "a"), F.lit(chunks)).alias("chunk"))
    blob = held.select("tile", "dim", "nodes", "weights", "data")
    heads = work.select("host", "chunk").distinct().withColumn("guest", F.lit(None).cast("string"))
    sent = (heads.join(blob, heads["host"] == blob["tile"]).unionByName(work.join(blob, work["guest"] == blob["tile"]))
            .select("host", "chunk", "guest", "dim", "nodes", "weights", "data")
            .repartition("host", "chunk").sortWithinPartitions("host", "chunk", F.col("guest").asc_nulls_first()))

    def rows(a, b, n):
        some = n > 0
        return pa.RecordBatch.from_arrays([pa.array(a[some]), pa.nulls(int(some.sum()), pa.int64()) if b is None else pa.array(b[some]), pa.array(n[some])],
                                          names=["a", "b", "n"])

    def met(batches) -> Iterator[pa.RecordBatch]:
        host, own = None, np.zeros(0, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                name, _, guest, d, nodes, weights, data = (c[r].as_py() for c in batch.columns)
                tile = quantise(np.frombuffer(nodes, "<i8"), np.frombuffer(weights, "<i8"), units(np.frombuffer(data, kind).reshape(-1, d)))
                if guest is None:
                    if host is not None:
                        yield rows(host.nodes, None, own)
                    host, own = tile, np.zeros(len(tile.nodes), np.int64)
                    continue
                link = linked(host, tile, least)
                if guest == name:
                    np.fill_diagonal(link, False)
                else:
                    yield rows(tile.nodes, None, host.weights @ link)
                own += link @ tile.weights
                i, j = forest(link)
                yield rows(host.nodes[i], tile.nodes[j], np.ones(len(i), np.int64))
        if host is not None:
            yield rows(host.nodes, None, own)

    return sent.mapInArrow(met, "a long, b long, n long")


def unpacked(held: DataFrame) -> DataFrame:
    """(tile, node) of every node."""
    def out(batches):
        for batch in batches:
            for name, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(nodes, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(own)], names=["tile", "node"])

    return held.select("tile", "nodes").mapInArrow(out, "tile string, node long")


def certain(near: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, n) as of `products` for pairs of tiles that are linked throughout.

    They share their pivot, and with any such pair the innermost tile of the pivot makes one too, also with itself. So all
    links are connected through one node of the innermost tile.
    """
    both = near.select(F.col("a").alias("tile"), F.col("b").alias("other")).unionByName(
        near.where("a <> b").select(F.col("b").alias("tile"), F.col("a").alias("other")))
    nodes = unpacked(held)
    weight = held.select("tile", "cell", "dim", "mass", F.element_at("high", F.col("cell") + 1).alias("far"), "first")
    sums = both.join(weight.select(F.col("tile").alias("other"), "mass"), "other").groupBy("tile").agg(F.sum("mass").alias("n"))
    inner = (weight.join(sums.select("tile"), "tile", "left_semi").groupBy("dim", "cell").agg(F.min(F.struct("far", "first")).alias("x"))
             .select("dim", "cell", F.col("x.first").alias("hub")))
    found = nodes.join(sums.join(weight.select("tile", "dim", "cell"), "tile").join(inner, ["dim", "cell"]).select("tile", "n", "hub"), "tile")
    return found.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "n").unionByName(
        found.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), F.lit(1).cast("long").alias("n")))


def links(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", least: float = 0.9,
          tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of the table.

    n_links counts the other rows whose cosine with this one is at least `least`, component_id is the smallest id that links
    reach, itself included; kept says whether that is the row's own. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different dimensions. Rows that share an id are vectors of
    their own. A null id counts as a link, but is never a component's id unless it has no other. Other columns are ignored;
    an empty table gives no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be positive, and at most 1")
    within = math.acos(least)
    element = vectors.schema[vector].dataType.elementType.typeName()
    v = F.col(vector) if element in ("float", "double") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id).alias("vec_id"), F.when(usable(v), v).alias("v"))
    nodes = (rows.where("v is not null").groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
             .select(F.monotonically_increasing_id().alias("node"), "weight", "low", F.size("v").alias("dim"), "v"))
    nodes = stored(nodes, "nodes")
    pivots = pivots_of(nodes, nodes.count(), within / 2, tile_rows)
    packed = stored(tiles(nodes, pivots, tile_rows), "tiles")
    kind = "<f4" if element == "float" else "<f8"

    def weigh(batches):
        for batch in batches:
            sums = [int(np.frombuffer(w, "<i8").sum()) for w in batch.column(1).to_pylist()]
            first = [int(np.frombuffer(x, "<i8").min()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(first, pa.int64())], names=["tile", "mass", "first"])

    masses = packed.select("tile", "weights", "nodes").mapInArrow(weigh, "tile string, mass long, first long")
    marks = stored(packed.select("tile", "dim", "cell", "n", "low", "high").join(masses, "tile"), "marks")
    count = marks.count()
    work = stored(pairs(marks, count, within), "pairs")
    sure = work.where("sure")
    found = products(work.where("not sure"), packed, count, least, kind)
    if not sure.isEmpty():
        found = found.unionByName(certain(sure, packed.select("tile", "nodes").join(marks, "tile")))
    found = stored(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    # a node of a sure tile was counted with itself
    inside = sure.where("a = b").select(F.col("a").alias("tile"))
    alone = unpacked(packed.join(inside, "tile", "left_semi")).select("node", F.lit(1).alias("own")) if not inside.isEmpty() else None
    roots = components(found.where("b is not null").select("a", "b"))
    placed_nodes = nodes.select("node", "low", "weight", "v").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed_nodes = placed_nodes.join(counts, "node", "left")
    own = F.lit(0)
    if alone is not None:
        placed_nodes, own = placed_nodes.join(alone, "node", "left"), F.coalesce("own", F.lit(0)) * F.col("weight")
    placed_nodes = placed_nodes.withColumn("n", F.coalesce("n", F.lit(0)) - own + F.col("weight") - 1)
    lowest = placed_nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = placed_nodes.join(lowest, "root").select("v", "n", "component_id")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (rows.join(answer, "v", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


#: Only for small tables: it compares all pairs.
SQL = """
WITH RECURSIVE ok AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT r.a, p.b FROM reached AS r JOIN pairs AS p ON r.b = p.a),
lowest AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""
