"""Boosted trees on gradient histograms, grown leaf by leaf, with missing values, categories and early stopping.

Features become bytes: at most 255 bins, and one for missing values. Every pass over the rows adds up gradients, curvatures
and counts per (node, feature, bin) inside each task. A few such sums go to the driver; where there are more, those of a
(node, feature) meet in one task, which finds the best split, so that the driver gets a row per node and feature, however
many rows there are. The leaf of the largest gain is split first. A pass looks at all leaves that this order may need next,
so a tree takes about as many passes as it has levels. Executors keep the rows in blocks with their scores, in memory as far
as it goes; every few rounds new scores replace the old ones, and between, tasks add the latest trees themselves.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from evengap.operators.skew import durable, passing

MISSING = 255
#: Rounds whose trees are added by the tasks before new scores are kept.
FRESH = 8
#: Histograms of six kilobytes that the driver adds up itself; more of them meet in tasks.
GATHERED = 4_000
SPLIT = Row("node", "feature", "gain", "sides", "left", "total")
LEAST_CURVATURE = 1e-3

# Default parameters of the boosted trees.
DEFAULTS = {"learning_rate": 0.1, "max_leaf_nodes": 31, "min_samples_leaf": 20, "l2_regularization": 0.0, "max_depth": None,
            "max_iter": 200, "max_features": 1.0}


# ---- bins

def fit_bins(train: DataFrame, columns: Sequence[str], categories: Sequence[str] = (), most: int = MISSING) -> dict:
    """Cut points of numeric columns and codes of categories, from all rows.

    A column of few different values is cut between each two of them, others at quantiles. Categories are numbered by
    frequency, the rarest beyond `most` count as missing.
    """
    numeric = [c for c in columns if c not in categories]
    bins: dict = {"columns": list(columns), "cuts": {}, "codes": {}}
    value = {c: F.col(c).cast("double") for c in numeric}
    value = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    few = numeric
    if numeric:
        # a rough count, of 52 longs a column where one to two per cent takes 410; below, `seen` decides exactly
        counted = train.agg(*[F.approx_count_distinct(v).alias(c) for c, v in value.items()]).first()
        few = [c for c in numeric if counted[c] <= 1.3 * most]
    seen: dict[str, list] = {c: [] for c in [*few, *categories]}
    if seen:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), value[c].alias("v"), F.lit(None).cast("string").alias("s")) for c in few],
                        *[F.struct(F.lit(c).alias("c"), F.lit(None).cast("double").alias("v"), F.col(c).cast("string").alias("s")) for c in categories])
        rows = (train.select(F.explode(cells).alias("x")).select("x.*").where("v is not null or s is not null")
                .groupBy("c", "v", "s").agg(F.count(F.lit(1)).alias("n")))
        top = F.row_number().over(_by("c").orderBy(F.desc("n"), "s", "v"))
        for r in rows.withColumn("place", top).where(F.col("place") <= most + 1).orderBy("c", "place").collect():
            seen[r.c].append(r.v if r.s is None else r.s)
    for c in categories:
        bins["codes"][c] = {s: i for i, s in enumerate(seen[c][:most])}
    many = [c for c in numeric if c not in few or len(seen[c]) > most]
    for c in (c for c in few if c not in many):
        values = sorted(seen[c])
        bins["cuts"][c] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if many:
        places = [i / most for i in range(1, most)]
        found = train.agg(*[F.percentile_approx(value[c], places, 20_000).alias(c) for c in many]).first()
        for c in many:
            bins["cuts"][c] = sorted(set(found[c] or []))
    return bins


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def binned(frame: pd.DataFrame, bins: dict) -> np.ndarray:
    """A byte for each row and column; a value equal to a cut lies below it."""
    out = np.full((len(frame), len(bins["columns"])), MISSING, np.uint8)
    for i, c in enumerate(bins["columns"]):
        if c in bins["codes"]:
            codes = frame[c].map(bins["codes"][c])
            out[:, i] = codes.fillna(MISSING).astype(np.uint8)
        else:
            x = frame[c].to_numpy(np.float64, na_value=np.nan)
            known = ~np.isnan(x)
            out[known, i] = np.searchsorted(bins["cuts"][c], x[known], "left")
    return out


# ---- trees

class Tree:
    """Nodes as arrays; `goes_left` holds for every inner node and bin, missing ones too, where its rows go."""

    def __init__(self):
        self.feature, self.left, self.right, self.value, self.goes_left = [], [], [], [], []
        self.add()

    def add(self) -> int:
        self.feature.append(-1)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(0.0)
        self.goes_left.append(np.zeros(256, bool))
        return len(self.feature) - 1

    def parts(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, its rows in ascending order) of every leaf that rows of x, best stored by column, end in."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                yield node, rows
                continue
            sides = self.goes_left[node][x[:, self.feature[node]][rows]]
            todo += [(n, r) for n, r in ((self.left[node], rows[sides]), (self.right[node], rows[~sides])) if len(r)]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for node, rows in self.parts(x):
            at[rows] = node
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]

    def dump(self) -> dict:
        return {"feature": self.feature, "left": self.left, "right": self.right, "value": self.value,
                "goes_left": [np.packbits(s).tobytes().hex() if f >= 0 else "" for s, f in zip(self.goes_left, self.feature)]}

    @classmethod
    def load(cls, d: dict) -> "Tree":
        t = cls.__new__(cls)
        t.feature, t.left, t.right, t.value = d["feature"], d["left"], d["right"], d["value"]
        t.goes_left = [np.unpackbits(np.frombuffer(bytes.fromhex(h), np.uint8)).astype(bool) if h else np.zeros(256, bool) for h in d["goes_left"]]
        return t


def best_split(hist: np.ndarray, category: bool, l2: float, least: int) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(gain, which bins go left, sums on the left) of a node's histogram (256 x gradient, curvature, rows) of one feature.

    Numeric bins are cut in order, with the missing ones on either side; categories, missing being one, in order of
    gradient by curvature. Of equal gains the first cut counts, missing to the right first.
    """
    total = hist.sum(axis=0)
    order = np.arange(MISSING)
    if category:
        some = np.flatnonzero(hist[:, 2] > 0)
        order = some[np.argsort(hist[some, 0] / (hist[some, 1] + l2 + 1e-12), kind="stable")]
    below = np.cumsum(hist[order], axis=0)
    tries = [(below, False)]
    if not category and hist[MISSING, 2] > 0:
        tries.append((below + hist[MISSING], True))
    best = None
    whole = total[0] ** 2 / (total[1] + l2 + 1e-300)
    for left, with_missing in tries:
        right = total - left
        fits = (left[:, 2] >= least) & (right[:, 2] >= least) & (left[:, 1] >= LEAST_CURVATURE) & (right[:, 1] >= LEAST_CURVATURE)
        if not fits.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[:, 0] ** 2 / (left[:, 1] + l2) + right[:, 0] ** 2 / (right[:, 1] + l2) - whole
        gain[~fits] = -np.inf
        at = int(np.argmax(gain > gain.max() - 1e-12 * (1 + abs(gain.max()))))
        if best is None or gain[at] > best[0] + 1e-12 * (1 + abs(best[0])):
            sides = np.zeros(256, bool)
            sides[order[:at + 1]] = True
            sides[MISSING] = with_missing if not category else sides[MISSING]
            best = float(gain[at]), sides, left[at]
    if best is None or best[0] <= 1e-12:
        return None
    if category and hist[MISSING, 2] == 0:  # what was never seen goes where most rows go
        best[1][hist[:, 2] == 0] = best[2][2] * 2 > total[2]
    elif not category and hist[MISSING, 2] == 0:
        best[1][MISSING] = best[2][2] * 2 > total[2]
    return best


#: A block of rows in one: bins column by column, labels, weights, held-out marks and scores, each as bytes.
BLOCKS = "bins binary, y binary, w binary, held_out binary, f binary"
KINDS = (np.uint8, np.int8, np.float64, np.bool_, np.float64)


def block(*columns: np.ndarray) -> tuple[bytes, ...]:
    return tuple(c.astype(t).tobytes() for c, t in zip(columns, KINDS))


def blocks(data: DataFrame, start: float) -> RDD:
    """The rows (bins, y, w, held_out) in blocks, all with the same score, kept by the executors.

    They are written once, dealt over all cores, so that a lost executor costs no more than reading its blocks again.
    """
    def out(batches):
        for batch in batches:
            if batch.num_rows:
                y, w, held = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4))
                bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(y), -1)
                made = block(bins.T, y, w, held, np.full(len(y), start))
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()) for raw in made], names=["bins", "y", "w", "held_out", "f"])

    rows = data.select("bins", F.col("y").cast("int"), F.col("w").cast("double"), "held_out").mapInArrow(out, BLOCKS)
    cores = data.sparkSession.sparkContext.defaultParallelism
    few = rows.rdd.getNumPartitions() < cores
    return durable(rows.repartition(cores) if few else rows).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def rows_of(made: Iterator[tuple], trees: list[Tree], width: int):
    """(bins, y, w, held, score) of every block, with the scores of `trees` added."""
    for raw in made:
        x, y, w, held, f = (np.frombuffer(r, t) for r, t in zip(raw, KINDS))
        x = x.reshape(width, len(y)).T
        yield x, y, w, held, f + sum((t.scores(x) for t in trees), np.zeros(len(x)))


@functools.cache
def settled() -> None:
    """Spares a Python worker, which collects garbage after every task, all the modules it has loaded."""
    gc.freeze()


def look(data: RDD, width: int, trees: list[Tree], tree: Tree, nodes: list[int], kinds: np.ndarray, l2: float, least: int) -> tuple[dict, float | None]:
    """The best split of every node and feature, as {(node, feature): Row}; and the held-out loss before this tree."""
    wanted, n = {node: i for i, node in enumerate(nodes)}, len(nodes)

    def summed(made):
        settled()
        parts = np.zeros((width, 3, n * 256))
        loss = np.zeros(2)
        for x, y, w, held, f in rows_of(made, trees, width):
            if held.any():
                margin = np.where(y[held] == 1, -f[held], f[held])
                loss += (w[held] * np.logaddexp(0, margin)).sum(), w[held].sum()
            # where the histogram of a row's node begins; rows that are not wanted come behind all of them
            base = np.full(len(x), n * 256, np.intp)
            for node, rows in tree.parts(x):
                if node in wanted:
                    base[rows] = wanted[node] * 256
            base[held] = n * 256
            rows = np.flatnonzero(base < n * 256)
            if not len(rows):
                continue
            if some := 4 * len(rows) < 3 * len(x):  # else to leave them out costs more than to count them
                base, y, w, f = base[rows], y[rows], w[rows], f[rows]
            p = 1 / (1 + np.exp(-f))
            g, h = w * (p - y), w * p * (1 - p)
            for i, sums in enumerate(parts):
                at = base + (x[:, i][rows] if some else x[:, i])
                for j, weights in enumerate((g, h, None)):
                    sums[j] += np.bincount(at, weights, minlength=(n + 1) * 256)[:n * 256]
        return parts.reshape(width, 3, n, 256).transpose(2, 0, 3, 1), loss

    def searched(key: int, hist: np.ndarray) -> Row:
        found = best_split(hist, bool(kinds[key % width]), l2, least)
        return SPLIT(nodes[key // width], key % width, found and found[0], found and np.packbits(found[1]).tobytes(),
                     found[2].tolist() if found else [], hist.sum(axis=0).tolist())

    def keyed(made):
        parts, loss = summed(made)
        yield -1, loss
        for key, hist in enumerate(parts.reshape(n * width, 256, 3)):
            if hist[:, 2].any():
                yield key, hist.copy()

    def met(pairs):
        sums: dict = {}
        for key, part in pairs:
            sums[key] = sums[key] + part if key in sums else part
        for key, total in sums.items():
            yield key, total if key < 0 else searched(key, total)

    if n * width * data.getNumPartitions() <= GATHERED:
        got = data.mapPartitions(lambda made: [summed(made)]).collect()
        hists, loss = sum(h for h, _ in got).reshape(n * width, 256, 3), sum(x for _, x in got)
        rows = [searched(key, hist) for key, hist in enumerate(hists) if hist[:, 2].any()]
    else:  # as many tasks as have some work with histograms of six kilobytes
        got = data.mapPartitions(keyed).partitionBy(max(1, min(n * width // 50, 1000)), lambda key: key).mapPartitions(met).collect()
        loss, rows = next(x for key, x in got if key < 0), [r for key, r in got if key >= 0]
    return {(r.node, r.feature): r for r in rows}, float(loss[0] / loss[1]) if loss[1] else None


def grow(data: RDD, width: int, trees: list[Tree], p: dict, kinds: np.ndarray, rng: np.random.Generator) -> tuple[Tree, float | None]:
    """The next tree, its values still without the learning rate; and the held-out loss before it."""
    tree, depth, split, sums, evaluated = Tree(), {0: 0}, {}, {}, set()
    l2, least, most = p["l2_regularization"], p["min_samples_leaf"], p["max_leaf_nodes"] or 1 << 30
    children: dict[int, tuple[int, int]] = {}
    todo, loss = [0], None
    while todo:
        found, held = look(data, width, trees, tree, todo, kinds, l2, least)
        loss = held if not evaluated else loss
        for node in todo:
            evaluated.add(node)
            mine = [found[node, i] for i in range(width) if (node, i) in found]
            if not mine:
                continue
            sums[node] = mine[0].total
            allowed = set(range(width)) if p["max_features"] >= 1 else set(rng.permutation(width)[:max(1, round(p["max_features"] * width))].tolist())
            mine = [r for r in mine if r.gain is not None and r.feature in allowed]
            if mine:
                split[node] = max(mine, key=lambda r: (r.gain, -r.feature))
        # the order of largest gains, as far as it is known; leaves behind all splits cannot change it
        ready = [(-split[0].gain, 0)] if 0 in split else []
        leaves, chosen = 1, []
        while ready and leaves < most:
            _, node = heapq.heappop(ready)
            chosen.append(node)
            leaves += 1
            if node not in children:
                r = split[node]
                children[node] = tree.add(), tree.add()
                tree.feature[node], (tree.left[node], tree.right[node]) = r.feature, children[node]
                tree.goes_left[node] = np.unpackbits(np.frombuffer(r.sides, np.uint8)).astype(bool)
                sums[children[node][0]], sums[children[node][1]] = r.left, [t - x for t, x in zip(sums[node], r.left)]
                for c in children[node]:
                    depth[c] = depth[node] + 1
            for c in children[node]:
                if c in split:
                    heapq.heappush(ready, (-split[c].gain, c))
        room = lambda c: sums[c][2] >= 2 * least and (p["max_depth"] is None or depth[c] < p["max_depth"])
        last = chosen[-1:] if leaves >= most else []
        todo = [c for n in chosen if n not in last for c in children[n] if c not in evaluated and room(c)]
    for node in set(children) - set(chosen):  # looked at ahead, but not in the order
        tree.feature[node] = -1
    for node, (g, h, _) in ((n, s) for n, s in sums.items()):
        tree.value[node] = -g / (h + l2) if h + l2 > 0 else 0.0
    return tree, loss


def boost_trees(data: DataFrame, bins: dict, params: dict, patience: int | None, seed: int = 0) -> tuple[float, list[Tree], list[float]]:
    """(start, trees, held-out loss before each tree and after the last) for rows (bins, y, w, held_out).

    With a patience, growing ends that many rounds after the lowest held-out loss, and the trees after it are cut off.
    """
    p = {**DEFAULTS, **params}
    width = len(bins["columns"])
    kinds = np.array([c in bins["codes"] for c in bins["columns"]])
    ones = data.where("not held_out").agg(F.sum(F.col("w") * F.col("y")).alias("one"), F.sum("w").alias("all")).first()
    share = (ones["one"] or 0.0) / ones["all"] if ones["all"] else 0.5
    start = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    trees: list[Tree] = []
    losses: list[float] = []
    fresh = 0
    rng = np.random.default_rng(seed)

    def done() -> bool:
        return patience is not None and len(losses) > patience and int(np.argmin(losses)) <= len(losses) - 1 - patience

    with passing(data.sparkSession):
        state, old = blocks(data, start), None
        try:
            for _ in range(p["max_iter"]):
                tree, loss = grow(state, width, trees[fresh:], p, kinds, rng)
                if old is not None:  # the passes of a tree have made the new scores
                    old.unpersist()
                    old = None
                if loss is not None:
                    losses.append(loss)
                if done() or tree.feature[0] < 0:
                    break
                tree.value = [v * p["learning_rate"] for v in tree.value]
                trees.append(tree)
                if len(trees) - fresh >= FRESH:
                    old, state, fresh = state, rescored(state, width, trees[fresh:]), len(trees)
            if patience is not None and losses:
                if len(losses) == len(trees):
                    _, loss = look(state, width, trees[fresh:], Tree(), [0], kinds, 0.0, 1)
                    losses.append(loss)
                trees = trees[:int(np.argmin(losses))]
        finally:
            for kept in (state, old):
                if kept is not None:
                    kept.unpersist()
    return start, trees, losses


def rescored(state: RDD, width: int, trees: list[Tree]) -> RDD:
    def out(made):
        for x, *columns in rows_of(made, trees, width):
            yield block(x.T, *columns)

    return state.mapPartitions(out).persist(StorageLevel.MEMORY_AND_DISK)


# ---- stages of a pipeline, which can be saved and loaded

class Binner(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `bins`, a byte for each feature."""

    spec = Param(Params._dummy(), "spec", "cuts and codes as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec: str = "{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        bins = json.loads(self.getOrDefault(self.spec))

        @F.pandas_udf("binary")
        def as_bytes(frame: pd.DataFrame) -> pd.Series:
            return pd.Series([r.tobytes() for r in binned(frame, bins)], dtype=object)

        own = [F.col(c).cast("string" if c in bins["codes"] else "double").alias(c) for c in bins["columns"]]
        return df.withColumn("bins", as_bytes(F.struct(*own)))


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability` from `bins`."""

    trees = Param(Params._dummy(), "trees", "start, trees and held-out losses as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str = "{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _content(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def numTrees(self) -> int:
        return len(self._content()["trees"])

    @property
    def heldOutLosses(self) -> list[float]:
        """Before the first tree, and after every tree that was grown, those cut off included."""
        return self._content()["losses"]

    def _transform(self, df: DataFrame) -> DataFrame:
        d = self._content()
        width, start, trees = d["width"], d["start"], [Tree.load(t) for t in d["trees"]]

        @F.pandas_udf("double")
        def chance(raw: pd.Series) -> pd.Series:
            x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), width)
            return pd.Series(1 / (1 + np.exp(-(start + sum((t.scores(x) for t in trees), np.zeros(len(x)))))))

        out = df.withColumn("__p", chance("bins"))
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__p")


def fit_trees(data: DataFrame, bins: dict, params: dict, patience: int | None = None, seed: int = 0) -> BoostedTrees:
    start, trees, losses = boost_trees(data, bins, params, patience, seed)
    return BoostedTrees(trees=json.dumps({"width": len(bins["columns"]), "start": start, "trees": [t.dump() for t in trees], "losses": losses}))
