"""Vector links against all pairs in double precision."""

import math

import numpy as np
import pytest

from evengap.llm import closeness

SCHEMA = "vec_id long, embedding array<float>, label int, node string, tile int, v string, n int"


def brute(rows, least=0.9):
    ok = [i for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    link = {i: set() for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                link[own[a]].add(own[b])
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = rows[j][0], len(link[j]), low, rows[j][0] == low
    return sorted(out, key=repr)


def got(spark, rows, **more):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1, "n", 2, "v", 3) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in closeness.links(frame, **more).collect()), key=repr)


def vectors(seed, groups, spread, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for size in groups:
        centre = rng.normal(size=dim)
        out += [centre + spread * rng.normal(size=dim) for _ in range(size)]
    return [(x * rng.uniform(0.1, 50)).tolist() for x in out]


@pytest.mark.parametrize("spread,tile_rows", [(0.02, 8), (0.2, 8), (0.33, 4), (0.33, 64), (0.6, 4096)])
def test_links_equal_all_pairs(spark, spread, tile_rows):
    """Hot groups that are linked throughout, and groups whose cosines lie around the threshold."""
    rows = list(enumerate(vectors(3, [120, 40, 15, 7, *[1] * 30], spread)))
    rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    assert got(spark, rows, tile_rows=tile_rows) == brute(rows)


def test_odd_rows(spark):
    x, y = [1.0, 2.0, 3.0], [3.0, -2.0, 0.5]
    rows = [(5, x), (2, x), (2, x), (2, [2.0, 4.0, 6.0]), (9, y), (None, y), (None, None), (7, None), (8, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]),
            (6, [1.0, float("nan"), 1.0]), (10, [float("inf"), 1.0, 1.0]), (11, [1.0, 2.0]), (12, [1e-30, 2e-30, 3e-30]), (13, [1e30, 2e30, 3e30]),
            (14, [-1.0, -2.0, -3.0]), (15, [0.0, 1.0, 0.0]), (16, [-0.0, 1.0, 0.0])]
    for rows in (rows, rows * 30):
        assert got(spark, rows) == brute(rows)
        assert got(spark, rows, tile_rows=4) == brute(rows)
    assert got(spark, []) == []


def test_every_cosine_lies_within_its_bound():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64, 900):
        u = closeness.units(rng.normal(size=(50, dim)) ** 3)
        t = closeness.quantise(np.arange(50), np.ones(50, int), u)
        rounded = (t.small @ t.small.T).astype(float) * t.scale[:, None] * t.scale
        assert (np.abs(u @ u.T - rounded) <= t.length[:, None] * t.error + t.error[:, None] + closeness.SLACK).all()
        for least in (0.1, 0.5, 0.9):
            assert (closeness.linked(t, t, least) == (u @ u.T >= least)).all()


def test_forest_keeps_what_is_connected():
    rng = np.random.default_rng(4)

    def parts(pairs, n):
        root = list(range(n))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[top(a)] = top(b)
        return [[top(i) == top(j) for j in range(n)] for i in range(n)]

    for share in (0.02, 0.1, 0.5, 1.0):
        link = rng.random((30, 20)) < share
        i, j = closeness.forest(link)
        assert link[i, j].all() and len(i) <= 50
        assert parts(zip(i, 30 + j), 50) == parts(((a, 30 + b) for a, b in zip(*np.nonzero(link))), 50)


def test_tiles_that_need_no_products(spark):
    """A hot group around a pivot is linked without multiplying its tiles."""
    rows = vectors(6, [400, *[1] * 20], 0.01)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, v array<double>").selectExpr(
        "vec_id as node", "1L as weight", "size(v) as dim", "v")
    within = math.acos(0.9)
    pivots = closeness.pivots_of(frame, 420, within / 2, 16)
    marks = closeness.tiles(frame, pivots, 16).select("tile", "dim", "cell", "low", "high").cache()
    work = closeness.pairs(marks, marks.count(), within)
    assert work.where("sure").count() >= 25 * 26 // 2
