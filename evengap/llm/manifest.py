"""Merkle manifest of a table by time-forward processing.

Rows are leaves, in order of id within their group; eight neighbours have a parent, and the groups' roots form one more
tree. A node's label is its level and its place there. In the upward sweep a priority queue ordered by label brings
digests to their parents; in the reversed sweep it brings every child the proof of its parent, to which the child's
siblings are put in front. The queue is external: labels go through sorted shuffles that deal whole blocks of 8^4
neighbours to a task, so that a sweep over four levels is one shuffle, a task holds one block, and a group of any size
is shared out. Numbers of sweeps grow with the logarithm of the leaves to the base 4096.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evengap.llm.common import stored

ARITY, LEVELS = 8, 4
BLOCK = ARITY ** LEVELS

#: What stands left and right of a node in its run, from its own level up to the root.
PATH = "array<struct<left:string,right:string>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of a row: of every value its UTF-8 byte count, a colon and the value, or a dash for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def height(total: int) -> int:
    """Levels that a block of a tree of so many nodes has."""
    return next((k for k in range(LEVELS) if ARITY ** k >= total), LEVELS)


def upward(digests: list[str], levels: int) -> tuple[dict[tuple[int, int], list[str]], str]:
    """The children's digests of every inner node of a block, and the digest of its top."""
    queue = [((1, i // ARITY), i, d) for i, d in enumerate(digests)] if levels else []
    runs: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        runs[label], top = children, digest(*children)
        level, place = label
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // ARITY), place, top))
    return runs, top


def downward(runs: dict[tuple[int, int], list[str]], levels: int, above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The paths of a block's leaves in order, if `above` is the path of its top."""
    if not levels:
        return [above]
    queue, paths = [((-levels, 0), above)], []
    while queue:
        (level, place), path = heapq.heappop(queue)
        if not level:
            paths.append(path)
            continue
        children = runs[-level, place]
        for i in range(len(children)):
            own = "".join(children[:i]), "".join(children[i + 1:])
            heapq.heappush(queue, ((level + 1, place * ARITY + i), [own, *path]))
    return paths


def fold(leaf: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its path."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def proof_digest(path: Iterable[tuple[str, str]]) -> str:
    return digest(*(x for pair in path for x in pair))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """With the columns place (from 0 in each `grp`, in `order`, then any) and total (rows of the `grp`)."""
    nodes = nodes.withColumn("_tie", F.monotonically_increasing_id())  # parts even what is equal, so that no range is hot
    nodes = stored(nodes, "nodes")
    nodes = nodes.repartitionByRange("grp", *order, "_tie").sortWithinPartitions("grp", *order, "_tie")
    nodes = stored(nodes.withColumn("_at", F.monotonically_increasing_id()), "ordered").drop("_tie")
    part = F.shiftright("_at", 33)
    runs = nodes.groupBy(F.col("grp").alias("_g"), part.alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("_g")  # as many rows as a group has partitions
    before = F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("_n").over(group))
    return (nodes.join(runs, F.col("grp").eqNullSafe(F.col("_g")) & (part == F.col("_p")))
            .withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_g", "_p", "_first", "_n", "_before"))


def dealt(rows: DataFrame) -> DataFrame:
    """Whole blocks in one task, each in order of place."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")


def block_of(place: str = "place") -> Column:
    return F.shiftright(place, 3 * LEVELS).alias("block")


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each (grp, block) as tuples; the first columns are grp, block, place."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:2] != row[:2]:
                yield held[0][:2], held
                held = []
            held.append(row)
    if held:
        yield held[0][:2], held


def rise(nodes: DataFrame) -> DataFrame:
    """The tops of all blocks of (grp, place, total, digest), as nodes of the next sweep."""
    out = nodes.select("grp", "place", "total", "digest")
    schema = out.schema

    def tops(batches):
        for (group, block), rows in blocks(batches):
            total = rows[0][3]
            _, top = upward([r[4] for r in rows], height(total))
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([block], pa.int64()),
                                              pa.array([-(-total // BLOCK)], pa.int64()), pa.array([top])], names=schema.names)

    return dealt(out.select("grp", block_of(), "place", "total", "digest")).mapInArrow(tops, schema)


def sink(nodes: DataFrame, paths: DataFrame, also: list[str], schema: T.StructType | str, finish: Callable) -> DataFrame:
    """Reversed sweep: finish(row, path, top) for all nodes, from (grp, place, top, path) of their blocks.

    finish gets grp, place, digest and the columns `also` as a tuple, and returns the values of a row of `schema`.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    rows = nodes.select("grp", block_of(), "place", "total", "digest", F.lit(None).cast("string").alias("top"), F.lit(None).cast(PATH).alias("path"), *also)
    heads = paths.select("grp", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("total"),
                         F.lit(None).cast("string").alias("digest"), "top", "path", *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in also))

    def proven(batches):
        for (group, _), (head, *rows) in blocks(batches):
            above = [(p["left"], p["right"]) for p in head[6]]
            levels = height(rows[0][3])
            runs, _ = upward([r[4] for r in rows], levels)
            found = [finish((group, r[2], r[4], *r[7:]), path, head[5]) for r, path in zip(rows, downward(runs, levels, above))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), target)], names=target.names)

    return dealt(rows.unionByName(heads)).mapInArrow(proven, schema)


class Manifest(NamedTuple):
    """Nodes of every sweep, from the leaves up; root is null for an empty table."""
    leaves: DataFrame
    sweeps: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of all sweeps; the last has one node in each grp."""
    sweeps = [nodes]
    while (sweeps[-1].agg(F.max("total")).first()[0] or 0) > 1:
        sweeps.append(stored(rise(sweeps[-1]), "sweep"))
    return sweeps


def build(docs: DataFrame, *, id: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS,
          also: dict[str, Column] | None = None) -> Manifest:
    """The digests of all nodes. Leaves ascend by id (null first), equal ids by digest, in each value of `group`.

    Every row is a leaf, repeated ones too; rows of equal digests are interchangeable. Groups ascend by their UTF-8
    bytes, null first. `also` adds columns to the leaves; other columns are ignored, whatever their names. An empty
    table has no root.
    """
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(id).alias("id"), leaf(*map(F.col, columns)).alias("digest"),
                         *(c.alias(n) for n, c in (also or {}).items()))
    sweeps = climb(stored(numbered(leaves, ["id", "digest"]), "leaves"))
    roots = sweeps[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    tops = climb(stored(numbered(roots, ["name"]), "roots"))
    root = tops[-1].first()
    return Manifest(sweeps[0], sweeps, tops, root and root["digest"])


def proofs(found: Manifest, schema: T.StructType | str | None = None, finish: Callable | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(grp, place, id, leaf, subroot, path) of every leaf, or what `finish` makes of it, see `sink`.

    A path has one pair of strings a level: the digests left and right of the node in its run.
    """
    kind = found.leaves.schema["id"].dataType.simpleString()
    root = found.tops[-1]
    paths = root.select("grp", "place", F.lit("").alias("top"), F.array().cast(PATH).alias("path"))
    between = f"grp string, place long, top string, path {PATH}"

    def as_pairs(path):
        return [{"left": a, "right": b} for a, b in path]

    for nodes in reversed(found.tops[1:-1]):
        paths = stored(sink(nodes, paths, [], between, lambda row, path, top: (row[0], row[1], top, as_pairs(path))), "paths")
    # of each group the path of its root, which is the one node of its tree's last sweep
    paths = stored(sink(found.tops[0], paths, ["name"], between, lambda row, path, top: (row[3], 0, row[2], as_pairs(path))), "paths")
    for nodes in reversed(found.sweeps[1:-1]):
        paths = stored(sink(nodes, paths, [], between, lambda row, path, top: (row[0], row[1], top, as_pairs(path))), "paths")
    if finish is None:
        schema = f"grp string, place long, id {kind}, leaf string, subroot string, path {PATH}"
        finish, also = (lambda row, path, top: (row[0], row[1], row[3], row[2], top, as_pairs(path))), ()
    return sink(found.leaves, paths, ["id", *also], schema, finish)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's proof held against a tampered copy.

    The copy lower-cases A to Z in the texts of the rows whose id's decimal crc32 is divisible by 3 (no null id).
    """
    other = F.translate("text", LETTERS, LETTERS.lower())
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf(*(other if c == "text" else F.col(c) for c in COLUMNS))
    # null where nothing was tampered with
    found = build(docs, also={"tampered": F.when(chosen & (other != F.col("text")), changed)})
    root = found.root

    def finish(row, path, top):
        folded = fold(row[4] or row[2], path)
        return row[3], row[2], top, root, proof_digest(path), folded, folded == root

    kind = docs.schema["doc_id"].dataType.simpleString()
    return proofs(found, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
                  finish, ("tampered",))


#: CRC-32 of the UTF-8 bytes of a text in DuckDB, for code points below 2048; `crc_table` has to be in scope.
SQL_CRC_TABLE = """(SELECT list_transform(range(256), lambda x: list_reduce([x, 1, 2, 3, 4, 5, 6, 7, 8], lambda r, _:
    CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc_table)"""
SQL_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]::BIGINT[] END))),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"""


def sql(levels: int = 7, top_levels: int = 2) -> str:
    """DuckDB SQL of `audit`, for groups of up to 8^levels rows and 8^top_levels groups."""
    def fields(text: str) -> str:
        return "sha256(concat(" + ", ".join(
            f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    lower = f"translate(text, '{LETTERS}', '{LETTERS.lower()}')"
    steps = [f"""rows AS (SELECT doc_id, lang, {fields('text')} AS leaf, CASE WHEN {SQL_CRC.format('doc_id::VARCHAR')} % 3 = 0
        THEN {fields(lower)} ELSE {fields('text')} END AS f FROM documents, {SQL_CRC_TABLE})""",
             """t0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
        FROM (SELECT doc_id, lang AS g, leaf AS d, f FROM rows))"""]

    def tree(t: str, depth: int) -> None:
        run = "OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        for k in range(depth):
            steps.append(f"""{t}{k + 1} AS (SELECT g, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
        FROM {t}{k} GROUP BY g, i // 8, n)""")
        for k in range(depth):
            steps.append(f"""{t}s{k} AS (SELECT g, i, n, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k})""")

    tree("t", levels)
    steps.append(f"u0 AS (SELECT 0 AS g, g AS name, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{levels})")
    tree("u", top_levels)
    steps.append("f0 AS (SELECT doc_id, g, d, f, i, '' AS p FROM t0)")
    for k in range(levels):
        steps.append(f"""f{k + 1} AS (SELECT f.doc_id, f.g, f.d, f.i, CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f, p || l || r AS p
        FROM f{k} AS f JOIN ts{k} AS s ON f.g IS NOT DISTINCT FROM s.g AND f.i // {8 ** k} = s.i)""")
    steps.append(f"""h0 AS (SELECT f.doc_id, f.d, u.d AS subroot, u.i, f, p FROM f{levels} AS f JOIN u0 AS u ON f.g IS NOT DISTINCT FROM u.name)""")
    for k in range(top_levels):
        steps.append(f"""h{k + 1} AS (SELECT h.doc_id, h.d, h.subroot, h.i, CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f, p || l || r AS p
        FROM h{k} AS h JOIN us{k} AS s ON h.i // {8 ** k} = s.i)""")
    body = ",\n    ".join(steps)
    return f"""WITH {body}
    SELECT h.doc_id, h.d AS leaf, subroot, u.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = u.d AS verified
    FROM h{top_levels} AS h, u{top_levels} AS u"""


SQL = sql()
