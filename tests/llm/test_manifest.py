"""The Merkle manifest against a version that builds plain lists."""

import hashlib
import zlib

import pytest

from evengap.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, id string, place string, digest string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def own_leaf(row, text):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    return H(field(row[0]), field(row[3]), field(row[2]), field(row[4]), field(text))


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """The root, and for every node its siblings level by level."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(where):
            begin = i // 8 * 8
            paths[k].append((level[begin:i], level[i + 1:begin + 8]))
        level = [H(*level[i:i + 8]) for i in range(0, len(level), 8)]
        where = [i // 8 for i in where]
    return level[0], paths


def brute(rows):
    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, leaves = {}, {}
    for lang in names:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, own_leaf(r, r[1])))
        leaves[lang] = own
        trees[lang] = tree([own_leaf(r, r[1]) for r in own])
    root, above = tree([trees[x][0] for x in names])
    out = []
    for lang, upper in zip(names, above):
        for r, path in zip(leaves[lang], trees[lang][1]):
            path = path + upper
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = own_leaf(r, lowered(r[1]) if bad else r[1])
            for left, right in path:
                folded = H(*left, folded, *right)
            proof = H(*(x for left, right in path for x in left + right))
            out.append((r[0], own_leaf(r, r[1]), trees[lang][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def rows_of(n, lang):
    return [(i, f"Text {i} É" if i % 5 else None, lang, f"s{i % 3}" if i % 4 else None, i % 7 or None, "x", "y", "z", None) for i in range(n)]


@pytest.mark.parametrize("rows", [
    rows_of(1, "en"),
    rows_of(9, "en") + rows_of(64, None) + rows_of(1, "") + rows_of(65, "é"),
    rows_of(20, "de") + 3 * rows_of(5, "en") + [(None, "no id", "de", None, None, "a", None, None, None)] * 2 + [(4, "Same id", "de", "s", 2, None, None, None, None)],
    [r for k in range(70) for r in rows_of(2, f"l{k}")] + rows_of(700, "large") + [(7, "", "large", "", 0, "", "", "", ""), (8, "Long " * 50_000, "large", "", 0, "", "", "", "")],
], ids=["one", "shapes", "ties", "many groups"])
def test_audit_equals_lists(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in manifest.audit(docs).collect()), key=repr)
    assert got == brute(rows)
    assert any(r[-1] for r in got)


def test_several_sweeps(spark):
    """More than 4,096 leaves in a group, and more than 4,096 groups."""
    rows = rows_of(4200, "en") + [(i, f"Text {i}", f"l{i}", "s", 1, None, None, None, None) for i in range(4200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in manifest.audit(docs).collect()), key=repr) == brute(rows)


def test_proofs_fold_to_the_root(spark):
    found = manifest.build(spark.createDataFrame(rows_of(5000, "en") + rows_of(30, None), SCHEMA))
    rows = manifest.proofs(found).collect()
    assert len(rows) == 5030 and sorted(r.place for r in rows if r.grp) == list(range(5000))
    for r in rows[::50]:
        assert manifest.fold(r.leaf, [(p.left, p.right) for p in r.path]) == found.root
        if r.path[0].right:
            assert manifest.fold(r.leaf, [(p.right, p.left) for p in r.path]) != found.root
    assert len(found.sweeps) == 3


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert manifest.build(docs).root is None and manifest.audit(docs).collect() == []
