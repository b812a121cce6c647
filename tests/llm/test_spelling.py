"""Spelling variants against all pairs."""

import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from evengap.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@settings(max_examples=300, deadline=None)
@given(words=st.sets(st.text(alphabet="abé", max_size=8), max_size=25))
def test_scan_equals_all_pairs(words):
    words = sorted(words)
    found = {(i, j): common for i, j, common in spelling.scan(words)}
    assert set(found) == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
    for (i, j), common in found.items():
        a, b = words[i], words[j]
        assert a[:common] == b[:common] and a[common:common + 1] != b[common:common + 1]


def brute(counts, times=5):
    out, forms = [], {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= times * n else None
        out.append((w, len(near)))
    rows = []
    for w, n_near in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, counts[w], n_near, counts[forms[w]] if forms[w] is not None else None))
    return sorted(rows)


def test_variants(spark):
    import random

    rng = random.Random(5)
    words = {"".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 6, 7, 8, 9]))) for _ in range(500)}
    # a hot prefix, a hot suffix, a chain of forms, a very long word
    words |= {"interestin" + a + b for a in "abcdefghijkl" for b in "abcdefghij"} | {a + b + "interestin" for a in "abcdefgh" for b in "abc"}
    words |= {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500}
    counts = {w: rng.choice([1, 2, 10, 60, 400, 3000]) for w in words}
    frame = spark.createDataFrame([(w, n, "extra") for w, n in counts.items()], "word string, n long, other string")
    for longest in (4, 2000):
        got = sorted(tuple(r) for r in spelling.variants(frame, longest=longest).collect())
        assert got == brute(counts)
    assert any(r[1] and r[2] != r[1] for r in brute(counts))


def test_no_list_is_longer(spark):
    """Words of one prefix are dealt on until a list is short, and no pair is found twice."""
    words = ["prefixes" + a + b + c for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefgh"]
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    sizes = spelling.lists(frame, 1, 20).selectExpr("key", "hi - lo > 1 as wide").groupBy("key", "wide").count().collect()
    assert max(r["count"] for r in sizes if r.wide) <= 20 and max(r["count"] for r in sizes) <= 10 * 10
    found = [(r.word, r.other) for r in spelling.near(frame, longest=20).collect()]
    assert len(found) == len(set(found)) == 800 * (9 + 9 + 7)


def test_vocabulary(spark):
    texts = ["Straße straße STRASSE l'Étéàà ÉTÉÀÀÈ abcdef Abcdef", None, "", "abcdef " * 300, "no", "abcdef1abcdef_abcdef", "z" * 5000,
             "Überall überall", "abcdef"]
    rows = [(i, t, "w", 1) for i, t in enumerate(texts)] + [(None, "abcdef without id", None, None), (3, "abcdef " * 300, "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    want = Counter()
    for name, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += len(run) >= 6
    got = {r.word: r.n for r in spelling.vocabulary(docs, fewest=1, change=spelling.slip).collect()}
    assert got == {w: n for w, n in want.items() if n}
    assert "straße" in got and "Überall" in got and "überall" in got
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).collect() == []


def test_pieces_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    other = re.compile(f"[^{spelling.LETTERS}]")
    for text in ("", "abcdefghijklmnop", "abc defghijk lmn opqrstuv w", "a b c d e f g h i j k"):
        parts = list(spelling.pieces(text, other))
        assert "".join(parts) == text
        assert [r for p in parts for r in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)
