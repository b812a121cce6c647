"""Every operator of the llm subpackage against a brute-force version, on tables with nulls, copies and odd rows."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evengap.llm import (chat, contamination, licences, packing, pseudonyms, simhash, tokenfile, topk, toxicity, wordids,
                         wrappers)
from evengap.llm.deobfuscate import Restorer, language_model, trigrams
from evengap.llm.pagetext import article
from evengap.llm.queries import tokenizer

TEXTS = ["The quick brown fox jumps over the lazy dog.\nAgain  and\tagain.", "", None, "Grüße an  alle!\n\nZwei Zeilen",
         "a", "The quick brown fox jumps over the lazy dog.\nAgain  and\tagain.", " leading and trailing ", "x" * 3000,
         "word " * 2000, "tab\tand hard space, l'été <|endoftext|> \x00 end\n"]
SCHEMA = "doc_id long, text string, ids string, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(TEXTS)] + [(1, "again the same id", None, "y"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def library(name):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer(name))
    found.encode_special_tokens = True
    return lambda t: found.encode(t or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(alphabet="aAbB 's.,\n\t éÉßİΣ1́", max_size=30), max_size=5))
def test_word_ids_equal_the_library(name, spaced, texts):
    whole = library(name)
    ids, counts = wordids.encoder(tokenizer(name), spaced)(texts)
    assert [len(whole(t)) for t in texts] == counts.tolist()
    assert [i for t in texts for i in whole(t)] == ids.tolist()


def test_packing(spark, docs):
    whole = library("byte_bpe_50k.json")
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), most=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length <= 64 and r.length & (r.length - 1) == 0 for r in rows)
    for i, t in enumerate(TEXTS):
        if i != 1:
            own = sorted((r.start, r.length, r.ids) for r in rows if r.doc_id == i)
            assert b"".join(x[2] for x in own) == packed(whole(t) + [0])
            assert [x[0] for x in own] == np.cumsum([0, *(x[1] for x in own)])[:-1].tolist()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(whole("again the same id")) + 2
    assert packing.pack(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


@settings(max_examples=40, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), share=st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(ids, share):
    assert tokenfile.decode_ids(tokenfile.encode_ids(np.array(ids, np.uint32), share)).tolist() == ids


def test_token_files(spark, docs, tmp_path):
    whole = library("word_bpe_49k.json")
    tokenfile.write_ids(docs, str(tmp_path / "ids"), tokenizer("word_bpe_49k.json"), segment=100)
    rows = sorted(tokenfile.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    names = [r.doc_id for r in rows]
    assert names == sorted(names, key=lambda x: (x is not None, x))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    for i, t in enumerate(TEXTS):
        assert any(r.doc_id == i and r.ids == packed(whole(t) + [2]) for r in rows)
    tokenfile.write_ids(docs.limit(0), str(tmp_path / "none"), tokenizer("word_bpe_49k.json"))
    assert tokenfile.read_ids(spark, str(tmp_path / "none")).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(names, fps, radius=3):
    root = list(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min((n for n, r in zip(names, root) if r == own and n is not None), default=None) for own in root]


def test_near_copies(spark, docs):
    base = [f"w{i}" for i in range(400)]
    more = [(100 + i, " ".join(base[:i] + ["changed"] + base[i + 1:]), None, None) for i in range(0, 40, 3)]
    table = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    rows = table.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = sorted((-1 if r.doc_id is None else r.doc_id, f, c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_copies(table).collect())
    assert got == want
    roots = brute_components(range(len(fps)), fps)
    kept = [-1 if r.doc_id is None else r.doc_id for r in simhash.keep_first(table).collect()]
    firsts = [min((r.doc_id for r, x in zip(rows, roots) if x == root and r.doc_id is not None), default=-1) for root in set(roots)]
    assert sorted(kept) == sorted(firsts)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_one_row_of_a_component_stays(spark):
    text, other, third = "alpha beta gamma delta", "quite another text it is", "and a third one of its own"
    docs = spark.createDataFrame([
        (1, text, "a", 0), (1, text, "b", 0), (2, text, "c", 0), (2, other, "d", 0), (None, third, "e", 0), (None, third, "f", 0),
        (None, other, "g", 0)], "doc_id long, text string, _name string, n int")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    rows = sorted((r.text, r.doc_id, r._name) for r in got.collect())
    assert [(t, i) for t, i, _ in rows] == [(text, 1), (third, None), (other, 2)]
    assert rows[0][2] in "ab" and rows[1][2] in "ef" and rows[2][2] == "d"
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_masks_cover_and_groups_split():
    masks = simhash.covering_masks(3)
    rng = np.random.default_rng(1)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(diff & m == 0 for m in masks)
    fps = np.unique(rng.integers(0, 2**62, 60, dtype=np.uint64)[rng.integers(0, 60, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    ids = list(range(len(fps)))
    small, large = (simhash.close_pairs(fps, 3, most=m) for m in (10, 10_000))
    roots = []
    for a, b in (small, large):
        root = list(ids)
        for x, y in zip(a, b):
            assert int(fps[x] ^ fps[y]).bit_count() <= 3
            root = [root[y] if r == root[x] else r for r in root]
        roots.append([min(i for i in ids if root[i] == r) for r in root])
    assert roots[0] == roots[1]


def test_contamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([
        (1, "before " * 500 + item.upper().replace(" ", ", ") + " after" * 900, 1), (2, item.replace("seven", "other"), 2),
        (3, None, 3), (4, "", 4), (None, item, 5), (5, "one two three", 6), (1, "a second row of one id", 7)],
        "doc_id long, text string, h int")
    items = spark.createDataFrame([(7, item, 0), (8, "one two three", 0), (9, None, 0), (None, item, 0), (7, item, 0)],
                                  "item_id long, text string, n int")
    got = contamination.contained(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.shared, r.shingles, r.containment) for r in got) == [
        (1, 7, 10, 10, 1.0), (1, 8, 1, 1, 1.0), (2, 8, 1, 1, 1.0), (5, 8, 1, 1, 1.0)]
    assert sorted(r.h for r in contamination.without(docs, items).collect()) == [3, 4, 5]
    long = items.where("item_id = 7")
    assert sorted(r.h for r in contamination.without(docs, long).collect()) == [2, 3, 4, 5, 6]
    assert contamination.contained(docs, items.limit(0)).count() == contamination.contained(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("rows", [2_000_000, 0])
def test_contamination_equals_brute_force_and_sql(spark, monkeypatch, rows):
    """Items of 0 to 12 words, joined by broadcasts and by shuffles."""
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", rows)
    draw = random.Random(3)
    text = lambda n: " ".join(draw.choice("abcd") for _ in range(n))
    docs = [(i, text(draw.choice([0, 1, 2, 4, 7, 30, 200]))) for i in range(60)] + [(100, None)]
    items = [(i, text(i % 13) + ". ") for i in range(80)] + [(100, None), (101, "zz top"), (102, "...")]
    want = {}
    for d, body in docs:
        for i, item in items:
            w, g = (body or "").split(), (item or "").replace(".", " ").split()
            k = min(len(g), 5)
            has = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
            own = {tuple(g[j:j + k]) for j in range(len(g) - k + 1)} if g else set()
            if own and len(own & has) / len(own) >= 0.8:
                want[d, i] = (len(own & has), len(own))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contained(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id): (r.shared, r.shingles) for r in got} == want and len(got) == len(want) > 200
    db = duckdb.connect()
    db.register("documents", documents.toPandas())
    db.register("benchmark", benchmark.toPandas())
    assert {(r[0], r[1]): (r[2], r[3]) for r in db.sql(contamination.SQL).fetchall()} == want


def test_pseudonyms(spark):
    texts = ["Card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112.", "Call +1 (523) 555-1055 or 523-555-1055!",
             "From 10.0.255.1 on 2024-02-29, 31/12/1999 and 2023-02-30", "Mail bosbt.42@mail8.example.com.", "nothing 12 here", None, "",
             "SSN 123-45-6789"]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, _new int")
    rows = {r._new: r for r in pseudonyms.pseudonymise(docs, "k", count="n").collect()}
    assert [rows[i].n for i in range(8)] == [2, 2, 3, 1, 0, 0, 0, 1]
    assert [rows[i].text for i in (4, 5, 6)] == ["nothing 12 here", None, ""]
    digits = lambda s: re.sub("[^0-9]", "", s)
    one, two = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), not 4111111111111112\.", rows[0].text).groups()
    weigh = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(two))]
    assert digits(one) == two != "4111111111111111" and sum(weigh) % 10 == 0
    a, b = re.search(r"Call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})!", rows[1].text).groups()
    assert digits(a) == digits(b) != "5235551055"
    assert re.fullmatch(r"From (\d+\.){3}\d+ on \d{4}-\d\d-\d\d, \d\d/\d\d/\d{4} and 2023-02-30", rows[2].text)
    assert re.fullmatch(r"Mail [a-z]{5}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com\.", rows[3].text) and "bosbt" not in rows[3].text
    many = spark.range(256 * 256).selectExpr("concat('10.9.', id div 256, '.', id % 256) AS text")
    assert pseudonyms.pseudonymise(many, "k").distinct().count() == 256 * 256
    days = spark.range(73049).selectExpr("cast(date_add(date'1900-01-01', int(id)) as string) AS text")
    assert pseudonyms.pseudonymise(days, "k").distinct().count() == 73049


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{''.join(rng.choice(list('aeiourstn'), 5))}" for _ in range(300)]
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = list(rng.choice(plain, 30)) + (["moronic", "stupid"] if bad else [])
        rows.append((i, " ".join(words), "t"))
        marks.append((i, int(bad), None))
    rows += [(None, None, "t"), (1000, "you st00pid m0r0nic s t u p i d", "t"), (1001, "", "t"), (1001, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    fitted = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, fitted).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.95
    assert got[1000] > 0.7 > got[1001] == got[None]
    assert toxicity.score(docs.limit(0), fitted).count() == 0
    clash = toxicity.score(docs.selectExpr("doc_id", "'x' AS score", "1 AS _scored", "text"), fitted)
    assert clash.columns == ["doc_id", "_scored", "text", "score"] and {r.doc_id: r.score for r in clash.collect()} == got
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert len({r.score for r in none}) == 1


def test_restoration():
    counts = trigrams(["an idiot and a stupid loser went to the clown"] * 50)
    restorer = Restorer(language_model([(int(c), int(counts[c])) for c in np.flatnonzero(counts)]))
    for word, plain in [("1d10t", "idiot"), ("id!ot", "idiot"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"),
                        ("cl0wn***", "clown"), ("THE!!", "the")]:
        assert plain in restorer.word(word)
    assert "idiot" in restorer.words("an i d i o t") and restorer.words("") == set()


def test_restoration_of_long_tokens_and_runs():
    counts = trigrams(["you are an idiot and a stupid loser went to the clown", "so you idiot are a moron"] * 50)
    restorer = Restorer(language_model([(int(c), int(counts[c])) for c in np.flatnonzero(counts)]))
    assert "idiot" in restorer.words(" ".join("youidiot")) and "idiot" in restorer.words(" ".join("wenttotheclown" * 30 + "youidiot"))
    assert "idiot" in restorer.word("i" * 50 + "diot") and "idiot" in restorer.word("i" * 5000 + "diot")
    assert {"idiot", "moron"} <= set(restorer.word("/".join(["1d10t", "m0r0n"] * 10)))
    assert {"idiot", "moron"} <= set(restorer.word("/".join(["1d10t", "m0r0n"])))
    assert {"idiiot", "idiot"} <= set(restorer.word("idiiot")) and "loser" in restorer.word("looser")


PAGE = """<html><head><title>T</title><script>var a = "</p>";</script></head><body><header>Site</header><div class="menu"><a href=1>One</a></div>
<div class="post"><h1>Title &amp; more</h1><div class="cookie-notice">Cookies</div><p>First <b>bold</b>text&nbsp;x<p>Second<ul><li>a<li>b</ul>
<form>Mail <input></form><div class=ad>Buy</div></div><div id="comments"><p>Nice</p></div><footer>Foot</footer></body></html>"""


def test_page_text(spark):
    assert article(PAGE, set()) == "Title & more First boldtext x Second a b"
    plain = "<body><p>Terms of this site</p><p class=t>Text {}</p></body>"
    rows = [(1, "http://a.org/1", PAGE, 5), (2, None, None, 5), (2, "http://a.org/2", "", 5), (3, "odd", "<article>cut <p>of", 5)]
    rows += [(10 + i, "http://b.org/x", plain.replace("<p>T", "<p class=s>T").format(i), 5) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in wrappers.extract(pages).collect())
    assert got[:4] == [(1, "Title & more First boldtext x Second a b", 40), (2, "", 0), (2, "", 0), (3, "cut of", 6)]
    assert [x[1] for x in got[4:]] == [f"Text {i}" for i in range(6)]  # the sentence on all pages belongs to the template
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_wrapper_drops_repeated_menus_also_in_articles(spark):
    bare = "<body><ul><li>Home</li><li>News</li><li>About us</li></ul><h1>Title {0}</h1>{1}<div><p>Terms</p><p>Imprint</p></div></body>"
    inside = "<body><article><h1>Title {0}</h1>{1}<ul><li>Print this</li><li>Send this</li></ul></article></body>"
    rows = [(10 * k + i, f"http://h{k}.org/{i}", page.format(i, "".join(f"<p>Line {i} {j}</p>" for j in range(i + 1))), 5)
            for k, page in enumerate((bare, inside)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert got == {10 * k + i: " ".join([f"Title {i}", *(f"Line {i} {j}" for j in range(i + 1))]) for k in range(2) for i in range(5)}


def test_wrapper_keeps_articles_that_a_host_repeats(spark):
    copy = "<body><article><h1>Same title</h1><p>The very same article text.</p></article><p>Seen {} times</p></body>"
    heads = "<body><article><h1>Introduction</h1><p>Body {0} of its own</p><h2>Conclusion</h2><p>End {0} of it</p></article></body>"
    bare = "<body><div><p>Home page</p><p>All news</p></div><div><h1>Title {0}</h1><p>Text {0} told at length.</p></div><div><p>Made by us</p></div></body>"
    same = "<body><h1>Same title</h1><p>" + "The very same text without any article tag. " * 20 + "</p><p>Seen {} times</p></body>"
    rows = [(100 * h + i, f"http://h{h}.org/{i}", page.format(i)) for h, page in enumerate([copy, heads, bare, same]) for i in range(4)]
    rows += [(900 + i, "http://h0.org/again", copy.format(0)) for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == "Same title The very same article text." == got[900 + i]
        assert got[100 + i] == f"Introduction Body {i} of its own Conclusion End {i} of it"
        assert got[200 + i] == f"Title {i} Text {i} told at length."
        assert got[300 + i].startswith("Same title The very same text")


def test_hostile_markup_takes_linear_time():
    start = time.monotonic()
    n = 100_000
    assert article("<a" * n, set()) == "<a" * n
    assert article("<div>" * n + "x" + "</section>" * n, set()) == "x"
    for page in ['<a "' * (n + 1) + ">", "<script" * n, "<!--" * n, "<div>" * n + "<li></li>" * n, "<script>" + "</script " * n, "</" * n + ">"]:
        article(page, set())
    assert article("<p>one</p><script>x > 2; y", set()) == article("<p>one<!-- two", set()) == "one"
    assert time.monotonic() - start < 20


def test_hosts_of_many_shapes_are_folded_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 3)
    tags = ["h1", "h2", "h3", "p", "pre", "ul"]
    rows = [(i, "http://a.org/", f"<body><section>Top line</section><blockquote>Text {i}</blockquote>"
             + "".join(f"<{t}>own {i} {t}</{t}>" for b, t in enumerate(tags) if i >> b & 1) + "</body>") for i in range(40)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 40 and all(r.text.startswith(f"Text {r.page_id}") for r in got)


def test_long_runs_of_dots_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "Licensed under " + "." * 1_000_000 + "x"), (2, "Licensed under the MIT license" + " ." * 1000)],
                                 "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    assert got == {1: "unknown", 2: "MIT"} and time.monotonic() - start < 20


def test_wrappers_align():
    wrapper, place = wrappers.align([["a", False], ["b", False], ["d", False]], ["a", "c", "d"])
    assert [w[0] for w in wrapper] == ["a", "b", "c", "d"] and [w[1] for w in wrapper] == [False, True, True, False]
    assert [wrapper[i][0] for i in place] == ["a", "c", "d"]


def test_licences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and "
           "this permission notice shall be included in all copies. The software is provided \"as is\", without warranty.")
    docs = spark.createDataFrame([(1, mit, 0), (2, "Text.\nLicensed under the Apache License, Version 2.0.", 0), (3, None, 0), (4, "", 0),
                                  (None, "Released under the MIT License.\nAll rights reserved.", 0), (5, "Licensed under the Foo License.", 0)],
                                 "doc_id long, text string, seq int")
    got = {r.doc_id: (r.sentences, r.licences) for r in licences.scan(docs).collect()}
    assert got == {1: ("mit-grant mit-notice as-is", "MIT"), 2: ("apache2-ref", "Apache-2.0"), 3: ("", ""), 4: ("", ""),
                   None: ("mit-ref reserved", "MIT all-rights-reserved"), 5: ("unknown", "unknown")}


def test_licences_without_the_word_and_across_lines(spark):
    cases = {
        "Distributed under the GNU GPL v3.": "gpl3-ref", "Released under CC BY 4.0.": "cc-by-ref", "Available under CC0 1.0.": "cc0-ref",
        "This work is published under Creative Commons Attribution 4.0.": "cc-by-ref", "Released under the GNU GPL v2.": "gpl2-ref",
        "Provided under the GNU LGPL v2.1.": "lgpl-ref", "Licensed under the GNU AGPL v3.": "agpl3-ref",
        "Released under the MIT License.": "mit-ref", "Licensed under the Apache License, Version 2.0.": "apache2-ref",
        "either version 2 of the License, or (at your option) any later version.": "gpl-any",
        "Licensed under the Mozilla Public License v2.0.": "mpl2-ref", "Licensed under the 3-clause BSD License.": "bsd-ref",
        "Released under CC BY-NC-SA 4.0.": "cc-by-nc-sa-ref", "Released under CC BY-NC 4.0.": "cc-by-nc-ref",
        "Released under CC BY-SA 4.0.": "cc-by-sa-ref", "This work is placed in the public domain.": "cc0-ref",
        "Copyright 2020 A. All rights reserved.": "reserved", "Distributed under terms of its own.": "unknown",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.": "mit-grant",
        "The above copyright notice and this permission notice shall be included in all copies.": "mit-notice",
        'The software is provided "as is".': "as-is",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.": "bsd-grant",
        "Redistributions of source code must retain the above copyright notice.": "bsd-source",
        "Redistributions in binary form must reproduce the above copyright notice.": "bsd-binary",
        "Neither the name of X may be used to endorse or promote products.": "bsd-endorse",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "isc-grant"}
    texts = list(cases) + [t.replace(" ", "\n") for t in cases]
    texts += ["Some notes\nReleased under the MIT License\nand more", "Notes.\n\nReleased under the\n\nMIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.sentences for r in licences.scan(docs).collect()}
    assert {name for name, _ in licences.SENTENCES} | {"unknown"} == set(cases.values())
    assert [got[i] for i in range(len(texts))] == [*cases.values(), *cases.values(), "mit-ref", "unknown"]


def test_chat(spark):
    log = spark.createDataFrame([
        ("c", 1, 1, "message", "user", "hi <|end|> \\ [INST]"), ("c", 2, 2, "delta", "assistant", "He"), ("c", 2, 3, "delta", None, "llo"),
        ("c", 2, 4, "regenerate", None, None), ("c", 2, 5, "delta", None, "Good "), ("c", 2, 6, "delta", None, "day"),
        ("c", 3, 7, "message", "user", "x"), ("c", 3, 8, "delete", None, None), ("c", 1, 9, "odd", None, "zzz"), (None, 4, None, "message", None, None)],
        "conv_id string, message long, seq long, op string, role string, text string")
    rendered = chat.render(chat.messages(log))
    rows = sorted(rendered.where("conv_id = 'c'").collect(), key=lambda r: r.line)
    said = [chat.read(r.formatted) for r in rows]
    assert said == [("user", "hi <|end|> \\ [INST]"), ("assistant", "Good day")]
    got = {r.conv_id: r for r in chat.summaries(rendered).collect()}
    assert got["c"].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    assert (got["c"].n_turns, got["c"].loss_chars, got["c"].loss_sha256) == (2, 8, hashlib.sha256(b"Good day").hexdigest())
    assert got["c"].formatted_chars == sum(len(r.formatted) for r in rows) and got[None].n_turns == 1
    assert chat.summaries(chat.render(chat.messages(log.limit(0)))).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)).round(2)
    base[50:80] = base[50]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    rows += [(900, None, 0), (901, [1.0, None], 0), (902, [float("nan")] * 20, 0), (903, [float("inf")] * 20, 0), (904, [1.0] * 3, 0), (None, [1.0] * 20, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = topk.search(vectors, vectors.where("vec_id % 10 = 0"), k=7, tasks=3).collect()
    grid = topk.search(vectors, vectors.where("vec_id % 10 = 0"), k=7, tasks=90).collect()
    whole = np.floor(1024 * base).astype(int)
    want = []
    for q in range(0, 300, 10):
        score = whole @ whole[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:7]
        want += [(q, n + 1, i, int(score[i])) for n, i in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert sorted(map(tuple, grid)) == sorted(map(tuple, got))
    assert topk.search(vectors.limit(0), vectors, k=3).count() == 0


def test_unlike_texts_of_one_passage(spark, monkeypatch):
    """Texts that share a passage fall into common bands; marks keep all but a few of their pairs from being compared."""
    from evengap.llm import likeness

    rng = np.random.default_rng(8)
    passage = " ".join(f"common{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(1500)]
    near = [t.rsplit(" ", 2)[0] for t in texts[:100]]
    rows = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    compared, own = [], likeness.verified

    def counted(pairs, *args):
        compared.append(pairs.count())
        return own(pairs, *args)

    monkeypatch.setattr(likeness, "verified", counted)
    monkeypatch.setattr(likeness, "PART", 64)
    kept = simhash.keep_first(rows, like=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1500))
    assert sum(compared) <= 300


def test_texts_just_below_the_threshold(spark, monkeypatch):
    """Texts of Jaccard 0.77 to each other can't be told apart by marks; no row is made for a pair of them, and no link is lost."""
    from evengap.llm import likeness

    rng = np.random.default_rng(9)
    common = " ".join(f"common{i}" for i in range(200))
    texts = [common + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 30)) for _ in range(150)]
    texts += [t.rsplit(" ", 2)[0] for t in texts[100:]]  # a near copy each of 50
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared, own = [], likeness.verified

    def counted(pairs, *args):
        compared.append(pairs.count())
        return own(pairs, *args)

    monkeypatch.setattr(likeness, "verified", counted)
    monkeypatch.setattr(likeness, "PART", 32)
    found = likeness.sets(rows, "text", ["doc_id"])
    of = dict(found.select("fp", "doc_id").collect())
    pairs = {tuple(sorted((of[r.a], of[r.b]))) for r in likeness.links(found).collect()}
    assert pairs == {(100 + i, 150 + i) for i in range(50)}
    assert sum(compared) <= 10 * len(texts)


def test_shared_counts():
    from evengap.llm import likeness

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30_000, n)).astype(np.uint64) for n in (1, 5_000, 9_000, 20_000, 20_000, 3)]
    i, j = np.triu_indices(len(sets), 1)
    assert likeness.shared(sets)(i, j).tolist() == [np.intersect1d(sets[a], sets[b]).size for a, b in zip(i, j)]


def test_chains_in_a_band(spark):
    """Each text is alike to the next only, and all are one component; what joins no chain stays."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[15 * i:15 * i + 200]) for i in range(12)] + ["quite another text of more than five words", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i + 100, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(rows, like=0.8).collect()) == [0, 12, 13]


def test_viterbi_equals_enumeration():
    """Every way through the lattice of a short word, scored one by one."""
    from evengap.llm import deobfuscate as d

    counts = trigrams(["the idiot is a little fool but good people will call all", "bill sells old books"])
    model = language_model([(int(c), int(counts[c])) for c in np.flatnonzero(counts)])

    def ways(word, i=0, before=""):
        if i == len(word):
            yield 0.0, ""
            return
        c = word[i]
        outs = [(x, cost) for x, cost in [(c, 0.0)] * (c in d.CODE) + [(x, d.IMITATE) for x in d.IMITATED.get(c, "")]]
        if c == before:
            outs.append(("", d.DROP_REPEAT))
        elif c not in d.CODE:
            outs.append(("", d.DROP_SIGN))
        for x, cost in outs:
            for score, rest in ways(word, i + 1, c):
                yield cost + score, x + rest

    def score(cost, out):
        codes = [0, 0, *(d.CODE[c] for c in out), 0]
        return cost + sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    rng = np.random.default_rng(3)
    for word in ["1d10t", "ca11", "goood", "1!t", "b00k$", "$$", "f-0-0-l", *("".join(rng.choice(list("abil01!-$"), 5)) for _ in range(200))]:
        best = max(score(cost, out) for cost, out in ways(word))
        got = d.restore(word, model)
        assert max(score(cost, out) for cost, out in ways(word) if out == got) == pytest.approx(best)


def test_long_runs_and_tokens_are_decoded():
    counts = trigrams(["you are an idiot and a moron", "such an idiot", "moron moron idiot"] * 50)
    restorer = Restorer(language_model([(int(c), int(counts[c])) for c in np.flatnonzero(counts)]))
    assert "idiot" in restorer.words("i" * 60 + "d1" + "0" * 50 + "t")
    assert {"idiot", "moron"} <= restorer.words("/".join(["1d10t", "m0r0n"] * 30))
    assert "idiot" in restorer.words(" ".join("idiot" * 1 + "moron" * 40))
    assert restorer.words("x" * 200_000 + "1") and restorer.words("1/" * 50_000)


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_generations_of_pieces(name, spaced):
    """Ids stay right while pieces grow old, come back and are dropped."""
    whole, encode = library(name), wordids.WordIds(tokenizer(name), spaced, most=40)
    rng = np.random.default_rng(5)
    for _ in range(60):
        texts = [" ".join(rng.choice(["alpha", "beta,", "gämma", "x" * 30, "delta", " odd", "é"], 4)) + f" {rng.integers(200)} w{rng.integers(30)}" for _ in range(5)]
        ids, counts = encode(texts)
        assert [i for t in texts for i in whole(t)] == ids.tolist() and [len(whole(t)) for t in texts] == counts.tolist()
        assert len(encode.known) <= 40 + 60


@settings(max_examples=300, deadline=None)
@given(word=st.text(alphabet="abcil", min_size=2, max_size=9), at=st.integers(0, 8))
def test_one_doubled_letter_is_decided_as_by_viterbi(word, at):
    from evengap.llm import deobfuscate as d

    counts = trigrams(["call all bill ball cab lab alibi", "a bail la ca ila"])
    restorer = Restorer(language_model([(int(c), int(counts[c])) for c in np.flatnonzero(counts)]))
    word = word[:at] + word[at:at + 1] + word[at:]
    assert restorer.word(word)[:2] == tuple(dict.fromkeys([word, d.restore(word, restorer.model)])) or len(d.TWICE.findall(word)) != 1 or d.TWICE.search(word).end() - d.TWICE.search(word).start() > 2



def test_letters_of_latin_texts_are_folded_and_encoded_plainly():
    """Latin-1 texts are folded like ASCII ones, their words go to the model alone, and the ids stay the library's."""
    path = tokenizer("word_bpe_49k.json")
    ids = wordids.WordIds(path, False)
    assert ids.plain is not ids.library
    assert ids.pieces("Ä Straße\nÉTÉ") == ["ä", "straße", "été"] and ids.pieces("Ä Łódź") == ["Ä", "Łódź"]
    texts = ["Übergröße, ÄRGER. ªº µm naïve Łódź İstanbul e\u0301te\u0301 ÷×", "don't l'été 3,5 ÿ ŸÿÞþ " + "".join(map(chr, range(32, 256))),
             "\u212bngstrom K\u212a ﬁne ǅ", "plain words only", ""]
    for some in (texts, *([t] for t in texts), [t.lower() for t in texts], [" ".join(texts)]):
        got, counts = ids(some)
        want = [ids.whole(t).tolist() for t in some]
        assert counts.tolist() == [len(w) for w in want] and got.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_piece_is_looked_up_once_a_call(name, spaced):
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    encode = wordids.WordIds(tokenizer(name), spaced)
    encode.known = Counted(encode.known)
    texts = ["over and over again\n" * 500, "again", "", "  odd  ", "é\tè over"]
    ids, counts = encode(texts)
    whole = library(name)
    assert ids.tolist() == [i for t in texts for i in whole(t)] and counts.tolist() == [len(whole(t)) for t in texts]
    assert encode.known.asked < 40


def test_spaced_pieces_are_told_by_the_ids_that_begin_them(monkeypatch):
    encode = wordids.WordIds(tokenizer("byte_bpe_50k.json"), True)
    used = []
    kept = encode._keep
    monkeypatch.setattr(encode, "_keep", lambda words, ids, counts: (used.append((list(words), counts.tolist())), kept(words, ids, counts)))
    texts = ["a b's c1,2 ünï-x Ġ Ġa xĠy 日本  z q r q\ts t  <|endoftext|>", "b's \tc u"]
    whole = library("byte_bpe_50k.json")
    assert encode(texts)[0].tolist() == [i for t in texts for i in whole(t)]
    for words, counts in used:
        assert counts == [len(whole(w)) for w in words]


def test_an_encoder_frees_what_other_operators_keep(spark):
    wordids.KEPT["a model of other operators"] = object()
    try:
        encode = wordids.encoder(tokenizer("byte_bpe_50k.json"), True)
        assert list(wordids.KEPT) == [(tokenizer("byte_bpe_50k.json"), True)]
        assert encode.most <= 300_000  # two generations of them in each worker
    finally:
        wordids.forget_all()
