"""Main text of web pages by inferred wrappers.

Pages of one host follow a template. Each page is a stream of blocks named by their place in the markup, with
neighbouring repeats folded. The distinct streams of a host are aligned one after the other into a wrapper, a
union-free regular expression: a mismatch makes an item optional, a folded repeat makes it a group, and text that
differs between pages makes it a slot. Blocks whose text is the same on all pages belong to the template, each by its
slot and its turn within a repeat. Inside an article only links and short list items can be template, and copies of an
article count once, so neither its headings nor a text that a host repeats is lost. What the wrapper leaves is chosen
from by its markup.
"""

from __future__ import annotations

import difflib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evengap.llm import pagetext
from evengap.llm.common import stored
from evengap.llm.contamination import small_enough

#: Shapes or partial wrappers that one task folds; a host with more is folded in several rounds.
FAN = 64
#: Different articles of a host that a text has to stand beside unchanged to count as template.
PAGES = 3


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def align(wrapper: list[list], items: list[str]) -> tuple[list[list], list[int]]:
    """A wrapper [path, optional] that also covers the items, and the place of each item in it."""
    if not wrapper:
        return [[x, False] for x in items], list(range(len(items)))
    matcher = difflib.SequenceMatcher(None, [w[0] for w in wrapper], items, autojunk=False)
    out: list[list] = []
    place = [0] * len(items)
    for kind, a, b, c, d in matcher.get_opcodes():
        if kind == "equal":
            for i, j in zip(range(a, b), range(c, d)):
                place[j] = len(out)
                out.append(wrapper[i])
            continue
        out += [[w[0], True] for w in wrapper[a:b]]
        for j in range(c, d):
            place[j] = len(out)
            out.append([items[j], True])
    return out, place


def infer(shapes: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from distinct (host, shape): each round folds some `FAN` parts of a host into one."""
    def folded(rows: DataFrame) -> DataFrame:
        keys = ["host", "part"]

        # shapes stream past in order; a task holds the wrapper of one group and a batch of shapes, however many there are
        def fold(batches):
            now, wrapper = None, []
            for batch in batches:
                for *key, one in zip(*(batch[c] for c in [*keys, "wrapper"])):
                    if key != now:
                        if now is not None:
                            yield pd.DataFrame({"host": [now[0]], "part": [now[1]], "wrapper": [json.dumps(wrapper)]})
                        now, wrapper = key, []
                    other = json.loads(one)
                    wrapper, place = align(wrapper, [w[0] for w in other])
                    for w, i in zip(other, place):
                        wrapper[i] = [w[0], wrapper[i][1] or w[1]]
            if now is not None:
                yield pd.DataFrame({"host": [now[0]], "part": [now[1]], "wrapper": [json.dumps(wrapper)]})

        return (rows.select(*keys, "wrapper").repartition(*keys).sortWithinPartitions(*keys, "wrapper")
                .mapInPandas(fold, "host string, part long, wrapper string"))

    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    count = 1
    while count * FAN < most:
        count *= FAN
    rows = shapes.select("host", F.pmod(F.xxhash64("shape"), F.lit(count)).alias("part"), F.col("shape").alias("wrapper"))
    while count > 1:
        rows = stored(folded(rows), "parts")
        count //= FAN
        rows = rows.withColumn("part", F.pmod("part", F.lit(count)))
    return folded(rows).select("host", "wrapper")


def parsed(pages: DataFrame, url: str, html: str, also: dict[str, str] | None = None) -> DataFrame:
    """(columns of `also`, host, shape, at, texts, zones, kinds): each page's folded stream as a wrapper of its own, its blocks and their places."""
    also = also or {}
    kept = pages.select(*[F.col(c).alias(n) for n, c in also.items()], host(url).alias("host"), F.col(html).cast("string").alias("html"))
    schema = T.StructType(kept.drop("html").schema.fields + T.StructType.fromDDL(
        "shape string, at array<long>, texts array<string>, zones array<int>, kinds array<int>").fields)
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                shape, texts, where, zones, kinds = pagetext.parts(text or "")
                rows.append((json.dumps([[s, False] for s in shape]), where, texts, zones, kinds))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                                             names=schema.names)

    return kept.mapInArrow(run, schema)


def streams(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, shape, at, hashes, page): the streams, the hashed texts by place, and a hash of the article, or else of all texts."""
    hashes = F.transform("texts", lambda t: F.xxhash64(t))
    firm = F.filter(F.arrays_zip("texts", "kinds"), lambda x: x["kinds"] == pagetext.FIRM)["texts"]
    page = F.when(F.size(firm) > 0, F.xxhash64(firm)).otherwise(F.xxhash64("texts"))
    return parsed(pages, url, html).select("host", "shape", "at", hashes.alias("hashes"), page.alias("page"))


def template(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, shape as a hash, fixed): the places whose text is the same on all pages, on hosts with several different articles.

    A place is an item of the shape and its turn among the item's repeats, so that the lines of a menu are told apart.
    """
    seen = stored(streams(pages, url, html), "streams")
    shapes = stored(seen.groupBy("host", "shape").agg(F.count("*").alias("n")), "shapes")
    wrappers = infer(shapes)

    def placed(batches):
        for rows in batches:
            out = []
            for h, s, w in zip(rows["host"], rows["shape"], rows["wrapper"]):
                wrapper = json.loads(w)
                items = [x[0] for x in json.loads(s)]
                _, place = align(wrapper, items)
                out.append((h, s, place))
            yield pd.DataFrame(out, columns=["host", "shape", "slots"])

    slots = stored(shapes.select("host", "shape").join(wrappers, "host").mapInPandas(
        placed, "host string, shape string, slots array<int>"), "slots")
    # one row for each distinct page before its blocks are spread
    distinct = seen.dropDuplicates(["host", "shape", "page", "at", "hashes"])
    item, turn = F.shiftright("x.at", 32).cast("int"), F.col("x.at").bitwiseAND(F.lit(0xFFFFFFFF))
    spots = (distinct.join(slots, ["host", "shape"])
             .select("host", "page", "slots", F.explode(F.arrays_zip("at", "hashes")).alias("x"))
             .select("host", "page", F.get("slots", item).alias("slot"), turn.alias("turn"), F.col("x.hashes").alias("h")))
    by_page = spots.groupBy("host", "slot", "turn", "page").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    by_slot = by_page.groupBy("host", "slot", "turn").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))
    fixed = stored(by_slot.where((F.col("a") == F.col("b")) & (F.col("n") >= PAGES)).select("host", "slot", "turn"), "fixed")
    # back from slots of the host's wrapper to the items of each shape
    items = slots.select("host", F.xxhash64("shape").alias("shape"), F.posexplode("slots").alias("item", "slot"))
    return (items.join(small_enough(fixed, fixed.count()), ["host", "slot"])
            .groupBy("host", "shape").agg(F.collect_set(F.shiftleft(F.col("item").cast("long"), 32).bitwiseOR(F.col("turn"))).alias("fixed")))


def extract(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its article's text, blocks joined by one space.

    A null page counts as empty; an empty page, or one without article text, gives an empty text. Pages without a host
    in their url form one group. Repeated ids and rows are extracted each by itself, other columns are ignored, and an
    empty table gives no rows. Markup that never closes ends with the page. Pages that repeat an article, with or without
    other texts around it, keep it.
    """
    fixed = stored(template(pages, url=url, html=html), "templates")
    out = parsed(pages, url, html, {"page_id": id, "url": url}).withColumn("shape", F.xxhash64("shape"))
    size = fixed.agg(F.sum(F.size("fixed"))).first()[0] or 0
    out = out.join(small_enough(fixed, size), ["host", "shape"], "left").select("page_id", "url", "texts", "zones", "kinds", "at", "fixed")
    kinds = pages.schema[id].dataType.simpleString(), pages.schema[url].dataType.simpleString()

    def texts(batches):
        for batch in batches:
            found = [pagetext.chosen(*row, set(f or ())) for *row, f in zip(*(batch.column(i).to_pylist() for i in range(2, 7)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())],
                                             names=["page_id", "url", "text"])

    return (out.mapInArrow(texts, f"page_id {kinds[0]}, url {kinds[1]}, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
