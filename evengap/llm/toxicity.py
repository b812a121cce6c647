"""Toxicity of whole texts: disguised words are restored, then scored by what labelled documents show of words.

Every restored word has features: itself and its beginnings. The share of toxic ones among the labelled documents that
have a feature, drawn to the overall share where few have it, is its weight; a word counts with its best feature. A
logistic model of a text's three heaviest words, fitted on weights from the other half of the labelled rows, gives the
score.
"""

from __future__ import annotations

import math
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evengap.llm.common import free_names, stored
from evengap.llm.deobfuscate import Restorer, count_trigrams, language_model
from evengap.llm.wordids import KEPT

TOP = 3
PRIOR = 3.0
#: Letters of the beginnings.
BEGUN = (3, 4, 5)


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in BEGUN if len(word) > n)]


def remainder(id: str) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3, F.lit(0))


class Heavy:
    """The heaviest words of texts, by log odds of features. What tokens stand for is kept, in two generations.

    Most tokens hold no heavy word, so all that is kept of them is that they were met.
    """

    def __init__(self, restorer: Restorer, odds: dict[str, float], most: int = 300_000):
        self.restorer, self.most = restorer, most
        self.whole = {f[1:]: x for f, x in odds.items() if f[0] == "="}
        self.begun = {f[1:]: x for f, x in odds.items() if f[0] == "^"}
        self.met, self.older = set(), set()
        self.heavy: dict[str, dict[str, float]] = {}

    def weights(self, words) -> dict[str, float]:
        found = {}
        whole, begun = self.whole.get, self.begun.get
        for w in words:
            x = whole(w, 0.0)
            for n in BEGUN:
                if len(w) > n:
                    x = max(x, begun(w[:n], 0.0))
            if x > 0:
                found[w] = x
        return found

    def heaviest(self, text: str) -> list[float]:
        own = set(text.split())
        new = own - self.met
        if new:
            for token in new - self.older:
                found = self.weights(self.restorer.word(token))
                if found:
                    self.heavy[token] = found
            self.met |= new
            if len(self.met) > self.most:
                self.met, self.older = set(), self.met
        found: dict[str, float] = {}
        for token in own & self.heavy.keys():
            found |= self.heavy[token]
        found |= self.weights(self.restorer.spaced(text))
        if len(self.heavy) > self.most:
            self.met, self.older, self.heavy = set(), set(), {}
        return (sorted(found.values(), reverse=True) + [0.0] * TOP)[:TOP]


def kept_here(key: str, make):
    """What `make` gives, kept in this worker for its next tasks; whatever else was kept is freed."""
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = make()
    return KEPT[key]


def log_odds(counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Features whose share of toxic documents lies above the overall share `base`."""
    out = {}
    for f, (toxic, n) in counts.items():
        share = (toxic + PRIOR * base) / (n + PRIOR)
        if n >= 2 and share > 2 * base:
            out[f] = float(np.log(share / (1 - share)) - np.log(base / (1 - base)))
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights with the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: int) -> DataFrame:
    """(text, y, half) of about `most` labelled rows whose remainder is not 1, chosen by a hash of the id."""
    marked = (labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & (remainder(id) != 1))
              .groupBy(F.col(id).alias("_id")).agg(F.max(label).cast("int").alias("y")))
    share = min(1.0, most / max(1, marked.count()))
    chosen = marked.where(F.shiftrightunsigned(F.xxhash64("_id", F.lit(1)), 1) <= math.ceil(share * (2**63 - 1024)))
    # the sample is bounded by `most`, so it may be broadcast
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    return rows.select("text", "y", (remainder("_id") == 0).cast("int").alias("half"))


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic",
        most: int = 20_000) -> dict:
    """The model: language model of all documents, log odds of features and logistic weights.

    most: bound on the labelled rows used. The language model counts every document, whatever `most` is. Without labels
    of both classes the model knows no feature and scores every text alike.
    """
    model = language_model([(r.code, r.n) for r in count_trigrams(docs, text).collect()])
    rows = stored(training_rows(docs, labels, id, text, label, most), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches):
        restorer, known, seen = Restorer(shared.value), {}, {}
        for batch in batches:
            for t, y, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens = set((t or "").split())
                if len(known) > 200_000:
                    known = {}
                for token in tokens - known.keys():
                    known[token] = tuple({sys.intern(f) for w in restorer.word(token) for f in features(w)})
                spaced = {f for w in restorer.spaced(t or "") for f in features(w)}
                for f in spaced.union(*map(known.__getitem__, tokens)):
                    c = seen.setdefault(f, [0, 0, 0, 0])
                    c[2 * half] += y
                    c[2 * half + 1] += 1
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(
            pa.array([seen[f][i] for f in names], pa.int64()) for i in range(4))], names=["f", "t0", "n0", "t1", "n1"])

    sums = [F.sum(c).alias(c) for c in ("t0", "n0", "t1", "n1")]
    size = rows.agg(F.count("*"), F.sum("y")).first()
    if not size[0] or not 0 < size[1] < size[0]:
        return {"model": model, "odds": {}, "weights": np.array([np.log((size[1] or 0) + 0.1) - np.log(size[0] + 0.2), 0, 0, 0])}
    base = size[1] / size[0]
    found = (rows.mapInArrow(counted, "f string, t0 long, n0 long, t1 long, n1 long").groupBy("f").agg(*sums)
             .where((F.col("t0") + F.col("t1") >= 2) & ((F.col("t0") + F.col("t1")) / (F.col("n0") + F.col("n1")) > 2 * base))
             .collect())
    all_odds = log_odds({r.f: (r.t0 + r.t1, r.n0 + r.n1) for r in found}, base)
    halves = docs.sparkSession.sparkContext.broadcast(
        [log_odds({r.f: (r.t1, r.n1) for r in found}, base), log_odds({r.f: (r.t0, r.n0) for r in found}, base)])

    def weighed(batches):
        restorer = Restorer(shared.value)
        other = [Heavy(restorer, x) for x in halves.value]
        for batch in batches:
            x = [[*other[half].heaviest(t or ""), float(y)]
                 for t, y, half in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], names=["x"])

    x = np.array([r.x for r in rows.mapInArrow(weighed, "x array<double>").collect()])
    return {"model": model, "odds": all_odds, "weights": logistic(x[:, :TOP], x[:, TOP])}


def score(docs: DataFrame, fitted: dict, *, text: str = "text", name: str = "score", also: list[str] | None = None) -> DataFrame:
    """The columns `also` (all by default) of every row, and the score of its whole text from 0 to 1.

    Null texts count as empty and get the score of a text without any heavy word. Rows are scored by themselves:
    repeated rows score alike, other columns play no part, and an empty table gives none. A column that is called `name`
    already is replaced.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(fitted), uuid.uuid4().hex
    own = [c for c in (also if also is not None else docs.columns) if c.lower() != name.lower()]
    hidden, = free_names(docs, "scored")
    kept = docs.select(*own, F.col(text).cast("string").alias(hidden))
    schema = kept.drop(hidden).withColumn(name, F.lit(0.0)).schema

    def scored(batches):
        w = shared.value["weights"]
        heavy = kept_here(key, lambda: Heavy(Restorer(shared.value["model"]), shared.value["odds"]))
        for batch in batches:
            x = np.array([heavy.heaviest(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()])
            z = w[0] + (x.reshape(-1, TOP) @ w[1:] if batch.num_rows else np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             names=schema.names)

    return kept.mapInArrow(scored, schema)
