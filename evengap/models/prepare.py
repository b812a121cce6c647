"""Class weights, exact medians and the feature pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.operators.select import CATEGORICAL
from evengap.operators.skew import durable

SKETCH = 10_000  # values that a quantile sketch keeps: its places are off by at most rows / SKETCH
GATHERED = 10_000


def class_weights(df: DataFrame, y: str = "y", name: str = "w") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for label, n in counts.items():
        weight = F.when(F.col(y) == label, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(name, weight)


def _narrowed(at: dict, lo: float, hi: float, less: int, low: int, within: int, high: int) -> dict:
    """Where a place among the values of a range lies, given counts around two values ``lo <= hi`` of the range."""
    rank = at["rank"]
    if rank <= less:
        return {**at, "high": lo, "n": less}
    if rank <= less + low:
        return {**at, "value": lo}
    if rank <= less + low + within:
        return {**at, "low": lo, "high": hi, "n": within, "rank": rank - less - low}
    if rank <= less + low + within + high:
        return {**at, "value": hi}
    return {**at, "low": hi, "n": at["n"] - less - low - within - high, "rank": rank - less - low - within - high}


def column_medians(df: DataFrame, columns: Sequence[str], limit: int = GATHERED) -> DataFrame:
    """Exact median of every column, as rows; null for a column without values. NaN counts as the largest value.

    Distributed selection: a quantile sketch proposes two values around the place wanted, and exact counts below, at,
    between and above them say in which of these ranges the place lies, whether the sketch was right or not. A round
    keeps about one value in 2,500; once a range has at most ``limit`` values they are read in order. Three scans up to
    ``2_500 * limit`` rows and two more for every further factor of 2,500. Each scan is one aggregate over all columns,
    combined before the shuffle, so no row is moved and a column of equal values costs no more than others. ``df`` is
    evaluated by every scan: pass a stored table.
    """
    value = lambda c: F.col(c).cast("double")
    middle = [0.5 - 2 / SKETCH, 0.5 + 2 / SKETCH]
    row = df.agg(*[a for i, c in enumerate(columns) for a in (
        F.count(c).alias(f"n{i}"), F.percentile_approx(value(c), middle, SKETCH).alias(f"q{i}"))]).first()
    places = {}
    for i, c in enumerate(columns):
        for rank in {(row[f"n{i}"] + 1) // 2, row[f"n{i}"] // 2 + 1} if row[f"n{i}"] else ():
            places[c, rank] = {"low": None, "high": None, "n": row[f"n{i}"], "rank": rank, "near": row[f"q{i}"]}

    def within(key):
        at, x = places[key], value(key[0])
        kept = x.isNotNull()
        if at["low"] is not None:
            kept &= x > F.lit(at["low"])
        if at["high"] is not None:
            kept &= x < F.lit(at["high"])
        return F.when(kept, x)

    while wide := [k for k, at in places.items() if "value" not in at and at["n"] > limit]:
        if any("near" not in places[k] for k in wide):
            shares = {k: [min(1.0, max(0.0, places[k]["rank"] / places[k]["n"] + gap)) for gap in (-2 / SKETCH, 2 / SKETCH)]
                      for k in wide}
            row = df.agg(*[F.percentile_approx(within(k), shares[k], SKETCH).alias(f"q{i}") for i, k in enumerate(wide)]).first()
            for i, k in enumerate(wide):
                places[k]["near"] = row[f"q{i}"]
        counts = []
        for i, k in enumerate(wide):
            x, lo, hi = within(k), *[F.lit(v) for v in places[k]["near"]]
            counts += [F.count_if(x < lo).alias(f"a{i}"), F.count_if(x == lo).alias(f"b{i}"),
                       F.count_if((x > lo) & (x < hi)).alias(f"c{i}"), F.count_if((x == hi) & (hi > lo)).alias(f"d{i}")]
        row = df.agg(*counts).first()
        for i, k in enumerate(wide):
            lo, hi = places[k].pop("near")
            places[k] = _narrowed(places[k], lo, hi, *[row[f"{part}{i}"] for part in "abcd"])
    if few := [k for k, at in places.items() if "value" not in at]:
        row = df.agg(*[F.sort_array(F.collect_list(within(k))).alias(f"v{i}") for i, k in enumerate(few)]).select(
            *[F.get(f"v{i}", F.lit(places[k]["rank"] - 1)).alias(f"v{i}") for i, k in enumerate(few)]).first()
        for i, k in enumerate(few):
            places[k]["value"] = row[f"v{i}"]
    found = {c: [at["value"] for (name, _), at in places.items() if name == c] for c in columns}
    return df.sparkSession.createDataFrame([(c, min(v) / 2 + max(v) / 2 if len(v) > 1 else v[0] if v else None)
                                            for c, v in found.items()], "column_name string, median double")


def _number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def scaling(train: DataFrame, columns: Sequence[str], limit: int = GATHERED) -> list[dict]:
    """Per output column: source, whether it is a missing indicator, fill value, mean and population deviation.

    Indicators exist for the columns with missing values in the fitting rows.
    """
    medians = {r["column_name"]: r["median"] for r in column_medians(train, columns, limit).collect()}
    gaps = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    outputs = [{"name": c, "source": c, "indicator": False, "fill": 0.0 if medians[c] is None else medians[c]} for c in columns]
    outputs += [{"name": f"{c}_missing", "source": c, "indicator": True, "fill": None} for c in columns if gaps[c]]
    value = lambda o: (F.col(o["source"]).isNull().cast("double") if o["indicator"]
                       else F.coalesce(F.col(o["source"]).cast("double"), F.lit(float(o["fill"]))))
    # one aggregate of a vector: as many aggregates as outputs would be too many to compile
    rows = train.select(array_to_vector(F.array(*[value(o) for o in outputs])).alias("v"))
    row = rows.agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).first()["s"]
    for o, mean, variance in zip(outputs, row["mean"], row["variance"], strict=True):
        std = (float(variance) * (row["count"] - 1) / row["count"]) ** 0.5
        o["mean"], o["std"] = float(mean), std if std else 1.0
    return outputs


def fit_preprocess(train: DataFrame, columns: Sequence[str], scale: bool = True,
                   limit: int = GATHERED) -> PipelineModel:
    """Median fill, missing indicators, standardising and one-hot encoding, as one savable pipeline.

    A category unseen in the fitting rows becomes all zeros.
    """
    categories = [c for c in columns if c in CATEGORICAL]
    outputs = scaling(train, [c for c in columns if c not in CATEGORICAL], limit)
    exprs = []
    for o in outputs:
        src = f"CAST(`{o['source']}` AS DOUBLE)"
        raw = f"CAST({src} IS NULL AS DOUBLE)" if o["indicator"] else f"coalesce({src}, {_number(o['fill'])})"
        exprs.append((f"({raw} - {_number(o['mean'])}) / {_number(o['std'])}" if scale else raw) + f" AS `z_{o['name']}`")
    filled = [f"coalesce(CAST(`{c}` AS STRING), 'missing') AS `c_{c}`" for c in categories]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs + filled)} FROM __THIS__")]
    if categories:
        stages.append(StringIndexer(inputCols=[f"c_{c}" for c in categories], handleInvalid="keep",
                                    stringOrderType="alphabetAsc", outputCols=[f"i_{c}" for c in categories]))
        stages.append(OneHotEncoder(inputCols=[f"i_{c}" for c in categories],
                                    outputCols=[f"h_{c}" for c in categories], dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"z_{o['name']}" for o in outputs] + [f"h_{c}" for c in categories],
                                  outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def prepared(prepare: PipelineModel, train: DataFrame) -> DataFrame:
    """Features, label and weight of the fitting rows, written once, as every fit reads them several times."""
    return durable(class_weights(prepare.transform(train)).select("features", "y", "w"))


def feature_names(prepared: DataFrame, col: str = "features") -> list[str]:
    """Names of the vector's elements, from the column metadata the assembler writes."""
    attrs = prepared.schema[col].metadata["ml_attr"]["attrs"]
    found = sorted((a["idx"], a.get("name", str(a["idx"]))) for kind in attrs.values() for a in kind)
    return [name.removeprefix("z_").removeprefix("h_") for _, name in found]
