"""Estimators, scoring and inspection."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.models.boosting import Binner, BoostedTrees, fit_bins, fit_trees
from evengap.models.prepare import class_weights, feature_names, fit_preprocess, prepared
from evengap.operators.describe import with_hash_rank
from evengap.operators.enrich import union_all
from evengap.operators.evaluate import average_precision
from evengap.operators.select import BOOLEAN, CATEGORICAL, EXTRA_GROUPS
from evengap.operators.skew import durable, passing

#: Rounds without a lower held-out loss after which boosting ends.
PATIENCE = 15


def fit_logreg(train: DataFrame, columns: Sequence[str], C: float = 1.0, max_iter: int = 200) -> PipelineModel:
    """Weighted logistic regression on standardised features.

    ``C`` weighs the summed loss against half the squared norm, so the penalty
    on the mean loss is 1 / (C * sum of weights); balanced weights add up to the
    number of rows.
    """
    prepare = fit_preprocess(train, columns)
    data = class_weights(prepare.transform(train))
    total = data.agg(F.sum("w")).first()[0]
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", maxIter=max_iter,
                               regParam=1.0 / (C * total), standardization=False).fit(data)
    return PipelineModel(stages=[*prepare.stages, model])


def fit_pca_logreg(train: DataFrame, columns: Sequence[str], n: int, C: float = 1.0,
                   max_iter: int = 200) -> tuple[PipelineModel, float]:
    """Logistic regression on the first ``n`` principal components; also the variance they explain."""
    prepare = fit_preprocess(train, columns)
    n = min(n, len(feature_names(prepare.transform(train.limit(0)))))
    data = prepared(prepare, train)
    pca = PCA(k=n, inputCol="features", outputCol="components").fit(data)
    data = pca.transform(data)
    total = data.agg(F.sum("w")).first()[0]
    model = LogisticRegression(featuresCol="components", labelCol="y", weightCol="w", maxIter=max_iter,
                               regParam=1.0 / (C * total), standardization=False).fit(data)
    return PipelineModel(stages=[*prepare.stages, pca, model]), float(sum(pca.explainedVariance))


def boosting_frame(train: DataFrame, columns: Sequence[str], val: DataFrame | None = None) -> tuple[Binner, DataFrame]:
    """The fitted bins, and the binned rows, labels and weights of training and held-out rows, written once."""
    spec = fit_bins(train, list(columns), [c for c in columns if c in CATEGORICAL])
    binner, needed = Binner(spec=json.dumps(spec)), ["bins", "y", "w", "held_out"]
    data = class_weights(binner.transform(train)).withColumn("held_out", F.lit(False)).select(*needed)
    if val is not None:
        held = class_weights(binner.transform(val)).withColumn("held_out", F.lit(True))
        data = union_all(data, held.select(*needed))
    return binner, durable(data)


def some_bins(binner: Binner, columns: Sequence[str], *frames: DataFrame) -> tuple:
    """The fitted bins and the binned rows of some of the columns, in the order given; nothing is fitted or binned again."""
    spec = json.loads(binner.getOrDefault("spec"))
    runs: list[list[int]] = []
    for place in map(spec["columns"].index, columns):
        if runs and runs[-1][0] + runs[-1][1] == place:
            runs[-1][1] += 1
        else:
            runs.append([place, 1])
    own = F.concat(*[F.substring("bins", place + 1, n) for place, n in runs])
    spec = {"columns": list(columns), **{part: {c: v for c, v in spec[part].items() if c in columns} for part in ("cuts", "codes")}}
    return Binner(spec=json.dumps(spec)), *[f.withColumn("bins", own) for f in frames]


def boost(binner: Binner, data: DataFrame, params: dict, early_stop: bool = True, seed: int = 0) -> BoostedTrees:
    """Trees on the rows that are not held out; ``patience`` among the parameters is used with ``early_stop`` only."""
    patience = params.get("patience", PATIENCE) if early_stop else None
    return fit_trees(data, json.loads(binner.getOrDefault("spec")), params, patience, seed)


def fit_gbt(train: DataFrame, columns: Sequence[str], params: dict | None = None, val: DataFrame | None = None,
            seed: int = 0) -> PipelineModel:
    """Weighted boosted trees, see :mod:`evengap.models.boosting`.

    With ``val`` rows the loss of every round is known; boosting ends ``patience`` rounds (a parameter) after the lowest
    one, and the model is cut there. An empty ``val`` is none.
    """
    val = None if val is None or val.isEmpty() else val
    with passing(train.sparkSession):
        binner, data = boosting_frame(train, columns, val)
        return PipelineModel(stages=[binner, boost(binner, data, params or {}, val is not None, seed)])


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    """The kept columns, the label and the predicted probability."""
    out = model.transform(df)
    return out.select(*keep, "y", vector_to_array("probability")[1].alias(name))


def pr_auc(model, df: DataFrame) -> float | None:
    with passing(df.sparkSession):
        row = average_precision(score(model, df.withColumn("__g", F.lit(0)), ["__g"]), ["__g"]).first()
    return row["pr_auc"] if row else None


def coefficient_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Coefficient of every feature of a logistic model, with the kind of feature."""
    names = feature_names(PipelineModel(stages=model.stages[:-1]).transform(df.limit(0)))
    extra = {c: g for g, cols in EXTRA_GROUPS.items() for c in cols}

    def kind(name: str) -> str:
        if name.endswith("_missing"):
            return "missing"
        if name in BOOLEAN:
            return "flag"
        if any(name.startswith(f"{c}_") for c in CATEGORICAL):
            return "category"
        return extra.get(name, "numeric")

    rows = [(n, kind(n), float(c)) for n, c in zip(names, model.stages[-1].coefficients.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, coefficient double")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: Sequence[str],
                           n: int | None = None, repeats: int = 5, seed: int = 0) -> DataFrame:
    """Mean and deviation of the PR-AUC lost when one feature is shuffled among all rows, or ``n`` sampled ones.

    The numbered rows are written once. A shuffle pairs row number i with the row that comes i-th in another hash
    order; the pairing is an equi-join on the number. Features and repeats are
    scored in one pass and told apart by grouping.
    """
    sample = durable(with_hash_rank(df, key, seed, "__i", n))
    frames = []
    for r in range(repeats):
        donors = (with_hash_rank(sample.drop("__i"), key, seed + 1 + r, "__i")
                  .select("__i", *[F.col(c).alias(f"__d_{c}") for c in features]))
        frames.append(sample.join(donors, "__i").withColumn("repeat", F.lit(r)))
    pairs = union_all(*frames)
    named = F.array(*[F.lit(c) for c in features])
    shuffled = (pairs.withColumn("feature", F.explode(named))
                .select("feature", "repeat", "y",
                        *[F.when(F.col("feature") == c, F.col(f"__d_{c}")).otherwise(F.col(c)).alias(c)
                          for c in features]))
    base = pr_auc(model, sample)
    losses = average_precision(score(model, shuffled, ["feature", "repeat"]), ["feature", "repeat"])
    return (losses.withColumn("loss", F.lit(base) - F.col("pr_auc")).groupBy("feature")
            .agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std")))

