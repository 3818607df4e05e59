"""Models over URL measures and fused vectors: boosted trees, and an ensemble of three classifiers."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.operators.registry import balanced
from webwarden.session import path_exists

logger = logging.getLogger(__name__)

#: Most rows of each label that a classifier is fitted on; scoring covers all rows.
FIT_CAP = 20_000
# Weights of the ensemble's members.
WEIGHTS = {"forest": 0.45, "margin": 0.35, "logit": 0.20}


def boosted(train: DataFrame, features: list[str], label: str, key: str, trees: int = 20, depth: int = 4, step: float = 0.05, cap: int = FIT_CAP) -> PipelineModel:
    """Boosted trees on a balanced part of the rows, chosen by hash of the key."""
    fit = balanced(train, label, key, cap)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=7)]).fit(fit)


def ensemble(train: DataFrame, features: list[str], label: str, key: str, cap: int = FIT_CAP) -> PipelineModel:
    """A forest, a linear margin and a logistic model over the same standardised features."""
    fit = balanced(train, label, key, cap)
    named = lambda m, n: m.setLabelCol(label).setFeaturesCol("scaled").setPredictionCol(f"p_{n}").setRawPredictionCol(f"raw_{n}")
    stages = [
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        named(RandomForestClassifier(numTrees=20, maxDepth=6, seed=7), "forest").setProbabilityCol("q_forest"), named(LinearSVC(maxIter=20), "margin"), named(LogisticRegression(maxIter=30), "logit").setProbabilityCol("q_logit"),
    ]
    return Pipeline(stages=stages).fit(fit)


def ensemble_score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with `score`, the weighted mean of the members' probabilities; the margin passes through a sigmoid. Members
    that the model lacks are left out, and the weights of the others count as a whole; without any, the score is 0.50."""
    out = model.transform(rows)
    parts = {
        "forest": ("q_forest", lambda: vector_to_array("q_forest")[1]), "margin": ("raw_margin", lambda: 1 / (1 + F.exp(-vector_to_array("raw_margin")[1]))), "logit": ("q_logit", lambda: vector_to_array("q_logit")[1])
    }
    there = [k for k, (column, _) in parts.items() if column in out.columns]
    score = sum((WEIGHTS[k] * parts[k][1]() for k in there), F.lit(0.0)) / sum(WEIGHTS[k] for k in there) if there else F.lit(0.5)
    return out.select(*rows.columns, F.round(score, 4).alias("score"))


def save(model: PipelineModel, path: str) -> None:
    """Write a model to the shared folder, in place of one that is there."""
    model.write().overwrite().save(path)


def loaded(spark: SparkSession, path: str, train: Callable[[], PipelineModel]) -> PipelineModel:
    """The model saved under a path. Where there is none, or what is there cannot be read, one is trained and saved."""
    if path_exists(spark, path):
        try:
            return PipelineModel.load(path)
        except Exception as e:  # a broken or foreign artefact: the default takes its place
            logger.warning("no model could be read from %s: %s", path, str(e).splitlines()[0] if str(e) else type(e).__name__)
    model = train()
    save(model, path)
    return model


def metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: rows, accuracy, precision, recall, f1, false positive rate, and the area under the curve by ranks,
    which are counted per distinct rounded score, so nothing is sorted in one task but at most 10,001 scores."""
    per = scored.groupBy(F.round(score, 4).alias("s")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.sum((F.col(label) != 1).cast("bigint")).alias("n"))
    from pyspark.sql import Window

    below = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = F.col("s") >= threshold
    add = lambda c: F.sum(c)
    t = per.withColumn("u", F.col("p") * (below + F.col("n") / 2)).agg(
        add("p").alias("P"), add("n").alias("N"), add(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), add(F.when(hit, F.col("n")).otherwise(0)).alias("fp"), add("u").alias("u")
    )
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "P", "N"))
    return t.select((p + n).alias("rows"), part(tp + n - fp, p + n).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, p).alias("recall"), part(2 * tp, tp + fp + p).alias("f1"), part(fp, n).alias("fpr"), part(F.col("u"), p * n).alias("auc"))


def ablation(model: PipelineModel, rows: DataFrame, groups: dict[str, list[str]], id_col: str) -> DataFrame:
    """(id, base, one column per group): how much a row's score falls when a group's features are set to 0."""
    from functools import reduce

    prob = lambda df: model.transform(df).select(id_col, vector_to_array("probability")[1].alias("q"))
    parts = [prob(rows).withColumnRenamed("q", "base")]
    for name, cols in groups.items():
        parts.append(prob(rows.withColumns({c: F.lit(0.0) for c in cols})).withColumnRenamed("q", f"without_{name}"))
    joined = reduce(lambda a, b: a.join(b, id_col), parts)
    return joined.select(id_col, F.round("base", 4).alias("base"), *[F.round(F.col("base") - F.col(f"without_{g}"), 4).alias(g) for g in groups])
