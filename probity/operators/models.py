"""Classifiers over feature tables with Spark ML: split, fit, cross-validate, calibrate, choose, score."""
from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators import metrics as M
from probity.sources.scratch import stored

#: Fits at a time.
FITS = 4
KEYS = ("id", "user_id", "target_is_bot")
LABEL, WEIGHT, SCORE = "label", "weight", "bot_probability"


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*KEYS, LABEL, WEIGHT, "is_test", "fold", "features")]


def labelled(df: DataFrame) -> DataFrame:
    """Rows with a label, with balanced class weights: n / (2 * n of the class)."""
    x = df.where("target_is_bot >= 0").withColumn(LABEL, F.col("target_is_bot").cast("double"))
    n = x.groupBy(LABEL).agg(F.count("*").alias("_k"))
    total = n.agg(F.sum("_k").alias("_n"))
    w = n.crossJoin(total).select(F.col(LABEL).alias("_l"), (F.col("_n") / (2 * F.col("_k"))).alias(WEIGHT))  # two rows
    return x.join(F.broadcast(w), F.col(LABEL) == F.col("_l")).drop("_l")


def classifiers(seed: int = 42) -> dict[str, Callable[[], object]]:
    """Estimators by name; boosted trees stand in for the boosting libraries that aren't installed."""
    common = {"labelCol": LABEL, "featuresCol": "features", "weightCol": WEIGHT}
    return {
        "logistic_regression": lambda **p: LogisticRegression(**common, maxIter=2000, regParam=0.001, **p),
        "random_forest": lambda **p: RandomForestClassifier(**common, seed=seed, **{"numTrees": 400, "maxDepth": 18, **p}),
        "gradient_boosting": lambda **p: GBTClassifier(**common, seed=seed, **{"maxIter": 400, "maxDepth": 3, "stepSize": 0.05, **p}),
        "linear_svc": lambda **p: LinearSVC(**common, maxIter=200, **p),
    }


def pipeline(estimator, features: list[str], scale: bool = True) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="raw" if scale else "features", handleInvalid="error")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator])


def score(model, df: DataFrame, out: str = SCORE) -> DataFrame:
    """df with the probability of class 1; margins of models without one go through the logistic function."""
    x = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in x.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return x.withColumn(out, p).drop("raw", "features", "rawPrediction", "probability", "prediction")


def evaluate(df: DataFrame, label: str = LABEL, p: str = SCORE) -> dict[str, float]:
    c = M.confusion(df, label, p).first()
    precision = c["tp"] / max(1, c["tp"] + c["fp"])
    recall = c["tp"] / max(1, c["tp"] + c["fn"])
    auc = M.roc_auc(df, label, p).first()["roc_auc"]
    ap = M.average_precision(df, label, p).first()["average_precision"]
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / max(1e-12, precision + recall), "accuracy": c["accuracy"], "brier": c["brier"], "roc_auc": auc, "average_precision": ap}


def folds(df: DataFrame, k: int, key: str = "id", seed: int = 42) -> DataFrame:
    """df with fold 0..k-1, each class spread evenly; written once for the k fits."""
    return stored(M.stratified_folds(df, LABEL, key, k, seed))


def vectors(df: DataFrame, features: list[str], k: int, key: str = "id", seed: int = 42) -> DataFrame:
    """(key, label, weight, fold, raw): the features assembled once, for all fits of a search."""
    x = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="error").transform(M.stratified_folds(df, LABEL, key, k, seed))
    return stored(x.select(key, LABEL, *[c for c in (WEIGHT,) if c in df.columns], "fold", "raw"))


def parallel(calls: list[Callable[[], object]], most: int = FITS) -> list:
    """The results of the calls, `most` at a time: each is a series of Spark jobs, which share the cluster."""
    threads = [inheritable_thread_target(f) for f in calls]
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(lambda f: f(), threads))


def fitted(x: DataFrame, estimator, scale: bool = True):
    """A model of the rows of vectors()."""
    if scale:
        return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), estimator]).fit(x)
    return Pipeline(stages=[estimator.copy({estimator.featuresCol: "raw"})]).fit(x)


def _on_fold(x: DataFrame, make, i: int, scale: bool) -> DataFrame:
    """The scores of fold i by a model that hasn't seen it."""
    return score(fitted(x.where(F.col("fold") != i), make(), scale), x.where(F.col("fold") == i))


def cross_validate(df: DataFrame, make, features: list[str], k: int = 5, scale: bool = True, key: str = "id") -> dict[str, float]:
    """Mean measures of k fits, each tested on the fold that it hasn't seen."""
    x = vectors(df, features, k, key)
    runs = parallel([lambda i=i: evaluate(_on_fold(x, make, i, scale)) for i in range(k)])
    return {m: sum(r[m] or 0.0 for r in runs) / k for m in runs[0]}


def random_search(df: DataFrame, make, grid: dict[str, list], features: list[str], draws: int = 20, k: int = 3, seed: int = 42, told: list | None = None) -> tuple[dict, float]:
    """The parameters of the best mean AUC over k folds among seeded draws from the grid; ties: the first draw.

    All draws are fitted for the first fold; then, best first, for the others. A draw that couldn't become the best
    even with an AUC of 1 in all folds that are left is dropped, which changes no result. told gets (draw, fold)
    of each fit."""
    rng = random.Random(seed)
    tried = [{p: rng.choice(v) for p, v in sorted(grid.items())} for _ in range(draws)]
    x = vectors(df, features, k)

    def auc(draw: int, fold: int) -> float:
        if told is not None:
            told.append((draw, fold))
        return M.roc_auc(_on_fold(x, lambda: make(**tried[draw]), fold, True), LABEL, SCORE).first()["roc_auc"] or 0.0

    first = parallel([lambda d=d: auc(d, 0) for d in range(draws)])
    best, at = -1.0, 0
    for d in sorted(range(draws), key=lambda d: (-first[d], d)):
        if (first[d] + k - 1) / k < best:
            break  # the draws behind have less in the first fold
        mean = (first[d] + sum(parallel([lambda i=i: auc(d, i) for i in range(1, k)]))) / k
        if mean > best or mean == best and d < at:
            best, at = mean, d
    return tried[at], best


#: Grids of the searches, for the estimators that stand in for the boosting libraries; draws of each.
GRIDS = {"gradient_boosting": ({"maxDepth": [3, 5, 7], "stepSize": [0.03, 0.05, 0.08], "maxIter": [60, 100, 150], "subsamplingRate": [0.7, 0.8, 0.9]}, 20), "random_forest": ({"maxDepth": [8, 12, 18], "numTrees": [100, 200, 400], "subsamplingRate": [0.7, 0.85, 1.0]}, 15), "logistic_regression": ({"elasticNetParam": [0.0, 0.5, 1.0]}, 3)}


def compare(train: DataFrame, test: DataFrame, features: list[str], makes: dict[str, Callable] | None = None, grids: dict | None = None, k: int = 5, top: int = 3) -> tuple[list[dict], list[dict]]:
    """Cross-validated measures of all models, best AUC first; and of the `top` of these, with the parameters that a
    search found, measures on the rows that no fit has seen, best AUC first."""
    makes, grids = makes or classifiers(), GRIDS if grids is None else grids
    rows = [{"model": name, **cross_validate(train, make, features, k)} for name, make in makes.items()]
    rows.sort(key=lambda r: (-r["roc_auc"], r["model"]))
    held = []
    for r in rows[:top]:
        grid, draws = grids.get(r["model"], ({}, 1))
        chosen = random_search(train, makes[r["model"]], grid, features, draws)[0] if grid else {}
        model = pipeline(makes[r["model"]](**chosen), features).fit(train)
        held.append({"model": r["model"], "parameters": chosen, **evaluate(score(model, test))})
    held.sort(key=lambda r: (-r["roc_auc"], r["model"]))
    return rows, held


def calibrated(df: DataFrame, make, features: list[str], k: int = 5, scale: bool = True, key: str = "id") -> Callable[[DataFrame], DataFrame]:
    """A scorer: k pairs of a model and a logistic map of its margin, fitted on the fold that the model
    hasn't seen; the mean of their probabilities."""
    x = folds(df, k, key)

    def pair(i: int) -> tuple:
        model = pipeline(make(), features, scale).fit(x.where(F.col("fold") != i))
        out = margin(model, x.where(F.col("fold") == i))
        platt = pipeline(LogisticRegression(labelCol=LABEL, featuresCol="features", maxIter=100), ["_margin"], False).fit(out)
        return model, platt

    pairs = parallel([lambda i=i: pair(i) for i in range(k)])

    def apply(rows: DataFrame) -> DataFrame:
        names = []
        for i, (model, platt) in enumerate(pairs):
            rows = score(platt, margin(model, rows), f"_p{i}").drop("_margin")
            names.append(f"_p{i}")
        mean = sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)
        return rows.withColumn(SCORE, mean).drop(*names)

    apply.pairs = pairs
    return apply


def margin(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("_margin", vector_to_array("rawPrediction")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def correlations(df: DataFrame, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    """The features of the highest absolute Spearman correlation with the label."""
    x = VectorAssembler(inputCols=[*features, LABEL], outputCol="v").transform(df)
    m = Correlation.corr(x, "v", "spearman").first()[0].toArray()[-1][:-1]
    return sorted(zip(features, map(float, m)), key=lambda r: -abs(r[1]))[:top]


def importances(model, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda r: -r[1])[:top]


def predict(scorer: Callable[[DataFrame], DataFrame], df: DataFrame, threshold: float) -> DataFrame:
    """Unlabelled rows with bot_probability and predicted_bot."""
    return scorer(df.where("target_is_bot < 0")).select("id", "user_id", SCORE, (F.col(SCORE) >= threshold).cast("int").alias("predicted_bot"))
