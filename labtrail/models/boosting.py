"""Boosted trees through pyspark.ml: folds, search, final fit, predictions."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.evaluation import metrics
from labtrail.functions import recode, thresholds
from labtrail.models.compiled import Ensemble, fit_quantile
from labtrail.operators.ranking import quantiles, random_position
from labtrail.session import stage

PERSON = "person_id"
# Spark's trees know no missing value; one far below every feature splits off first
MISSING = -1e9

# fixed values: objective class of each metric
OBJECTIVES = {
    **dict.fromkeys(["tweedie", "mae", "mse", "rmse", "q50"], "cont"),
    **dict.fromkeys(["logloss", "auc", "f1", "F1", "aucpr"], "bin"),
    "mlogloss": "multi",
}
# fixed values: quantile goals without a Spark objective, which `compiled.fit_quantile` fits
QUANTILES = {"q05": 0.05, "q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9, "q95": 0.95}


def objective(metric: str) -> str:
    """cont, bin or multi; quantiles other than the median have no Spark objective (`QUANTILES`)."""
    if metric not in OBJECTIVES:
        raise ValueError(f"unknown metric: {metric}")
    return OBJECTIVES[metric]


def assemble(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Feature vector and label, written to the checkpoint folder before iterating."""
    filled = df.withColumns(
        {f"_f_{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(MISSING)) for i, c in enumerate(features)}
    )
    names = [f"_f_{i}" for i in range(len(features))]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    return stage(vectors.withColumn("label", F.col(label).cast("double")).drop(*names))


def fold_assign(df: DataFrame, folds: int, salt: str = "fold") -> DataFrame:
    """Shuffled folds whose sizes differ by at most one row."""
    placed = random_position(df, [], [PERSON], salt, "_pos", "_size")
    small, larger = F.floor(F.col("_size") / folds), F.col("_size") % folds
    edge = larger * (small + 1)
    fold = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (small + 1))).otherwise(
        larger + F.floor((F.col("_pos") - edge) / small)
    )
    return placed.withColumn("fold", fold.cast("int")).drop("_pos", "_size")


# fixed values: search ranges (depth, rows per leaf, row share, column share, gain)
SEARCH = {
    "maxDepth": (2, 8),
    "minInstancesPerNode": (5, 20),
    "subsamplingRate": (0.5, 0.8),
    "featureSubsetStrategy": (0.5, 1.0),
    "minInfoGain": (0.0, 0.15),
}


def random_settings(n: int, seed: int = 429) -> list[dict]:
    """Seeded random settings within SEARCH."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        setting: dict = {}
        for name, (low, high) in SEARCH.items():
            if isinstance(low, int):
                setting[name] = rng.randint(low, high)
            else:
                value = round(rng.uniform(low, high), 4)
                setting[name] = str(value) if name == "featureSubsetStrategy" else value
        out.append(setting)
    return out


def _estimator(kind: str, settings: Mapping, metric: str, rounds: int, rate: float, held: str | None):
    common = {
        "featuresCol": "features",
        "labelCol": "label",
        "maxIter": rounds,
        "stepSize": rate,
        "seed": 1239,
        **settings,
    }
    if held:
        common["validationIndicatorCol"] = held
    if kind == "cont":
        loss = "absolute" if metric in ("mae", "q50") else "squared"
        return GBTRegressor(lossType=loss, **common)
    return GBTClassifier(**common)


def _evaluator(metric: str):
    kind = objective(metric)
    if kind == "cont":
        return RegressionEvaluator(metricName="mae" if metric in ("mae", "q50") else "rmse")
    if metric == "auc":
        return BinaryClassificationEvaluator(metricName="areaUnderROC")
    if metric == "aucpr":
        return BinaryClassificationEvaluator(metricName="areaUnderPR")
    if metric in ("f1", "F1"):
        return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    return MulticlassClassificationEvaluator(metricName="logLoss")


def tune_cv(
    train: DataFrame, metric: str, trials: int, folds: int, rounds: int = 200, rate: float = 0.3
) -> tuple[dict, list[dict]]:
    """Best setting of a seeded random search with K folds, and all scores."""
    kind = objective(metric)
    estimator = _estimator(kind, {}, metric, rounds, rate, None)
    settings = random_settings(trials)
    maps = [{estimator.getParam(k): v for k, v in s.items()} for s in settings]
    evaluator = _evaluator(metric)
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=evaluator,
        foldCol="fold",
        numFolds=folds,
        parallelism=2,
    )
    scores = search.fit(fold_assign(train, folds)).avgMetrics
    better = max if evaluator.isLargerBetter() else min
    best = scores.index(better(scores))
    return settings[best], [{**s, "score": v} for s, v in zip(settings, scores)]


def best_rounds(
    train: DataFrame, settings: Mapping, metric: str, folds: int, most: int, rate: float
) -> int:
    """Mean number of rounds at which the held-out fold stops improving."""
    placed = stage(fold_assign(train, folds))
    counts = []
    for k in range(folds):
        part = placed.withColumn("_held", F.col("fold") == k)
        model = _estimator(objective(metric), settings, metric, most, rate, "_held").fit(part)
        counts.append(model.getNumTrees)
    return max(1, int(sum(counts) / len(counts)))


@dataclass
class Fitted:
    """One model, or one per class for a multi-class goal; one model may be an ensemble of expressions."""

    kind: str
    models: dict


def fit_gbt(
    train: DataFrame, metric: str, settings: Mapping | None = None, rounds: int = 50, rate: float = 0.1,
    features: Sequence[str] = (),
) -> Fitted:
    """Boosted trees; several classes are fitted one against the rest.

    A quantile is fitted by `compiled.fit_quantile`, which needs the names of the vector's `features`.
    """
    settings = dict(settings or {})
    if metric in QUANTILES:
        depth, least = settings.get("maxDepth", 3), settings.get("minInstancesPerNode", 5)
        return Fitted("quantile", {1: fit_quantile(train, features, QUANTILES[metric], rounds, rate, depth, least)})
    kind = objective(metric)
    if kind != "multi":
        return Fitted(kind, {1: _estimator(kind, settings, metric, rounds, rate, None).fit(train)})
    # the classes of a goal are a handful of label values
    classes = sorted(int(r[0]) for r in train.select("label").distinct().collect())
    models = {}
    for c in classes:
        one = train.withColumn("label", recode.one_vs_rest(F.col("label"), c).cast("double"))
        models[c] = _estimator("bin", settings, metric, rounds, rate, None).fit(one)
    return Fitted(kind, models)


def predict(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Add abnorm_probs (value for a continuous goal), or abnorm_probs_<class>."""
    drop = ["rawPrediction", "probability", "prediction"]
    if all(isinstance(m, Ensemble) for m in fitted.models.values()) and fitted.kind != "multi":
        return df.withColumn("abnorm_probs", fitted.models[1].score())
    if fitted.kind == "cont":
        return fitted.models[1].transform(df).withColumnRenamed("prediction", "abnorm_probs")
    out = df
    for c, model in fitted.models.items():
        name = "abnorm_probs" if fitted.kind == "bin" else f"_p_{c}"
        out = model.transform(out).withColumn(name, vector_to_array("probability")[1]).drop(*drop)
    if fitted.kind == "multi":
        total = sum((F.col(f"_p_{c}") for c in fitted.models), F.lit(0.0))
        out = out.withColumns(
            {f"abnorm_probs_{c}": F.try_divide(F.col(f"_p_{c}"), total) for c in fitted.models}
        ).drop(*[f"_p_{c}" for c in fitted.models])
    return out


def cutoff_of(scored: DataFrame, score: str, label: Column) -> Column:
    """Precision-recall balance on the training rows, as a scalar."""
    train = scored.where(F.col("split_set") == 0).select(F.col(score), label.alias("_y"))
    return metrics.pr_balance_cutoff(train, [], score, "_y").scalar()


def predict_table(
    fitted: Fitted,
    df: DataFrame,
    goal: str,
    lab: str = "",
    choice: str = "",
    cutoffs: Mapping[str, float] | None = None,
) -> DataFrame:
    """Prediction rows: truth, probability and class by cut-off.

    Cut-offs are found on the training rows, one per class, unless `cutoffs`
    passes those of an earlier frame. A continuous goal is classed by the lab's
    abnormality rule. Rows without a set get 3.
    """
    rows = df if "split_set" in df.columns else df.withColumn("split_set", F.lit(3.0))
    scored = predict(fitted, rows)
    if fitted.kind in ("cont", "quantile"):
        return scored.withColumns(
            {
                "true_value": F.col(goal),
                "abnorm_preds": thresholds.abnormal(lab, choice, "abnorm_probs"),
                "true_abnorm": thresholds.abnormal(lab, choice, goal),
            }
        )
    scored = scored.withColumn("true_abnorm", F.col(goal))
    for c in fitted.models:
        tail = "" if fitted.kind == "bin" else f"_{c}"
        score = f"abnorm_probs{tail}"
        if cutoffs is not None:
            cut = F.lit(float(cutoffs[score]))
        else:
            cut = cutoff_of(scored, score, recode.one_vs_rest(F.col(goal), c))
        scored = scored.withColumn(f"abnorm_preds{tail}", (F.col(score) > cut).cast("long"))
    return scored


def importance_summary(contributions: DataFrame) -> DataFrame:
    """Per feature: mean size and sign of the contributions, also where the feature is high or low.

    `contributions` has row_id, feature, value, contribution. High and low are 1
    and 0 for a 0/1 feature, else at or beyond the quartiles.
    """
    known = contributions.where(F.col("value").isNotNull())
    ends = quantiles(known, ["feature"], "value", {"q25": 0.25, "q75": 0.75})
    kinds = contributions.groupBy("feature").agg(
        F.coalesce(F.bool_and(F.col("value").isin(0.0, 1.0)), F.lit(True)).alias("binary")
    )
    rows = contributions.join(kinds.join(ends, "feature", "left"), "feature")
    v, phi = F.col("value"), F.col("contribution")
    high = F.coalesce(F.when(F.col("binary"), v == 1).otherwise(v >= F.col("q75")), F.lit(False))
    low = F.coalesce(F.when(F.col("binary"), v == 0).otherwise(v <= F.col("q25")), F.lit(False))
    return rows.groupBy("feature").agg(
        F.avg(F.abs(phi)).alias("mean_size"),
        F.avg(phi).alias("mean_signed"),
        F.avg(F.when(high, phi)).alias("mean_when_1"),
        F.avg(F.when(low, phi)).alias("mean_when_0"),
        F.count_if(high).alias("n_1"),
        F.count_if(low).alias("n_0"),
    )


def settings_table(spark: SparkSession, trials: Sequence[dict]) -> DataFrame:
    """The search's settings and scores as a table; one row per trial."""
    return spark.createDataFrame([{k: str(v) for k, v in t.items()} for t in trials])
