"""Fitted ensembles as expressions: scores in Catalyst or any SQL engine, and exact contributions of features.

An ensemble's nodes are exported as a table, of which there are at most trees x 2^depth. A tree is one nested CASE over the
feature columns, the same text for Spark and for other engines; the raw score is the weighted sum of the trees.

Contributions are Shapley values of the path-weighted expectation: a feature that is not known sends a row down both
sides of a split by their shares of the training rows. A leaf needs only the features on its path, so the value
is a sum over leaves, computed for batches of rows. The contributions of a row and the ensemble's mean add up
to its raw score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.session import stage
from labtrail.sources.writers import work_folder

#: Value of a missing feature; see `boosting.MISSING`.
MISSING = -1e9


@dataclass(frozen=True)
class Node:
    """A leaf (`feature` is None) or a split: rows with feature <= threshold go left."""

    value: float
    rows: float
    feature: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> Iterator[tuple[Node, list[tuple[Node, bool]]]]:
        """Each leaf with the splits above it and whether it lies to their left."""
        if self.feature is None:
            yield self, []
            return
        for child, is_left in ((self.left, True), (self.right, False)):
            for leaf, path in child.leaves():
                yield leaf, [(self, is_left), *path]

    def sql(self, values: dict[int, str] | None = None) -> str:
        """Nested CASE; `values` gives the text of each leaf by its identity, if not its value."""
        if self.feature is None:
            return values[id(self)] if values else f"cast({self.value!r} as double)"
        column = f"coalesce(cast({self.feature} as double), cast({MISSING!r} as double))"
        test = f"{column} <= cast({self.threshold!r} as double)"
        return f"case when {test} then {self.left.sql(values)} else {self.right.sql(values)} end"


@dataclass(frozen=True)
class Ensemble:
    """Weighted trees; `logistic` ones give the margin of a probability."""

    trees: Sequence[tuple[float, Node]]
    logistic: bool
    start: float = 0.0

    def raw_sql(self) -> str:
        return " + ".join([f"cast({self.start!r} as double)", *[f"cast({w!r} as double) * ({t.sql()})" for w, t in self.trees]])

    def score_sql(self) -> str:
        """Probability, or the value of a continuous goal."""
        return f"1 / (1 + exp(-2 * ({self.raw_sql()})))" if self.logistic else self.raw_sql()

    def score(self) -> Column:
        return F.expr(self.score_sql())

    @property
    def mean(self) -> float:
        """Raw score of a row of which nothing is known."""
        return self.start + sum(w * sum(leaf.value * _share(path) for leaf, path in t.leaves()) for w, t in self.trees)


def _share(path: Sequence[tuple[Node, bool]]) -> float:
    out = 1.0
    for node, is_left in path:
        out *= (node.left if is_left else node.right).rows / node.rows
    return out


def exported(model, features: Sequence[str]) -> Ensemble:
    """The ensemble of a fitted GBT model, whose vector holds `features` in order."""
    spark = SparkSession.active()
    folder = work_folder(spark)
    model.write().save(folder)
    # at most trees x 2^depth rows
    table = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    nodes = {(r["treeID"], r["id"]): r for r in table}

    def node(tree: int, k: int) -> Node:
        r = nodes[tree, k]
        if r["leftChild"] < 0:
            return Node(r["prediction"], float(r["rawCount"]))
        if r["split"]["numCategories"] >= 0:
            raise ValueError("only numeric splits are exported")
        (threshold,) = r["split"]["leftCategoriesOrThreshold"]
        children = node(tree, r["leftChild"]), node(tree, r["rightChild"])
        return Node(r["prediction"], float(r["rawCount"]), features[r["split"]["featureIndex"]], threshold, *children)

    logistic = "Classification" in type(model).__name__
    return Ensemble([(float(w), node(k, 0)) for k, w in enumerate(model.treeWeights)], logistic)


# ------------------------------------------------------------- contributions


def leaf_parts(tree: Node) -> Iterator[tuple[float, list[tuple[str, float, float, float]]]]:
    """For each leaf its value and, for each feature on its path, (name, above, up to, share of rows kept)."""
    for leaf, path in tree.leaves():
        merged: dict[str, list[float]] = {}
        for split, is_left in path:
            low, high, share = merged.get(split.feature, (-math.inf, math.inf, 1.0))
            share *= (split.left if is_left else split.right).rows / split.rows
            if is_left:
                high = min(high, split.threshold)
            else:
                low = max(low, split.threshold)
            merged[split.feature] = [low, high, share]
        yield leaf.value, [(f, *x) for f, x in merged.items()]


def explained(ensemble: Ensemble, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Contributions of each feature for arrays of feature values."""
    size = len(next(iter(columns.values())))
    out = {f: np.zeros(size) for f in columns}
    for weight, tree in ensemble.trees:
        for value, parts in leaf_parts(tree):
            m = len(parts)
            inside = [((columns[f] > low) & (columns[f] <= high)).astype(float) for f, low, high, _ in parts]
            for i, (feature, _, _, share) in enumerate(parts):
                # number of known features among the others -> sum of products over all such sets
                sums = [np.ones(size)]
                for j, (_, _, _, other) in enumerate(parts):
                    if j != i:
                        grown = [s * other for s in sums] + [np.zeros(size)]
                        for k, s in enumerate(sums):
                            grown[k + 1] = grown[k + 1] + s * inside[j]
                        sums = grown
                chance = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
                total = sum(c * s for c, s in zip(chance, sums, strict=True))
                out[feature] += weight * value * (inside[i] - share) * total
    return out


def contributions(df: DataFrame, ensemble: Ensemble, features: Sequence[str], key: str) -> DataFrame:
    """Rows (`row_id`, `feature`, `value`, `contribution`) of every row and feature; a missing value stays null."""
    rows = df.select(F.col(key).cast("long").alias("row_id"), *[F.col(f"`{f}`").cast("double").alias(f) for f in features])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {f: np.asarray(batch.column(f).fill_null(MISSING)) for f in features}
            found = explained(ensemble, columns)
            for f in features:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), pa.array([f] * batch.num_rows), batch.column(f), pa.array(found[f])],
                    ["row_id", "feature", "value", "contribution"],
                )

    return rows.mapInArrow(explain, "row_id long, feature string, value double, contribution double")


# --------------------------------------------------------------- quantile fits


def fit_quantile(
    train: DataFrame, features: Sequence[str], share: float, rounds: int = 20, rate: float = 0.1, depth: int = 3,
    least: int = 5, seed: int = 1239, every: int = 5,
) -> Ensemble:
    """Boosted trees for the quantile `share` of `label`, from rows of `boosting.assemble`.

    A round fits a tree to the direction in which each row's error should move, which decides the regions; the
    value of each leaf is then the quantile of the errors of its rows, from one grouped job. Scores are
    expressions over the features, and the table is written every few rounds to keep plans short.
    """
    if not 0 < share < 1:
        raise ValueError("a quantile lies between 0 and 1")
    start = float(train.agg(F.percentile("label", share)).first()[0])
    rows = stage(train.withColumn("_score", F.lit(start)))
    trees: list[tuple[float, Node]] = []
    for k in range(rounds):
        error = F.col("label") - F.col("_score")
        target = rows.withColumn("_move", F.when(error > 0, share).otherwise(share - 1))
        learner = DecisionTreeRegressor(
            featuresCol="features", labelCol="_move", maxDepth=depth, minInstancesPerNode=least, seed=seed + k
        )
        shape = _tree(learner.fit(target), features)
        leaves = [leaf for leaf, _ in shape.leaves()]
        numbers = {id(leaf): str(i) for i, leaf in enumerate(leaves)}
        placed = rows.select(F.expr(shape.sql(numbers)).alias("leaf"), error.alias("error"))
        # a row for each leaf
        found = {r["leaf"]: r["v"] for r in placed.groupBy("leaf").agg(F.percentile("error", share).alias("v")).collect()}
        tree = _with_values(shape, {id(leaf): float(found.get(i, 0.0)) for i, leaf in enumerate(leaves)})
        trees.append((rate, tree))
        rows = rows.withColumn("_score", F.col("_score") + F.expr(f"cast({rate!r} as double) * ({tree.sql()})"))
        if (k + 1) % every == 0:
            rows = stage(rows)
    return Ensemble(trees, logistic=False, start=start)


def _tree(model, features: Sequence[str]) -> Node:
    """A fitted regression tree, read from the driver's copy: at most 2^depth nodes."""

    def node(j) -> Node:
        rows = float(j.impurityStats().count())
        if j.subtreeDepth() == 0:
            return Node(j.prediction(), rows)
        children = node(j.leftChild()), node(j.rightChild())
        return Node(j.prediction(), rows, features[j.split().featureIndex()], j.split().threshold(), *children)

    return node(model._java_obj.rootNode())


def _with_values(tree: Node, values: dict[int, float]) -> Node:
    if tree.feature is None:
        return Node(values[id(tree)], tree.rows)
    children = _with_values(tree.left, values), _with_values(tree.right, values)
    return Node(tree.value, tree.rows, tree.feature, tree.threshold, *children)
