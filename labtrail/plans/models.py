"""Model fit, prediction and importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.evaluation import metrics
from labtrail.functions import dates
from labtrail.models import boosting, compiled
from labtrail.models.compiled import Ensemble, Node
from labtrail.plans.registry import BASE, query, u_sql

FEATURES = ["age", "male", "bmi", "mean", "last", "n_lab", "n_code"]


def training_rows(t):
    """Person features before the base date with the fixture's labels."""
    base = dates.day(BASE)
    labs = t.lab.where((F.col("dt") < base) & F.col("value").isNotNull()).groupBy("person_id").agg(
        F.avg("value").alias("mean"),
        F.max(F.struct("dt", "rid", "value"))["value"].alias("last"),
        F.count(F.lit(1)).alias("n_lab"),
    )
    codes = t.code.where(F.col("dt") < base).groupBy("person_id").agg(F.count(F.lit(1)).alias("n_code"))
    persons = t.person.select(
        "person_id",
        dates.age_at(base, F.col("birth_date")).alias("age"),
        (F.col("sex") == "male").cast("int").alias("male"),
        "bmi",
    )
    # the outcome follows the history, so that there is something to learn
    rows = t.pred.join(persons, "person_id").join(labs, "person_id", "left").join(codes, "person_id", "left")
    risk = F.coalesce(F.col("mean"), F.lit(95.0)) + 20 * F.col("p1")
    return rows.withColumn("y", (risk > 108).cast("int"))


def _assembled(t, label="y"):
    return boosting.assemble(training_rows(t), FEATURES, label)


def _train(df):
    return df.where(F.col("split_set") == 0)


@query("fit_gbt", "split_set:f n:i n_case:i auc:f avg_prec:f")
def fit_gbt(t):
    rows = _assembled(t)
    fitted = boosting.fit_gbt(_train(rows), "logloss", {"maxDepth": 3}, rounds=5, rate=0.3)
    from labtrail.evaluation.metrics import ranked_metrics

    return ranked_metrics(boosting.predict(fitted, rows), ["split_set"], "abnorm_probs", "y")


@query("fit_gbt_rounds", "rounds:i n:i")
def fit_gbt_rounds(t):
    train = _train(_assembled(t))
    rounds = boosting.best_rounds(train, {"maxDepth": 3}, "logloss", 2, 6, 0.3)
    return train.agg(F.count(F.lit(1)).alias("n")).withColumn("rounds", F.lit(rounds))


@query("tune_cv", "maxDepth:s minInstancesPerNode:s subsamplingRate:s score:s")
def tune_cv(t):
    _, trials = boosting.tune_cv(_train(_assembled(t)), "logloss", trials=2, folds=2, rounds=3)
    return boosting.settings_table(t.spark, trials)


@query("predict_table", "person_id:i split_set:f y:i abnorm_probs:f abnorm_preds:i true_abnorm:i")
def predict_table(t):
    rows = _assembled(t)
    fitted = boosting.fit_gbt(_train(rows), "logloss", {"maxDepth": 3}, rounds=5, rate=0.3)
    return boosting.predict_table(fitted, rows, "y")


@query(
    "predict_table_multi",
    "person_id:i true_abnorm:i abnorm_probs_0:f abnorm_probs_1:f abnorm_probs_2:f abnorm_preds_1:i",
)
def predict_table_multi(t):
    mean = F.coalesce(F.col("mean"), F.lit(95.0))
    three = training_rows(t).withColumn("y", F.when(mean > 108, 1).when(mean < 85, 2).otherwise(0))
    rows = boosting.assemble(three, FEATURES, "y")
    fitted = boosting.fit_gbt(_train(rows), "mlogloss", {"maxDepth": 2}, rounds=3, rate=0.3)
    return boosting.predict_table(fitted, rows, "y")


@query("predict_table_value", "person_id:i true_value:f abnorm_probs:f abnorm_preds:f true_abnorm:f")
def predict_table_value(t):
    rows = training_rows(t).where(F.col("last").isNotNull()).withColumn("event_age", F.col("age"))
    vectors = boosting.assemble(rows, ["age", "male", "mean", "n_lab"], "last")
    fitted = boosting.fit_gbt(_train(vectors), "rmse", {"maxDepth": 3}, rounds=5, rate=0.3)
    return boosting.predict_table(fitted, vectors, "last", "egfr", "KDIGO-soft")


@query(
    "fold_assign",
    "person_id:i fold:i",
    f"select person_id, ntile(7) over (order by {u_sql('person_id', salt='fold')}, person_id) - 1 as fold from pred",
)
def fold_assign(t):
    return boosting.fold_assign(t.pred, 7)


@query(
    "importance_summary",
    "feature:s mean_size:f mean_signed:f mean_when_1:f mean_when_0:f n_1:i n_0:i",
    """with c as (select rid as row_id, lab as feature, value, (coalesce(value, 100) - 90) / 10 as contribution from lab
                  union all select rid, 'high', cast(flag = 'H' as integer), case when flag = 'H' then 0.5 else -0.25 end from lab),
       q as (select feature, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, bool_and(value in (0, 1)) as zero_one from c group by feature),
       m as (select c.*, case when zero_one then value = 1 else value >= b end as hi, case when zero_one then value = 0 else value <= a end as lo from c join q using (feature))
       select feature, avg(abs(contribution)) as mean_size, avg(contribution) as mean_signed, avg(contribution) filter (hi) as mean_when_1,
         avg(contribution) filter (lo) as mean_when_0, count(*) filter (hi) as n_1, count(*) filter (lo) as n_0 from m group by feature""",
)
def importance_summary(t):
    value = F.col("value")
    labs = t.lab.select(
        F.col("rid").alias("row_id"),
        F.col("lab").alias("feature"),
        "value",
        ((F.coalesce(value, F.lit(100.0)) - 90) / 10).alias("contribution"),
    )
    high = F.col("flag") == "H"
    flags = t.lab.select(
        F.col("rid").alias("row_id"),
        F.lit("high").alias("feature"),
        high.cast("double").alias("value"),
        F.when(high, 0.5).otherwise(-0.25).alias("contribution"),
    )
    return boosting.importance_summary(labs.unionByName(flags))


# --------------------------------------------- ensembles as expressions


def _fitted(t):
    rows = _assembled(t)
    fitted = boosting.fit_gbt(_train(rows), "logloss", {"maxDepth": 3}, rounds=5, rate=0.3)
    return rows, fitted, compiled.exported(fitted.models[1], FEATURES)


@query("compiled_scores", "person_id:i gap:f", "select person_id, 0 as gap from pred")
def compiled_scores(t):
    """The difference between the scores of a fitted model and of its expression, row by row: none."""
    rows, fitted, ensemble = _fitted(t)
    scored = boosting.predict(fitted, rows)
    return scored.select("person_id", F.abs(F.col("abnorm_probs") - ensemble.score()).alias("gap"))


@query(
    "feature_contributions",
    "person_id:i n:i gap:f",
    f"select person_id, {len(FEATURES)} as n, 0 as gap from pred",
)
def feature_contributions(t):
    """What a row's contributions and the mean leave of its raw score: nothing."""
    rows, _, ensemble = _fitted(t)
    parts = compiled.contributions(rows, ensemble, FEATURES, "person_id")
    sums = parts.groupBy("row_id").agg(F.sum("contribution").alias("sum"), F.count(F.lit(1)).alias("n"))
    raw = rows.select("person_id", F.expr(ensemble.raw_sql()).alias("raw"))
    joined = raw.join(sums.withColumnRenamed("row_id", "person_id"), "person_id")
    return joined.select("person_id", "n", F.abs(F.col("raw") - F.col("sum") - ensemble.mean).alias("gap"))


#: A fixed ensemble, so that its scores have an independent SQL.
FIXED = Ensemble(
    [
        (1.0, Node(0, 100, "mean", 101.5, Node(-0.75, 60), Node(0, 40, "n_code", 30.0, Node(0.25, 15), Node(0.625, 25)))),
        (0.5, Node(0, 100, "bmi", 27.0, Node(0, 70, "mean", 88.25, Node(-0.375, 30), Node(0.125, 40)), Node(0.5, 30))),
        (0.5, Node(0, 100, "n_lab", 6.0, Node(-0.125, 50), Node(0.25, 50))),
    ],
    logistic=True,
)


_FIXED_SQL = f"""l as (select person_id, avg(value) as mean, count(*) as n_lab from lab where dt < date '{BASE}' and value is not null group by person_id),
  c as (select person_id, count(*) as n_code from code where dt < date '{BASE}' group by person_id),
  f as (select d.person_id, split_set, p1, bmi, mean, n_lab, n_code from pred d join person p on p.person_id = d.person_id
        left join l on l.person_id = d.person_id left join c on c.person_id = d.person_id),
  scored as (select *, {FIXED.raw_sql()} as raw, {FIXED.score_sql()} as prob, cast(coalesce(mean, 95) + 20 * p1 > 108 as integer) as truth from f)"""


@query(
    "predict_compiled",
    "person_id:i split_set:f raw:f abnorm_probs:f",
    f"with {_FIXED_SQL} select person_id, split_set, raw, prob as abnorm_probs from scored",
)
def predict_compiled(t):
    rows = training_rows(t)
    return rows.select("person_id", "split_set", F.expr(FIXED.raw_sql()).alias("raw"), FIXED.score().alias("abnorm_probs"))


@query(
    "predict_table_fixed",
    "person_id:i split_set:f y:i abnorm_probs:f abnorm_preds:i true_abnorm:i",
    f"""with {_FIXED_SQL},
          k as (select prob, cast(sum(truth) as double) as c, cast(count(*) as double) as n from scored where split_set = 0 group by prob),
          w as (select prob, sum(c) over (order by prob desc) as tp, sum(n) over (order by prob desc) as pos, sum(c) over () as m from k),
          cut as (select prob as cutoff from w order by abs(tp / pos - tp / m), prob limit 1)
        select person_id, split_set, truth as y, prob as abnorm_probs, cast(prob > (select cutoff from cut) as integer) as abnorm_preds, truth as true_abnorm from scored""",
)
def predict_table_fixed(t):
    """The whole prediction table, cut-off included, from the fixed ensemble."""
    return boosting.predict_table(boosting.Fitted("bin", {1: FIXED}), training_rows(t), "y")


@query(
    "fit_quantile",
    "metric:s below_median:s",
    "select unnest(['q05', 'q95']) as metric, true as below_median",
)
def fit_quantile(t):
    """Whether a quantile's model has a smaller pinball loss than the median's on the training rows."""
    rows = training_rows(t).where(F.col("last").isNotNull())
    names = ["age", "male", "mean", "n_lab"]
    train = _train(boosting.assemble(rows, names, "last"))
    middle = compiled.fit_quantile(train, names, 0.5, rounds=6, rate=0.3)
    parts = []
    for metric in ("q05", "q95"):
        fitted = boosting.fit_gbt(train, metric, {"maxDepth": 3}, rounds=6, rate=0.3, features=names)
        scored = boosting.predict(fitted, train).withColumn("_middle", middle.score())
        loss = [metrics.METRICS[metric](F.col("last"), F.col(c), F.lit(1)) for c in ("abnorm_probs", "_middle")]
        parts.append(scored.agg((loss[0] < loss[1]).alias("below_median")).withColumn("metric", F.lit(metric)))
    return parts[0].unionByName(parts[1])
