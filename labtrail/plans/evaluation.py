"""Metrics, bootstrap, calibration and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.evaluation import bootstrap, compare, metrics
from labtrail.functions import recode
from labtrail.functions.uniform import LOW_BITS, MIX_PRIME, MIX_ROUNDS, poisson_limits, uniform
from labtrail.operators.tables import case_control_continuous
from labtrail.plans.cleaning import CLEAN_CTES
from labtrail.plans.cohorts import SUBGROUP_CTES, membership
from labtrail.plans.registry import query, u_sql

REPLICATES = 100


def ranked_sql(source: str, groups: str, score: str, label: str = "y") -> str:
    """AUC and average precision per group, plain SQL."""
    return f"""(select {groups}, sum(c + k) as n, sum(c) as n_case,
        case when any_value(m) > 0 and any_value(q) > 0 then sum(c * (kb + k / cast(2 as double))) / (any_value(m) * any_value(q)) end as auc,
        case when any_value(m) > 0 then sum(c / m * (tp / (tp + fp))) end as avg_prec
      from (select *, sum(c) over (partition by {groups} order by s desc) as tp, sum(k) over (partition by {groups} order by s desc) as fp,
              coalesce(sum(k) over (partition by {groups} order by s rows between unbounded preceding and 1 preceding), 0) as kb,
              sum(c) over (partition by {groups}) as m, sum(k) over (partition by {groups}) as q
            from (select {groups}, {score} as s, cast(sum({label}) as double) as c, cast(count(*) - sum({label}) as double) as k
                  from {source} group by {groups}, {score}))
      group by {groups})"""


def draw_sql(source: str, place: str) -> str:
    """`source` with `draw`, the 62-bit number of a place and a replicate."""
    low, high = (1 << LOW_BITS) - 1, LOW_BITS
    out = f"(select *, cast({place} & {low} as bigint) % {MIX_PRIME} as ha, cast({place} & {low} as bigint) % {MIX_PRIME} as hb from {source})"
    for k, both in enumerate(zip(MIX_ROUNDS["a"], MIX_ROUNDS["b"], strict=True)):
        steps = [
            f"(xor({h}, {h} >> 15) * (({f} + replicate * {r}) % {MIX_PRIME}) % {MIX_PRIME} + replicate * {s} + ({place} >> {high}) * {t} + {11 * (k + 1)}) % {MIX_PRIME} as {h}"
            for h, (f, r, s, t) in zip(("ha", "hb"), both, strict=True)
        ]
        out = f"(select * replace ({', '.join(steps)}) from {out})"
    return f"(select *, ha * {1 << 31} + hb as draw from {out})"


def poisson_sql(source: str, groups: str, columns: str, replicates: int = REPLICATES) -> str:
    """Replicate 0 and rows repeated by Poisson weights, plain SQL."""
    row = "cast(cast('0x' || substr(md5(concat_ws('|', cast(person_id as varchar), 'weight')), 1, 15) as bigint) as bigint)"
    rows = f"(select {groups}, {columns}, {row} as number, replicate from {source}, range(0, {replicates + 1}) r(replicate))"
    weight = " + ".join(f"cast(draw >= {x} as integer)" for x in poisson_limits())
    return f"""(select {groups}, replicate, {columns} from (
        select *, unnest(range(case when replicate = 0 then 1 else {weight} end)) from {draw_sql(rows, 'number')}))"""


def resample_sql(source: str, groups: str, columns: str, replicates: int = REPLICATES) -> str:
    """Replicate 0 and all drawn rows, plain SQL."""
    names = [g.strip() for g in groups.split(",")]
    same = " and ".join(f"a.{g} = b.{g}" for g in names)
    cols = ", ".join(f"b.{c.strip()}" for c in columns.split(","))
    placed = f"""(select *, row_number() over (partition by {groups} order by {u_sql('person_id', salt='row')}, person_id) - 1 as pos,
        count(*) over (partition by {groups}) as size from {source})"""
    mixed = draw_sql(f"(select * from {placed} p, range(1, {replicates + 1}) r(replicate))", "pos")
    return f"""(select {groups}, 0 as replicate, {columns} from {source}
      union all select {', '.join(f'a.{g}' for g in names)}, a.replicate, {cols} from (
        select {groups}, replicate, draw % size as pos from {mixed}) a join {placed} b on {same} and a.pos = b.pos)"""


def interval_sql(source: str, groups: str, names: list[str]) -> str:
    parts = ", ".join(
        f"""max({m}) filter (replicate = 0) as {m},
            list_sort(list({m}) filter (replicate > 0 and {m} is not null))[cast(floor(count({m}) filter (replicate > 0) * 0.025) as bigint) + 1] as {m}_low,
            list_sort(list({m}) filter (replicate > 0 and {m} is not null))[cast(floor(count({m}) filter (replicate > 0) * 0.975) as bigint) + 1] as {m}_high"""
        for m in names
    )
    return f"(select {groups}, {parts} from {source} group by {groups})"


@query("roc_auc", "split_set:f n:i n_case:i auc:f", f"select * from {ranked_sql('pred', 'split_set', 'p1')}")
def roc_auc(t):
    return metrics.ranked_metrics(t.pred, ["split_set"], "p1", "y")


@query(
    "avg_precision",
    "split_set:f avg_prec:f",
    f"select * from {ranked_sql('pred', 'split_set', 'p2')}",
)
def avg_precision(t):
    return metrics.ranked_metrics(t.pred, ["split_set"], "p2", "y")


_P = "greatest(least(p1, 1 - 2.220446049250313e-16::double), 2.220446049250313e-16::double)"
_POINT = {
    "brier": "avg((p1 - y) * (p1 - y))",
    "log_loss": f"avg(case when y = 1 then -ln({_P}) else -ln(1 - {_P}) end)",
}
for _name, _sql in _POINT.items():

    def _point(t, name=_name.replace("_", "")):
        return metrics.metric(t.pred, ["split_set"], name, "p1", "y")

    query(_name, "split_set:f value:f", f"select split_set, {_sql} as value from pred group by split_set")(_point)

_CONT = "(select l.lab, value as y, 90 + (value - 90) / 2 + rid % 10 as p from lab l where value is not null)"


def _continuous(t):
    return t.lab.where(F.col("value").isNotNull()).select(
        "lab", F.col("value").alias("y"), (90 + (F.col("value") - 90) / 2 + F.col("rid") % 10).alias("p")
    )


_CONT_METRICS = {
    "mae": "avg(abs(y - p))",
    "mse": "avg((y - p) * (y - p))",
    "rmse": "sqrt(avg((y - p) * (y - p)))",
    "tweedie": "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))",
}
_CONT_NAMES = {"tweedie": "tweedie_d2"}
for _name, _sql in _CONT_METRICS.items():

    def _cont(t, name=_name):
        return metrics.metric(_continuous(t), ["lab"], name, "p", "y")

    query(_CONT_NAMES.get(_name, _name), "lab:s value:f", f"select lab, {_sql} as value from {_CONT} group by lab")(_cont)


@query(
    "pinball",
    "lab:s share:f value:f",
    " union all ".join(
        f"select lab, {q / 100} as share, avg(case when y >= p then (y - p) * {q / 100}::double else (p - y) * (1 - {q / 100}::double) end) as value from {_CONT} group by lab"
        for q in (5, 10, 25, 50, 75, 90, 95)
    ),
)
def pinball(t):
    rows = _continuous(t)
    y, p, w = F.col("y"), F.col("p"), F.lit(1)
    shares = (5, 10, 25, 50, 75, 90, 95)
    wide = rows.groupBy("lab").agg(*[metrics.METRICS[f"q{q:02d}"](y, p, w).alias(f"q{q}") for q in shares])
    lines = [F.struct(F.lit(q / 100).alias("share"), F.col(f"q{q}").alias("value")) for q in shares]
    return wide.select("lab", F.inline(F.array(*lines)))


@query(
    "f1",
    "split_set:f value:f",
    """select split_set, 2 * count(*) filter (y = 1 and p1 > 0.5) / cast(count(*) filter (y = 1) + count(*) filter (p1 > 0.5) as double) as value
       from pred group by split_set""",
)
def f1(t):
    rows = t.pred.withColumn("guess", (F.col("p1") > 0.5).cast("int"))
    return metrics.metric(rows, ["split_set"], "f1", "guess", "y")


_CURVE = """(select split_set, s, m, q, tp, fp from (select *, sum(c) over (partition by split_set order by s desc) as tp,
    sum(k) over (partition by split_set order by s desc) as fp, sum(c) over (partition by split_set) as m, sum(k) over (partition by split_set) as q
  from (select split_set, p1 as s, cast(sum(y) as double) as c, cast(count(*) - sum(y) as double) as k from pred group by split_set, p1)))"""


@query(
    "roc_curve",
    "split_set:f threshold:f fpr:f tpr:f",
    f"select split_set, s as threshold, fp / q as fpr, tp / m as tpr from {_CURVE} union all select distinct split_set, null, 0, 0 from pred",
)
def roc_curve(t):
    return metrics.roc_curve(t.pred, ["split_set"], "p1", "y")


@query(
    "pr_curve",
    "split_set:f threshold:f precision:f recall:f",
    f"select split_set, s as threshold, tp / (tp + fp) as precision, tp / m as recall from {_CURVE}",
)
def pr_curve(t):
    return metrics.pr_curve(t.pred, ["split_set"], "p1", "y")


CUTOFF_SQL = f"(select split_set, arg_min(s, row(abs(tp / (tp + fp) - tp / m), s)) as cutoff from {_CURVE} group by split_set)"


@query("pr_balance_cutoff", "split_set:f cutoff:f", f"select * from {CUTOFF_SQL}")
def pr_balance_cutoff(t):
    return metrics.pr_balance_cutoff(t.pred, ["split_set"], "p1", "y")


@query(
    "confusion",
    "split_set:f tn:i fp:i fn:i tp:i",
    """select split_set, count(*) filter (y = 0 and p1 <= 0.4) as tn, count(*) filter (y = 0 and p1 > 0.4) as fp,
        count(*) filter (y = 1 and p1 <= 0.4) as fn, count(*) filter (y = 1 and p1 > 0.4) as tp from pred group by split_set""",
)
def confusion(t):
    rows = t.pred.withColumn("guess", (F.col("p1") > 0.4).cast("int"))
    return metrics.confusion(rows, ["split_set"], "guess", "y")


def _bins_sql(edges: list[str]) -> str:
    case = " ".join(f"when p1 > {a} and p1 <= {b} then {i + 1}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"""select 'x' as kind, bin, avg(p1) as predicted, avg(y) as observed, count(*) as n, sum(y) as n_case, count(*) - sum(y) as n_control
      from (select p1, y, case {case} end as bin from pred, q) where bin is not null group by bin having sum(y) >= 5 and count(*) - sum(y) >= 5"""


_EQUAL = [f"{i * 0.1!r}::double" for i in range(11)]
_DECILES = ", ".join(f"quantile_cont(p1, {min(i * 0.1, 1.0)!r}) as e{i}" for i in range(11))
_BIN_SPEC = "kind:s bin:i predicted:f observed:f n:i n_case:i n_control:i"


@query(
    "calibration_bins",
    _BIN_SPEC,
    f"""with q as (select {_DECILES} from pred)
        select * replace ('equal' as kind) from ({_bins_sql(_EQUAL)})
        union all select * replace ('decile' as kind) from ({_bins_sql([f'e{i}' for i in range(11)])})""",
)
def calibration_bins(t):
    parts = [
        metrics.calibration_bins(t.pred, "p1", "y", kind).withColumn("kind", F.lit(kind))
        for kind in ("equal", "decile")
    ]
    return parts[0].unionByName(parts[1])


_GRID_STEPS = 20000


@query(
    "calibration_interval",
    "bin:i observed:f low:f high:f",
    f"""with q as (select 1), bins as (select *, n_case + 0.1::double as a, n_control + 0.1::double as b from ({_bins_sql(_EQUAL)})),
        x as (select bin, observed, i / {_GRID_STEPS}::double as x, case when i in (0, {_GRID_STEPS}) then 0 else
                exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(i / {_GRID_STEPS}::double) + (b - 1) * ln(1 - i / {_GRID_STEPS}::double)) end as d
              from bins, range(0, {_GRID_STEPS} + 1) r(i)),
        c as (select *, sum(step) over (partition by bin order by x) as cdf from (
                select *, coalesce(d + lag(d) over (partition by bin order by x), 0) / 2 / {_GRID_STEPS} as step from x)),
        e as (select *, lead(cdf) over (partition by bin order by x) as nxt from c),
        f as (select bin, observed, s, x + (s - cdf) / (nxt - cdf) / {_GRID_STEPS} as v from e, (values (0.025::double), (0.975::double)) t(s) where cdf <= s and nxt > s)
        select bin, any_value(observed) as observed, min(v) as low, max(v) as high from f group by bin""",
)
def calibration_interval(t):
    return metrics.with_beta_interval(metrics.calibration_bins(t.pred, "p1", "y"))


@query(
    "ece",
    "split_set:f ece:f",
    f"""select split_set, sum(case when b is null then 0 else abs(sy - sp) end) / sum(n) as ece from (
          select split_set, b, count(*) as n, sum(y) as sy, sum(p1) as sp from (
            select *, case {' '.join(f'when p1 > {a} and p1 <= {b} then 1.0 * {i}' for i, (a, b) in enumerate(zip(_EQUAL, _EQUAL[1:])))} end as b from pred)
          group by split_set, b) group by split_set""",
)
def ece(t):
    return metrics.ece(t.pred, ["split_set"], "p1", "y")


_NRI = """(avg(cast(sign(p2 - p1) as double)) filter (y = 1)) - (avg(cast(sign(p2 - p1) as double)) filter (y = 0))"""


@query("nri", "split_set:f nri:f", f"select split_set, {_NRI} as nri from pred group by split_set")
def nri(t):
    return metrics.nri(t.pred, ["split_set"], "p1", "p2", "y")


@query(
    "bootstrap_ci",
    "split_set:f value:f value_low:f value_high:f",
    f"""with b as {resample_sql('pred', 'split_set', 'p1, y')},
        r as (select split_set, replicate, auc as value from {ranked_sql('b', 'split_set, replicate', 'p1')})
        select * from {interval_sql('r', 'split_set', ['value'])}""",
)
def bootstrap_ci(t):
    return bootstrap.bootstrap_ci(t.pred, ["split_set"], ["person_id"], "auc", "p1", "y", REPLICATES)


def _paired_sql(source: str, groups: str) -> str:
    """Differences of two scores per replicate, with intervals and p-values."""
    g = ", ".join(f"a.{x.strip()}" for x in groups.split(","))
    same = " and ".join(f"a.{x.strip()} = b.{x.strip()}" for x in groups.split(",")) + " and a.replicate = b.replicate"
    same_c = same.replace("b.", "c.")
    return f"""ranked as (select {g}, a.replicate, a.n, a.n_case, a.auc as auc_1, b.auc as auc_2, a.avg_prec as avg_prec_1, b.avg_prec as avg_prec_2, nri,
        b.auc - a.auc as auc_diff, b.avg_prec - a.avg_prec as avg_prec_diff
      from {ranked_sql(source, groups + ', replicate', 'p1')} a
      join {ranked_sql(source, groups + ', replicate', 'p2')} b on {same}
      join (select {groups}, replicate, {_NRI} as nri from {source} group by {groups}, replicate) c on {same_c}),
    est as (select * exclude (replicate) from ranked where replicate = 0),
    ci as {interval_sql('ranked', groups, ['auc_diff', 'avg_prec_diff', 'nri'])},
    pv as (select {g}, avg(cast(abs(b.auc_diff - a.auc_diff) >= abs(a.auc_diff) as integer)) as auc_diff_p,
                  avg(cast(abs(b.avg_prec_diff - a.avg_prec_diff) >= abs(a.avg_prec_diff) as integer)) as avg_prec_diff_p
           from ranked a join est b using ({groups}) where a.replicate > 0 and a.auc_diff is not null group by all),
    paired as (select * from est join (select * exclude (auc_diff, avg_prec_diff, nri) from ci) using ({groups}) left join pv using ({groups}))"""


_PAIRED = (
    "n:i n_case:i auc_1:f auc_2:f auc_diff:f auc_diff_low:f auc_diff_high:f auc_diff_p:f avg_prec_1:f avg_prec_2:f "
    "avg_prec_diff:f avg_prec_diff_low:f avg_prec_diff_high:f avg_prec_diff_p:f nri:f nri_low:f nri_high:f"
)


@query(
    "bootstrap_diff",
    "split_set:f " + _PAIRED,
    f"with b as {resample_sql('pred', 'split_set', 'p1, p2, y')}, {_paired_sql('b', 'split_set')} select * from paired",
)
def bootstrap_diff(t):
    return bootstrap.bootstrap_diff(t.pred, ["split_set"], ["person_id"], "p1", "p2", "y", REPLICATES)


@query(
    "bootstrap_nri",
    "split_set:f nri:f nri_low:f nri_high:f",
    f"""with b as {resample_sql('pred', 'split_set', 'p1, p2, y')}, r as (select split_set, replicate, {_NRI} as nri from b group by all)
        select * from {interval_sql('r', 'split_set', ['nri'])}""",
)
def bootstrap_nri(t):
    return bootstrap.bootstrap_nri(t.pred, ["split_set"], ["person_id"], "p1", "p2", "y", REPLICATES)


def _delong_sql(source: str, groups: str) -> str:
    def mid(score, extra=""):
        part = f"partition by {groups}{extra}"
        return f"(rank() over ({part} order by {score}) + (count(*) over ({part}, {score}) - 1) / cast(2 as double))"

    return f"""(select {groups}, avg(v1) filter (y = 1) as auc_1, avg(v2) filter (y = 1) as auc_2,
        sqrt((var_samp(v1 - v2) filter (y = 1)) / count(*) filter (y = 1) + (var_samp(v1 - v2) filter (y = 0)) / count(*) filter (y = 0)) as se_diff
      from (select {groups}, y, case when y = 1 then (z1 - w1) / k else 1 - (z1 - w1) / m end as v1, case when y = 1 then (z2 - w2) / k else 1 - (z2 - w2) / m end as v2
        from (select {groups}, y, {mid('p1')} as z1, {mid('p1', ', y')} as w1, {mid('p2')} as z2, {mid('p2', ', y')} as w2,
                cast(sum(y) over (partition by {groups}) as double) as m, cast(sum(1 - y) over (partition by {groups}) as double) as k from {source}))
      group by {groups})"""


@query(
    "delong",
    "split_set:f auc_1:f auc_2:f se_diff:f z:f",
    f"select *, abs(auc_1 - auc_2) / se_diff as z from {_delong_sql('pred', 'split_set')}",
)
def delong(t):
    return compare.delong(t.pred, ["split_set"], "p1", "p2", "y")


def _normal_p(z: str) -> str:
    """Two-sided normal p-value: the tail integrated by Simpson's rule."""
    return f"""(2 * (select sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow({z} + 12 * i / 4000::double, 2) / 2)) * 12 / 12000 / sqrt(2 * pi())
      from range(0, 4001) r(i)))"""


@query(
    "delong_pvalue",
    "split_set:f z:f log10_p:f p:f",
    f"""with d as (select split_set, abs(auc_1 - auc_2) / se_diff as z from {_delong_sql('pred', 'split_set')}), e as (select *, {_normal_p('z')} as p from d)
        select *, log10(p) as log10_p from e""",
)
def delong_pvalue(t):
    return compare.with_delong_p(compare.delong(t.pred, ["split_set"], "p1", "p2", "y"))


def long_predictions(t):
    """The fixture's two models and their mean, one row per model and person."""
    lines = [
        F.struct(F.lit("m1").alias("model"), F.col("p1").alias("prob")),
        F.struct(F.lit("m2").alias("model"), F.col("p2").alias("prob")),
        F.struct(F.lit("m3").alias("model"), ((F.col("p1") + F.col("p2")) / 2).alias("prob")),
    ]
    return t.pred.select("person_id", "split_set", "y", F.inline(F.array(*lines)))


_LONG = """long as (select person_id, split_set, y, 'm1' as model, p1 as prob from pred union all select person_id, split_set, y, 'm2', p2 from pred
  union all select person_id, split_set, y, 'm3', (p1 + p2) / 2 from pred)"""
PAIRS = [("m1", "m2"), ("m1", "m3"), ("m2", "m3")]


@query(
    "join_pairs",
    "person_id:i split_set:f y:i model_1:s model_2:s prob_1:f prob_2:f",
    f"""with {_LONG}, part as (select * replace (case when not (model = 'm3' and person_id % 4 = 0) then prob end as prob) from long)
        select a.person_id, a.split_set, a.y, a.model as model_1, b.model as model_2, a.prob as prob_1, b.prob as prob_2
        from part a join part b on a.person_id = b.person_id and a.model < b.model where a.prob is not null and b.prob is not null""",
)
def join_pairs(t):
    # a quarter of one model's predictions is missing
    known = F.expr("not (model = 'm3' and person_id % 4 = 0)")
    some = long_predictions(t).withColumn("prob", F.when(known, F.col("prob")))
    return compare.join_pairs(some, PAIRS)


_SETS_SQL = """sets as (select person_id, 'Train' as set_name from pred where split_set = 0 union all select person_id, 'Tuning' from pred where split_set = 1
  union all select person_id, 'Test' from pred where split_set = 2 union all select person_id, 'TrainTuning' from pred where split_set <> 2)"""


@query(
    "cross_eval_grid",
    "model_1:s model_2:s set_name:s filter:s n:i n_case:i",
    f"""with {CLEAN_CTES}, {SUBGROUP_CTES}, {_SETS_SQL}, p as (select * from (values ('m1','m2'),('m1','m3'),('m2','m3')) v(model_1, model_2))
        select model_1, model_2, set_name, filter, count(*) as n, sum(y) as n_case from pred join sets using (person_id) join members using (person_id), p
        group by all having sum(y) >= 10""",
)
def cross_eval_grid(t):
    rows = compare.evaluation_grid(
        compare.join_pairs(long_predictions(t), PAIRS),
        membership(t),
        compare.named_sets(),
        10,
        ["model_1", "model_2"],
    )
    return rows.groupBy("model_1", "model_2", "set_name", "filter").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_case")
    )




_GRID = f"""{CLEAN_CTES}, {SUBGROUP_CTES}, {_LONG}, {_SETS_SQL},
  g0 as (select a.model as model_1, b.model as model_2, set_name, filter, a.person_id, a.y, a.prob as p1, b.prob as p2
         from long a join long b on a.person_id = b.person_id and a.model < b.model
         join sets on sets.person_id = a.person_id join members on members.person_id = a.person_id),
  g as (select * from g0 where (model_1, model_2, set_name, filter) in (
          select (model_1, model_2, set_name, filter) from g0 group by model_1, model_2, set_name, filter having sum(y) >= 10))"""
_CELL = "model_1, model_2, set_name, filter"


@query(
    "compare_models",
    "model_1:s model_2:s set_name:s filter:s " + _PAIRED + " se_diff:f z:f",
    f"""with {_GRID}, b as {poisson_sql('g', _CELL, 'p1, p2, y')}, {_paired_sql('b', _CELL)}
        select *, abs(d.auc_1 - d.auc_2) / se_diff as z
        from paired join (select * from {_delong_sql('g', _CELL)}) d using ({_CELL})""",
)
def compare_models(t):
    return compare.compare_models(long_predictions(t), PAIRS, membership(t), compare.named_sets(), REPLICATES)


@query(
    "score_models",
    "model:s set_name:s filter:s n:i n_case:i auc:f auc_low:f auc_high:f avg_prec:f avg_prec_low:f avg_prec_high:f "
    "brier:f brier_low:f brier_high:f logloss:f logloss_low:f logloss_high:f",
    f"""with {CLEAN_CTES}, {SUBGROUP_CTES}, {_LONG}, {_SETS_SQL},
        g as (select model, set_name, filter, person_id, y, prob from long join sets using (person_id) join members using (person_id)),
        b as {poisson_sql('g', 'model, set_name, filter', 'prob, y')},
        r as (select * from {ranked_sql('b', 'model, set_name, filter, replicate', 'prob')} join
          (select model, set_name, filter, replicate, avg((prob - y) * (prob - y)) as brier,
             avg(case when y = 1 then -ln({_P.replace('p1', 'prob')}) else -ln(1 - {_P.replace('p1', 'prob')}) end) as logloss from b group by all)
          using (model, set_name, filter, replicate)),
        e as (select model, set_name, filter, n, n_case from r where replicate = 0)
        select * from e join {interval_sql('r', 'model, set_name, filter', ['auc', 'avg_prec', 'brier', 'logloss'])} using (model, set_name, filter)""",
)
def score_models(t):
    return compare.score_models(long_predictions(t), membership(t), compare.named_sets(), REPLICATES)


@query(
    "metric_diff_row",
    "split_set:f metric:s n_features:i diff_est:f low_ci:f high_ci:f pval_diff:f avg_full:f avg_fs:f",
    f"""with b as {resample_sql('pred', 'split_set', 'p1, p2, y')}, {_paired_sql('b', 'split_set')}
        select split_set, 'avg_prec' as metric, 20 as n_features, avg_prec_diff as diff_est, avg_prec_diff_low as low_ci, avg_prec_diff_high as high_ci,
          avg_prec_diff_p as pval_diff, avg_prec_1 as avg_full, avg_prec_2 as avg_fs from paired""",
)
def metric_diff_row(t):
    return compare.metric_diff_row(long_predictions(t), "m1", "m2", "avg_prec", 20, REPLICATES)


_GROUPS = """(select split_set, count(p1) filter (y = 1) as n1, avg(p1) filter (y = 1) as m1, stddev_samp(p1) filter (y = 1) as s1,
   count(p1) filter (y = 0) as n2, avg(p1) filter (y = 0) as m2, stddev_samp(p1) filter (y = 0) as s2 from pred group by split_set)"""


def _welch(t):
    rows = case_control_continuous(t.pred, ["split_set"], {"p1": "p1"}, {"y": "y"})
    tested, df = compare.welch_t(
        F.col("n_cases") - F.col("n_missing_cases"),
        F.col("cases_mean"),
        F.col("cases_sd"),
        F.col("n_controls") - F.col("n_missing_controls"),
        F.col("controls_mean"),
        F.col("controls_sd"),
    )
    return rows.select("split_set", tested.alias("t"), df.alias("df"))


@query(
    "welch_t",
    "split_set:f t:f df:f",
    f"""select split_set, (m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2) as t,
          pow(s1 * s1 / n1 + s2 * s2 / n2, 2) / (pow(s1 * s1 / n1, 2) / (n1 - 1) + pow(s2 * s2 / n2, 2) / (n2 - 1)) as df from {_GROUPS}""",
)
def welch_t(t):
    return _welch(t)


@query(
    "welch_pvalue",
    "split_set:f t:f p:f",
    f"""with w as (select split_set, abs(m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2) as t,
          pow(s1 * s1 / n1 + s2 * s2 / n2, 2) / (pow(s1 * s1 / n1, 2) / (n1 - 1) + pow(s2 * s2 / n2, 2) / (n2 - 1)) as v, m1 - m2 as gap from {_GROUPS})
        select split_set, t * sign(gap) as t, 1 - 2 * (select sum(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * pow(1 + pow(t * i / 2000, 2) / v, -(v + 1) / 2))
            * t / 6000 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) from range(0, 2001) r(i)) as p from w""",
)
def welch_pvalue(t):
    return compare.with_welch_p(_welch(t))


_PROPORTIONS = """(select split_set, (k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) as z from (
         select split_set, cast(count(*) filter (y = 1 and p2 > 0.5) as double) as k1, cast(count(*) filter (y = 1) as double) as n1,
           cast(count(*) filter (y = 0 and p2 > 0.5) as double) as k2, cast(count(*) filter (y = 0) as double) as n2 from pred group by split_set))"""


@query("prop_ztest", "split_set:f z:f p:f", f"select split_set, z, {_normal_p('abs(z)')} as p from {_PROPORTIONS}")
def prop_ztest(t):
    high = F.col("p2") > 0.5
    counts = t.pred.groupBy("split_set").agg(
        F.count_if((F.col("y") == 1) & high).alias("k1"),
        F.count_if(F.col("y") == 1).alias("n1"),
        F.count_if((F.col("y") == 0) & high).alias("k2"),
        F.count_if(F.col("y") == 0).alias("n2"),
    )
    z = compare.prop_z(*[F.col(c).cast("double") for c in ("k1", "n1", "k2", "n2")])
    return compare.with_prop_p(counts.select("split_set", z.alias("z")))


@query(
    "round_min5",
    "person_id:i rounded:f",
    """with r as (select person_id, round(p1 * 30) as r from pred), k as (select r, count(*) as n from r group by r),
       e as (select min(r) as a, max(r) as b from k where n >= 5)
       select person_id, case when n >= 5 then r when abs(a - r) < abs(b - r) then a else b end as rounded from r join k using (r), e""",
)
def round_min5(t):
    return compare.round_min5(t.pred.withColumn("v", F.col("p1") * 30), "v")


_LEVELS_SQL = "['baseline', 'registry data', 'other labs', 'last value', 'sumstats', 'all data', 'all data + PGS', 'maxim']"


def comparison_rows(t):
    """A comparison table made from persons: lab, two predictor sets, p-value and estimate."""
    levels = dict(enumerate(recode.PREDICTOR_LEVELS))
    key = F.col("person_id")
    rows = t.person.select(
        recode.lookup(key % 4, dict(enumerate(["eGFR", "HbA1c", "TSH", "LDL"]))).alias("lab"),
        recode.lookup(F.floor(key / 4) % 8, levels).alias("model_1"),
        recode.lookup(F.floor(key / 32) % 8, levels).alias("predictors"),
        uniform("person_id", salt="pv").alias("p"),
        (uniform("person_id", salt="est") - 0.4).alias("est"),
    )
    kept = rows.where(~((F.col("lab") == "TSH") & F.col("predictors").isin("maxim", "all data + PGS")))
    return kept.groupBy("lab", "model_1", "predictors").agg(
        F.min("p").alias("p"), F.avg("est").alias("est"), F.count(F.lit(1)).alias("n")
    )


COMPARISON = f"""cmp as (select lab, model_1, predictors, min(p) as p, avg(est) as est, count(*) as n from (
  select ['eGFR', 'HbA1c', 'TSH', 'LDL'][person_id % 4 + 1] as lab, {_LEVELS_SQL}[cast(floor(person_id / 4) as bigint) % 8 + 1] as model_1,
    {_LEVELS_SQL}[cast(floor(person_id / 32) as bigint) % 8 + 1] as predictors, {u_sql('person_id', salt='pv')} as p,
    {u_sql('person_id', salt='est')} - cast(0.4 as double) as est from person)
  where not (lab = 'TSH' and predictors in ('maxim', 'all data + PGS')) group by all)"""


@query(
    "adjacent_pvalues",
    "lab:s predictors:s p:f sign:s",
    f"""with {COMPARISON}, l as (select unnest(range(1, 9)) as i, unnest({_LEVELS_SQL}) as name),
        pairs as (select a.i, a.name as predictors, b.name as before from l a left join l b on b.i = a.i - 1),
        f as (select labs.lab, i, pairs.predictors, case when i = 1 then 0 else coalesce(x.p, y.p, 1) end as p
              from (select distinct lab from cmp) labs cross join pairs
              left join cmp x on x.lab = labs.lab and x.model_1 = before and x.predictors = pairs.predictors
              left join cmp y on y.lab = labs.lab and y.model_1 = pairs.predictors and y.predictors = before)
        select lab, predictors, p, case when p < 0.05 then 'sig' else 'ns' end as sign from f""",
)
def adjacent_pvalues(t):
    return compare.adjacent_pvalues(comparison_rows(t))
