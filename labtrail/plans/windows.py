"""Ordered work within a person and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labtrail.functions import dates, recode
from labtrail.operators import cleaning, cohort, series
from labtrail.operators.ranking import score_table
from labtrail.plans.registry import BASE, END, START, query

FLAGGED = "(select *, cast(case flag when 'N' then 0 when 'L' then -1 when 'H' then 1 end as double) as abnorm from daily)"


def flagged_days(t):
    return cleaning.daily_last(t.lab).withColumn("abnorm", recode.ordinal_flag(F.col("flag")))


def runs_sql(source: str, flag: str) -> str:
    return f"""(with c as (select *, count(*) over (partition by person_id) as n from {source}),
      p as (select person_id, dt, {flag}, lag({flag}) over (partition by person_id order by dt) as prev
            from c where n > 1 and {flag} is not null),
      s as (select *, case when prev is null or prev <> {flag} then dt end as st from p)
    select person_id, dt, {flag}, start_dt, date_diff('day', start_dt, dt) as diff from (
      select *, last_value(st ignore nulls) over (partition by person_id order by dt rows between unbounded preceding and current row) as start_dt from s))"""


@query(
    "min_rows_over",
    "rid:i person_id:i",
    "select rid, person_id from (select *, count(*) over (partition by person_id) as n from lab) where n >= 8",
)
def min_rows_over(t):
    return series.several_rows(t.lab, 8)


@query(
    "prev_flag",
    "rid:i abnorm:f prev_abnorm:f",
    f"select rid, abnorm, coalesce(lag(abnorm) over (partition by person_id order by dt), -1) as prev_abnorm from {FLAGGED} where abnorm is not null",
)
def prev_flag(t):
    return series.previous_flag(flagged_days(t).where(F.col("abnorm").isNotNull()))


@query(
    "run_start",
    "person_id:i dt:s abnorm:f start_dt:s diff:i",
    f"select * from {runs_sql(FLAGGED, 'abnorm')}",
)
def run_start(t):
    return series.abnormal_runs(flagged_days(t), "abnorm")


@query(
    "first_in_window",
    "person_id:i start_dt:s dt:s diff:i abnorm:f",
    f"""select * from (select *, row_number() over (partition by person_id order by start_dt, diff) as k
        from {runs_sql(FLAGGED, 'abnorm')} where abnorm >= 1 and diff >= 90) where k = 1""",
)
def first_in_window(t):
    return series.first_reaching(series.abnormal_runs(flagged_days(t), "abnorm"), 90, "abnorm")


@query(
    "latest_value",
    "rid:i person_id:i dt:s value:f",
    f"select * from (select *, max(dt) over (partition by person_id) as m from lab where dt < date '{BASE}') where dt = m",
)
def latest_value(t):
    return series.latest_rows(t.lab.where(F.col("dt") < dates.day(BASE)))


@query(
    "first_date_rows",
    "rid:i person_id:i dt:s value:f",
    "select * from (select *, min(dt) over (partition by person_id) as m from lab where value >= 140) where dt = m",
)
def first_date_rows(t):
    return series.first_date_rows(t.lab.where(F.col("value") >= 140))


@query(
    "second_date_rows",
    "rid:i person_id:i dt:s value:f",
    """select * from (select *, dense_rank() over (partition by person_id order by dt) as k from lab where value >= 120) where k = 2""",
)
def second_date_rows(t):
    return series.second_date_rows(t.lab.where(F.col("value") >= 120))


@query(
    "highest_level",
    "person_id:i level:i",
    """select distinct person_id, level from (select *, max(level) over (partition by person_id) as m from (
         select person_id, cast(floor(value) as bigint) % 9 as level from covariate where kind = 'view' and year(dt) <= 2024)) where level = m""",
)
def highest_level(t):
    rows = t.covariate.where((F.col("kind") == "view") & (F.year("dt") <= 2024))
    return rows.groupBy("person_id").agg(F.max(F.floor("value") % 9).alias("level"))


@query(
    "any_over_exclude",
    "rid:i person_id:i",
    f"""select rid, person_id from lab where person_id not in (
          select person_id from lab where dt < date '{BASE}' and value >= 150)""",
)
def any_over_exclude(t):
    bad = (F.col("dt") < dates.day(BASE)) & (F.col("value") >= 150)
    return series.without_any(t.lab, bad)


@query(
    "change_from_prev",
    "person_id:i sum_change:f mean_change:f",
    """select person_id, coalesce(sum(d), 0) as sum_change, avg(d) as mean_change from (
         select person_id, value - lag(value) over (partition by person_id order by dt) as d from daily where value is not null) group by person_id""",
)
def change_from_prev(t):
    return series.change_from_previous(cleaning.daily_last(t.lab))


MONTHS_SQL = """months as (select person_id, cast(date_trunc('month', dt) as date) as dt, avg(value) as value, min(sex) as sex,
    min(event_age) + (max(event_age) - min(event_age)) / cast(2 as double) as event_age
  from daily where value is not null and dt < date '2000-01-01' group by all),
calendar as (select person_id, cast(unnest(generate_series(cast(min(dt) as timestamp), cast(max(dt) as timestamp), interval 1 month)) as date) as dt
  from months group by person_id),
gaps as (select c.person_id, c.dt, m.value, m.event_age, m.sex, year(c.dt) * 12 + month(c.dt) as i
  from calendar c left join months m on m.person_id = c.person_id and m.dt = c.dt),
known as (select *,
    last_value(case when value is not null then i end ignore nulls) over w as ia, last_value(value ignore nulls) over w as va,
    last_value(event_age ignore nulls) over w as aa,
    first_value(case when value is not null then i end ignore nulls) over x as ib, first_value(value ignore nulls) over x as vb,
    first_value(event_age ignore nulls) over x as ab,
    min(sex) over (partition by person_id) as s
  from gaps window w as (partition by person_id order by dt rows between unbounded preceding and current row),
                   x as (partition by person_id order by dt rows between current row and unbounded following)),
linear as (select person_id, dt, s as sex,
    coalesce(value, va + (vb - va) * ((i - ia) / cast(ib - ia as double))) as value,
    coalesce(event_age, aa + (ab - aa) * ((i - ia) / cast(ib - ia as double))) as event_age from known)"""


def _months(t):
    rows = cleaning.daily_last(t.lab).where(F.col("value").isNotNull() & (F.col("dt") < dates.day(START)))
    return series.monthly_mean(rows)


@query(
    "monthly_mean",
    "person_id:i dt:s value:f sex:s event_age:f",
    f"with {MONTHS_SQL} select * from months",
)
def monthly_mean(t):
    return _months(t)


@query("month_calendar", "person_id:i dt:s", f"with {MONTHS_SQL} select * from calendar")
def month_calendar(t):
    return series.month_calendar(_months(t))


@query(
    "join_right_calendar",
    "person_id:i dt:s value:f",
    f"with {MONTHS_SQL} select person_id, dt, value from gaps",
)
def join_right_calendar(t):
    months = _months(t)
    return months.join(series.month_calendar(months), ["person_id", "dt"], "right")


@query(
    "interpolate_linear",
    "person_id:i dt:s value:f event_age:f sex:s",
    f"with {MONTHS_SQL} select * from linear",
)
def interpolate_linear(t):
    return series.filled_months(_months(t), ["value", "event_age"], ["sex"])


@query(
    "label_window_stats",
    "person_id:i sex:s y_mean:f y_min:f y_next:f",
    f"""select person_id, sex, avg(value) as y_mean, min(value) as y_min, arg_min(value, dt) as y_next
        from daily where value is not null and dt >= date '{START}' and dt <= date '{END}' group by person_id, sex""",
)
def label_window_stats(t):
    rows = cleaning.daily_last(t.lab).where(F.col("value").isNotNull())
    return cohort.window_stats(rows, dates.day(START), dates.day(END), "egfr")


@query(
    "year_then_extreme",
    "person_id:i sex:s y_mean:f y_min:f y_next:f",
    """with y as (select person_id, sex, year(dt) as yr, avg(value) as m, min(value) as lo, arg_min(value, dt) as f
                  from daily where value is not null and dt >= date '1998-01-01' and dt <= date '2000-12-31' group by all)
       select person_id, sex, max(m) as y_mean, max(lo) as y_min, arg_min(f, yr) as y_next from y group by person_id, sex""",
)
def year_then_extreme(t):
    rows = cleaning.daily_last(t.lab).where(F.col("value").isNotNull())
    return cohort.yearly_stats(rows, dates.day("1998-01-01"), dates.day(END), "ldl")


@query(
    "midrank",
    "person_id:i midrank:f",
    "select person_id, rank() over (order by p1) + (count(*) over (partition by p1) - 1) / cast(2 as double) as midrank from pred",
)
def midrank(t):
    table = score_table(t.pred, [], "p1", {"n": F.lit(1)})
    ranks = table.select("p1", (F.col("n_below") + (F.col("n") + 1) / 2).alias("midrank"))
    return t.pred.join(ranks, "p1")


@query(
    "row_number_topn",
    "source:s feature:s importance:i n:i",
    """select * from (select *, row_number() over (partition by source order by importance desc, feature) as n from (
         select source, substr(code, 1, 3) as feature, count(*) as importance from code group by all)) where n in (1, 4, 5, 6, 7, 8, 11, 13, 14, 16)""",
)
def row_number_topn(t):
    features = t.code.groupBy("source", F.substring("code", 1, 3).alias("feature")).agg(
        F.count(F.lit(1)).alias("importance")
    )
    # one row per feature: bounded by the code vocabulary
    order = Window.partitionBy("source").orderBy(F.desc("importance"), "feature")
    ranked = features.withColumn("n", F.row_number().over(order))
    return ranked.where(F.col("n").isin(1, 4, 5, 6, 7, 8, 11, 13, 14, 16))


@query(
    "group_index",
    "score_type:s model:s score:f model_no:i",
    """with s as (select unit as score_type, lab as model, avg(value) as score from lab where unit is not null group by all)
       select *, row_number() over (partition by score_type order by model) as model_no from s""",
)
def group_index(t):
    scores = (
        t.lab.where(F.col("unit").isNotNull())
        .groupBy(F.col("unit").alias("score_type"), F.col("lab").alias("model"))
        .agg(F.avg("value").alias("score"))
    )
    order = Window.partitionBy("score_type").orderBy("model")
    return scores.withColumn("model_no", F.row_number().over(order))
