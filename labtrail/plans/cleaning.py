"""Cleaning, outliers, attrition and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.operators import cleaning
from labtrail.plans.registry import query
from labtrail.plans.scalars import EGFR_SQL

_ROW = "rid:i person_id:i event_age:i dt:s value:f unit:s flag:s"

RULES = cleaning.CleanRules(
    lab="egfr",
    unit="umol/l",
    choice="KDIGO-soft",
    min_age=18,
    dummies={"L": 45.0, "N": 80.0, "H": -1, "LL": 20.0, "HH": 300.0},
    low=30,
    high=190,
    max_z=3,
)

# the cleaning chain as plain SQL over every row
CLEAN_CTES = f"""
aged as (select * from labx where event_age >= 18),
exact as (select * exclude (k) from (
  select *, row_number() over (partition by person_id, dt, value, unit order by rid) as k from aged) where k = 1),
manual as (select * exclude (k, n) replace (case when n > 1 then coalesce(unit, 'umol/l') else unit end as unit) from (
  select *, count(*) over (partition by person_id, dt) as n,
         row_number() over (partition by person_id, dt order by event_age desc nulls last, unit desc nulls last, value desc nulls last, rid) as k
  from exact) where k = 1),
filled as (select * replace (
    case when value is not null then value when flag = 'L' then 45 when flag = 'N' then 80 when flag = 'LL' then 20 when flag = 'HH' then 300 end as value,
    case when value is not null then unit when flag in ('L', 'N') then 'umol/l' when flag = 'H' then null else unit end as unit) from manual),
valued as (select *, case flag when 'N' then 0 when 'L' then -1 when 'H' then 1 when 'LL' then -2 when 'HH' then 2 end as abnorm
           from filled where value is not null),
in_unit as (select * from valued where unit = 'umol/l'),
meaned as (select person_id, dt, event_age, sex, abnorm, avg(value) as value from in_unit group by all),
rated as (select * replace ({EGFR_SQL} as value) from meaned),
known as (select * from rated where value >= 30 and value <= 190),
zed as (select *, (value - avg(value) over ()) / nullif(stddev_pop(value) over (), 0) as z from known),
severe as (select * exclude (z) from zed where abs(z) < 3),
person_z as (select *, (value - avg(value) over (partition by person_id)) / nullif(stddev_samp(value) over (partition by person_id), 0) as z from severe),
person_n as (select *, count(*) filter (z > 2.5) over (partition by person_id) as nh, count(*) filter (z < -4) over (partition by person_id) as nl from person_z),
single as (select * from person_n where not coalesce((nh = 1 and z > 5 and value > 175) or (nl = 1 and z < -4 and value < 50), false)),
clean as (select person_id, sex, event_age, dt, value, abnorm,
                 case when value < 60 then 1 when value <= 65 and value >= 60 then 0.5 else 0 end as abnorm_custom from single)"""


@query(
    "clean_lab",
    "person_id:i sex:s event_age:i dt:s value:f abnorm:f abnorm_custom:f",
    f"with {CLEAN_CTES} select * from clean",
)
def clean_lab(t):
    return cleaning.clean_lab(t.labx, RULES)


@query(
    "attrition",
    "step_no:i step:s n_rows_now:i n_persons_now:i n_rows_removed:i n_persons_removed:i",
    f"""with {CLEAN_CTES}, s as (
      select 0 as step_no, 'Start' as step, count(*) as r, count(distinct person_id) as p from labx
      union all select 1, 'Min age', count(*), count(distinct person_id) from aged
      union all select 2, 'Dups exact', count(*), count(distinct person_id) from exact
      union all select 3, 'Dups manual', count(*), count(distinct person_id) from manual
      union all select 4, 'Values', count(*), count(distinct person_id) from valued
      union all select 5, 'Unit', count(*), count(distinct person_id) from in_unit
      union all select 6, 'Dups mean', count(*), count(distinct person_id) from meaned
      union all select 7, 'Outliers_known', count(*), count(distinct person_id) from known
      union all select 8, 'Outliers', count(*), count(distinct person_id) from severe
      union all select 9, 'Outliers_single', count(*), count(distinct person_id) from single)
    select step_no, step, r as n_rows_now, p as n_persons_now,
           coalesce(lag(r) over (order by step_no) - r, 0) as n_rows_removed,
           coalesce(lag(p) over (order by step_no) - p, 0) as n_persons_removed from s""",
)
def attrition(t):
    return cleaning.attrition(t.labx, RULES)


@query(
    "clean_lab_last_of_day",
    "person_id:i event_age:i dt:s value:f abnorm_custom:f",
    """with exact as (select * exclude (k) from (
         select *, row_number() over (partition by person_id, dt, value, unit order by rid) as k from labx) where k = 1),
       manual as (select * exclude (k, n) replace (case when n > 1 then coalesce(unit, 'umol/l') else unit end as unit) from (
         select *, count(*) over (partition by person_id, dt) as n,
           row_number() over (partition by person_id, dt order by event_age desc nulls last, unit desc nulls last, value desc nulls last, rid) as k
         from exact) where k = 1),
       v as (select *, round(case when unit = '%' then 10.93 * value - 23.5 else value end) as mmol from manual where value is not null),
       z as (select *, (mmol - avg(mmol) over ()) / stddev_pop(mmol) over () as z from v)
       select person_id, event_age, dt, mmol as value, case when mmol > 47 then 1 when mmol <= 47 then 0 end as abnorm_custom
       from z where abs(z) < 1.5""",
)
def clean_lab_last_of_day(t):
    rules = cleaning.CleanRules(
        lab="hba1c", unit="mmol/mol", priority_unit="umol/l", choice="strong", max_z=1.5, keep_last_of_day=True
    )
    return cleaning.clean_lab(t.labx, rules)


@query(
    "outliers_known",
    "part:s rid:i value:f",
    """select 'both' as part, rid, value from lab where value >= 60 and value <= 120
       union all select 'upper', rid, value from lab where value <= 120""",
)
def outliers_known(t):
    both = cleaning.known_outliers(t.lab, 60, 120).withColumn("part", F.lit("both"))
    upper = cleaning.known_outliers(t.lab, None, 120).withColumn("part", F.lit("upper"))
    return both.unionByName(upper)


@query(
    "outliers_severe",
    "rid:i value:f removed_from:f removed_to:f",
    """with z as (select rid, value, (value - avg(value) over ()) / stddev_pop(value) over () as z from lab)
       select rid, value, (select min(value) from z where z >= 1.2) as removed_from, (select max(value) from z where z <= -1.2) as removed_to
       from z where abs(z) < 1.2""",
)
def outliers_severe(t):
    bounds = cleaning.severe_bounds(t.lab, 1.2)
    pair = bounds.select(F.struct("removed_from", "removed_to").alias("b")).scalar()
    return cleaning.severe_outliers(t.lab, 1.2).withColumn("_b", pair).select("*", "_b.*")


_SPIKED = "case when rid % 50 = 0 then value * 8 when rid % 50 = 1 then value / 20 else 100 + value / 100 end"


@query(
    "outliers_single",
    "rid:i person_id:i value:f",
    f"""with w as (select rid, person_id % 60 as person_id, {_SPIKED} as value from lab where value is not null),
       z as (select *, (value - avg(value) over (partition by person_id)) / nullif(stddev_samp(value) over (partition by person_id), 0) as z from w),
       n as (select *, count(*) filter (z > 2.5) over (partition by person_id) as nh, count(*) filter (z < -4) over (partition by person_id) as nl from z)
       select rid, person_id, value from n
       where not coalesce((nh = 1 and z > 5 and value > 175) or (nl = 1 and z < -4 and value < 50), false)""",
)
def outliers_single(t):
    value = (
        F.when(F.col("rid") % 50 == 0, F.col("value") * 8)
        .when(F.col("rid") % 50 == 1, F.col("value") / 20)
        .otherwise(100 + F.col("value") / 100)
    )
    rows = t.lab.where(F.col("value").isNotNull()).select(
        "rid", (F.col("person_id") % 60).alias("person_id"), value.alias("value")
    )
    return cleaning.single_outliers(rows)


@query(
    "zscore_person",
    "rid:i z:f",
    """select rid, (value - avg(value) over (partition by person_id)) / nullif(stddev_samp(value) over (partition by person_id), 0) as z from lab""",
)
def zscore_person(t):
    return cleaning.zscore_person(t.lab)


@query(
    "zscore_global",
    "rid:i z:f",
    "select rid, (value - avg(value) over ()) / stddev_pop(value) over () as z from lab",
)
def zscore_global(t):
    return cleaning.zscore_global(t.lab)


_COPIES_SQL = """select rid, person_id, event_age, date_trunc('month', dt)::date as dt,
       case when value is null then null else 40 + round(value / 40) end as value, unit, flag, sex from lab"""


def _copies(t):
    """Coarse dates and values, so that many rows share a key."""
    return t.lab.select(
        "rid",
        "person_id",
        "event_age",
        F.trunc("dt", "month").alias("dt"),
        (40 + F.round(F.col("value") / 40)).alias("value"),
        "unit",
        "flag",
        "sex",
    )


@query(
    "dedup_exact",
    _ROW,
    f"""select * from (select *, row_number() over (partition by person_id, dt, value, unit order by rid) as k from ({_COPIES_SQL})) where k = 1""",
)
def dedup_exact(t):
    return cleaning.dedup_exact(_copies(t))


@query(
    "dedup_none",
    _ROW,
    f"select * from (select *, count(*) over (partition by person_id, dt) as n from ({_COPIES_SQL})) where n = 1",
)
def dedup_none(t):
    return cleaning.dedup_none(_copies(t))


@query(
    "dedup_unit_priority",
    _ROW,
    f"""select * replace (case when n > 1 then coalesce(unit, 'mmol/mol') else unit end as unit) from (
          select *, count(*) over (partition by person_id, dt) as n, row_number() over (partition by person_id, dt
            order by event_age desc nulls last, unit desc nulls last, value desc nulls last, rid) as k from ({_COPIES_SQL})) where k = 1""",
)
def dedup_unit_priority(t):
    return cleaning.dedup_unit_priority(_copies(t), "mmol/mol")


@query(
    "flag_duplicates",
    _ROW,
    f"select * from (select *, count(*) over (partition by person_id, dt, value, unit) as n from ({_COPIES_SQL})) where n > 1",
)
def flag_duplicates(t):
    return cleaning.flag_duplicates(_copies(t), cleaning.ROW_KEY)


@query(
    "same_day_mean",
    "person_id:i dt:s event_age:i sex:s flag:s unit:s value:f",
    "select person_id, dt, event_age, sex, flag, unit, avg(value) as value from lab group by all",
)
def same_day_mean(t):
    return cleaning.same_day_mean(t.lab)


@query(
    "last_of_day",
    "rid:i person_id:i dt:s value:f",
    "select * from (select *, max(ts) over (partition by person_id, dt) as last from covariate) where ts = last",
)
def last_of_day(t):
    return cleaning.last_of_day(t.covariate)
