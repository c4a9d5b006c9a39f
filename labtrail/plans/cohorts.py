"""Runs, exclusions, labels, splits, histories, covariates and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions import dates, recode, thresholds, units
from labtrail.functions.uniform import uniform
from labtrail.operators import cleaning, cohort, covariates, feature_store, features, history, registry, series
from labtrail.operators.feature_store import Source
from labtrail.plans.cleaning import CLEAN_CTES, RULES
from labtrail.plans.registry import BASE, END, START, query, u_sql
from labtrail.plans.scalars import SMOKE_NAMES, SMOKE_SQL
from labtrail.plans.windows import MONTHS_SQL, runs_sql
from labtrail.session import bucketed, stage


def clean(t):
    return cleaning.clean_lab(t.labx, RULES)


def stored(t):
    """The cleaned series as later steps read it: written once, in buckets of persons."""
    return bucketed(clean(t), "person_id")


def _lab(t, code, value, abnorm=None):
    """One derived series per lab code of the fixture."""
    rows = t.lab.where((F.col("lab") == code) & F.col("value").isNotNull())
    rows = rows.withColumn("value", value)
    return rows if abnorm is None else rows.withColumn("abnorm_custom", abnorm)


@query(
    "abnormal_runs",
    "person_id:i dt:s abnorm_custom:f start_dt:s diff:i",
    f"with {CLEAN_CTES} select * from {runs_sql('clean', 'abnorm_custom')}",
)
def abnormal_runs(t):
    return series.abnormal_runs(clean(t))


_DIAGNOSIS = f"""diagnosed as (select person_id, dt as diagnosis_dt, start_dt as first_abnormal_dt, diff from (
  select *, row_number() over (partition by person_id order by start_dt, diff) as k
  from {runs_sql("(select * from clean where abnorm_custom <> 0.5)", 'abnorm_custom')} where abnorm_custom >= 1 and diff >= 90) where k = 1)"""


@query(
    "data_diagnosis",
    "person_id:i diagnosis_dt:s first_abnormal_dt:s diff:i",
    f"with {CLEAN_CTES}, {_DIAGNOSIS} select * from diagnosed",
)
def data_diagnosis(t):
    return series.data_diagnosis(clean(t).where(F.col("abnorm_custom") != 0.5), 90)


KIDNEY_ORDER = ["data", "diagnosis", "drug", "nephrectomy", "cystatin", "albumin"]
_KIDNEY_CTES = f"""{CLEAN_CTES}, {_DIAGNOSIS},
reasons as (
  select person_id, 'data' as reason, diagnosis_dt as first_dt from diagnosed
  union all select person_id, 'diagnosis', min(dt) from code where regexp_matches(code, '^A0[1-5]') group by person_id
  union all select person_id, 'drug', min(dt) from code where source = 'PURCH' and starts_with(code, 'B10') group by person_id
  union all select person_id, 'nephrectomy', min(dt) from code where starts_with(code, 'C20') group by person_id
  union all select person_id, 'cystatin', min(dt) from (
    select person_id, dt, 133 * pow(least(value / 100 / 0.8, 1), -0.499) * pow(greatest(value / 100 / 0.8, 1), -1.328) * pow(0.996, event_age)
      * case when sex = 'male' then 1 else 0.932 end as rate from lab where lab = '2-HIGH' and value is not null) where rate < 60 group by person_id
  union all select person_id, 'albumin', min(dt) from lab where lab = '3-MEDIUM' and value - 125 >= 30 group by person_id)"""


def coded_tests():
    drug = (F.col("source") == "PURCH") & F.col("code").startswith("B10")
    return {"diagnosis": F.col("code").rlike("^A0[1-5]"), "drug": drug}


def kidney_reasons(t, rows):
    rate = units.cystatin_2012(F.col("value") / 100, F.col("sex"), F.col("event_age"))
    return cohort.kidney_reasons(
        rows,
        cohort.first_events(t.code, {**coded_tests(), "nephrectomy": F.col("code").startswith("C20")}),
        _lab(t, "2-HIGH", rate),
        _lab(t, "3-MEDIUM", F.col("value") - 125),
    )


_SERIES = "person_id:i sex:s event_age:i dt:s value:f abnorm_custom:f"


def _kept_sql(source: str, base: str = BASE) -> str:
    return f"""select distinct * from {source} where person_id not in (select person_id from reasons where first_dt < date '{base}')"""


@query("exclude_egfr", _SERIES, f"with {_KIDNEY_CTES} {_kept_sql('clean')}")
def exclude_egfr(t):
    rows = stored(t)
    return cohort.exclude(rows, kidney_reasons(t, rows), dates.day(BASE))


@query(
    "exclusion_counts",
    "step_no:i step:s n_persons_removed:i n_rows_removed:i n_persons_left:i n_rows_left:i",
    f"""with {_KIDNEY_CTES},
      o as (select * from (values (1,'data'),(2,'diagnosis'),(3,'drug'),(4,'nephrectomy'),(5,'cystatin'),(6,'albumin')) v(step_no, step)),
      hit as (select person_id, min(step_no) as no from reasons join o on o.step = reason where first_dt < date '{BASE}' group by person_id),
      p as (select c.person_id, count(*) as n, coalesce(any_value(no), 7) as no from clean c left join hit h on h.person_id = c.person_id group by c.person_id),
      s as (select 0 as step_no, 'start' as step union all select * from o)
    select step_no, step, (select count(*) from p where no = step_no) as n_persons_removed,
      (select coalesce(sum(n), 0) from p where no = step_no) as n_rows_removed,
      (select count(*) from p where no > step_no) as n_persons_left, (select coalesce(sum(n), 0) from p where no > step_no) as n_rows_left from s""",
)
def exclusion_counts(t):
    rows = stored(t)
    return cohort.exclusion_counts(rows, kidney_reasons(t, rows), KIDNEY_ORDER, dates.day(BASE))


_AGE_SQL = f"cast(floor(date_diff('day', birth_date, date '{START}') / cast(365.25 as double)) as integer)"


@query(
    "final_cohort",
    "person_id:i sex:s event_age:i y_mean_abnorm:i",
    f"""with {_KIDNEY_CTES}, k as ({_kept_sql('clean', START)})
        select distinct k.person_id, k.sex, {_AGE_SQL} as event_age, 0 as y_mean_abnorm from k join person p on p.person_id = k.person_id
        where {_AGE_SQL} between 30 and 60""",
)
def final_cohort(t):
    rows = stored(t)
    return cohort.final_cohort(rows, kidney_reasons(t, rows), t.person, dates.day(START), 30, 60)


@query(
    "final_cohort_30_70",
    "person_id:i sex:s event_age:i y_mean_abnorm:i",
    f"""with {_KIDNEY_CTES}, k as ({_kept_sql('clean', START)})
        select distinct k.person_id, k.sex, {_AGE_SQL} as event_age, 0 as y_mean_abnorm from k join person p on p.person_id = k.person_id
        where {_AGE_SQL} between 30 and 70""",
)
def final_cohort_30_70(t):
    rows = stored(t)
    return cohort.final_cohort(rows, kidney_reasons(t, rows), t.person, dates.day(START))


_CODE_REASONS = """select person_id, 'diagnosis' as reason, min(dt) as first_dt from code where regexp_matches(code, '^A0[1-5]') group by person_id
  union all select person_id, 'drug', min(dt) from code where source = 'PURCH' and starts_with(code, 'B10') group by person_id"""


def _second_sql(reason: str, lab: str, test: str) -> str:
    return f"""select person_id, '{reason}', dt from (select person_id, dt, row_number() over (partition by person_id order by dt) as k
      from (select distinct person_id, dt from lab where lab = '{lab}' and {test})) where k = 2"""


def _code_events(t):
    return cohort.first_events(t.code, coded_tests())


@query(
    "exclude_hba1c",
    "rid:i person_id:i value:f abnorm_custom:f",
    f"""with s as (select rid, person_id, dt, value, case when value > 47 then 1 when value <= 47 then 0 end as abnorm_custom
                   from lab where lab = '1-URGENT' and value is not null),
        reasons as (select person_id, 'data' as reason, min(dt) as first_dt from s where value > 150 group by person_id
          union all {_CODE_REASONS}
          union all {_second_sql('fasting glucose', '2-HIGH', 'value / 10 >= 7')}
          union all {_second_sql('glucose', '3-MEDIUM', 'value / 10 >= 11')})
        {_kept_sql('s')}""",
)
def exclude_hba1c(t):
    rows = _lab(t, "1-URGENT", F.col("value"), thresholds.abnormal("hba1c", "strong"))
    marked = rows.withColumn("abnorm_custom", F.when(F.col("value") > 150, 1.0).otherwise(0.0))
    reasons = cohort.sugar_reasons(
        marked,
        _code_events(t),
        _lab(t, "2-HIGH", F.col("value") / 10),
        _lab(t, "3-MEDIUM", F.col("value") / 10),
    )
    return cohort.exclude(rows, reasons, dates.day(BASE))


@query(
    "exclude_ldl",
    "rid:i person_id:i value:f",
    f"""with s as (select rid, person_id, dt, value / 35 as value from lab where lab = '1-URGENT' and value is not null),
        reasons as (select person_id, 'data' as reason, min(dt) as first_dt from s where value >= 4 group by person_id
          union all {_CODE_REASONS}
          union all select person_id, 'fasting triglycerides', min(dt) from lab where lab = '4-NOT SPECIFIED' and value / 25 >= 5.6 group by person_id
          union all {_second_sql('triglycerides', '5-LOW', 'value / 20 >= 5.6')})
        {_kept_sql('s')}""",
)
def exclude_ldl(t):
    rows = _lab(t, "1-URGENT", F.col("value") / 35)
    reasons = cohort.fat_reasons(
        rows,
        _code_events(t),
        _lab(t, "4-NOT SPECIFIED", F.col("value") / 25),
        _lab(t, "5-LOW", F.col("value") / 20),
    )
    return cohort.exclude(rows, reasons, dates.day(BASE))


@query(
    "exclude_tsh",
    "rid:i person_id:i value:f abnorm_custom:f",
    f"""with s as (select rid, person_id, dt, value / 35 as value, case when value / 35 >= 4 then 1 when value / 35 < 0.4 then -1 else 0 end as abnorm_custom
                   from lab where lab = '2-HIGH' and value is not null),
        reasons as (select person_id, 'data' as reason, min(dt) as first_dt from s where abnorm_custom <> 0 group by person_id
          union all {_CODE_REASONS}
          union all select person_id, 't4', min(dt) from lab where lab = '1-URGENT' and (value / 6 > 23 or value / 6 <= 9) group by person_id
          union all select person_id, 't3', min(dt) from lab where lab = '5-LOW' and value / 24 > 6.3 group by person_id)
        {_kept_sql('s')}""",
)
def exclude_tsh(t):
    rows = _lab(t, "2-HIGH", F.col("value") / 35, thresholds.abnormal("tsh", "multi"))
    reasons = cohort.thyroid_reasons(
        rows,
        _code_events(t),
        _lab(t, "1-URGENT", F.col("value") / 6, thresholds.abnormal("t4")),
        _lab(t, "5-LOW", F.col("value") / 24, thresholds.abnormal("t3")),
    )
    return cohort.exclude(rows, reasons, dates.day(BASE))


_LABEL = "person_id:i sex:s y_mean:f y_mean_abnorm:f y_min:f y_min_abnorm:f y_next:f y_next_abnorm:f"


def _soft(c: str) -> str:
    return f"case when {c} < 60 then 1 when {c} <= 65 and {c} >= 60 then 0.5 else 0 end"


LABEL_CTE = f"""labels as (select *, {_soft('y_mean')} as y_mean_abnorm, {_soft('y_min')} as y_min_abnorm, {_soft('y_next')} as y_next_abnorm from (
  select person_id, sex, avg(value) as y_mean, min(value) as y_min, arg_min(value, dt) as y_next from clean
  where dt >= date '{START}' and dt <= date '{END}' group by person_id, sex))"""


def label_table(t, rows=None):
    return cohort.labels(clean(t) if rows is None else rows, dates.day(START), dates.day(END), "egfr", "KDIGO-soft")


@query("labels", _LABEL, f"with {CLEAN_CTES}, {LABEL_CTE} select * from labels")
def labels(t):
    return label_table(t)


@query(
    "labels_per_year",
    _LABEL,
    f"""with {CLEAN_CTES}, y as (select person_id, sex, year(dt) as yr, avg(value) as m, min(value) as lo, arg_min(value, dt) as f
          from clean where dt >= date '1998-01-01' and dt <= date '{END}' group by all),
        l as (select person_id, sex, min(m) as y_mean, min(lo) as y_min, arg_min(f, yr) as y_next from y group by person_id, sex)
        select *, {_soft('y_mean')} as y_mean_abnorm, {_soft('y_min')} as y_min_abnorm, {_soft('y_next')} as y_next_abnorm from l""",
)
def labels_per_year(t):
    return cohort.labels_per_year(
        clean(t), dates.day("1998-01-01"), dates.day(END), "egfr", "KDIGO-soft"
    )


@query(
    "case_counts",
    "goal:s n:i n_cases:f pct_cases:f",
    f"""with {CLEAN_CTES}, {LABEL_CTE}, g as (select unnest(['MEAN', 'MIN', 'NEXT']) as goal, unnest([y_mean_abnorm, y_min_abnorm, y_next_abnorm]) as c from labels)
        select goal, count(*) as n, sum(c) as n_cases, round(cast(sum(c) as double) / count(*) * 100, 2) as pct_cases from g group by goal""",
)
def case_counts(t):
    goals = {"MEAN": "y_mean_abnorm", "MIN": "y_min_abnorm", "NEXT": "y_next_abnorm"}
    return cohort.case_counts(label_table(t), goals)


_AGED_SQL = f"cast(floor(date_diff('day', birth_date, date '{BASE}') / cast(365.25 as double)) as integer)"


@query(
    "age_restrict",
    "person_id:i y_mean:f event_age:i",
    f"""with {CLEAN_CTES}, {LABEL_CTE} select l.person_id, y_mean, {_AGED_SQL} as event_age from labels l left join person p on p.person_id = l.person_id
        where not coalesce({_AGED_SQL} < 30 or {_AGED_SQL} > 60, false)""",
)
def age_restrict(t):
    return cohort.age_restrict(label_table(t), t.person, dates.day(BASE), 30, 60)


@query(
    "cohort_members",
    "person_id:i",
    "select person_id from person where cohort in ('HELSINKI BIOBANK', 'AURIA BIOBANK') and pc1 is not null",
)
def cohort_members(t):
    return cohort.cohort_members(t.person, ["HELSINKI BIOBANK", "AURIA BIOBANK"], t.person)


_TEST_SQL = f"""(select person_id from (select person_id, row_number() over (order by {u_sql('person_id', salt='test')}, person_id) as k
  from labels where person_id in (select person_id from person where cohort = 'HELSINKI BIOBANK')) where k <= 60)"""


@query("test_sample", "person_id:i", f"with {CLEAN_CTES}, {LABEL_CTE} select * from {_TEST_SQL}")
def test_sample(t):
    members = cohort.cohort_members(t.person, ["HELSINKI BIOBANK"])
    return cohort.test_sample(label_table(t), members, n=60)


@query(
    "stratified_split",
    "person_id:i split_set:f",
    f"""with {CLEAN_CTES}, {LABEL_CTE}, p as (
          select person_id, row_number() over w - 1 as pos, count(*) over (partition by y_mean_abnorm, y_next_abnorm, y_min_abnorm) as n from labels
          window w as (partition by y_mean_abnorm, y_next_abnorm, y_min_abnorm order by {u_sql('person_id', salt='split')}, person_id)),
        h as (select *, floor(n * (cast(0.2 as double) + cast(0.1 as double)) + 0.5) as held from p)
        select person_id, case when pos >= held then 0 when pos < floor(held * (cast(0.2 as double) / (cast(0.2 as double) + cast(0.1 as double))) + 0.5) then 1 else 0.5 end as split_set from h""",
)
def stratified_split(t):
    return cohort.stratified_split(
        label_table(t), ["y_mean_abnorm", "y_next_abnorm", "y_min_abnorm"], tuning=0.2, fine_tune=0.1
    )


@query(
    "future_split",
    "person_id:i split_set:f",
    f"""with {CLEAN_CTES}, {LABEL_CTE}, t as (select * from {_TEST_SQL})
        select distinct person_id, 0 as split_set from clean where dt >= date '1999-01-01' and dt <= date '1999-12-31'
        union all select person_id, case when person_id in (select person_id from t) then 2 else 1 end from labels""",
)
def future_split(t):
    rows = stored(t)
    earlier = cohort.labels(rows, dates.day("1999-01-01"), dates.day("1999-12-31"), "egfr")
    later = stage(label_table(t, rows))
    members = cohort.cohort_members(t.person, ["HELSINKI BIOBANK"])
    return cohort.future_split(earlier, later, cohort.test_sample(later, members, n=60))


@query(
    "pre_base_history",
    _SERIES,
    f"with {CLEAN_CTES}, {LABEL_CTE} select * from clean where dt < date '{BASE}' and person_id in (select person_id from labels)",
)
def pre_base_history(t):
    rows = stored(t)
    return cohort.pre_base_history(rows, label_table(t, rows), dates.day(BASE))


# ------------------------------------------------------------------- history

STATS = (
    "MEAN NO_HISTORY SD MIN MAX SUM KURT SKEW ABS_ENERG SUM_CHANGE MEAN_CHANGE SEQ_LEN QUANT_25 QUANT_75 "
    "IDX_QUANT_0 IDX_QUANT_100 ABNORM MIN_LOC MAX_LOC FIRST_LAST"
).split()
_STAT_SPEC = "person_id:i split_set:f " + " ".join(f"{s}:f" for s in STATS) + " LAST_VAL_DATE:s"

STATS_CTE = f"""h as (select c.*, split_set from clean c join pred p on p.person_id = c.person_id where dt < date '{BASE}'),
d as (select *, value - lag(value) over (partition by person_id order by dt) as step, avg(value) over (partition by person_id) as mu from h),
stats as (select person_id, split_set, avg(value) as "MEAN", 0 as "NO_HISTORY", stddev_samp(value) as "SD", min(value) as "MIN", max(value) as "MAX",
  sum(value) as "SUM",
  case when count(*) > 1 then avg(pow(value - mu, 4)) / nullif(pow(avg(pow(value - mu, 2)), 2), 0) - 3 end as "KURT",
  case when count(*) > 1 then avg(pow(value - mu, 3)) / nullif(pow(avg(pow(value - mu, 2)), 1.5), 0) end as "SKEW",
  sum(value * value) as "ABS_ENERG", coalesce(sum(step), 0) as "SUM_CHANGE", avg(step) as "MEAN_CHANGE", count(*) as "SEQ_LEN",
  list_sort(list(value))[cast(floor((count(*) - 1) * 0.25 + 0.5) as bigint) + 1] as "QUANT_25",
  list_sort(list(value))[cast(floor((count(*) - 1) * 0.75 + 0.5) as bigint) + 1] as "QUANT_75",
  arg_min(value, dt) as "IDX_QUANT_0", arg_max(value, dt) as "IDX_QUANT_100", trunc(sum(abnorm_custom)) as "ABNORM",
  abs(date_diff('day', date '{BASE}', arg_min(dt, row(value, dt)))) / cast(365.25 as double) as "MIN_LOC",
  abs(date_diff('day', date '{BASE}', arg_min(dt, row(-value, dt)))) / cast(365.25 as double) as "MAX_LOC",
  date_diff('day', min(dt), max(dt)) / cast(365.25 as double) as "FIRST_LAST", max(dt) as "LAST_VAL_DATE"
  from d group by person_id, split_set)"""


def sumstats(t):
    return history.history_sumstats(clean(t), t.pred, dates.day(BASE))


@query("history_sumstats", _STAT_SPEC, f"with {CLEAN_CTES}, {STATS_CTE} select * from stats")
def history_sumstats(t):
    return sumstats(t)


_MEANS = ("MIN", "MAX", "MEAN", "SUM", "ABS_ENERG", "QUANT_25", "QUANT_75", "IDX_QUANT_0", "IDX_QUANT_100", "MIN_LOC", "MAX_LOC")
_SHAPE = ("KURT", "SKEW", "SD", "MEAN_CHANGE")


def _impute_sql(mode: int) -> str:
    def cell(s):
        if s == "NO_HISTORY":
            return '1 as "NO_HISTORY"'
        if s in _MEANS or (mode == 2 and s in _SHAPE):
            return f'(select avg("{s}") from stats where split_set = 0) as "{s}"'
        return f'null as "{s}"' if s in _SHAPE else f'0 as "{s}"'

    cells = ", ".join(cell(s) for s in STATS)
    last = "date '2013-01-01'" if mode == 2 else "null"
    return f"""with {CLEAN_CTES}, {STATS_CTE} select * from stats union all by name
      select person_id, split_set, {cells}, {last} as "LAST_VAL_DATE" from pred where person_id not in (select person_id from stats)"""


@query("mean_impute", _STAT_SPEC, _impute_sql(1))
def mean_impute(t):
    return history.mean_impute(stage(sumstats(t)), t.pred, 1)


@query("mean_impute_all", _STAT_SPEC, _impute_sql(2))
def mean_impute_all(t):
    return history.mean_impute(stage(sumstats(t)), t.pred, 2)


@query(
    "days_since_last",
    "person_id:i LAST_VAL_DIFF:i",
    f"""with {CLEAN_CTES}, {STATS_CTE} select person_id, date_diff('day', "LAST_VAL_DATE", date '{START}') as "LAST_VAL_DIFF" from stats""",
)
def days_since_last(t):
    return history.days_since_last(sumstats(t), dates.day(START))


_RATE = """case when sex = 'male' then 142 * pow(least(value / 88.4 / 0.9, 1), -0.302) * pow(greatest(value / 88.4 / 0.9, 1), -1.2) * pow(0.9938, event_age)
  else 142 * pow(least(value / 88.4 / 0.7, 1), -0.241) * pow(greatest(value / 88.4 / 0.9, 1), -1.2) * pow(0.9938, event_age) * 1.012 end"""


@query(
    "monthly_interpolated",
    "person_id:i dt:s value:f event_age:f abnorm_custom:f",
    f"with {MONTHS_SQL}, r as (select person_id, dt, event_age, {_RATE} as value from linear) select *, case when value < 60 then 1 else 0 end as abnorm_custom from r",
)
def monthly_interpolated(t):
    return history.monthly_interpolated(cleaning.daily_last(t.lab), dates.day(START))


_LABS = {f"{i}": f"L{i}" for i in range(1, 6)}
_LAB_NAMES = list(_LABS.values())


def short_labs(t):
    code = recode.lookup(F.substring("lab", 1, 1), _LABS)
    return t.lab.where((F.col("dt") < dates.day(BASE)) & F.col("value").isNotNull()).withColumn("lab", code)


LAB_LONG = f"""lf as (select person_id, concat('L', substr(lab, 1, 1)) as lab, avg(value) as m,
  list_sort(list(value))[cast(floor((count(*) - 1) * 0.25 + 0.5) as bigint) + 1] as a,
  list_sort(list(value))[cast(floor((count(*) - 1) * 0.75 + 0.5) as bigint) + 1] as b
  from lab where dt < date '{BASE}' and value is not null group by all)"""
_WIDE_SQL = ", ".join(
    f"""max(m) filter (lab = '{n}') as "{n}_MEAN", max(a) filter (lab = '{n}') as "{n}_QUANT25", max(b) filter (lab = '{n}') as "{n}_QUANT75" """
    for n in _LAB_NAMES
)
_WIDE_SPEC = " ".join(f"{n}_{s}:f" for n in _LAB_NAMES for s in ("MEAN", "QUANT25", "QUANT75"))


@query("lab_matrix", "person_id:i " + _WIDE_SPEC, f"with {LAB_LONG} select person_id, {_WIDE_SQL} from lf group by person_id")
def lab_matrix(t):
    return history.lab_matrix(history.lab_features(short_labs(t)), _LAB_NAMES)


@query(
    "lab_source_override",
    "person_id:i lab:s MEAN:f QUANT25:f QUANT75:f",
    """with a as (select person_id, lab, value from lab where lab not in ('1-URGENT', '2-HIGH') and value is not null
                  union all select person_id, 'rate', value / 2 from lab where lab = '1-URGENT' and value is not null)
       select person_id, lab, avg(value) as "MEAN", quantile_cont(value, 0.25) as "QUANT25", quantile_cont(value, 0.75) as "QUANT75" from a group by all""",
)
def lab_source_override(t):
    derived = _lab(t, "1-URGENT", F.col("value") / 2)
    labs = history.replace_labs(t.lab, derived, ["1-URGENT", "2-HIGH"], "rate")
    return history.lab_features(labs.where(F.col("value").isNotNull()), method="linear")


# ---------------------------------------------------------------- covariates

_LAST = "2024-01-20"


@query(
    "smoke_latest",
    "person_id:i smoke:i",
    f"""with s as (select person_id, dt, case when s in ('NO', 'NEVER', 'PASSIVE') then 0 when s in ('FORMER', 'EVER') then 1 when s = 'CURRENT' then 2 end as smoke
          from (select *, {SMOKE_SQL} as s from covariate)),
        k as (select *, max(dt) over (partition by person_id) as m from s where smoke is not null and dt < date '{_LAST}')
        select person_id, max(smoke) as smoke from k where dt = m group by person_id""",
)
def smoke_latest(t):
    status = recode.lookup(F.col("rid") % 7, dict(enumerate(SMOKE_NAMES)))
    return covariates.smoke_latest(t.covariate.withColumn("status", status), dates.day(_LAST))


@query(
    "bp_latest",
    "person_id:i sbp:f dbp:f",
    f"""with k as (select *, max(dt) over (partition by person_id, kind) as m from covariate where value is not null and dt < date '{_LAST}')
        select coalesce(a.person_id, b.person_id) as person_id, sbp, dbp from
          (select person_id, avg(value) as sbp from k where dt = m and kind = 'view' group by person_id) a
          full join (select person_id, avg(value) as dbp from k where dt = m and kind = 'click' group by person_id) b on a.person_id = b.person_id""",
)
def bp_latest(t):
    parts = [
        covariates.latest_mean(t.covariate.where(F.col("kind") == kind), dates.day(_LAST), "value", name)
        for kind, name in (("view", "sbp"), ("click", "dbp"))
    ]
    return parts[0].join(parts[1], "person_id", "full")


@query(
    "alcohol_latest",
    "person_id:i alcohol:i",
    f"""with k as (select *, max(dt) over (partition by person_id) as m from covariate where kind = 'error' and dt < date '{_LAST}')
        select person_id, max(cast(floor(value) as integer) % 4) as alcohol from k where dt = m group by person_id""",
)
def alcohol_latest(t):
    rows = t.covariate.where(F.col("kind") == "error").withColumn("status", F.floor("value") % 4)
    return covariates.latest_status(rows, dates.day(_LAST), "status", "alcohol")


@query(
    "edu_max",
    "person_id:i edu:i",
    """select person_id, case when max(cast(floor(value) as bigint) % 9) <= 4 then 0 else 1 end as edu from covariate
       where kind = 'signup' and year(dt) <= 2024 group by person_id""",
)
def edu_max(t):
    rows = t.covariate.where(F.col("kind") == "signup")
    code = F.concat((F.floor("value") % 9).cast("string"), F.lit("01"))
    return covariates.edu_max(rows.withColumn("code", code), 2024)


@query(
    "bmi_with_fallback",
    "person_id:i bmi:f",
    f"""with m as (select person_id, avg(value) as bmi from (select *, max(dt) over (partition by person_id) as m from covariate
              where kind = 'view' and value > 150 and dt < date '{_LAST}') where dt = m group by person_id)
        select * from m union all
        select person_id, bmi from person where bmi is not null and person_id not in (select person_id from m)
          and (case when pc1 is null then date '{_LAST}' - 365 else birth_date + cast(round((40 + pc1 * 60) * cast(365.25 as double)) as integer) end) < date '{_LAST}'""",
)
def bmi_with_fallback(t):
    visits = t.covariate.where((F.col("kind") == "view") & (F.col("value") > 150))
    persons = t.person.withColumn("weight_age", 40 + F.col("pc1") * 60)
    return covariates.bmi_with_fallback(visits, persons, dates.day(_LAST))


@query(
    "covariate_fill",
    "person_id:i bmi:f edu:f",
    "select person_id, coalesce(bmi, 22) as bmi, case when person_id % 4 = 0 then 0.5 else person_id % 2 end as edu from person",
)
def covariate_fill(t):
    edu = F.when(F.col("person_id") % 4 != 0, (F.col("person_id") % 2).cast("double"))
    return covariates.covariate_fill(t.person.withColumn("edu", edu), covariates.MISSING_COVARIATES)


@query(
    "pgs_attach",
    "person_id:i y:i PGS1:f PGS2:f pc1:f",
    f"""select d.person_id, y, case when d.person_id % 3 <> 0 then {u_sql('d.person_id', salt='s1')} end as "PGS1",
               {u_sql('d.person_id', salt='s2')} as "PGS2", pc1 from pred d join person p on p.person_id = d.person_id where pc1 is not null""",
)
def pgs_attach(t):
    two = t.person.where(F.col("person_id") % 3 != 0).select("person_id", uniform("person_id", salt="s1").alias("score"))
    five = t.person.select(
        F.lit(0).alias("a"), "person_id", F.lit(1).alias("b"), F.lit(2).alias("c"), uniform("person_id", salt="s2").alias("score")
    )
    return covariates.pgs_attach(t.pred, {"PGS1": two, "PGS2": five}, t.person.select("person_id", "pc1"))


@query(
    "pcs_required",
    "person_id:i y:i pc1:f",
    "select d.person_id, y, pc1 from pred d join person p on p.person_id = d.person_id where pc1 is not null",
)
def pcs_required(t):
    return covariates.pcs_required(t.pred, t.person.select("person_id", "pc1"))


# ------------------------------------------------------------ feature tables

CHAPTERS = list("ABCDEFGHIJ")
_CHAPTER_SQL = ", ".join(f"""count(*) filter (code like '{c}%') as "{c}" """ for c in CHAPTERS)


def chapter_counts(t):
    events = registry.history_window(t.code, dates.day(BASE))
    return registry.code_counts(
        events.withColumn("chapter", registry.code_prefix(F.col("code"), 1)), "chapter"
    )


@query(
    "code_matrix",
    "person_id:i " + " ".join(f"{c}:i" for c in CHAPTERS),
    f"""select p.person_id, {', '.join(f'coalesce("{c}", 0) as "{c}"' for c in CHAPTERS)} from person p
        left join (select person_id, {_CHAPTER_SQL} from code where dt < date '{BASE}' group by person_id) c on c.person_id = p.person_id""",
)
def code_matrix(t):
    return registry.code_matrix(chapter_counts(t), t.person, "chapter", CHAPTERS)


def feature_sources(t, codes, least=None, leaking=()):
    """Covariates, history statistics, codes and other labs; `codes` are long counts by feature."""
    stats = history.days_since_last(sumstats(t), dates.day(START)).drop("split_set", "LAST_VAL_DATE")
    labs = history.lab_features(short_labs(t))
    lines = [F.struct(F.concat_ws("_", "lab", F.lit(s)).alias("feature"), F.col(s).alias("value")) for s in ("MEAN", "QUANT25", "QUANT75")]
    covs = t.person.select("person_id", recode.sex_binary(F.col("sex"), True).alias("sex"), "bmi", "pc1")
    return [
        Source("covariate", covs),
        Source("history", stats),
        Source("code", codes.withColumnsRenamed({"chapter": "feature", "n": "value"}), absent=0.0, least=least),
        Source("lab", labs.select("person_id", F.inline(F.array(*lines))), leaking=leaking),
    ]


def matrix(t, names=("sex", "bmi", "NO_HISTORY", "MEAN", "SD", "LAST_VAL_DIFF", *CHAPTERS, "L1_MEAN", "L5_QUANT75")):
    """The named features of all persons as columns; codes are 0 for a person without them."""
    rows = feature_store.store(t.pred, feature_sources(t, chapter_counts(t)), only=names)
    return feature_store.columns(t.pred, rows, {x: 0.0 if x in CHAPTERS else None for x in names}, needed=["K"])


@query(
    "feature_matrix",
    "person_id:i y:i split_set:f sex:i bmi:f NO_HISTORY:i MEAN:f SD:f LAST_VAL_DIFF:f K:i A:f J:f L1_MEAN:f L5_QUANT75:f",
    f"""with {CLEAN_CTES}, {STATS_CTE}, {LAB_LONG}, w as (select person_id, {_WIDE_SQL} from lf group by person_id),
      c as (select person_id, {_CHAPTER_SQL} from code where dt < date '{BASE}' group by person_id)
      select distinct p.person_id, p.y, p.split_set, case when q.sex = 'male' then 1 else 0 end as sex, q.bmi, s."NO_HISTORY", s."MEAN", s."SD",
        date_diff('day', s."LAST_VAL_DATE", date '{START}') as "LAST_VAL_DIFF", 0 as "K", coalesce(c."A", 0) as "A", coalesce(c."J", 0) as "J",
        w."L1_MEAN", w."L5_QUANT75"
      from pred p join person q on q.person_id = p.person_id left join stats s on s.person_id = p.person_id
      left join c on c.person_id = p.person_id left join w on w.person_id = p.person_id""",
)
def feature_matrix(t):
    return matrix(t, ("sex", "bmi", "NO_HISTORY", "MEAN", "SD", "LAST_VAL_DIFF", "A", "J", "L1_MEAN", "L5_QUANT75"))


#: The store's SQL: three-character codes with a sum of at least five, labs without the third, K07 added if nobody has it.
LEAKING, RARE, ADDED = ("L3",), 5, ("K07", "B11")
_STORED = ("NO_HISTORY", "MEAN", "SD", "SEQ_LEN", "LAST_VAL_DIFF")
_FEATURE_SQL = f"""{CLEAN_CTES}, {STATS_CTE}, {LAB_LONG},
  stats2 as (select *, date_diff('day', "LAST_VAL_DATE", date '{START}') as "LAST_VAL_DIFF" from stats),
  fs as (
    select person_id, 0 as o, 'covariate' as "group", unnest(['sex', 'bmi', 'pc1']) as feature, unnest([case when sex = 'male' then 1.0::double else 0 end, bmi, pc1]) as value from person
    union all select person_id, 1, 'history', unnest([{', '.join(f"'{x}'" for x in _STORED)}]), unnest([{', '.join(f'cast("{x}" as double)' for x in _STORED)}]) from stats2
    union all select person_id, 2, 'code', substr(code, 1, 3), cast(count(*) as double) from code where dt < date '{BASE}' group by person_id, substr(code, 1, 3)
    union all select person_id, 3, 'lab', lab || '_' || s, v from (select person_id, lab, unnest(['MEAN', 'QUANT25', 'QUANT75']) as s, unnest([m, a, b]) as v from lf)),
  rows as (select * from fs where value is not null and person_id in (select person_id from pred)),
  kept as (select o, "group", feature, count(*) as n_person, sum(value) as total, bool_and(value in (0, 1)) as is_binary, case when "group" = 'code' then 0.0 end as absent
    from rows group by all having not ("group" = 'code' and sum(value) < {RARE}) and not ("group" = 'lab' and split_part(feature, '_', 1) in ('L3'))),
  catalog as (select *, row_number() over (order by o, feature) - 1 as place from (
    select * from kept union all select 4, 'needed', f, 0, 0, true, 0 from (values ('K07'), ('B11')) v(f) where f not in (select feature from kept)))"""


def three_character_store(t):
    events = registry.history_window(t.code, dates.day(BASE))
    codes = registry.code_counts(events.withColumn("chapter", registry.code_prefix(F.col("code"), 3)), "chapter")
    sources = feature_sources(t, codes, RARE, LEAKING)
    stored = [Source(s.group, s.rows.select("person_id", *_STORED)) if s.group == "history" else s for s in sources]
    return feature_store.assembled(t.pred, stored, ADDED)


@query(
    "feature_catalog",
    "place:i group:s feature:s n_person:i total:f is_binary:s absent:f",
    f"with {_FEATURE_SQL} select * from catalog",
)
def feature_catalog(t):
    """Which features stay, with their statistics and places."""
    return three_character_store(t)[1]


@query(
    "feature_matrix_three",
    "person_id:i y:i split_set:f place:i feature:s value:f",
    f"""with {_FEATURE_SQL} select p.person_id, y, split_set, place, r.feature, value from pred p join rows r on r.person_id = p.person_id
        join catalog c on c."group" = r."group" and c.feature = r.feature""",
)
def feature_matrix_three(t):
    """The persons' vectors, entry by entry."""
    _, features, found = three_character_store(t)
    entries = F.explode(F.arrays_zip("places", "vals")).alias("e")
    rows = found.select("person_id", "y", "split_set", entries).select("person_id", "y", "split_set", F.col("e.places").alias("place"), F.col("e.vals").alias("value"))
    return rows.join(features.select("place", "feature"), "place")


@query(
    "join_left_features",
    "person_id:i y:i bmi:f n:i",
    "select p.person_id, y, bmi, n from pred p left join person q on q.person_id = p.person_id left join (select person_id, count(*) as n from lab group by person_id) l on l.person_id = p.person_id",
)
def join_left_features(t):
    counts = t.lab.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    return features.join_features(t.pred, [t.person.select("person_id", "bmi"), counts])


@query(
    "value_variance_tertile",
    "person_id:i variance:f n:i variance_group:s n_group:s",
    f"""with v as (select person_id, var_samp(value) as variance, count(*) as n from daily where value is not null and dt < date '{BASE}' group by person_id),
        c as (select quantile_cont(variance, 0.33) as vl, quantile_cont(variance, 0.67) as vh, quantile_cont(n, 0.33) as nl, quantile_cont(n, 0.67) as nh from v)
        select person_id, variance, n, case when variance <= vl then 'Low var' when variance >= vh then 'High var' when variance is not null then 'Mid var' end as variance_group,
          case when n < nl then 'Low N' when n > nh then 'High N' else 'Mid N' end as n_group from v, c""",
)
def value_variance_tertile(t):
    rows = cleaning.daily_last(t.lab).where(F.col("value").isNotNull() & (F.col("dt") < dates.day(BASE)))
    spread = rows.groupBy("person_id").agg(
        F.var_samp("value").alias("variance"), F.count(F.lit(1)).alias("n")
    )
    return features.variance_tertiles(spread)


SUBGROUP_CTES = f"""hist as (select * from clean where dt < date '{BASE}'),
v as (select person_id, var_samp(value) as variance, count(*) as n, max(dt) as last_dt, bool_or(abnorm_custom = 1) as ever from hist group by person_id),
c as (select quantile_cont(variance, 0.33) as vl, quantile_cont(variance, 0.67) as vh, quantile_cont(n, 0.33) as nl, quantile_cont(n, 0.67) as nh from v),
m as (select l.person_id, cast(floor(date_diff('day', birth_date, date '{BASE}') / cast(365.25 as double)) as integer) as age, v.*  exclude (person_id), vl, vh, nl, nh
  from pred l join person p on p.person_id = l.person_id left join v on v.person_id = l.person_id cross join c),
members as (
  select person_id, 'All' as filter from m
  union all select person_id, 'History' from m where n is not null
  union all select person_id, 'No history' from m where n is null
  union all select person_id, 'All normal | No history' from m where n is null or not coalesce(ever, false)
  union all select person_id, 'Last long ago | No history' from m where n is null or last_dt < date '1998-01-01'
  union all select person_id, 'Last long ago' from m where last_dt < date '1998-01-01'
  union all select person_id, case when variance <= vl then 'Low var' when variance >= vh then 'High var' else 'Mid var' end from m where variance is not null
  union all select person_id, case when n < nl then 'Low N' when n > nh then 'High N' else 'Mid N' end from m where n is not null
  union all select person_id, case when age < 40 then '30-40' when age < 50 then '40-50' when age < 60 then '50-60' else '60-70' end from m where age >= 30 and age <= 70)"""


def membership(t):
    aged = cohort.with_age(t.pred.select("person_id"), t.person, dates.day(BASE))
    hist = clean(t).where(F.col("dt") < dates.day(BASE))
    return features.subgroups(aged, hist, dates.day("1998-01-01"))


@query("subgroups", "person_id:i filter:s", f"with {CLEAN_CTES}, {SUBGROUP_CTES} select * from members")
def subgroups(t):
    return membership(t)


@query(
    "case_control_features",
    "person_id:i y:i n_icd:i n_lab:i rate:f rate_abnorm:i bmi:f",
    f"""with {CLEAN_CTES}, s as (select person_id, arg_max(value, dt) as rate, cast(bool_or(abnorm_custom = 1) as integer) as rate_abnorm
          from clean where dt < date '{BASE}' group by person_id)
        select d.person_id, y, n_icd, n_lab, rate, rate_abnorm, bmi from pred d join person p on p.person_id = d.person_id
        left join (select person_id, count(*) as n_icd from code where source <> 'PURCH' group by person_id) a on a.person_id = d.person_id
        left join (select person_id, count(*) as n_lab from lab group by person_id) b on b.person_id = d.person_id
        left join s on s.person_id = d.person_id""",
)
def case_control_features(t):
    return features.case_control_features(
        t.pred,
        {"n_icd": t.code.where(F.col("source") != "PURCH"), "n_lab": t.lab},
        {"rate": clean(t)},
        [t.person.select("person_id", "bmi")],
        dates.day(BASE),
    )
