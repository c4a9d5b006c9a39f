"""Joins, aggregations, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions import dates, recode
from labtrail.functions.texts import signed_bounds
from labtrail.operators import cleaning, extract, registry, tables
from labtrail.operators.ranking import quantiles
from labtrail.plans.cleaning import CLEAN_CTES
from labtrail.plans.cohorts import clean
from labtrail.plans.evaluation import COMPARISON, comparison_rows
from labtrail.plans.registry import BASE, END, START, query

# ---------------------------------------------------------------------- joins


@query(
    "join_inner_candidates",
    "rid:i person_id:i value:f",
    """select l.rid, l.person_id, l.value from lab l join (select person_id from lab where value > 155 group by person_id having count(*) = 1) c
       on c.person_id = l.person_id""",
)
def join_inner_candidates(t):
    single = (
        t.lab.where(F.col("value") > 155)
        .groupBy("person_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n = 1")
    )
    return t.lab.join(single, "person_id")


@query(
    "join_anti_composite",
    "rid:i person_id:i dt:s value:f",
    """select l.rid, l.person_id, l.dt, l.value from lab l where not exists (
         select 1 from lab b where b.value > 150 and b.person_id = l.person_id and b.dt = l.dt and b.value = l.value)""",
)
def join_anti_composite(t):
    bad = t.lab.where(F.col("value") > 150).select("person_id", "dt", "value")
    return t.lab.join(bad, ["person_id", "dt", "value"], "left_anti")


@query(
    "join_right_labels",
    "person_id:i y:i rid:i value:f",
    f"""select p.person_id, y, rid, value from (select * from lab where dt < date '1995-06-01') l right join pred p on p.person_id = l.person_id""",
)
def join_right_labels(t):
    old = t.lab.where(F.col("dt") < dates.day("1995-06-01")).select("rid", "person_id", "value")
    return old.join(t.pred, "person_id", "right")


FIVE_LABS = {"1-URGENT": "L1", "2-HIGH": "L2", "3-MEDIUM": "L3", "4-NOT SPECIFIED": "L4", "5-LOW": "L5"}


def _full_join_sql() -> str:
    """Full joins of the mean per person, one lab after the other."""
    parts = [f"(select person_id, avg(value) as v from lab where lab = '{x}' group by person_id) {n}" for x, n in FIVE_LABS.items()]
    names = list(FIVE_LABS.values())
    text = parts[0]
    for k in range(1, len(names)):
        known = ", ".join(f"{n}.person_id" for n in names[:k])
        text += f" full join {parts[k]} on {names[k]}.person_id = coalesce({known}, null)"
    everyone = ", ".join(f"{n}.person_id" for n in names)
    values = ", ".join(f'{n}.v as "{n}"' for n in names)
    return f"select coalesce({everyone}) as person_id, {values} from {text}"


@query("join_full_coalesce", "person_id:i L1:f L2:f L3:f L4:f L5:f", _full_join_sql())
def join_full_coalesce(t):
    # one pivot replaces the fold of full joins
    short = t.lab.withColumn("short", recode.lookup(F.col("lab"), FIVE_LABS))
    kept = short.where(F.col("short").isNotNull())
    return kept.groupBy("person_id").pivot("short", list(FIVE_LABS.values())).agg(F.avg("value"))


@query("join_semi", "rid:i person_id:i", "select rid, person_id from lab where person_id in (select person_id from pred where split_set = 2)")
def join_semi(t):
    return t.lab.join(t.pred.where("split_set = 2").select("person_id"), "person_id", "left_semi")


@query(
    "join_anti",
    "rid:i person_id:i",
    "select rid, person_id from lab where person_id not in (select person_id from pred where split_set = 0)",
)
def join_anti(t):
    return t.lab.join(t.pred.where("split_set = 0").select("person_id"), "person_id", "left_anti")


@query(
    "join_anti_before_date",
    "rid:i person_id:i",
    f"select distinct rid, person_id from lab where person_id not in (select person_id from code where dt < date '{BASE}' and starts_with(code, 'D1'))",
)
def join_anti_before_date(t):
    events = t.code.where(F.col("code").startswith("D1"))
    before = extract.any_before(events, dates.day(BASE))
    return t.lab.join(before, "person_id", "left_anti").select("rid", "person_id").distinct()


@query(
    "join_semi_before_date",
    "part:s person_id:i",
    f"""select 'prior' as part, person_id from pred where person_id in (select person_id from code where dt < date '{BASE}' and starts_with(code, 'D1'))
        union all select 'later', person_id from pred where person_id in (select person_id from code where dt >= date '{BASE}' and starts_with(code, 'D1'))""",
)
def join_semi_before_date(t):
    events = t.code.where(F.col("code").startswith("D1"))
    parts = {
        "prior": extract.any_before(events, dates.day(BASE)),
        "later": extract.any_from(events, dates.day(BASE)),
    }
    out = [
        t.pred.join(p, "person_id", "left_semi").withColumn("part", F.lit(n)) for n, p in parts.items()
    ]
    return out[0].unionByName(out[1])


# ------------------------------------------------------------- yearly results


def year_counts(t):
    """Cases and controls per year and definition, one row per year."""
    value, high = F.col("value"), F.col("value") >= 120
    rows = cleaning.daily_last(t.lab).where(value.isNotNull())
    per = rows.groupBy(F.year("dt").alias("year"), "person_id").agg(
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.count_if(high).alias("k")
    )
    return per.groupBy("year").agg(
        F.count_if(F.col("k") >= 1).alias("n_case"),
        F.count_if(F.col("k") < 1).alias("n_control"),
        F.count_if(F.col("k") >= 2).alias("n_case_90"),
        F.count_if(F.col("k") < 2).alias("n_control_90"),
        F.count_if(F.col("mean") >= 120).alias("n_mean_abnormal"),
        F.count_if(F.col("mean") < 120).alias("n_mean_normal"),
        F.count_if(F.col("low") >= 120).alias("n_min_abnormal"),
        F.count_if(F.col("low") < 120).alias("n_min_normal"),
    )


def code_years(t):
    events = t.code.where((F.year("dt") > 1995) & F.col("code").startswith("A0"))
    return (
        events.select(F.year("dt").alias("year"), "person_id")
        .distinct()
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n_case_icd"))
    )


def joined_years(t):
    counts = year_counts(t)
    strict = counts.select("year", "n_case_90", "n_control_90")
    loose = counts.drop("n_case_90", "n_control_90")
    return strict.join(loose, "year", "right").join(code_years(t), "year", "left")


_YEARS = """per as (select year(dt) as year, person_id, avg(value) as mean, min(value) as low, count(*) filter (value >= 120) as k from daily where value is not null group by all),
counts as (select year, count(*) filter (k >= 1) as n_case, count(*) filter (k < 1) as n_control, count(*) filter (k >= 2) as n_case_90, count(*) filter (k < 2) as n_control_90,
  count(*) filter (mean >= 120) as n_mean_abnormal, count(*) filter (mean < 120) as n_mean_normal, count(*) filter (low >= 120) as n_min_abnormal, count(*) filter (low < 120) as n_min_normal
  from per group by year),
icd as (select year(dt) as year, count(distinct person_id) as n_case_icd from code where year(dt) > 1995 and starts_with(code, 'A0') group by 1),
years as (select a.* exclude (n_case_90, n_control_90), b.n_case_90, b.n_control_90, n_case_icd from counts a
  left join (select year, n_case_90, n_control_90 from counts) b on b.year = a.year left join icd on icd.year = a.year),
status as (
  select year, 'Diagnosis (30 days)' as type, n_case, n_control from years union all select year, 'Diagnosis (90 days)', n_case_90, n_control_90 from years
  union all select year, 'Diagnosis (ICD)', n_case_icd, null from years union all select year, 'Mean abnormal', n_mean_abnormal, n_mean_normal from years
  union all select year, 'Min abnormal', n_min_abnormal, n_min_normal from years)"""
_YEAR_COLUMNS = "n_case:i n_control:i n_case_90:i n_control_90:i n_case_icd:i n_mean_abnormal:i n_mean_normal:i n_min_abnormal:i n_min_normal:i"


@query("join_year_counts", "year:i " + _YEAR_COLUMNS, f"with {_YEARS} select * from years")
def join_year_counts(t):
    return joined_years(t)


@query("pivot_status", "year:i type:s n_case:i n_control:i", f"with {_YEARS} select * from status")
def pivot_status(t):
    return tables.pivot_status(joined_years(t))


@query(
    "case_share",
    "year:i type:s share:f",
    f"with {_YEARS} select year, type, n_case / cast(n_case + n_control as double) as share from status",
)
def case_share(t):
    return tables.case_share(tables.pivot_status(joined_years(t)))


@query(
    "year_mean_gap",
    "mean_cases:f mean_gap:f",
    f"""with {_YEARS}, p as (select year, sum(n_case) filter (type = 'Diagnosis (90 days)') as a, sum(n_case) filter (type = 'Diagnosis (ICD)') as b
          from status where year >= 1997 group by year) select avg(a) as mean_cases, avg(a - b) as mean_gap from p""",
)
def year_mean_gap(t):
    return tables.year_mean_gap(
        tables.pivot_status(joined_years(t)), "Diagnosis (90 days)", "Diagnosis (ICD)", 1997
    )


# --------------------------------------------------------------- aggregations


@query("person_row_count", "n_persons:i n_rows:i", "select count(distinct person_id) as n_persons, count(*) as n_rows from lab")
def person_row_count(t):
    return tables.person_row_count(t.lab)


_CODES3 = "(select *, substr(code, 1, 3) as three from c2)"
_AGED_CODES = "c2 as (select c.*, floor(date_diff('day', birth_date, dt) / cast(365.25 as double)) as event_age from code c join person p on p.person_id = c.person_id)"


def aged_codes(t):
    births = t.person.select("person_id", "birth_date")
    age = dates.age_at(F.col("dt"), F.col("birth_date"))
    return (
        t.code.join(births, "person_id")
        .withColumn("event_age", age)
        .withColumn("three", registry.code_prefix(F.col("code"), 3))
        .drop("birth_date")
    )


_PREVALENCE = f"""prev as (select three, count(*) as n_entry, count(distinct person_id) as n_person, count(distinct person_id) / cast((select count(*) from person) as double) as share
  from {_CODES3} where event_age between 30 and 60 group by three)"""


@query(
    "code_prevalence",
    "three:s n_entry:i n_person:i share:f",
    f"with {_AGED_CODES}, {_PREVALENCE} select * from prev",
)
def code_prevalence(t):
    return registry.prevalence(aged_codes(t), t.person, "three", 30, 60)


@query(
    "code_matrix_three",
    "person_id:i three:s n:i",
    f"""with {_AGED_CODES}, {_PREVALENCE.replace('30 and 60', '18 and 70')}, k as (select three from prev where share >= 0.01),
        c as (select person_id, three, count(*) as n from {_CODES3} where dt < date '{BASE}' group by all)
        select p.person_id, k.three, coalesce(n, 0) as n from person p cross join k left join c on c.person_id = p.person_id and c.three = k.three""",
)
def code_matrix_three(t):
    """The matrix of all codes that a hundredth of the persons have, as rows: its columns depend on the data."""
    codes = aged_codes(t)
    wide, chosen = registry.frequent_code_matrix(codes, registry.history_window(codes, dates.day(BASE)), t.person, "three", 0.01)
    entries = F.array(*[F.struct(F.lit(c).alias("three"), F.col(f"`{c}`").alias("n")) for c in chosen])
    return wide.select("person_id", F.inline(entries)) if chosen else wide.select("person_id", F.lit("").alias("three"), F.lit(0).alias("n")).limit(0)


@query(
    "code_min_pct",
    "part:s rid:i line:i three:s",
    f"""with {_AGED_CODES}, {_PREVALENCE}, k as (select * from {_CODES3} where three in (select three from prev where share >= 0.06))
        select 'all' as part, rid, line, three from k union all select 'aged', rid, line, three from k where event_age between 30 and 60""",
)
def code_min_pct(t):
    rows = aged_codes(t)
    parts = [
        registry.frequent_events(rows, t.person, "three", 0.06, 30, 60, limit).withColumn("part", F.lit(n))
        for n, limit in (("all", False), ("aged", True))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "code_counts_two_cohorts",
    "three:s n_first:i n_second:i",
    """with c as (select person_id, substr(code, 1, 3) as three, cohort from code join person using (person_id))
       select three, count(distinct person_id) filter (cohort = 'HELSINKI BIOBANK') as n_first, count(distinct person_id) filter (cohort = 'AURIA BIOBANK') as n_second
       from c group by three having n_first > 4 and n_second > 4""",
)
def code_counts_two_cohorts(t):
    events = t.code.withColumn("three", registry.code_prefix(F.col("code"), 3))
    return registry.counts_in_two_cohorts(
        events,
        t.person.where("cohort = 'HELSINKI BIOBANK'"),
        t.person.where("cohort = 'AURIA BIOBANK'"),
        "three",
    )


@query(
    "value_counts",
    "value:s n:i share:f",
    "select flag as value, count(*) as n, count(*) / cast((select count(*) from lab) as double) as share from lab group by flag",
)
def value_counts(t):
    return tables.value_counts(t.lab, "flag").withColumnRenamed("flag", "value")


@query(
    "sorted_counts",
    "code:s n:i place:i",
    """select code, n, row_number() over (order by n desc, code) as place from (select substr(code, 1, 1) as code, count(*) as n from code group by 1)""",
)
def sorted_counts(t):
    return ranked_codes(t, 1)


def ranked_codes(t, letters):
    counts = t.code.groupBy(registry.code_prefix(F.col("code"), letters).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return tables.ranked_rows(counts, [F.desc("n"), F.asc_nulls_last("code")])


@query(
    "sorted_counts_three",
    "code:s n:i place:i",
    """select code, n, row_number() over (order by n desc, code) as place from (select substr(code, 1, 3) as code, count(*) as n from code group by 1)""",
)
def sorted_counts_three(t):
    return ranked_codes(t, 3)


@query(
    "top_features",
    "feature:s importance:i",
    "select substr(code, 1, 3) as feature, count(*) as importance from code group by 1 order by importance desc, feature limit 10",
)
def top_features(t):
    counts = t.code.groupBy(registry.code_prefix(F.col("code"), 3).alias("feature")).agg(
        F.count(F.lit(1)).alias("importance")
    )
    return tables.top_rows(counts, [F.desc("importance"), F.col("feature")])


@query(
    "last_per_code",
    "lab:s n:i unit:s",
    """select lab, n, unit from (select *, row_number() over (partition by lab order by n desc, unit desc nulls last) as k from (
         select lab, coalesce(unit, 'NA') as unit, count(*) as n from lab group by all)) where k = 1""",
)
def last_per_code(t):
    counts = t.lab.groupBy("lab", F.coalesce("unit", F.lit("NA")).alias("unit")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return tables.last_per_code(counts, "lab", "n", "unit")


@query(
    "first_code_date",
    "person_id:i code:s dt:s",
    "select person_id, code, min(dt) as dt from code where regexp_matches(code, '^A[0-2]') group by all",
)
def first_code_date(t):
    return registry.first_code_date(t.code, "^A[0-2]")


@query(
    "flag_mean_median",
    "flag:s mean:f median:f",
    """select case flag when 'A' then 'H' when 'AA' then 'HH' else flag end as flag, avg(value) as mean, median(value) as median
       from labx where value is not null and unit = 'umol/l' and flag is not null group by 1""",
)
def flag_mean_median(t):
    flag = recode.plain_flag(F.col("flag"), doubled=True)
    rows = t.labx.where(F.col("value").isNotNull() & (F.col("unit") == "umol/l")).withColumn("flag", flag)
    rows = rows.where(F.col("flag").isNotNull())
    return quantiles(rows, ["flag"], "value", {"median": 0.5}, mean="mean")


@query(
    "any_abnormal",
    "person_id:i ever:i",
    f"with {CLEAN_CTES} select person_id, cast(bool_or(abnorm_custom = 1) as integer) as ever from clean where dt < date '{BASE}' group by person_id",
)
def any_abnormal(t):
    rows = clean(t).where(F.col("dt") < dates.day(BASE))
    return rows.groupBy("person_id").agg(F.bool_or(F.col("abnorm_custom") == 1).alias("ever"))


@query(
    "row_sum_codes",
    "person_id:i n_codes:i",
    """select p.person_id, nullif(n, 0) as n_codes from person p left join (select person_id, count(*) as n from code where starts_with(code, 'A0') group by 1) c
       on c.person_id = p.person_id""",
)
def row_sum_codes(t):
    counts = registry.code_counts(t.code.where(F.col("code").startswith("A0")), "code")
    return registry.person_code_totals(counts, t.person)


@query("rows_per_person", "person_id:i n:i", "select person_id, count(*) as n from lab group by person_id")
def rows_per_person(t):
    return t.lab.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "describe_counts",
    "n:i mean:f sd:f low:f q1:f median:f q3:f high:f",
    """select count(*) as n, avg(k) as mean, stddev_samp(k) as sd, min(k) as low, quantile_cont(k, 0.25) as q1, median(k) as median, quantile_cont(k, 0.75) as q3, max(k) as high
       from (select cast(count(*) as double) as k from lab group by person_id)""",
)
def describe_counts(t):
    per = t.lab.groupBy("person_id").agg(F.count(F.lit(1)).cast("double").alias("k"))
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    cuts = quantiles(per, [], "k", points).select(F.struct(*points).alias("c")).scalar()
    stats = per.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("k").alias("mean"),
        F.stddev_samp("k").alias("sd"),
        F.min("k").alias("low"),
        F.max("k").alias("high"),
    )
    return stats.withColumn("_c", cuts).select("*", "_c.*")


_CC = "labelled as (select d.*, bmi, pc1, cohort from pred d join person p on p.person_id = d.person_id)"


def labelled(t):
    return t.pred.join(t.person.select("person_id", "bmi", "pc1", "cohort"), "person_id")


_STATS3 = (
    "n_total:i n_missing:i all_mean:f all_sd:f n_cases:i n_missing_cases:i cases_mean:f cases_sd:f "
    "n_controls:i n_missing_controls:i controls_mean:f controls_sd:f"
)


@query(
    "case_control_continuous",
    "split_set:f variable:s outcome:s " + _STATS3,
    f"""with {_CC}, l as (select split_set, variable, v, outcome, label from (
          select split_set, unnest(['BMI', 'PC1']) as variable, unnest([bmi, pc1]) as v, y, p1 from labelled) a,
          lateral (select unnest(['y', 'high']) as outcome, unnest([a.y, cast(a.p1 > 0.5 as integer)]) as label))
        select split_set, variable, outcome, count(*) as n_total, count(*) filter (v is null) as n_missing, avg(v) as all_mean, stddev_samp(v) as all_sd,
          count(*) filter (label = 1) as n_cases, count(*) filter (label = 1 and v is null) as n_missing_cases, avg(v) filter (label = 1) as cases_mean, stddev_samp(v) filter (label = 1) as cases_sd,
          count(*) filter (label = 0) as n_controls, count(*) filter (label = 0 and v is null) as n_missing_controls, avg(v) filter (label = 0) as controls_mean, stddev_samp(v) filter (label = 0) as controls_sd
        from l group by all""",
)
def case_control_continuous(t):
    rows = labelled(t).withColumn("high", (F.col("p1") > 0.5).cast("int"))
    return tables.case_control_continuous(
        rows, ["split_set"], {"BMI": "bmi", "PC1": "pc1"}, {"y": "y", "high": "high"}
    )


_BINARY = f"""{_CC}, b as (select split_set, condition, hit, y from (select *, unnest(['heavy', 'no PC', 'A0 before']) as condition,
    unnest([coalesce(bmi >= 30, false), pc1 is null, person_id in (select person_id from code where starts_with(code, 'A0') and dt < date '{BASE}')]) as hit from labelled)),
  cc as (select split_set, condition, 'y' as outcome, count(*) filter (y = 1) as n_cases, count(*) filter (y = 0) as n_controls,
    count(*) filter (y = 1 and hit) as cases_prior, count(*) filter (y = 0 and hit) as controls_prior from b group by all)"""
_BINARY_SPEC = "split_set:f condition:s outcome:s n_cases:i n_controls:i cases_prior:i controls_prior:i"


def binary_table(t):
    prior = extract.any_before(t.code.where(F.col("code").startswith("A0")), dates.day(BASE))
    rows = labelled(t).join(prior.withColumn("prior", F.lit(True)), "person_id", "left")
    conditions = {
        "heavy": F.col("bmi") >= 30,
        "no PC": F.col("pc1").isNull(),
        "A0 before": F.col("prior"),
    }
    return tables.case_control_binary(rows, ["split_set"], conditions, {"y": "y"})


@query("case_control_binary", _BINARY_SPEC, f"with {_BINARY} select * from cc")
def case_control_binary(t):
    return binary_table(t)


@query(
    "suppress_small",
    _BINARY_SPEC,
    f"""with {_BINARY} select * replace (case when n_cases <= 5 then 0 else n_cases end as n_cases, case when cases_prior <= 5 then 0 else cases_prior end as cases_prior,
          case when controls_prior <= 5 then 0 else controls_prior end as controls_prior) from cc""",
)
def suppress_small(t):
    columns = ("n_cases", "cases_prior", "controls_prior")
    return binary_table(t).withColumns({c: recode.small_to_zero(F.col(c)) for c in columns})


@query(
    "mean_sd_across_labs",
    "lab:s model_1:s predictors:s est:f est_mean:f est_sd:f",
    f"""with {COMPARISON} select lab, model_1, predictors, est, avg(est) over (partition by predictors) as est_mean, stddev_samp(est) over (partition by predictors) as est_sd
        from cmp where model_1 = 'baseline'""",
)
def mean_sd_across_labs(t):
    rows = comparison_rows(t).where(F.col("model_1") == "baseline")
    return tables.mean_sd_across(rows, ["predictors"], "est")


# ------------------------------------------------------ set operations, reshapes


@query(
    "union_two_series",
    "person_id:i dt:s value:f",
    "select person_id, dt, value from lab where lab = '1-URGENT' union all select person_id, dt, value from covariate",
)
def union_two_series(t):
    first = t.lab.where("lab = '1-URGENT'").select("person_id", "dt", "value")
    return first.unionByName(t.covariate.select("person_id", "dt", "value"))


@query(
    "union_distinct",
    "person_id:i dt:s",
    "select person_id, dt from lab union select person_id, dt from code",
)
def union_distinct(t):
    return t.lab.select("person_id", "dt").unionByName(t.code.select("person_id", "dt")).distinct()


@query(
    "minus_ids",
    "person_id:i",
    f"select person_id from lab except select person_id from lab where dt >= date '{START}' and dt <= date '{END}'",
)
def minus_ids(t):
    window = t.lab.where(F.col("dt").between(dates.day(START), dates.day(END)))
    return t.lab.select("person_id").distinct().join(window.select("person_id"), "person_id", "left_anti")


@query(
    "unpivot_codes",
    "person_id:i dt:s source:s code:s",
    """select distinct person_id, dt, source, code from (
         select person_id, dt, source, code1 as code from register union all select person_id, dt, source, code2 from register)
       where code is not null and regexp_matches(code, '^[A-Z][0-9]')""",
)
def unpivot_codes(t):
    rows = t.register.select("person_id", "dt", "source", "code1", "code2")
    return registry.unpivot_codes(rows, ["person_id", "dt", "source"], ["code1", "code2"])


@query(
    "unpivot_register",
    "person_id:i event_age:i dt:s code:s",
    """select person_id, event_age, dt, cast(rid % 90 as varchar) as code from register
       where source = 'OPER_IN' and rid % 11 <> 0 and rid % 90 < 52""",
)
def unpivot_register(t):
    text = F.when(F.col("rid") % 11 == 0, "unknown").otherwise((F.col("rid") % 90).cast("string"))
    rows = t.register.where("source = 'OPER_IN'").withColumn("treatment", text)
    return registry.unpivot_register(rows, "treatment")


@query(
    "pivot_box_stats",
    "lab:s level:s y0:f y25:f y50:f y75:f y100:f",
    """select lab, case flag when 'N' then 'Normal' when 'H' then 'High' when 'L' then 'Low' end as level, min(value) as y0, quantile_cont(value, 0.25) as y25,
         median(value) as y50, quantile_cont(value, 0.75) as y75, max(value) as y100 from lab where flag is not null and value is not null group by all""",
)
def pivot_box_stats(t):
    rows = t.lab.where(F.col("flag").isNotNull() & F.col("value").isNotNull())
    points = {"y0": 0.0, "y25": 0.25, "y50": 0.5, "y75": 0.75, "y100": 1.0}
    found = quantiles(rows, ["lab", "flag"], "value", points)
    long = found.unpivot(["lab", "flag"], list(points), "stat", "value")
    wide = tables.long_to_columns(long, ["lab", "flag"], "stat", list(points), "value")
    names = {"N": "Normal", "H": "High", "L": "Low"}
    return wide.withColumn("level", recode.lookup(F.col("flag"), names))


@query(
    "unpivot_goals",
    "age_group:s goal:s pct:f",
    """with b as (select case when event_age < 30 then 'under' when event_age < 40 then '30-40' when event_age < 50 then '40-50' when event_age < 60 then '50-60' else '60-70' end as age_group,
              round(avg(cast(value < 60 as integer)) * 100, 1) as low, round(avg(cast(value > 120 as integer)) * 100, 1) as high from lab where value is not null group by 1)
       select age_group, 'low' as goal, low as pct from b where age_group <> 'under' union all select age_group, 'high', high from b where age_group <> 'under'""",
)
def unpivot_goals(t):
    age = F.col("event_age")
    group = F.when(age < 30, "under").when(age < 40, "30-40").when(age < 50, "40-50").when(age < 60, "50-60").otherwise("60-70")

    def percent(test):
        return F.concat(F.round(F.avg(test.cast("int")) * 100, 1).cast("string"), F.lit("%"))

    table = (
        t.lab.where(F.col("value").isNotNull())
        .groupBy(group.alias("age_group"))
        .agg(
            percent(F.col("value") < 60).alias("low"),
            percent(F.col("value") > 120).alias("high"),
            percent(F.col("value") > 150).alias("other"),
        )
    )
    return tables.unpivot_goals(
        table, "age_group", ["30-40", "40-50", "50-60", "60-70"], ["low", "high"]
    )


@query(
    "stack_labs",
    "lab:s flag:s n:i extra:i",
    """select 'urgent' as lab, flag, count(*) as n, null as extra from lab where lab = '1-URGENT' group by flag
       union all select 'high', flag, count(*), count(value) from lab where lab = '2-HIGH' group by flag""",
)
def stack_labs(t):
    first = t.lab.where("lab = '1-URGENT'").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    second = t.lab.where("lab = '2-HIGH'").groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("extra")
    )
    return tables.stack_labs({"urgent": first, "high": second})


@query(
    "fallback_rows",
    "lab:s model_1:s predictors:s est:f low:f high:f",
    f"""with {COMPARISON}, c as (select lab, model_1, predictors, est, case when est < 0 then est + 0.05 else est - 0.05 end as low, case when est < 0 then est - 0.05 else est + 0.05 end as high from cmp)
        select * from c union select lab, model_1, n, est, low, high from c, (values ('all data + PGS'), ('maxim')) v(n)
        where model_1 = 'baseline' and predictors = 'all data' and (lab, n) not in (select (lab, predictors) from c)""",
)
def fallback_rows(t):
    low, high = signed_bounds(F.col("est"), F.col("est") - 0.05, F.col("est") + 0.05)
    rows = comparison_rows(t).select(
        "lab", "model_1", "predictors", "est", low.alias("low"), high.alias("high")
    )
    return tables.fallback_rows(rows, ["all data + PGS", "maxim"])


@query(
    "stack_metrics",
    "lab:s type:s value:f low:f high:f",
    """with s as (select lab, avg(value) as auc, min(value) as auc_low, max(value) as auc_high, avg(value) / 2 as avg_prec, min(value) / 2 as avg_prec_low, max(value) / 2 as avg_prec_high
                  from lab group by lab)
       select lab, 'AUC' as type, auc as value, auc_low as low, auc_high as high from s union all select lab, 'Average Precision', avg_prec, avg_prec_low, avg_prec_high from s""",
)
def stack_metrics(t):
    wide = t.lab.groupBy("lab").agg(
        F.avg("value").alias("auc"), F.min("value").alias("auc_low"), F.max("value").alias("auc_high")
    )
    halves = {c.replace("auc", "avg_prec"): F.col(c) / 2 for c in ("auc", "auc_low", "auc_high")}
    return tables.stack_metrics(wide.withColumns(halves), ["lab"])
