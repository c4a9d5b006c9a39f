"""Scalar functions and abnormality thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions import dates, recode, texts, thresholds, units
from labtrail.operators import extract, registry
from labtrail.plans.registry import START, query, u_sql
from labtrail.functions.uniform import uniform

_MG = "value / cast(88.4 as double)"


def _egfr_sql(max_k: str = "0.9") -> str:
    def branch(k, alpha, top, factor):
        return (
            f"142 * pow(least({_MG} / cast({k} as double), 1), {alpha}) * "
            f"pow(greatest({_MG} / cast({top} as double), 1), -1.2) * pow(0.9938, event_age){factor}"
        )

    return (
        f"case when value is null then null when sex = 'male' then {branch('0.9', -0.302, '0.9', '')} "
        f"else {branch('0.7', -0.241, max_k, ' * 1.012')} end"
    )


EGFR_SQL = _egfr_sql()


@query(
    "egfr_2021",
    "rid:i egfr:f published:f",
    f"select rid, {EGFR_SQL} as egfr, {_egfr_sql('0.7')} as published from lab",
)
def egfr_2021(t):
    args = F.col("value"), F.col("sex"), F.col("event_age")
    return t.lab.select(
        "rid",
        units.egfr_2021(*args).alias("egfr"),
        units.egfr_2021(*args, female_max_k=0.7).alias("published"),
    )


@query(
    "cystatin_2012",
    "rid:i egfr:f",
    """select rid, case when c is not null then
         133 * pow(least(c / cast(0.8 as double), 1), -0.499) * pow(greatest(c / cast(0.8 as double), 1), -1.328)
         * pow(0.996, event_age) * case when sex = 'male' then 1 else 0.932 end end as egfr
       from (select *, value / 100 as c from lab)""",
)
def cystatin_2012(t):
    return t.lab.select(
        "rid",
        units.cystatin_2012(F.col("value") / 100, F.col("sex"), F.col("event_age")).alias("egfr"),
    )


@query(
    "hba1c_units",
    "rid:i value:f unit:s",
    """select rid, round(case when unit = 'umol/l' then 10.93 * (value / 10) - 23.5 else value end) as value, 'mmol/mol' as unit
       from lab""",
)
def hba1c_units(t):
    percent = F.col("unit") == "umol/l"
    rows = t.lab.select(
        "rid",
        F.when(percent, F.col("value") / 10).otherwise(F.col("value")).alias("value"),
        F.when(percent, "%").otherwise("mmol/mol").alias("unit"),
    )
    return rows.withColumn("value", units.hba1c_mmol(F.col("value"), F.col("unit"))).withColumn(
        "unit", F.lit("mmol/mol")
    )


@query("main_unit", "rid:i value:f unit:s", "select * from lab where unit = 'umol/l'")
def main_unit(t):
    return extract.main_unit(t.lab, "umol/l")


DUMMIES = {"L": 45.0, "N": 80.0, "H": -1, "LL": 20.0, "HH": 300.0}


@query(
    "fill_by_flag",
    "rid:i value:f unit:s flag:s",
    """select rid, v as value, u as unit, flag from (
         select rid, flag,
                case when value is not null then value when flag = 'L' then 45 when flag = 'N' then 80
                     when flag = 'LL' then 20 when flag = 'HH' then 300 end as v,
                case when value is not null then unit when flag in ('L', 'N') then 'umol/l' when flag = 'H' then null else unit end as u
         from labx) where v is not null""",
)
def fill_by_flag(t):
    value, flag, unit = F.col("value"), F.col("flag"), F.col("unit")
    filled = t.labx.select(
        "rid",
        units.filled_value(value, flag, DUMMIES).alias("value"),
        units.filled_unit(value, flag, unit, DUMMIES, "umol/l").alias("unit"),
        "flag",
    )
    return filled.where(F.col("value").isNotNull())


# key -> (lab, choice, scale of the fixture value, SQL rule on v and a)
_RULES = {
    "abnormal_egfr_strict": ("egfr", "KDIGO-strict", 1, "case when v < 60 then 1 else 0 end"),
    "abnormal_egfr_unknown_choice": ("krea", "something", 1, "case when v < 60 then 1 else 0 end"),
    "abnormal_egfr_soft": ("egfr", "KDIGO-soft", 1, "case when v < 60 then 1 when v <= 65 and v >= 60 then 0.5 else 0 end"),
    "abnormal_egfr_soft2": ("egfr", "KDIGO-soft2", 1, "case when v < 60 then 1 when v <= 70 and v >= 60 then 0.5 else 0 end"),
    "abnormal_egfr_age_full": (
        "egfr",
        "herold-full",
        1,
        """case when a < 40 and v < 60 then 1 when a >= 30 and a < 40 and v < 75 then 1 when a >= 40 and a < 50 and v < 70 then 1
           when a >= 50 and a < 60 and v < 60 then 1 when a >= 60 and a < 70 and v < 50 then 1
           when a >= 70 and a < 80 and v < 40 then 1 when a >= 80 and v < 35 then 1 else 0 end""",
    ),
    "abnormal_egfr_age_part": (
        "egfr",
        "herold-part",
        1,
        "case when floor(a) < 60 and v < 60 then 1 when floor(a) >= 60 and v < 50 then 1 else 0 end",
    ),
    "abnormal_cystatin": ("cystc", "", 0.01, "case when v > 1 and a <= 50 then 1 when v > 1.2 then 1 when v <= 1.2 then 0 end"),
    "abnormal_leuk": ("leuk", "", 0.1, "case when v < 3.4 then -1 when v > 8.2 then 1 else 0 end"),
    "abnormal_tsh_multi": ("tsh", "multi", 0.05, "case when v >= 4 then 1 when v < 0.4 then -1 else 0 end"),
    "abnormal_tsh_simple": ("tsh", "simple", 0.05, "case when v > 4 then 1 else 0 end"),
    "abnormal_tri": ("tri", "", 0.05, "case when v > 2 then 1 else 0 end"),
    "abnormal_uacr": (
        "uacr",
        "",
        2,
        "case when v < 3 then 0 when v > 3 and v <= 30 then 1 when v > 30 and v <= 220 then 2 else 3 end",
    ),
    "abnormal_hba1c_soft": ("hba1c", "soft", 1, "case when v > 42 then 1 when v <= 42 then 0 end"),
    "abnormal_hba1c_strong": ("hba1c", "strong", 1, "case when v > 47 then 1 when v <= 47 then 0 end"),
    "abnormal_gluc": ("fgluc", "", 0.1, "case when v >= 7 then 1 when v < 4 then -1 else 0 end"),
    "abnormal_ldl": ("ldl", "", 0.05, "case when v < 4 then 0 else 1 end"),
    "abnormal_t4": ("t4", "", 0.25, "case when v > 23 then 1 when v <= 9 then -1 else 0 end"),
    "abnormal_t3": ("t3", "", 0.1, "case when v > 6.3 then 1 else 0 end"),
    "abnormal_ana": ("ana", "", 5, "case when v > 400 then 1 else 0 end"),
    "abnormal_alat": ("alat", "", 1, "case when v > 45 then 1 else 0 end"),
    "abnormal_asat": ("asat", "", 1, "case when v > 35 then 1 else 0 end"),
}


def _threshold_query(key, lab, choice, scale, rule):
    # kidney and age-dependent tests use the value as it is, others start at 0
    shift = 0 if lab in ("egfr", "krea", "hba1c", "cystc") else 40
    sql = f"""select rid, {rule} as abnorm_custom from (
      select rid, (value - {shift}) * cast({scale} as double) as v, event_age + 10 as a from lab)"""

    @query(key, "rid:i abnorm_custom:f", sql)
    def build(t):
        rows = t.lab.select(
            "rid",
            ((F.col("value") - shift) * F.lit(float(scale))).alias("value"),
            (F.col("event_age") + 10).alias("event_age"),
        )
        return rows.select("rid", thresholds.abnormal(lab, choice).alias("abnorm_custom"))

    return build


for _key, (_lab, _choice, _scale, _rule) in _RULES.items():
    _threshold_query(_key, _lab, _choice, _scale, _rule)


@query(
    "age_at",
    "person_id:i age:f",
    f"""select person_id, floor(date_diff('day', birth_date, date '{START}') / cast(365.25 as double)) as age from person""",
)
def age_at(t):
    return t.person.select(
        "person_id", dates.age_at(dates.day(START), F.col("birth_date")).alias("age")
    )


@query(
    "parse_dates",
    "rid:i parsed:s",
    "select rid, case when rid % 3 = 2 then null else dt end as parsed from lab",
)
def parse_dates(t):
    text = (
        F.when(F.col("rid") % 3 == 0, F.date_format("dt", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("rid") % 3 == 1, F.date_format("dt", "yyyy-MM-dd"))
        .otherwise(F.date_format("dt", "dd/MM/yyyy"))
    )
    return t.lab.select("rid", dates.parse_date(text).alias("parsed"))


@query(
    "years_between",
    "rid:i years:f",
    f"select rid, abs(date_diff('day', date '{START}', dt)) / cast(365.25 as double) as years from lab",
)
def years_between(t):
    return t.lab.select(
        "rid", dates.years_between(F.col("dt"), dates.day(START)).alias("years")
    )


@query(
    "months_back",
    "rid:i base:s",
    "select rid, cast(dt - interval 3 month as date) as base from lab",
)
def months_back(t):
    return t.lab.select("rid", dates.months_back(F.col("dt"), 3).alias("base"))


@query(
    "date_plus_age",
    "person_id:i dated:s",
    f"""select person_id, case when bmi is null then date '{START}' - 365
          else birth_date + cast(round(bmi * cast(365.25 as double)) as integer) end as dated from person""",
)
def date_plus_age(t):
    return t.person.select(
        "person_id",
        dates.date_at_age(F.col("birth_date"), F.col("bmi"), dates.day(START)).alias("dated"),
    )


SMOKE_SQL = """case rid % 7 when 0 then 'NO' when 1 then 'NEVER' when 2 then 'PASSIVE' when 3 then 'FORMER'
                 when 4 then 'EVER' when 5 then 'CURRENT' else 'UNKNOWN' end"""
SMOKE_NAMES = ["NO", "NEVER", "PASSIVE", "FORMER", "EVER", "CURRENT", "UNKNOWN"]


@query(
    "smoke_recode",
    "rid:i smoke:i",
    f"""select rid, case when s in ('NO', 'NEVER', 'PASSIVE') then 0 when s in ('FORMER', 'EVER') then 1 when s = 'CURRENT' then 2 end as smoke
        from (select rid, {SMOKE_SQL} as s from covariate)""",
)
def smoke_recode(t):
    status = recode.lookup(F.col("rid") % 7, dict(enumerate(SMOKE_NAMES)))
    return t.covariate.select("rid", recode.smoking_status(status).alias("smoke"))


@query(
    "edu_binary",
    "rid:i edu:i",
    "select rid, case when rid % 9 <= 4 then 0 else 1 end as edu from covariate",
)
def edu_binary(t):
    code = F.concat((F.col("rid") % 9).cast("string"), F.lit("12"))
    return t.covariate.select(
        "rid", recode.education_binary(recode.education_level(code)).alias("edu")
    )


@query(
    "starts_with",
    "person_id:i dt:s code:s",
    "select person_id, dt, code from code where starts_with(code, 'A1')",
)
def starts_with(t):
    return t.code.where(F.col("code").startswith("A1"))


@query(
    "mean_sd_text",
    "lab:s text:s share:s",
    """select lab, concat(cast(round(avg(value), 2) as varchar), ' ± ', cast(round(stddev_samp(value), 2) as varchar), ' (',
          cast(round(count(*) filter (value is null) / cast(count(*) as double) * 100, 2) as varchar), '%)') as text,
        concat(cast(round(count(*) filter (flag = 'H') / cast(count(*) as double) * 100, 1) as varchar), '% (N=',
          cast(count(*) filter (flag = 'H') as varchar), ')') as share
       from lab group by lab""",
)
def mean_sd_text(t):
    stats = t.lab.groupBy("lab").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("flag") == "H").alias("high"),
    )
    return stats.select(
        "lab",
        texts.mean_sd_text(F.col("mean"), F.col("sd"), F.col("missing"), F.col("n")).alias("text"),
        texts.share_text(F.col("high"), F.col("n")).alias("share"),
    )


@query(
    "pretty_count",
    "rid:i small:s large:s",
    """select o_orderkey as rid,
        case when p >= 1000 then concat(cast(cast(round_even(p / cast(1000 as double), 0) as bigint) as varchar), 'K') else cast(p as varchar) end as small,
        case when q >= 1000000 then concat(cast(round(q / cast(1000000 as double), 2) as varchar), 'M')
             when q >= 1000 then concat(cast(cast(round_even(q / cast(1000 as double), 0) as bigint) as varchar), 'K') else cast(q as varchar) end as large
       from (select o_orderkey, cast(floor(o_totalprice) as bigint) % 3000 as p, cast(floor(o_totalprice) as bigint) * 37 as q from orders)""",
)
def pretty_count(t):
    price = F.floor("o_totalprice")
    return t.raw("orders").select(
        F.col("o_orderkey").alias("rid"),
        texts.pretty_count(price % 3000).alias("small"),
        texts.pretty_count(price * 37).alias("large"),
    )


@query(
    "feature_labels",
    "feature:s label:s n:i",
    """with f as (
         select concat(substr(lab, 1, 1), '_', s) as feature, lab, s, '' as p, count(*) as n from lab, (values ('MEAN'), ('QUANT25')) v(s) group by all
         union all select concat(p, s), null, s, p, count(*) from lab, (values ('ABS_ENERG'), ('IDX_QUANT_100'), ('QUANT_25')) v(s),
            (values (''), ('S_')) w(p) group by all
         union all select 'EVENT_AGE', null, null, null, count(*) from lab)
       select feature, n, case
         when lab is not null and s = 'MEAN' then concat('Mean - ', lab, ' ', ' in serum')
         when lab is not null then concat('25% Quant - ', lab, ' ', ' in serum')
         when s = 'ABS_ENERG' then concat('Absolute energy - ', case when p = 'S_' then 'Cystatin C' else 'eGFR' end)
         when s = 'IDX_QUANT_100' then concat('Last value - ', case when p = 'S_' then 'Cystatin C' else 'eGFR' end)
         when s = 'QUANT_25' then concat('25% Quant - ', case when p = 'S_' then 'Cystatin C' else 'eGFR' end)
         else 'Age' end as label from f""",
)
def feature_labels(t):
    digit = F.substring("lab", 1, 1)
    names = F.array(
        F.concat(digit, F.lit("_MEAN")),
        F.concat(digit, F.lit("_QUANT25")),
        *[F.lit(p + s) for p in ("", "S_") for s in ("ABS_ENERG", "IDX_QUANT_100", "QUANT_25")],
        F.lit("EVENT_AGE"),
    )
    features = (
        t.lab.select(F.explode(names).alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    concepts = t.lab.groupBy("lab").agg(F.count(F.lit(1))).select(
        digit.alias("concept_id"),
        F.concat("lab", F.lit(" [Mass/volume] in serum")).alias("concept_name"),
    )
    return texts.feature_labels(features, concepts, "egfr", "cystc")


_MODELS = [
    "lr_logloss_0_base",
    "xgb_mlogloss_1_clinpheno",
    "xgb_logloss_3_registry",
    "xgb_mlogloss_3_otherlabs",
    "xgb_logloss_2_sumstats",
    "xgb_logloss_4_all",
    "xgb_logloss_5_all_pgs",
    "maxim",
    "other",
]
_LABS = ["eGFR", "HbA1c", "TSH", "LDL"]


@query(
    "model_name_recode",
    "person_id:i predictors:s",
    """with m as (select person_id, replace(['lr_logloss_0_base','xgb_mlogloss_1_clinpheno','xgb_logloss_3_registry','xgb_mlogloss_3_otherlabs',
            'xgb_logloss_2_sumstats','xgb_logloss_4_all','xgb_logloss_5_all_pgs','maxim','other'][person_id % 9 + 1], 'mlogloss', 'logloss') as model,
            ['eGFR','HbA1c','TSH','LDL'][person_id % 4 + 1] as lab from person)
       select person_id, case when model = 'lr_logloss_0_base' and lab <> 'TSH' then 'baseline'
         when model = 'xgb_logloss_1_clinpheno' and lab = 'TSH' then 'baseline' when model = 'xgb_logloss_3_registry' then 'registry data'
         when model = 'xgb_logloss_3_otherlabs' then 'other labs' when model = 'xgb_logloss_2_sumstats' then 'sumstats'
         when model = 'xgb_logloss_4_all' then 'all data' when model = 'xgb_logloss_5_all_pgs' then 'all data + PGS'
         when model = 'maxim' then 'maxim' end as predictors from m""",
)
def model_name_recode(t):
    key = F.col("person_id")
    model = recode.lookup(key % 9, dict(enumerate(_MODELS)))
    lab = recode.lookup(key % 4, dict(enumerate(_LABS)))
    return t.person.select("person_id", recode.predictor_set(model, lab).alias("predictors"))


@query(
    "signed_ci_swap",
    "person_id:i est:f low:f high:f",
    f"""select person_id, est, case when est < 0 then est + 0.05 else est - 0.05 end as low,
              case when est < 0 then est - 0.05 else est + 0.05 end as high
        from (select person_id, {u_sql('person_id', salt='est')} - cast(0.4 as double) as est from person)""",
)
def signed_ci_swap(t):
    est = uniform("person_id", salt="est") - 0.4
    rows = t.person.select("person_id", est.alias("est"), (est - 0.05).alias("low"), (est + 0.05).alias("high"))
    low, high = texts.signed_bounds(F.col("est"), F.col("low"), F.col("high"))
    return rows.withColumns({"low": low, "high": high})
