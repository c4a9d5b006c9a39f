"""Projections, filters, predicates and schema operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions import dates, recode
from labtrail.operators import extract, registry, schema
from labtrail.plans.registry import BASE, query

_ROW = "rid:i person_id:i event_age:i dt:s value:f unit:s flag:s"


@query(
    "lab_extract",
    "person_id:i sex:s event_age:i dt:s value:f unit:s flag:s",
    """select person_id, sex, event_age, dt, value * 2 as value, unit, flag from lab
       union all select person_id, sex, event_age, dt, value, unit, flag from lab""",
)
def lab_extract(t):
    back = {canonical: raw for raw, canonical in extract.RAW_NAMES.items()}
    back["person_id"] = "SUBJECT"
    raw = t.lab.withColumn("MEASUREMENT_VALUE_HARMONIZED", F.col("value")).withColumnsRenamed(back)
    merged = raw.withColumn("MEASUREMENT_VALUE_MERGED", F.col("value") * 2).drop("value")
    # two releases: one has a merged value, the other has none
    plain = raw.drop("value")
    return extract.lab_extract(merged, "SUBJECT").unionByName(extract.lab_extract(plain, "SUBJECT"))


@query(
    "schema_promote_union",
    "id:i amount:f note:s origin:s",
    """select l_orderkey as id, cast(l_linenumber as double) as amount, cast(l_suppkey as varchar) as note, 'a' as origin from lineitem
       union all select c_custkey, c_acctbal, c_name, 'b' from customer""",
)
def schema_promote_union(t):
    a = t.raw("lineitem").select(
        F.col("l_orderkey").cast("int").alias("id"),
        F.col("l_linenumber").alias("amount"),
        F.col("l_suppkey").alias("note"),
        F.lit("a").alias("origin"),
    )
    b = t.raw("customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("amount"),
        F.col("c_name").alias("note"),
        F.lit("b").alias("origin"),
    )
    return schema.promote_union([a, b])


@query(
    "allow_list",
    _ROW,
    "select * from lab where person_id in (select person_id from person where pc1 is not null)",
)
def allow_list(t):
    return extract.allow_list(t.lab, t.person.where(F.col("pc1").isNotNull()))


@query("min_age_filter", _ROW, "select * from lab where event_age >= 30")
def min_age_filter(t):
    return extract.min_age(t.lab, 30)


@query("flag_filter_uacr", _ROW, "select * from lab where flag <> 'L'")
def flag_filter_uacr(t):
    return extract.without_low_flag(t.lab)


@query(
    "unit_alias",
    "rid:i unit:s",
    """select rid, case when u in ('u/l', 'iu/l') then 'mu/l' else u end as unit
       from (select rid, case unit when 'mg/dl' then 'iu/l' when 'umol/l' then 'u/l' end as u from lab)""",
)
def unit_alias(t):
    odd = recode.lookup(F.col("unit"), {"mg/dl": "iu/l", "umol/l": "u/l"})
    return t.lab.select("rid", recode.thyroid_unit(odd).alias("unit"))


@query(
    "flag_alias",
    "rid:i short:s doubled:s",
    """select rid, case when flag = 'A' then 'H' else flag end as short,
              case when flag = 'A' then 'H' when flag = 'AA' then 'HH' else flag end as doubled from labx""",
)
def flag_alias(t):
    flag = F.col("flag")
    return t.labx.select(
        "rid",
        recode.plain_flag(flag).alias("short"),
        recode.plain_flag(flag, doubled=True).alias("doubled"),
    )


@query(
    "flag_ordinal",
    "rid:i abnorm:f",
    """select rid, case flag when 'N' then 0 when 'L' then -1 when 'H' then 1 when 'LL' then -2 when 'HH' then 2 end as abnorm
       from labx""",
)
def flag_ordinal(t):
    return t.labx.select("rid", recode.ordinal_flag(F.col("flag")).alias("abnorm"))


@query("flag_missing_filter", _ROW, "select * from lab where flag is not null")
def flag_missing_filter(t):
    return extract.flagged_only(t.lab)


@query(
    "simple_flag",
    "rid:i abnorm:i",
    "select rid, case when flag = 'N' then 0 when flag is not null then 1 end as abnorm from labx",
)
def simple_flag(t):
    return t.labx.select("rid", recode.simple_flag(F.col("flag")).alias("abnorm"))


@query(
    "three_level_flag",
    "rid:i abnorm:i",
    "select rid, case flag when 'N' then 0 when 'L' then -1 when 'H' then 1 end as abnorm from labx",
)
def three_level_flag(t):
    return t.labx.select("rid", recode.three_level_flag(F.col("flag")).alias("abnorm"))


@query(
    "code_regex",
    "person_id:i dt:s code:s",
    "select person_id, dt, code from code where regexp_matches(code, '^(A0[1-5]|C2)')",
)
def code_regex(t):
    return registry.matching(t.code, "^(A0[1-5]|C2)")


@query(
    "code_shape",
    "rid:i line:i code2:s",
    "select rid, line, code2 from register where regexp_matches(code2, '^[A-Z][0-9]')",
)
def code_shape(t):
    return registry.matching(t.register, registry.WELL_FORMED, "code2")


@query(
    "registry_row_rules",
    "person_id:i event_age:i dt:s code:s category:s icdver:s source:s code_three:s",
    """with kept as (
         select * from register where not regexp_matches(category, '^ICP|^OP|^MOP')
           and regexp_matches(icdver, '^10|^NA')
           and regexp_matches(source, '^INPAT|^OUTPAT|^PRIM_OUT|^REIMB|^DEATH'))
       select person_id, event_age, dt, code1 as code, category, icdver, source, substr(code1, 1, 3) as code_three
       from kept where regexp_matches(code1, '^[A-Z][0-9]+')
       union all
       select person_id, event_age, dt, code2, category, icdver, source, substr(code2, 1, 3)
       from kept where regexp_matches(code2, '^[A-Z][0-9]+') and code1 is distinct from code2""",
)
def registry_row_rules(t):
    return registry.row_rules(t.register)


@query(
    "code_prefix",
    "rid:i line:i code_three:s code_five:s",
    "select rid, line, substr(code, 1, 3) as code_three, substr(code, 1, 5) as code_five from code",
)
def code_prefix(t):
    code = F.col("code")
    return t.code.select(
        "rid",
        "line",
        registry.code_prefix(code, 3).alias("code_three"),
        registry.code_prefix(code, 5).alias("code_five"),
    )


@query(
    "history_window",
    "person_id:i dt:s code:s",
    f"select person_id, dt, code from code where dt < date '{BASE}' and year(dt) >= 1997",
)
def history_window(t):
    return registry.history_window(t.code, dates.day(BASE), 1997)


@query(
    "age_band",
    "rid:i band:s",
    """select rid, case when event_age >= 30 and event_age < 40 then '30-40' when event_age >= 40 and event_age < 50 then '40-50'
              when event_age >= 50 and event_age < 60 then '50-60' when event_age >= 60 and event_age <= 70 then '60-70' end as band
       from lab""",
)
def age_band(t):
    return t.lab.select("rid", recode.age_band(F.col("event_age")).alias("band"))


@query(
    "sex_binary",
    "person_id:i sex:i again:i",
    """select person_id, case sex when 'female' then 0 else 1 end as sex,
              case sex when 'female' then 0 else 1 end as again from person""",
)
def sex_binary(t):
    coded = t.person.select("person_id", recode.sex_binary(F.col("sex")).alias("sex"))
    return coded.withColumn("again", recode.sex_binary(F.col("sex").cast("double"), is_text=False))


@query(
    "narrow_types",
    "rid:i is_even:i number:f maybe:i types:s",
    """select rid, 1 - rid % 2 as is_even, cast(rid % 7 as double) as number,
              case when value is not null then cast(value > 100 as integer) end as maybe,
              'tinyint double tinyint' as types from lab""",
)
def narrow_types(t):
    wide = t.lab.select(
        "rid",
        (1 - F.col("rid") % 2).alias("is_even"),
        (F.col("rid") % 7).alias("number"),
        F.when(F.col("value").isNotNull(), (F.col("value") > 100).cast("double"))
        .otherwise(F.lit(float("nan")))
        .alias("maybe"),
    )
    out = schema.narrow_types(wide, ["is_even", "number", "maybe"])
    shown = [F.typeof(c) for c in ("is_even", "number", "maybe")]
    return out.withColumn("types", F.concat_ws(" ", *shown))


@query(
    "ensure_columns",
    "person_id:i n:i K99:i",
    "select distinct person_id, count(*) over (partition by person_id) as n, 0 as K99 from code",
)
def ensure_columns(t):
    counts = t.code.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    return schema.ensure_columns(counts, ["n", "K99"])


@query(
    "feature_groups",
    "person_id:i sex:s MEAN:f SUM:f L1_MEAN:f",
    """select person_id, any_value(sex) as sex, avg(value) as "MEAN", sum(value) as "SUM",
              avg(value) filter (lab = '1-URGENT') as "L1_MEAN" from lab group by person_id""",
)
def feature_groups(t):
    first = F.when(F.col("lab") == "1-URGENT", F.col("value"))
    wide = t.lab.groupBy("person_id").agg(
        F.min("sex").alias("sex"),
        F.avg("value").alias("MEAN"),
        F.sum("value").alias("SUM"),
        F.max("dt").alias("LAST_VAL_DATE"),
        F.avg(first).alias("L1_MEAN"),
        F.max(first).alias("L1_MAX"),
    )
    groups = {
        "SUMSTATS": ["person_id", "MEAN", "SUM", "LAST_VAL_DATE"],
        "LAB_MAT": ["person_id", "L1_MEAN", "L1_MAX"],
    }
    chosen = schema.feature_groups(["sex", "SUMSTATS", "LAB_MAT_MEAN"], groups)
    return wide.select("person_id", *chosen)


_CONCEPTS = {
    "1-URGENT": "40764999",
    "2-HIGH": "3020564",
    "3-MEDIUM": "3030366",
    "4-NOT SPECIFIED": "3004410",
    "5-LOW": "3001308",
}


@query(
    "leakage_exclude",
    "target:s rid:i lab:s",
    """with c as (select rid, case lab when '1-URGENT' then '40764999' when '2-HIGH' then '3020564'
                    when '3-MEDIUM' then '3030366' when '4-NOT SPECIFIED' then '3004410' else '3001308' end as lab from lab)
       select 'egfr strict' as target, rid, lab from c where lab not in ('40764999', '46236952', '3020564', '3030366', '3020682')
       union all select 'egfr', rid, lab from c where lab not in ('40764999', '46236952', '3020564')
       union all select 'ldl single', rid, lab from c where lab not in ('3001308')""",
)
def leakage_exclude(t):
    labs = t.lab.select("rid", recode.lookup(F.col("lab"), _CONCEPTS).alias("lab"))
    parts = [
        schema.leakage_exclude(labs, "egfr", 1).withColumn("target", F.lit("egfr strict")),
        schema.leakage_exclude(labs, "egfr", 0).withColumn("target", F.lit("egfr")),
        schema.leakage_exclude(labs, "ldl", 1, True).withColumn("target", F.lit("ldl single")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "rare_feature_drop",
    "person_id:i code:s n:i",
    """with k as (select person_id, code, count(*) as n from code
                  where person_id in (select person_id from person where cohort = 'HELSINKI BIOBANK') group by all)
       select * from k where code in (select code from k group by code having sum(n) >= 5)""",
)
def rare_feature_drop(t):
    cohort = t.person.where(F.col("cohort") == "HELSINKI BIOBANK")
    return registry.rare_code_drop(registry.code_counts(t.code, "code"), cohort, "code")


@query(
    "prefix_second",
    "person_id:i S_MEAN:f S_N:i",
    'select person_id, avg(value) as "S_MEAN", count(*) as "S_N" from lab group by person_id',
)
def prefix_second(t):
    return schema.prefix_second(
        t.lab.groupBy("person_id").agg(F.avg("value").alias("MEAN"), F.count(F.lit(1)).alias("N"))
    )


@query(
    "split_select",
    "which:s person_id:i label:i",
    """with k as (select person_id, split_set, case when person_id % 5 = 0 then -1 else y end as l0 from pred),
            r as (select person_id, split_set, case when l0 = -1 then 2 else l0 end as label from k)
       select 'all' as which, person_id, label from r
       union all select 'train', person_id, label from r where split_set = 0
       union all select 'tuning', person_id, label from r where split_set = 1
       union all select 'test', person_id, label from r where split_set = 2""",
)
def split_select(t):
    label = F.when(F.col("person_id") % 5 == 0, -1).otherwise(F.col("y"))
    rows = t.pred.select("person_id", "split_set", recode.class_code(label).alias("label"))
    parts = [
        extract.split_rows(rows, which).withColumn("which", F.lit(which))
        for which in ("all", "train", "tuning", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "set_recode",
    "part:s person_id:i split_set:f set_fixed:f",
    """with r as (select person_id, split_set from pred)
       select 'final' as part, person_id, 0 as split_set, 0 as set_fixed from r where split_set in (1, 2)
       union all select 'train', person_id, split_set, split_set from r where split_set = 0
       union all select 'other', person_id, split_set, case when split_set = 0.5 then 0 else split_set end from r where split_set <> 0""",
)
def set_recode(t):
    rows = t.pred.select("person_id", "split_set")
    parts = {
        "final": extract.final_training_rows(rows),
        "train": extract.training_only(rows),
        "other": extract.not_training(rows),
    }
    shown = [
        df.withColumn("set_fixed", recode.fixed_set(F.col("split_set"))).withColumn("part", F.lit(p))
        for p, df in parts.items()
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query(
    "multiclass_to_binary",
    "person_id:i y:i abnorm_probs:f",
    """select person_id, case when (person_id % 3) - 1 = 1 then 1 else 0 end as y, p1 as abnorm_probs from pred""",
)
def multiclass_to_binary(t):
    multi = t.pred.select(
        "person_id", (F.col("person_id") % 3 - 1).alias("y"), F.col("p1").alias("abnorm_probs_1")
    )
    return multi.withColumn("y", recode.one_vs_rest(F.col("y"))).withColumnRenamed(
        "abnorm_probs_1", "abnorm_probs"
    )


@query(
    "risk_to_any",
    "person_id:i goal:i",
    "select person_id, case when person_id % 4 = 0 then 0 else 1 end as goal from pred",
)
def risk_to_any(t):
    risk = (F.col("person_id") % 4) / F.lit(2.0)
    return t.pred.select("person_id", recode.any_risk(risk).alias("goal"))
