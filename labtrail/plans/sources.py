"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.plans.registry import BASE, query
from labtrail.sources import readers, writers

_EVENTS = "person_id:i event_age:i dt:s code:s category:s icdver:s source:s"


@query(
    "scan_typed",
    "person_id:i sex:s birth_date:s bmi:f",
    "select person_id, sex, birth_date, bmi from person",
)
def scan_typed(t):
    path = writers.work_folder(t.spark) + "/persons.csv"
    t.person.select("person_id", "sex", "birth_date", "bmi").write.options(
        header=True, nullValue="NA"
    ).csv(path)
    return readers.read_file(t.spark, path, schema={"bmi": "double"})


@query(
    "scan_delim_project",
    "person_id:s birth_date:s",
    "select person_id, birth_date from person",
)
def scan_delim_project(t):
    path = writers.work_folder(t.spark) + "/minimum.txt"
    t.person.select(
        F.col("person_id").alias("FID"), "sex", F.col("birth_date").alias("DATE_OF_BIRTH"), "cohort"
    ).write.options(header=True, sep="\t", nullValue="NA", compression="gzip").csv(path)
    return readers.read_delimited(
        t.spark,
        path,
        ["FID", "DATE_OF_BIRTH"],
        rename={"FID": "person_id", "DATE_OF_BIRTH": "birth_date"},
    )


@query(
    "scan_by_code",
    "l_orderkey:i l_partkey:i l_quantity:f",
    "select l_orderkey, l_partkey, l_quantity from lineitem where l_linenumber = 3",
)
def scan_by_code(t):
    # the key arrives as text, the column is an integer
    return readers.select_code(
        t.raw("lineitem"), "l_linenumber", "3", ["l_orderkey", "l_partkey", "l_quantity"]
    )


@query(
    "scan_code_unit",
    "rid:i person_id:i dt:s value:f unit:s",
    """select rid, person_id, dt, value, unit from lab where lab = '1-URGENT' and unit = 'umol/l'
       union all select rid, person_id, dt, value, unit from lab where lab = '2-HIGH'""",
)
def scan_code_unit(t):
    columns = ["rid", "person_id", "dt", "value", "unit"]
    one_unit = readers.select_code(t.lab, "lab", "1-URGENT", columns, "unit", "umol/l")
    any_unit = readers.select_code(t.lab, "lab", "2-HIGH", columns, "unit", "NA")
    return one_unit.unionByName(any_unit)


@query(
    "scan_warehouse_diag_med",
    "person_id:i source:s event_age:i dt:s code1:s code2:s",
    """select person_id, source, event_age, dt, code1, code2 from register
       where (((source in ('INPAT','OUTPAT','PRIM_OUT','REIMB') and regexp_matches(code2, '^(K1|A2)'))
            or (source in ('INPAT','OUTPAT','PRIM_OUT') and regexp_matches(code1, '^(K1|A2)')))
            and not (regexp_matches(category, '^ICP') or regexp_matches(category, '^OP')
                     or regexp_matches(category, '^MOP') or category = 'None'))
          or (source = 'PURCH' and regexp_matches(code1, '^B0'))""",
)
def scan_warehouse_diag_med(t):
    return readers.diagnosis_and_drug_rows(t.register, diagnosis="^(K1|A2)", drug="^B0")


@query(
    "scan_deaths",
    _EVENTS,
    """select person_id, event_age, dt, code1 as code, category, icdver, source from register
       where source = 'DEATH' and code1 <> 'None' and regexp_matches(code1, '^[A-Z][0-9]+')""",
)
def scan_deaths(t):
    return readers.death_codes(t.register)


_PATIENTS = """
  select distinct person_id, event_age, dt, code, category, icdver, source from (
    select person_id, event_age, dt, code1 as code, category, icdver, source, code1, code2 from register
    union all select person_id, event_age, dt, code2, category, icdver, source, code1, code2 from register)
  where source in ('PRIM_OUT','INPAT','OUTPAT')
    and (regexp_matches(code1, '^[A-Z][0-9]+') or regexp_matches(code2, '^[A-Z][0-9]+'))
    and not (category like 'ICP%' or category like 'OP%' or category like 'MOP%' or category = 'None')
    and code is not null and regexp_matches(code, '^[A-Z][0-9]')"""
_REIMBURSEMENTS = """
  select person_id, event_age, dt, code2 as code, '1' as category, icdver, source from register
  where source = 'REIMB' and code2 <> 'None' and regexp_matches(code2, '^[A-Z][0-9]+')"""


@query("scan_patient_codes", _EVENTS, _PATIENTS)
def scan_patient_codes(t):
    return readers.visit_codes(t.register)


@query("scan_reimbursements", _EVENTS, _REIMBURSEMENTS)
def scan_reimbursements(t):
    return readers.reimbursement_codes(t.register)


@query(
    "union_sources",
    _EVENTS,
    f"""select person_id, event_age, dt, code1 as code, category, icdver, source from register
        where source = 'DEATH' and code1 <> 'None' and regexp_matches(code1, '^[A-Z][0-9]+')
        union all {_PATIENTS} union all {_REIMBURSEMENTS}""",
)
def union_sources(t):
    return (
        readers.death_codes(t.register)
        .unionByName(readers.visit_codes(t.register))
        .unionByName(readers.reimbursement_codes(t.register))
    )


@query(
    "scan_drug_purchases",
    "person_id:i event_age:i dt:s code:s",
    """select distinct person_id, event_age, dt, code1 as code from register
       where source = 'PURCH' and code1 <> 'NA'""",
)
def scan_drug_purchases(t):
    return readers.drug_purchases(t.register)


@query(
    "scan_operations",
    "person_id:i event_age:i dt:s code:s",
    """select person_id, event_age, dt, code1 as code from register
       where regexp_matches(source, '^OPER_IN|^OPER_OUT') and regexp_matches(code1, '^([ABC][0-3])')""",
)
def scan_operations(t):
    return readers.operations(t.register, "[ABC][0-3]")


@query(
    "scan_covariates",
    "person_id:i birth_date:s sex:s bmi:f cohort:s end_of_follow_up:s",
    """select person_id, birth_date, sex, bmi, cohort,
              cast(birth_date + cast(floor((40 + person_id % 500 / cast(10 as double)) * cast(365.25 as double)) as integer) as date)
                as end_of_follow_up from person""",
)
def scan_covariates(t):
    persons = t.person.withColumn("follow_up_age", 40 + (F.col("person_id") % 500) / F.lit(10.0))
    return readers.end_of_follow_up(persons)


@query(
    "scan_datetime_suffix",
    "rid:i EVENT_DATETIME:s OTHER_DATETIME:s",
    """select event_id as rid, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as EVENT_DATETIME,
              cast(null as varchar) as OTHER_DATETIME from events""",
)
def scan_datetime_suffix(t):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = t.covariate.select(
        "rid",
        stamp.alias("EVENT_DATETIME"),
        F.concat(F.lit("day "), stamp).alias("OTHER_DATETIME"),
    )
    return readers.parse_datetime_columns(text)


@query(
    "text_to_parquet",
    "person_id:i dt:s code:s source:s",
    "select person_id, dt, code, source from code",
)
def text_to_parquet(t):
    folder = writers.work_folder(t.spark)
    t.code.select("person_id", "dt", "code", "source").write.options(
        header=True, sep="\t", compression="gzip"
    ).csv(f"{folder}/codes.tsv.gz")
    return writers.text_to_parquet(
        t.spark,
        f"{folder}/codes.tsv.gz",
        f"{folder}/codes.parquet",
        types={"person_id": "bigint", "dt": "date"},
        partitions=8,
    )


@query(
    "latest_run",
    "person_id:i p1:f run_date:s",
    "select person_id, p2 as p1, '2000-03-01' as run_date from pred",
)
def latest_run(t):
    path = writers.work_folder(t.spark) + "/preds.parquet"
    older = t.pred.select("person_id", "p1", F.lit("2000-01-01").alias("run_date"))
    newer = t.pred.select("person_id", F.col("p2").alias("p1"), F.lit("2000-03-01").alias("run_date"))
    older.unionByName(newer).write.partitionBy("run_date").parquet(path)
    return readers.latest_run(t.spark.read.parquet(path))


@query(
    "sink_tables",
    "table_name:s n:i",
    """select 'data' as table_name, count(*) as n from lab
       union all select 'counts', count(*) from (select unit from lab group by unit)""",
)
def sink_tables(t):
    counts = t.lab.groupBy("unit").count()
    data_path, count_path = writers.write_tables(
        t.lab, counts, writers.work_folder(t.spark), "series"
    )
    data = t.spark.read.parquet(data_path).agg(F.count(F.lit(1)).alias("n"))
    units = t.spark.read.option("header", True).csv(count_path).agg(F.count(F.lit(1)).alias("n"))
    return data.select(F.lit("data").alias("table_name"), "n").unionByName(
        units.select(F.lit("counts").alias("table_name"), "n")
    )


@query(
    "audit_removed",
    "person_id:i reason:s",
    f"""select distinct person_id, 'no-measure' as reason from lab
        where person_id not in (select person_id from lab where dt >= date '{BASE}')
        union all
        select distinct person_id, 'age' from lab where dt >= date '{BASE}'
          and person_id not in (select person_id from lab where dt >= date '{BASE}' and event_age <= 60)""",
)
def audit_removed(t):
    recent = t.lab.where(F.col("dt") >= F.lit(BASE).cast("date"))
    young = recent.where(F.col("event_age") <= 60)
    return writers.removed_ids({"no-measure": (t.lab, recent), "age": (recent, young)})
