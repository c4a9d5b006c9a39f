"""Registration of queries and the shared SQL views they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.sources.driver_tables import Tables

BASE = "1999-10-01"
START = "2000-01-01"
END = "2000-12-31"


def u_sql(*ids: str, salt: str) -> str:
    """SQL twin of `labtrail.functions.uniform.uniform`."""
    parts = ", ".join(f"cast({i} as varchar)" for i in ids)
    return (
        f"(cast(cast('0x' || substr(md5(concat_ws('|', {parts}, '{salt}')), 1, 8) as bigint) as double)"
        " / cast(4294967296 as double))"
    )


VIEWS = f"""
person as (
  select c_custkey as person_id,
         case when c_custkey % 2 = 0 then 'male' else 'female' end as sex,
         cast(date '1930-01-01' + cast(c_custkey * 37 % 18000 as integer) as date) as birth_date,
         case c_nationkey % 3 when 0 then 'AURIA BIOBANK' when 1 then 'TAMPERE BIOBANK'
              else 'HELSINKI BIOBANK' end as cohort,
         case when c_custkey % 7 = 0 then null else cast(18 + c_custkey % 20 as double) end as bmi,
         case when c_custkey % 10 = 0 then null else cast(c_custkey % 100 as double) / 100 end as pc1
  from customer),
lab as (
  select o_orderkey as rid, p.person_id, p.sex,
         cast(floor(date_diff('day', p.birth_date, cast(o_orderdate as date)) / cast(365.25 as double)) as integer) as event_age,
         cast(o_orderdate as date) as dt, o_orderpriority as lab,
         case when cast(floor(o_totalprice) as bigint) % 17 = 0 then null
              else 40 + cast(cast(floor(o_totalprice) as bigint) % 1201 as double) / 10 end as value,
         case when o_orderkey % 11 = 0 then 'mg/dl' when o_orderkey % 13 = 0 then null else 'umol/l' end as unit,
         case when o_orderkey % 19 = 0 then null when o_orderstatus = 'F' then 'N'
              when o_orderstatus = 'O' then 'H' else 'L' end as flag
  from orders join person p on p.person_id = o_custkey),
code as (
  select l_orderkey as rid, l_linenumber as line, o_custkey as person_id, cast(l_shipdate as date) as dt,
         concat(substr('ABCDEFGHIJ', cast(p_partkey % 10 as integer) + 1, 1),
                lpad(cast(p_size as varchar), 2, '0'), cast(l_linenumber as varchar)) as code,
         case l_returnflag when 'A' then 'INPAT' when 'R' then 'OUTPAT' else 'PURCH' end as source,
         case l_linestatus when 'F' then 'ICP1' else '1' end as category
  from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey),
labx as (
  select * exclude (flag), case when rid % 23 = 0 then 'LL' when rid % 29 = 0 then 'HH' when rid % 31 = 0 then 'AA'
         when rid % 37 = 0 then 'A' else flag end as flag from lab),
register as (
  select rid, line, c.person_id,
         case line when 7 then 'DEATH' when 6 then 'REIMB' when 5 then 'PRIM_OUT'
              when 4 then case when rid % 2 = 0 then 'OPER_IN' else 'OPER_OUT' end else source end as source,
         cast(floor(date_diff('day', birth_date, dt) / cast(365.25 as double)) as integer) as event_age, dt,
         case when rid % 7 = 0 then 'None' else code end as code1,
         case when rid % 5 = 0 then code when rid % 3 = 0 then substr(code, 2, 3)
              when rid % 4 <> 0 then concat('K', substr(code, 2, 3)) end as code2,
         case when rid % 13 = 0 then 'MOP' when rid % 17 = 0 then 'None' else category end as category,
         case when rid % 6 = 0 then '9' when rid % 10 = 0 then 'NA' else '10' end as icdver
  from code c join person p on p.person_id = c.person_id),
covariate as (
  select event_id as rid, user_id as person_id, cast(ts as date) as dt, ts, event_type as kind, value from events),
pred as (
  select person_id, y,
         floor((cast(0.7 as double) * u1 + cast(0.3 as double) * y) * 100) / cast(100 as double) as p1,
         floor((cast(0.85 as double) * u2 + cast(0.15 as double) * y) * 100) / cast(100 as double) as p2,
         cast(case when u3 < cast(0.6 as double) then 0 when u3 < cast(0.7 as double) then 0.5
              when u3 < cast(0.85 as double) then 1 else 2 end as double) as split_set
  from (select person_id, case when person_id % 9 = 0 then 1 else 0 end as y,
               {u_sql('person_id', salt='p1')} as u1, {u_sql('person_id', salt='p2')} as u2,
               {u_sql('person_id', salt='set')} as u3 from person)),
daily as (
  select * exclude (rn) from (
    select *, row_number() over (partition by person_id, dt order by rid desc) as rn from lab) where rn = 1)
"""

# The engines round exact ties differently (decimal text against binary), so both
# sides move a value by this much before six decimals are shown.
TIE = 1.3e-9

_SPARK_CAST: dict[str, Callable] = {
    "i": lambda c: c.cast("long"),
    "f": lambda c: F.round(c.cast("double") + F.lit(TIE), 6),
    "s": lambda c: c.cast("string"),
}
_SQL_CAST: dict[str, str] = {
    "i": "cast({0} as bigint)",
    # a division 0/0 is NaN there and null here
    "f": f"(round(nullif(cast({{0}} as double), cast('nan' as double)) + cast({TIE} as double), 6) + cast(0 as double))",
    "s": "cast({0} as varchar)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def query(key: str, spec: str, sql: str | None = None):
    """Register a plan under `key`.

    `spec` lists the output as `name:type` with i (integer), f (double, six
    decimals) or s (text; dates are shown as text). It shapes both sides.
    """
    columns = _columns(spec)

    def register(build: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = build(Tables(spark, folder))
            return out.select(*[_SPARK_CAST[t](F.col(f"`{n}`")).alias(n) for n, t in columns])

        QUERIES[key] = run
        if sql is not None:
            shown = ", ".join(f'{_SQL_CAST[t].format(chr(34) + n + chr(34))} as "{n}"' for n, t in columns)
            ORACLES[key] = f"with {VIEWS} select {shown} from ({sql}) final_rows"
        return build

    return register
