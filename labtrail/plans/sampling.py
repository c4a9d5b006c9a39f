"""Recall sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from labtrail.functions import dates
from labtrail.operators import cohort
from labtrail.plans.evaluation import _P, interval_sql, ranked_sql
from labtrail.plans.registry import BASE, query, u_sql
from labtrail.sampling import recall

BINS = recall.Bins(0.02, (0.12, 0.26, 0.4, 0.55, 0.8))
TOTAL = 500
DRAWS = 100
SHARE = 0.25


def _sql_bins(source: str, score: str) -> str:
    cuts = [*BINS.cuts]
    group = " + ".join(["1"] + [f"cast({score} >= {c}::double as integer)" for c in cuts[:-1]])
    bounds = [BINS.lowest, *cuts]
    table = ", ".join(f"({i}, {low}::double, {high}::double)" for i, (low, high) in enumerate(zip(bounds, bounds[1:]), 1))
    return f"""(select s.*, {score} as prob, b.grp as "group", lower, cut, round(lower + (cut - lower) / 2, 3) as mid
      from {source} s join (values {table}) b(grp, lower, cut) on b.grp = {group} where {score} <= {cuts[-1]}::double)"""


_LABELLED = f"""select d.person_id, y, split_set, p1, p2, case cohort when 'TAMPERE BIOBANK' then 'Tampere' when 'AURIA BIOBANK' then 'Turku' end as site,
    floor(date_diff('day', birth_date, date '{BASE}') / cast(365.25 as double)) as event_age
  from pred d join person p on p.person_id = d.person_id where split_set <> 0 and cohort in ('TAMPERE BIOBANK', 'AURIA BIOBANK')"""
_PLANNED = f"""past as {_sql_bins('sited', 'p1')}, future as {_sql_bins('sited', 'p2')},
capacity as (select cast(g as integer) as "group", case when count(n) = 2 then min(n) else 0 end as capacity
  from range(1, {len(BINS.cuts) + 1}) r(g) left join (select "group", site, count(*) as n from future group by all) f on f."group" = g group by g),
r0 as (select "group", capacity, round_even(capacity / cast(2 as double), 0) * 2 as room, {TOTAL} / cast(count(*) over () as double) as s0 from capacity),
r1 as (select *, room < s0 as full1, least(room, s0) as s1 from r0),
r2 as (select *, case when full1 then s1 else round_even(({TOTAL} - sum(case when full1 then s1 else 0 end) over ()) / 2 / cast(nullif(count(*) filter (not full1) over (), 0) as double), 0) * 2 end as t2 from r1),
r3 as (select *, full1 or room < t2 as full2, least(room, t2) as s2 from r2),
r4 as (select *, case when full2 then s2 else round_even(({TOTAL} - sum(case when full2 then s2 else 0 end) over ()) / 2 / cast(nullif(count(*) filter (not full2) over (), 0) as double), 0) * 2 end as t3 from r3),
plan as (select "group", capacity, least(room, t3) as n from r4)"""
#: All labelled predictions, and those of persons old enough to be drawn.
EVERYONE = f"""sited as ({_LABELLED}),
{_PLANNED}"""
SITED = f"""sited as (select * from ({_LABELLED}) where event_age >= {recall.MIN_AGE}),
{_PLANNED}"""


def everyone(t, score="p1"):
    rows = recall.site_label(t.pred.withColumn("prob", F.col(score)), t.person)
    return cohort.with_age(rows, t.person, dates.day(BASE))


def sited(t, score="p1"):
    return recall.candidates(t.pred.withColumn("prob", F.col(score)), t.person, dates.day(BASE))


def past(t, rows=sited):
    return recall.prob_bins(rows(t), BINS)


def future(t, rows=sited):
    return recall.prob_bins(rows(t, "p2"), BINS)


def plan(t, rows=sited):
    return recall.planned(recall.bin_capacity(future(t, rows)), BINS, TOTAL)


@query("site_label", "person_id:i site:s event_age:i", f"with {EVERYONE} select * from sited")
def site_label(t):
    return everyone(t)


_BINNED = "person_id:i prob:f group:i lower:f cut:f mid:f"


@query("prob_bins", _BINNED, f"with {EVERYONE} select * from past")
def prob_bins(t):
    return past(t, everyone)


@query("join_left_bins", "person_id:i group:i mid:f site:s", f"with {EVERYONE} select * from future")
def join_left_bins(t):
    return future(t, everyone)


@query(
    "lag_midpoint",
    "group:i cut:f mid:f n:i",
    f"""with {EVERYONE}, c as (select "group", cut, count(*) as n from past group by all)
        select "group", cut, round(coalesce(lag(cut) over (order by cut), {BINS.lowest}) + (cut - coalesce(lag(cut) over (order by cut), {BINS.lowest})) / 2, 3) as mid, n from c""",
)
def lag_midpoint(t):
    return recall.bin_group_stats(past(t, everyone))


@query(
    "bin_capacity",
    "kind:s group:i capacity:i",
    f"""with {EVERYONE} select 'site' as kind, "group", capacity from capacity where "group" in (select "group" from future)
        union all select 'all', "group", count(*) from future group by "group" """,
)
def bin_capacity(t):
    rows = future(t, everyone)
    return recall.bin_capacity(rows).withColumn("kind", F.lit("site")).unionByName(
        recall.bin_capacity(rows, per_site=False).withColumn("kind", F.lit("all"))
    )


FINE = recall.Bins(0.005, tuple(round(0.015 + 0.01 * i, 3) for i in range(99)))
_FINE_CUTS = ", ".join(f"({k}, {c}::double)" for k, c in enumerate(FINE.cuts))


@query(
    "bin_merge",
    "group:i lower:f cut:f mid:f",
    f"""with recursive {EVERYONE},
        cuts as (select k, c, coalesce(lag(c) over (order by k), -1) as before from (values {_FINE_CUTS}) v(k, c)),
        fine as (select k, c, count(*) filter (site = 'Tampere') as a, count(*) filter (site = 'Turku') as b
                 from cuts left join sited on p2 >= before and p2 < c group by k, c),
        walk as (
          select -1 as k, cast(0 as bigint) as a, cast(0 as bigint) as b, cast(null as double) as kept, cast(0 as bigint) as last_size, cast(1 as double) as last_cut
          union all
          select f.k, case when least(w.a + f.a, w.b + f.b) >= 10 then 0 else w.a + f.a end, case when least(w.a + f.a, w.b + f.b) >= 10 then 0 else w.b + f.b end,
            case when least(w.a + f.a, w.b + f.b) >= 10 then f.c end,
            case when least(w.a + f.a, w.b + f.b) >= 10 then w.last_size else least(w.a + f.a, w.b + f.b) end,
            case when least(w.a + f.a, w.b + f.b) < 10 and least(w.a + f.a, w.b + f.b) <> w.last_size then f.c else w.last_cut end
          from walk w join fine f on f.k = w.k + 1),
        kept as (select kept as cut, row_number() over (order by k) as g, count(*) over () as n, (select arg_max(last_cut, k) from walk) as last_cut from walk where kept is not null),
        done as (select g as "group", case when g = n then last_cut else cut end as cut from kept),
        low as (select *, coalesce(lag(cut) over (order by "group"), {FINE.lowest}::double) as lower from done)
        select "group", lower, cut, round(lower + (cut - lower) / 2 + 1e-12, 3) as mid from low""",
)
def bin_merge(t):
    return recall.merged_bins(everyone(t, "p2"), FINE)


@query("sample_plan", "group:i capacity:i n:f", f"with {SITED} select * from plan")
def sample_plan(t):
    return plan(t)


@query(
    "plan_by_site",
    "group:i site:s n:f max_n:i",
    f"""with {SITED} select "group", site, n / 2 as n, capacity as max_n from plan, (values ('Tampere'), ('Turku')) v(site)""",
)
def plan_by_site(t):
    return recall.by_site(plan(t))


@query(
    "plan_collapse",
    "group:i n:f",
    f"""with {SITED} select case when "group" <= 2 then 1 else 2 end as "group", sum(n) as n from plan group by 1""",
)
def plan_collapse(t):
    return recall.collapsed(plan(t), BINS, (BINS.cuts[1], BINS.cuts[-1]))


_DRAW = f"""drawn as (select * from (select p.*, n, row_number() over (partition by p."group", site order by {u_sql('person_id', salt='draw')}, person_id) as k
  from past p join plan on plan."group" = p."group") where k <= floor(n / 2))"""


@query("stratified_draw", "person_id:i group:i site:s", f"with {SITED}, {_DRAW} select * from drawn")
def stratified_draw(t):
    return recall.stratified_draw(past(t), plan(t), most=TOTAL)


@query(
    "join_multi_key",
    "person_id:i group:i site:s n:f",
    f"""with {EVERYONE} select person_id, p."group", site, n / 2 as n from past p join plan on plan."group" = p."group" """,
)
def join_multi_key(t):
    return past(t, everyone).join(F.broadcast(recall.by_site(plan(t, everyone))), ["group", "site"])


@query(
    "draw_excluding",
    "person_id:i",
    f"""with {SITED}, a as (select person_id from (select person_id, n, row_number() over (partition by p."group", site order by {u_sql('person_id', salt='draw0')}, person_id) as k
          from past p join plan on plan."group" = p."group" where prob > 0.02) where k <= floor(n / 2))
        select * from a union all
        select person_id from (select person_id, n, row_number() over (partition by p."group", site order by {u_sql('person_id', salt='draw1')}, person_id) as k
          from future p join plan on plan."group" = p."group" where prob > 0.05 and person_id not in (select person_id from a)) where k <= floor(n / 2)""",
)
def draw_excluding(t):
    planned, other = plan(t), future(t)
    return recall.draw_excluding([(past(t), planned, 0.02), (other, planned, 0.05)], most=TOTAL)


@query(
    "participation",
    "person_id:i",
    f"""with {SITED}, {_DRAW} select person_id from (select person_id, row_number() over (order by {u_sql('person_id', salt='take')}, person_id) as j, count(*) over () as n from drawn)
        where j <= floor(n * {SHARE})""",
)
def participation(t):
    return recall.participation(recall.stratified_draw(past(t), plan(t), most=TOTAL), SHARE)


_DRAWS = f"""many as (select p.*, n, replicate, row_number() over (partition by replicate, p."group", site order by {u_sql('person_id', 'replicate', salt='draw')}, person_id) as k
  from past p join plan on plan."group" = p."group", range(1, {DRAWS + 1}) r(replicate)),
drawn as (select * from many where k <= floor(n / 2)),
taken as (select * from (select *, row_number() over (partition by replicate order by {u_sql('person_id', 'replicate', salt='take')}, person_id) as j,
  count(*) over (partition by replicate) as size from drawn) where j <= floor(size * {SHARE}))"""
_TYPES = """rows as (select 'All' as type, 0 as replicate, prob as score, y from past union all select 'Binned', 0, mid, y from past
  union all select 'Sampled', replicate, prob, y from drawn union all select 'Sampled&Participation', replicate, prob, y from taken
  union all select 'Sampled&Participation&Binned', replicate, mid, y from taken)"""
_MEAN_NAMES = ["auc", "avg_prec", "brier", "logloss"]


@query(
    "draw_bootstrap",
    "type:s " + " ".join(f"{m}_mean:f {m}_low:f {m}_high:f" for m in _MEAN_NAMES),
    f"""with {SITED}, {_DRAWS}, {_TYPES}, r as (select * from {ranked_sql('rows', 'type, replicate', 'score')} join
          (select type, replicate, avg((score - y) * (score - y)) as brier,
             avg(case when y = 1 then -ln({_P.replace('p1', 'score')}) else -ln(1 - {_P.replace('p1', 'score')}) end) as logloss from rows group by all)
          using (type, replicate)),
        m as (select type, {', '.join(f'avg({x}) as {x}_mean' for x in _MEAN_NAMES)} from r group by type)
        select * from m join (select type, {', '.join(f'{x}_low, {x}_high' for x in _MEAN_NAMES)} from {interval_sql('r', 'type', _MEAN_NAMES)}) using (type)""",
)
def draw_bootstrap(t):
    rows = past(t)
    return recall.draw_metrics(rows, recall.repeated_draws(rows, plan(t), DRAWS, SHARE, TOTAL))


@query(
    "selection_stats",
    "group:i cut:f mid:f min_selected:i mean_selected:f planned:f possible:i mean_rate:f rate_below:f rate_above:f share_of_possible:f",
    f"""with {SITED}, {_DRAWS}, s as (select replicate, "group", cut, mid, count(*) as k from drawn group by all),
        t as (select replicate, "group", avg(y) as rate from taken group by all),
        j as (select s.*, coalesce(rate, 0) as rate from s left join t on t.replicate = s.replicate and t."group" = s."group"),
        a as (select "group", cut, mid, min(k) as min_selected, avg(k) as mean_selected, avg(rate) as mean_rate,
                list_sort(list(rate))[cast(floor(count(*) * 0.025) as bigint) + 1] as lo, list_sort(list(rate))[cast(floor(count(*) * 0.975) as bigint) + 1] as hi from j group by all)
        select a."group", cut, mid, min_selected, mean_selected, n as planned, 2 * capacity as possible, mean_rate, mean_rate - lo as rate_below,
          greatest(hi - mean_rate, 0) as rate_above, mean_selected / (2 * capacity) as share_of_possible from a join plan on plan."group" = a."group" """,
)
def selection_stats(t):
    planned = plan(t)
    return recall.selection_stats(recall.repeated_draws(past(t), planned, DRAWS, SHARE, TOTAL), planned)


def _draw_box_sql(value: str) -> str:
    def near(q):
        return f"list_sort(list({value}))[cast(floor((count({value}) - 1) * {q} + 0.5) as bigint) + 1]"

    return f"""select "group", mid, '{value}' as variable, avg(m) as median, avg(a) as q1, avg(b) as q3, avg(c) as whisker_low, avg(d) as whisker_high
      from (select replicate, "group", mid, median({value}) as m, {near(0.25)} as a, {near(0.75)} as b, {near(0.025)} as c, {near(0.975)} as d
            from taken group by all) group by all"""


@query(
    "draw_boxes",
    "group:i mid:f variable:s median:f q1:f q3:f whisker_low:f whisker_high:f",
    f"with {SITED}, {_DRAWS} {_draw_box_sql('p2')} union all {_draw_box_sql('event_age')}",
)
def draw_boxes(t):
    """Boxes of value and age per draw; the second score stands for the mean value."""
    drawn = recall.repeated_draws(past(t), plan(t), DRAWS, SHARE, TOTAL)
    return recall.draw_boxes(drawn, ["p2", "event_age"])


@query(
    "bin_group_stats",
    "group:i cut:f mid:f n:i n_abnormal:i share:f",
    f"""with {EVERYONE} select "group", cut, mid, count(*) as n, sum(y) as n_abnormal, sum(y) / cast(count(*) as double) as share from past group by all""",
)
def bin_group_stats(t):
    return recall.bin_group_stats(past(t, everyone))


def _box_sql(value: str) -> str:
    def near(q):
        return f"list_sort(list({value}))[cast(floor((count({value}) - 1) * {q} + 0.5) as bigint) + 1]"

    return f"""select "group", '{value}' as variable, median({value}) as median, {near(0.25)} as q1, {near(0.75)} as q3, {near(0.025)} as whisker_low,
      {near(0.975)} as whisker_high from past group by "group" """


@query(
    "box_stats",
    "group:i variable:s median:f q1:f q3:f whisker_low:f whisker_high:f",
    f"with {EVERYONE} {_box_sql('p2')} union all {_box_sql('event_age')}",
)
def box_stats(t):
    rows = past(t, everyone).withColumn("event_age", F.col("event_age").cast("double"))
    parts = [
        recall.box_stats(rows, ["group"], v).withColumn("variable", F.lit(v)) for v in ("p2", "event_age")
    ]
    return parts[0].unionByName(parts[1])
