"""Registered queries of this subpackage, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm import infill, langid, line_dedup, merkle, minhash, mixing, neighbours, packing, substring_dedup, suffix_dedup, vector_dedup, warc
from labtrail.llm import quality as quality_rules
from labtrail.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality(documents(spark, folder))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLES["op3_quality_rules"] = r"""
with w as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
g as (
  select doc_id, i, x || ' ' || lead(x, 1) over a || ' ' || lead(x, 2) over a as g from u
  window a as (partition by doc_id order by i)),
r as (
  select doc_id, count(distinct p) as n_repeat_words from (
    select doc_id, unnest([i, i + 1, i + 2]) as p from g
    where g is not null qualify count(*) over (partition by doc_id, g) > 1) group by doc_id),
m as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         w, l from w left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols * 10 > n_words
            or word_chars < n_words * 2 or word_chars > n_words * 15 or n_dup_lines * 10 > len(l) * 3
            or len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\t]*[-*•]'))) * 10 > len(l) * 9
            or len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$'))) * 10 > len(l) * 3
            or len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) * 10 < n_words * 8) as kept
from m
"""


#: Domains of the test tables: sources dealt to five by number. Weights are per mille.
MIX = mixing.Mix(
    levels=("domain", "lang", "source"),
    weights={
        "domain": {"d0": 150, "d1": 250, "d2": 250, "d3": 200, "d4": 150},
        "lang": {"en": 500, "de": 200, "fr": 200, "es": 100},
    },
    other=100,
    share=0.8,
    max_epochs=3,
)


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as long)")
    return docs.withColumn("domain", F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % 5).cast("string")))


@query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    picked = mixing.selection(with_domain(documents(spark, folder)), MIX)
    return picked.select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def _level_sql(name: str, parent: str, keys: str, key: str, nodes: str) -> str:
    """DuckDB text of water filling: `nodes` has keys, capacity, weight and budget."""
    return f"""
{name}_a as (
  select *, capacity / cast(weight as double) as lvl,
         coalesce(sum(capacity) over (partition by {parent} order by capacity / cast(weight as double), {key} rows between unbounded preceding and 1 preceding), 0) as used,
         sum(weight) over (partition by {parent}) - coalesce(sum(weight) over (partition by {parent} order by capacity / cast(weight as double), {key} rows between unbounded preceding and 1 preceding), 0) as open
  from ({nodes})),
{name}_b as (select *, used + lvl * cast(open as double) <= budget as full_ from {name}_a),
{name} as (
  select {keys}, case when full_ then cast(capacity as double)
         else coalesce((budget - cast(sum(case when full_ then capacity else 0 end) over (partition by {parent}) as double)) * weight
              / nullif(cast(sum(case when full_ then 0 else weight end) over (partition by {parent}) as double), 0), 0.0) end as budget
  from {name}_b),"""


def _weight_sql(level: str) -> str:
    arms = " ".join(f"when '{k}' then {v}" for k, v in MIX.weights.get(level, {}).items())
    return f"case {level} {arms} else {MIX.other} end" if arms else str(MIX.other)


ORACLES["op5_mix_sources"] = f"""
with s as (
  select doc_id, 'd' || coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as bigint), 0) % 5 as domain,
         coalesce(lang, '') as lang, coalesce(source, '') as source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as tokens
  from documents),
leaf as (select domain, lang, source, sum(tokens) as tokens, sum(tokens) * {MIX.max_epochs} as capacity from s group by all),
{_level_sql("top", "1", "domain", "domain", f"select domain, sum(capacity) as capacity, {_weight_sql('domain')} as weight, cast((select sum(tokens) from s) as double) * cast({MIX.share} as double) as budget from leaf group by domain")}
{_level_sql("mid", "domain", "domain, lang", "lang", f"select domain, lang, sum(capacity) as capacity, {_weight_sql('lang')} as weight, any_value(budget) as budget from leaf join top using (domain) group by domain, lang")}
{_level_sql("low", "domain, lang", "domain, lang, source", "source", f"select domain, lang, source, capacity, {_weight_sql('source')} as weight, budget from leaf join mid using (domain, lang)")}
p as (
  select domain, lang, source, least(cast(floor(budget / tokens) as bigint), {MIX.max_epochs}) as whole, tokens as all_tokens, budget
  from leaf join low using (domain, lang, source) where tokens > 0),
q as (
  select s.*, whole, floor(budget - whole * all_tokens) as rest,
         sum(s.tokens) over (partition by domain, lang, source order by md5('{MIX.seed}|' || (whole + 1) || '|' || doc_id)
                             range between unbounded preceding and current row) as upto
  from s join p using (domain, lang, source) where s.tokens > 0)
select doc_id, domain, lang, source, tokens, unnest(range(1, whole + 1 + case when upto <= rest and whole < {MIX.max_epochs} then 1 else 0 end)) as epoch
from q
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, folder), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archived(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, folder))


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, folder))


@query
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(documents(spark, folder)).select("doc_id", "class_id", "n_leader_links", "copies")


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup(documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 20 == 0)


#: Fields of a document's leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.verified(docs, LEAF, "source", "doc_id", seen=merkle.leaf(*LEAF[:-1], text))
    proof = merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def _field_sql(column: str) -> str:
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || cast({column} as varchar), '-')"


#: Checksum of a number's decimal digits, as DuckDB has none: the polynomial's table and a fold over the bytes.
_CRC32 = """
crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) order by i) as t
  from range(256) r(i)),
crc as (
  select doc_id, xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), cast(4294967295 as bigint)), 4294967295) as crc
  from (select distinct doc_id from documents where doc_id is not null), crc_table)"""

ORACLES["op11_merkle_manifest"] = f"""
with recursive {_CRC32},
d as (
  select documents.*, case when crc % 2 = 0 then replace(text, chr(10), '') else text end as seen
  from documents left join crc using (doc_id)),
leaf as (
  select doc_id, source, sha256({" || ".join(map(_field_sql, LEAF))}) as h,
         sha256({" || ".join(map(_field_sql, (*LEAF[:-1], "seen")))}) as seen
  from d),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as place,
         count(*) over (partition by source) as n from leaf),
tree as (
  select source, 0 as level, place, h, n from placed
  union all
  select source, level + 1, place // 3, sha256(string_agg(h, '' order by place)), any_value((n + 2) // 3)
  from tree where n > 1 group by source, level, place // 3),
sub as (
  select source, h as subroot, row_number() over (order by encode(source) nulls first) - 1 as place, count(*) over () as n
  from tree where n = 1),
top as (
  select 0 as level, place, subroot as h, n from sub
  union all
  select level + 1, place // 3, sha256(string_agg(h, '' order by place)), any_value((n + 2) // 3)
  from top where n > 1 group by level, place // 3),
heights as (select source, max(level) as height from tree group by source),
up as (
  select doc_id, p.source, p.place as row_place, level, p.place // cast(pow(3, level) as bigint) as own, t.place as other, t.h
  from placed p join tree t on t.source is not distinct from p.source and t.n > 1
   and t.place // 3 = p.place // cast(pow(3, level + 1) as bigint) and t.place <> p.place // cast(pow(3, level) as bigint)
  union all
  select doc_id, p.source, p.place, height + level, s.place // cast(pow(3, level) as bigint), t.place, t.h
  from placed p join heights g on g.source is not distinct from p.source
  join sub s on s.source is not distinct from p.source
  join top t on t.n > 1 and t.place // 3 = s.place // cast(pow(3, level + 1) as bigint)
   and t.place <> s.place // cast(pow(3, level) as bigint)),
step as (
  select source, row_place, level, coalesce(string_agg(h, '' order by other) filter (other < own), '') as l,
         coalesce(string_agg(h, '' order by other) filter (other > own), '') as r
  from up group by source, row_place, level),
whole as (
  select p.source, p.place, height + (select max(level) from top) as levels
  from placed p join heights g on g.source is not distinct from p.source),
fold as (
  select source, place, 0 as level, seen as h from placed
  union all
  select f.source, f.place, f.level + 1, sha256(coalesce(l, '') || f.h || coalesce(r, ''))
  from fold f join whole w on w.source is not distinct from f.source and w.place = f.place and f.level < levels
  left join step s on s.source is not distinct from f.source and s.row_place = f.place and s.level = f.level),
proof as (select source, row_place, string_agg(l || r, '' order by level) as p from step group by source, row_place)
select doc_id, p.h as leaf, subroot, (select h from top where n = 1) as root, sha256(coalesce(o.p, '')) as proof_sha256,
       f.h as folded_root, f.h = (select h from top where n = 1) as verified
from placed p
join sub s on s.source is not distinct from p.source
join whole w on w.source is not distinct from p.source and w.place = p.place
join fold f on f.source is not distinct from p.source and f.place = p.place and f.level = w.levels
left join proof o on o.source is not distinct from p.source and o.row_place = p.place
"""


@query
def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.transformed(documents(spark, folder).select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLES["op13_infill"] = """
with d as (
  select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n,
         sha256('1:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
c as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as x, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as y,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
                or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 90 then 'plain'
              when cast('0x' || substr(h, 25, 8) as bigint) % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (
  select *, substr(t, 1, least(x, y)) as a, substr(t, least(x, y) + 1, abs(x - y)) as m, substr(t, greatest(x, y) + 1) as z from c)
select doc_id, n, form, case when form <> 'plain' then least(x, y) end as prefix_chars,
       case when form <> 'plain' then abs(x - y) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || a || '<S>' || z || '<M>' || m
                        when 'spm' then '<S>' || z || '<P>' || a || '<M>' || m else t end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""


@query
def op12_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.classes(table(spark, folder, "embeddings"))
