"""Queries p1 to p4 and p7 over the tables of the domain, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import cigar
from strandline.operators import frequency, orphans, pivot, rejects, sweep
from strandline.session import table


def _wide(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    declared = pivot.attributes(table(spark, sf, "field_definitions"), kind)
    if kind == "data":
        return pivot.pivot_blocks(table(spark, sf, "data_fields"), declared, entity="record_id", attribute="tag", value="data", order="loaded_at")
    return pivot.pivot_blocks(table(spark, sf, "info_fields"), declared, entity="variant_id", attribute="field_key", value="info", order="loaded_at")


def p1_data_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, "data")


def p1_info_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, "info")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pivot.unusable_cells(_wide(spark, sf, "data"), "record_id", "data").unionByName(pivot.unusable_cells(_wide(spark, sf, "info"), "variant_id", "info"))


def p1_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The typed cells of both wide tables one by one: the number of values, the sum of numbers, the text of others."""
    out = None
    for kind, entity in (("data", "record_id"), ("info", "variant_id")):
        wide, cells = _wide(spark, sf, kind), []
        for a in pivot.attributes(table(spark, sf, "field_definitions"), kind):
            v = F.col(f"`{a.key}`")
            n = F.size(v) if a.is_list else F.lit(1)
            listed = v if a.is_list else F.array(v)
            numeric = a.value_type in ("Integer", "Float")
            total = F.round(F.aggregate(listed, F.lit(0.0), lambda t, x: t + F.coalesce(x.cast("double"), F.lit(0.0))), 4) if numeric else F.lit(None).cast("double")
            text = F.lit(None).cast("string") if numeric else F.array_join(F.transform(listed, lambda x: x.cast("string")), ",", ".")
            cells.append(F.when(v.isNotNull(), F.struct(F.lit(a.key).alias("field_key"), n.alias("n_values"), total.alias("total"), text.alias("text"))))
        long = wide.select(F.lit(kind).alias("record_kind"), F.col(entity).alias("record_id"), F.inline(F.array_compact(F.array(*cells))))
        out = long if out is None else out.unionByName(long)
    return out


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    intervals = table(spark, sf, "features").where(F.col("feature_start") >= 1)
    return sweep.covered_and_gaps(intervals, ["file_id", "reference_sequence_name"], "feature_start", "feature_end")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    parents = {f: (table(spark, sf, p), f) for f, p in (("reference_sequence_id", "reference_sequences"), ("read_group_id", "read_groups"))}
    columns = ["table_name", "record_id", "reference_sequence_id", "read_group_id", "loaded_at"]
    a = table(spark, sf, "alignments").withColumn("table_name", F.lit("alignments")).select(columns)
    s = table(spark, sf, "slices").withColumns({"table_name": F.lit("slices"), "record_id": F.col("slice_id"), "read_group_id": F.lit(None).cast("int")}).select(columns)
    return orphans.orphan_references(a.unionByName(s), parents, record_id="record_id", at="loaded_at", keep=["table_name"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "record_id", "field_name")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, sf), ["table_name", "field_name"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected_rows(table(spark, sf, "feature_lines"), ["line_id"]).select("line_id")


def p4_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.valid_rows(table(spark, sf, "feature_lines"), ["line_id", "file_id", "line_no"])


def p4_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected_rows(table(spark, sf, "feature_lines"), ["file_id"]).groupBy("file_id", "reason").agg(F.count(F.lit(1)).alias("lines"))


def p7_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Records, distinct positions and covered bases per reference sequence."""
    a = table(spark, sf, "alignments").select("reference_sequence_id", "alignment_start", "cigar")
    # equal alignments first become one row with a weight
    freq = a.groupBy("reference_sequence_id", "alignment_start", "cigar").agg(F.count(F.lit(1)).alias("n"))
    placed = freq.where(F.col("alignment_start") > 0).withColumn("end", cigar.alignment_end(F.col("alignment_start"), F.col("cigar")))
    periods = sweep.covered_and_gaps(placed, ["reference_sequence_id"], "alignment_start", "end", gaps=False)
    bases = periods.groupBy(F.col("reference_sequence_id").alias("r")).agg(F.sum(F.col("last_position") - F.col("first_position") + 1).alias("covered_bases"))
    starts = freq.groupBy("reference_sequence_id", "alignment_start").agg(F.sum("n").alias("n"))
    counts = starts.groupBy("reference_sequence_id").agg(F.sum("n").alias("records"), F.count(F.when(F.col("alignment_start") > 0, 1)).alias("distinct_starts"))
    joined = counts.join(bases, F.col("reference_sequence_id").eqNullSafe(F.col("r")), "left")
    return joined.select("reference_sequence_id", "records", "distinct_starts", F.coalesce("covered_bases", F.lit(0)).alias("covered_bases"))


def p7_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct counts, modes and exact percentiles of integer columns per reference sequence."""
    a = table(spark, sf, "alignments").select("reference_sequence_id", F.when(F.col("mapping_quality") != 255, F.col("mapping_quality")).alias("mapping_quality"), F.when(F.col("template_length") != 0, F.col("template_length")).alias("template_length"))
    p = frequency.key_profile(a, "reference_sequence_id", ["mapping_quality", "template_length"], (0.05, 0.5, 0.95))
    marks = [F.get("percentiles", F.lit(i))["value"].alias(n) for i, n in enumerate(("p05", "p50", "p95"))]
    return p.select(F.col("key").alias("reference_sequence_id"), "field", "n", F.col("distinct").alias("n_distinct"), F.col("mode").alias("most_frequent"), *marks)


QUERIES = {
    "p1_found": p1_found,
    "p1_data_wide": p1_data_wide,
    "p1_info_wide": p1_info_wide,
    "p1_cells": p1_cells,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_rows": p4_rows,
    "p4_reasons": p4_reasons,
    "p7_coverage": p7_coverage,
    "p7_profile": p7_profile,
}

_FLOAT = "[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?"

_P1_VALUES = """
values_ as (
  select 'data' as record_kind, record_id, tag as field_key, trim(data) as v, data as raw, loaded_at from data_fields
  union all select 'info', variant_id, field_key, trim(info), info, loaded_at from info_fields),
typed as (
  select x.*, coalesce(d.value_type, 'String') as ty, coalesce(d.value_count, '1') as n
  from values_ x left join field_definitions d on d.record_kind = x.record_kind and d.field_key = x.field_key),
states as (
  select record_kind, record_id, field_key, ty, n, v, raw, loaded_at,
    case when ty = 'Flag' then case when v is null or v = '' then 2 else 1 end
         when v is null or v in ('', '.') then 0
         when len(list_filter(case when n = '1' then [v] else string_split(v, ',') end, lambda e: not (
           (n <> '1' and e = '.') or
           case ty when 'Integer' then coalesce(regexp_full_match(e, '[+-]?[0-9]+') and try_cast(e as bigint) between -2147483648 and 2147483647, false)
                   when 'Float' then regexp_full_match(e, '{f}')
                   when 'Character' then length(e) = 1
                   else true end))) = 0 then 2
         else 1 end as state
  from typed)
""".replace("{f}", _FLOAT)

_P3 = """
select '{t}' as table_name, a.{id} as record_id, '{f}' as field_name from {t} a
where a.{f} >= 0 and not exists (
  select 1 from {p} k where k.{f} = a.{f} and k.added_at <= a.loaded_at and (k.removed_at is null or a.loaded_at < k.removed_at))
"""
_P3_ALL = " union all ".join(
    _P3.format(t=t, id=i, f=f, p=p)
    for t, i, f, p in (("alignments", "record_id", "reference_sequence_id", "reference_sequences"), ("alignments", "record_id", "read_group_id", "read_groups"), ("slices", "slice_id", "reference_sequence_id", "reference_sequences"))
)

_KV = r'[A-Za-z0-9_]+ +("([^"\\]|\\["\\])*"|[^ ";]+)'
_P4 = rf"""
with l as (select line_id, file_id, line_no, regexp_replace(line, '\r$', '') as t from feature_lines where line is not null),
s as (select *, string_split(t, chr(9)) as f from l where not starts_with(t, '#') and regexp_matches(t, '[^ \t]')),
c as (select *, case
    when len(f) <> 9 then 'column_count'
    when f[1] = '' or f[2] = '' or f[3] = '' then 'empty_field'
    when not (regexp_full_match(f[4], '[0-9]+') and coalesce(try_cast(f[4] as hugeint) between 1 and 2147483647, false)) then 'invalid_start'
    when not (regexp_full_match(f[5], '[0-9]+') and coalesce(try_cast(f[5] as hugeint) between 1 and 2147483647, false)) then 'invalid_end'
    when cast(f[4] as hugeint) > cast(f[5] as hugeint) then 'start_after_end'
    when f[6] <> '.' and not (regexp_full_match(f[6], '{_FLOAT}') and coalesce(isfinite(try_cast(f[6] as double)), false)) then 'invalid_score'
    when f[7] not in ('+', '-', '.') then 'invalid_strand'
    when f[8] not in ('0', '1', '2', '.') then 'invalid_frame'
    when not regexp_full_match(f[9], '[^"]*("([^"\\]|\\.)*"[^"]*)*') then 'broken_quoting'
    when not regexp_full_match(f[9], ' *{_KV} *(; *{_KV} *)*;? *') then 'invalid_attributes' end as reason from s)
"""

ORACLES = {
    "p1_found": f"with {_P1_VALUES} select record_kind, record_id, field_key from states group by all having max(state) = 1",
    "p1_cells": f"""
with {_P1_VALUES}, best as (
  select *, case when n = '1' or ty = 'Flag' then [v] else string_split(v, ',') end as e from states s
  where state = 2 and exists (select 1 from field_definitions d where d.record_kind = s.record_kind and d.field_key = s.field_key)
  qualify row_number() over (partition by record_kind, record_id, field_key order by loaded_at desc nulls last, coalesce(raw, '') desc) = 1)
select record_kind, record_id, field_key, case when ty = 'Flag' then 1 else len(e) end as n_values,
  case when ty in ('Integer', 'Float') then round(coalesce(list_sum([cast(x as double) for x in e if x <> '.']), 0), 4) end as total,
  case when ty = 'Flag' then 'true' when ty not in ('Integer', 'Float') then array_to_string(e, ',') end as text from best""",
    "p2_found": """
with i as (select distinct file_id, reference_sequence_name, feature_start as a, feature_end as z from features where feature_start >= 1 and feature_end >= feature_start),
m as (select *, max(z) over (partition by file_id, reference_sequence_name order by a, z rows between unbounded preceding and 1 preceding) as before from i),
g as (select *, sum(case when before is null or a > before + 1 then 1 else 0 end) over (partition by file_id, reference_sequence_name order by a, z rows unbounded preceding) as isle from m),
p as (select file_id, reference_sequence_name, isle, min(a) as a, max(z) as z from g group by all),
n as (select *, lead(a) over (partition by file_id, reference_sequence_name order by a) as following from p)
select file_id, reference_sequence_name, 'period' as kind, a as first_position, z as last_position from n
union all select file_id, reference_sequence_name, 'gap', z + 1, following - 1 from n where following is not null""",
    "p3_found": _P3_ALL,
    "p3_report": f"""
with o as ({_P3_ALL})
select table_name, field_name, strftime(make_timestamp(epoch_us(loaded_at)), '%Y-%m') as month, count(*) as orphans
from (select o.*, coalesce(a.loaded_at, s.loaded_at) as loaded_at from o
      left join alignments a on o.table_name = 'alignments' and a.record_id = o.record_id
      left join slices s on o.table_name = 'slices' and s.slice_id = o.record_id)
group by all""",
    "p4_found": _P4 + "select line_id from c where reason is not null",
    "p4_rows": _P4
    + """select line_id, file_id, line_no, f[1] as seqname, f[2] as source, f[3] as feature, cast(f[4] as int) as start, cast(f[5] as int) as "end",
    case when f[6] <> '.' then cast(f[6] as double) end as score, case when f[7] <> '.' then f[7] end as strand,
    case when f[8] <> '.' then cast(f[8] as tinyint) end as frame, f[9] as attributes from c where reason is null""",
    "p4_reasons": _P4 + "select file_id, reason, count(*) as lines from c where reason is not null group by all",
    "p7_coverage": r"""
with a as (select reference_sequence_id as r, alignment_start as s,
             alignment_start + greatest(coalesce(list_sum([cast(x as bigint) for x in regexp_extract_all(cigar, '(\d+)[MDN=X]', 1)]), 0), 1) - 1 as e from alignments where alignment_start > 0),
d as (select distinct r, s, e from a),
m as (select *, max(e) over (partition by r order by s, e rows between unbounded preceding and 1 preceding) as before from d),
b as (select r, sum(greatest(0, e - greatest(s - 1, coalesce(before, 0)))) as covered_bases from m group by r)
select x.reference_sequence_id, x.records, x.distinct_starts, cast(coalesce(b.covered_bases, 0) as bigint) as covered_bases
from (select reference_sequence_id, count(*) as records, count(distinct case when alignment_start > 0 then alignment_start end) as distinct_starts from alignments group by 1) x
left join b on b.r is not distinct from x.reference_sequence_id""",
    "p7_profile": """
with b as (select reference_sequence_id, 'mapping_quality' as f, cast(mapping_quality as bigint) as v from alignments where mapping_quality <> 255
           union all select reference_sequence_id, 'template_length', cast(template_length as bigint) from alignments where template_length <> 0),
w as (select reference_sequence_id, f, v, count(*) as c from b group by all),
z as (select *, sum(c) over (partition by reference_sequence_id, f order by v) as upto, sum(c) over (partition by reference_sequence_id, f) as n,
        row_number() over (partition by reference_sequence_id, f order by c desc, v) as place from w)
select reference_sequence_id, f as field, cast(max(n) as bigint) as n, count(*) as n_distinct, max(case when place = 1 then v end) as most_frequent,
  min(case when upto >= greatest(ceil(0.05 * n), 1) then v end) as p05, min(case when upto >= greatest(ceil(0.5 * n), 1) then v end) as p50, min(case when upto >= greatest(ceil(0.95 * n), 1) then v end) as p95
from z group by reference_sequence_id, f""",
}
