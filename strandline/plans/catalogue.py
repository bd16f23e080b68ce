"""Queries of the engine's own operators over the tables of the domain, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import attributes as at
from strandline.functions import bases, bins, flags, modifications, offsets, regions, tags, variants
from strandline.functions import cigar as cg
from strandline.operators import convert, depth, overlap, statistics
from strandline.session import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _aln(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "alignments")


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    """One row per reference: its latest lifetime."""
    s = table(spark, sf, "reference_sequences")
    last = F.max_by(F.struct(F.col("reference_sequence_name").alias("name"), F.col("sequence_length").alias("length")), "added_at")
    return s.groupBy(F.col("reference_sequence_id").alias("ref_id")).agg(last.alias("s")).select("ref_id", "s.name", "s.length")


_SPAN = r"coalesce(list_sum([cast(x as bigint) for x in regexp_extract_all(cigar, '(\d+)[MDN=X]', 1)]), 0)"
_END = f"(alignment_start + greatest({_SPAN}, 1) - 1)"
_DICT = "(select reference_sequence_id as ref_id, arg_max(reference_sequence_name, added_at) as name, arg_max(sequence_length, added_at) as length from reference_sequences group by 1)"
_COMP = "translate({}, 'ACGTUWSMKRYBDHVNacgtuwsmkrybdhvn', 'TGCAAWSKMYRVHDBNtgcaawskmyrvhdbn')"


def _ends() -> tuple[Column, Column]:
    start = F.when(F.col("alignment_start") >= 1, F.col("alignment_start"))
    return start, cg.alignment_end(start, F.col("cigar"))


# region filters -----------------------------------------------------------------------------


def _region(spark: SparkSession, sf: str, interval: str) -> DataFrame:
    """The region is resolved against the dictionary on the driver, so the scan gets an id and bounds to push down."""
    r = regions.Region.parse(f"7{interval}")
    start, end = _ends()
    a = _aln(spark, sf).where(F.col("reference_sequence_id") == int(r.name))
    if r.end is not None:
        a = a.where(F.col("alignment_start") <= r.end)
    return overlap.region_filter(a.withColumn("_name", F.col("reference_sequence_id").cast("string")), r, name="_name", start=start, end=end).select("record_id", "alignment_start", end.alias("alignment_end"))


def _region_sql(test: str) -> str:
    return f"select record_id, alignment_start, case when alignment_start >= 1 then {_END} end as alignment_end from alignments where reference_sequence_id = 7 {test}"


@query(_region_sql(f"and alignment_start >= 1 and alignment_start <= 500000 and {_END} >= 20000"))
def region_filter_closed(spark, sf):
    return _region(spark, sf, ":20000-500000")


@query(_region_sql(f"and alignment_start >= 1 and {_END} >= 500000"))
def region_filter_open_end(spark, sf):
    return _region(spark, sf, ":500000")


@query(_region_sql(""))
def region_filter_unbounded(spark, sf):
    return _region(spark, sf, "")


@query("select record_id from alignments where flags & 4 <> 0")
def unmapped_query(spark, sf):
    return _aln(spark, sf).where(flags.has(F.col("flags"), "is_unmapped")).select("record_id")


@query("select record_id from alignments where flags & 4 <> 0 and (reference_sequence_id is null or reference_sequence_id < 0)")
def unplaced_query(spark, sf):
    return _aln(spark, sf).where(flags.has(F.col("flags"), "is_unmapped") & (F.col("reference_sequence_id").isNull() | (F.col("reference_sequence_id") < 0))).select("record_id")


@query("select record_id from alignments where flags & 1796 = 0")
def pileup_filter(spark, sf):
    return _aln(spark, sf).where(flags.is_piled(F.col("flags"))).select("record_id")


@query("select " + ", ".join(f"sum(case when flags & {b} <> 0 then 1 else 0 end)::bigint as {n}" for n, b in flags.BITS.items()) + " from alignments")
def flag_predicates(spark, sf):
    return _aln(spark, sf).agg(*[F.count_if(flags.has(F.col("flags"), n)).alias(n) for n in flags.BITS])


@query("select distinct record_id from data_fields where tag = 'NH' and try_cast(trim(data) as bigint) = 1")
def tag_unique_hit(spark, sf):
    d = table(spark, sf, "data_fields").where(F.col("tag") == "NH")
    return d.where(F.trim("data").try_cast("bigint") == 1).select("record_id").distinct()


@query("select record_id from alignments where read_name in (select read_name from alignments where flags & 1024 <> 0)")
def name_semi_join(spark, sf):
    a = _aln(spark, sf)
    names = a.where(flags.has(F.col("flags"), "is_duplicate")).select("read_name")
    return a.join(names, "read_name", "left_semi").select("record_id")


@query("select record_id from alignments where read_name not in (select read_name from alignments where flags & 1024 <> 0)")
def name_anti_join(spark, sf):
    a = _aln(spark, sf)
    names = a.where(flags.has(F.col("flags"), "is_duplicate")).select("read_name")
    return a.join(names, "read_name", "left_anti").select("record_id")


# joins --------------------------------------------------------------------------------------


@query(f"""
with a as (select record_id, reference_sequence_id as r, alignment_start as s, {_END} as e from alignments where alignment_start >= 1 and flags & 1796 = 0),
n as (select a.*, d.name from a join {_DICT} d on d.ref_id = a.r),
f as (select feature_id, reference_sequence_name as name, feature_start as s, feature_end as e from features where feature_start >= 1 and feature_end >= feature_start)
select n.record_id, f.feature_id from n join f on n.name = f.name and n.s <= f.e and f.s <= n.e""")
def overlap_join_binned(spark, sf):
    start, end = _ends()
    a = _aln(spark, sf).where(flags.is_piled(F.col("flags"))).select("record_id", F.col("reference_sequence_id").alias("ref_id"), start.alias("s"), end.alias("e"))
    a = a.join(_sequences(spark, sf), "ref_id")
    f = table(spark, sf, "features")
    pairs = overlap.overlap_join(a, f, left_on=("name", "s", "e"), right_on=("reference_sequence_name", "feature_start", "feature_end"), left_columns=["record_id"], right_columns=["feature_id"])
    return pairs.select("left.record_id", "right.feature_id")


@query("""
select v.variant_id, f.feature_id from variants v join features f on v.reference_sequence_name = f.reference_sequence_name
and v.variant_start >= 1 and f.feature_start >= 1 and f.feature_end >= f.feature_start and v.variant_start <= f.feature_end and f.feature_start <= v.variant_start + length(v.reference_bases) - 1""")
def overlap_join_variants_features(spark, sf):
    v = table(spark, sf, "variants").withColumn("e", variants.variant_end(F.col("variant_start"), F.col("reference_bases")))
    pairs = overlap.overlap_join(v, table(spark, sf, "features"), left_on=("reference_sequence_name", "variant_start", "e"), right_on=("reference_sequence_name", "feature_start", "feature_end"), left_columns=["variant_id"], right_columns=["feature_id"])
    return pairs.select("left.variant_id", "right.feature_id")


@query(f"select record_id, d.name, d.length from alignments a left join {_DICT} d on d.ref_id = a.reference_sequence_id")
def header_dictionary_join(spark, sf):
    a = _aln(spark, sf).select("record_id", F.col("reference_sequence_id").alias("ref_id"))
    return a.join(_sequences(spark, sf), "ref_id", "left").select("record_id", "name", "length")


@query(f"""
with a as (select read_name, record_id, flags, alignment_start as s, {_END} as e from alignments where flags & 2304 = 0 and flags & 1 <> 0 and alignment_start >= 1),
f as (select * from a where flags & 192 = 64), l as (select * from a where flags & 192 = 128)
select f.record_id as first_id, l.record_id as last_id,
  case when f.s <= l.s then 1 else -1 end * (greatest(f.e, l.e) - least(f.s, l.s) + 1) as first_length from f join l using (read_name)""")
def mate_pair_join(spark, sf):
    start, end = _ends()
    a = _aln(spark, sf).where(F.col("alignment_start") >= 1).withColumns({"s": start, "e": end})
    m = convert.mates(a, name="read_name", flags="flags", columns=["record_id", "s", "e"])
    size = convert.template_length(F.col("first.s"), F.col("first.e"), F.col("last.s"), F.col("last.e"), F.lit(True))
    return m.select(F.col("first.record_id").alias("first_id"), F.col("last.record_id").alias("last_id"), size.alias("first_length"))


# aggregates ---------------------------------------------------------------------------------

_FLAGSTAT_SQL = """
with a as (select flags as f, reference_sequence_id as r, mate_reference_sequence_id as m, case when mapping_quality <> 255 then mapping_quality end as q from alignments where flags is not null),
c as (select *, f & 2304 = 0 as p, f & 2304 = 0 and f & 1 <> 0 as pair, f & 4 = 0 as mapped from a),
b as (select *, pair and mapped and f & 8 = 0 as bt from c)
select f & 512 <> 0 as qc_fail, count(*) as "read", count_if(mapped)::bigint as mapped, count_if(f & 1024 <> 0)::bigint as duplicate, count_if(f & 256 <> 0)::bigint as secondary,
  count_if(f & 256 = 0 and f & 2048 <> 0)::bigint as supplementary, count_if(p)::bigint as "primary", count_if(p and mapped)::bigint as primary_mapped, count_if(p and f & 1024 <> 0)::bigint as primary_duplicate,
  count_if(pair)::bigint as paired, count_if(pair and f & 64 <> 0)::bigint as read_1, count_if(pair and f & 128 <> 0)::bigint as read_2, count_if(pair and mapped and f & 2 <> 0)::bigint as proper_pair,
  count_if(pair and mapped and f & 8 <> 0)::bigint as singleton, count_if(bt)::bigint as mate_mapped, count_if(bt and r is distinct from m)::bigint as mate_reference_mismatch,
  count_if(bt and r is distinct from m and (q is null or q >= 5))::bigint as mate_reference_mismatch_hq
from b group by 1"""


@query(_FLAGSTAT_SQL)
def flagstat(spark, sf):
    quality = F.when(F.col("mapping_quality") != 255, F.col("mapping_quality"))
    return statistics.flagstat(_aln(spark, sf), flags="flags", reference=F.col("reference_sequence_id"), mate_reference=F.col("mate_reference_sequence_id"), mapping_quality=quality)


@query(f"""
with s as ({_FLAGSTAT_SQL})
select qc_fail, case when "read" = 0 then 'N/A' else printf('%.2f%%', mapped * 100.0 / "read") end as mapped_share,
  case when "primary" = 0 then 'N/A' else printf('%.2f%%', primary_mapped * 100.0 / "primary") end as primary_mapped_share,
  case when paired = 0 then 'N/A' else printf('%.2f%%', proper_pair * 100.0 / paired) end as proper_pair_share,
  case when paired = 0 then 'N/A' else printf('%.2f%%', singleton * 100.0 / paired) end as singleton_share from s""")
def flagstat_percent(spark, sf):
    s, p, c = flagstat(spark, sf), statistics.percent, F.col
    return s.select("qc_fail", p(c("mapped"), c("read")).alias("mapped_share"), p(c("primary_mapped"), c("primary")).alias("primary_mapped_share"), p(c("proper_pair"), c("paired")).alias("proper_pair_share"), p(c("singleton"), c("paired")).alias("singleton_share"))


@query(f"""
with c as (select case when reference_sequence_id >= 0 then reference_sequence_id end as r, count_if(flags & 4 = 0)::bigint as m, count_if(flags & 4 <> 0)::bigint as u, count(*) as n from alignments group by 1)
select d.name, d.length, coalesce(c.m, 0) as mapped, coalesce(c.u, 0) as unmapped from {_DICT} d left join c on c.r = d.ref_id
union all select '*', 0, 0, n from c where r is null""")
def idxstats(spark, sf):
    return statistics.idxstats(_aln(spark, sf), _sequences(spark, sf), reference="reference_sequence_id", flags="flags", key="ref_id", name="name", length="length")


@query("select reference_sequence_id, count(*) as records from alignments group by 1")
def count_by_reference(spark, sf):
    return _aln(spark, sf).groupBy("reference_sequence_id").agg(F.count(F.lit(1)).alias("records"))


@query("select cast(sum(mapped) as bigint) as mapped from (select count(*) as mapped from alignments where flags & 4 = 0 and reference_sequence_id >= 0 group by reference_sequence_id)")
def count_mapped_metadata(spark, sf):
    return index_metadata(spark, sf).agg(F.sum("mapped").alias("mapped"))


_DEPTH_SQL = f"""
with a as (select reference_sequence_id as r, alignment_start as s, cigar, flags from alignments where reference_sequence_id is not null and alignment_start >= 1 and flags & 1796 = 0),
o as (select r, s, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) as op, generate_subscripts(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'), 1) as i, row_number() over () as dummy, cigar, rid from (select *, row_number() over () as rid from a)),
l as (select r, s, rid, i, right(op, 1) as k, cast(left(op, length(op) - 1) as bigint) as n from o),
b as (select r, k, n, s + coalesce(sum(case when k in ('M', 'D', 'N', '=', 'X') then n else 0 end) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as p from l),
e as (select r, p, 1 as d, 0 as a from b where k in ('M', '=', 'X') union all select r, p + n, -1, 0 from b where k in ('M', '=', 'X')
      union all select r, p, 0, 1 from b where k in ('M', 'D', 'N', '=', 'X') union all select r, p + n, 0, -1 from b where k in ('M', 'D', 'N', '=', 'X')),
g as (select r, p, sum(d) as d, sum(a) as a from e group by 1, 2),
w as (select r, p, sum(d) over (partition by r order by p) as depth, sum(a) over (partition by r order by p) as act, lead(p) over (partition by r order by p) as nxt from g),
z as (select r, cast(p as bigint) as p, cast(nxt as bigint) as nxt, cast(depth as bigint) as depth from w where act > 0)
"""


@query(_DEPTH_SQL + "select r as reference_sequence_id, cast(sum(nxt - p) as bigint) as positions, cast(sum((nxt - p) * depth) as bigint) as bases, max(depth) as greatest_depth, cast(sum(case when depth = 0 then nxt - p else 0 end) as bigint) as uncovered from z group by 1")
def depth_totals(spark, sf):
    runs = _depth(spark, sf)
    n = F.col("last_position") - F.col("first_position") + 1
    return runs.groupBy("reference_sequence_id").agg(F.sum(n).alias("positions"), F.sum(n * F.col("depth")).alias("bases"), F.max("depth").alias("greatest_depth"), F.coalesce(F.sum(F.when(F.col("depth") == 0, n)), F.lit(0)).alias("uncovered"))


def _depth(spark, sf):
    return depth.depth_runs(_aln(spark, sf), name="reference_sequence_id", start="alignment_start", cigar="cigar", flags="flags")


@query(_DEPTH_SQL + "select r as reference_sequence_id, unnest(generate_series(p, nxt - 1)) as position, depth from z")
def depth_per_position(spark, sf):
    return depth.per_position(_depth(spark, sf))


@query(_DEPTH_SQL + "select * from (select r as reference_sequence_id, unnest(generate_series(p, nxt - 1)) as position, depth from z where r = 7) where position between 20000 and 500000")
def depth_region(spark, sf):
    start, end = _ends()
    a = _aln(spark, sf).where((F.col("reference_sequence_id") == 7) & regions.overlaps_interval(start, end, 20000, 500000))
    runs = depth.depth_runs(a, name="reference_sequence_id", start="alignment_start", cigar="cigar", flags="flags")
    return depth.per_position(runs, lo=20000, hi=500000)


_BIN = "case " + " ".join(f"when (s - 1) >> {14 + 3 * (5 - lv)} = (e - 1) >> {14 + 3 * (5 - lv)} then {bins.first_bin(lv)} + ((s - 1) >> {14 + 3 * (5 - lv)})" for lv in range(5, 0, -1)) + " else 0 end"
_BINNED = f"(select *, cast({_BIN} as int) as bin from (select record_id, file_id, reference_sequence_id as ref, alignment_start as s, {_END} as e, flags from alignments where reference_sequence_id >= 0 and alignment_start >= 1))"


def _binned(spark, sf):
    return statistics.binned(_aln(spark, sf), reference="reference_sequence_id", start="alignment_start", cigar="cigar", offset="record_id")


@query(f"select record_id, bin from {_BINNED}")
def reg2bin_scalar(spark, sf):
    return _binned(spark, sf).select("record_id", "bin")


_BINS_LIST = "list_concat([0], " + ", ".join(f"range({bins.first_bin(lv)} + ((s - 1) >> {14 + 3 * (5 - lv)}), {bins.first_bin(lv)} + ((e - 1) >> {14 + 3 * (5 - lv)}) + 1)" for lv in range(1, 6)) + ")"


@query(f"select feature_id, cast(unnest({_BINS_LIST}) as int) as bin from (select feature_id, feature_start as s, feature_end as e from features where feature_start >= 1 and feature_end >= feature_start)")
def reg2bins_explode(spark, sf):
    f = table(spark, sf, "features").where((F.col("feature_start") >= 1) & (F.col("feature_end") >= F.col("feature_start")))
    return f.select("feature_id", F.explode(bins.reg2bins(F.col("feature_start"), F.col("feature_end"))).alias("bin"))


@query(f"""
with b as {_BINNED},
i as (select ref, bin, record_id, record_id - row_number() over (partition by ref, bin order by record_id) as island from b)
select ref, bin, min(record_id) as chunk_start, max(record_id) + 1 as chunk_end from i group by ref, bin, island""")
def index_bins(spark, sf):
    return statistics.index_chunks(_binned(spark, sf))


@query(f"select ref, w as \"window\", min(record_id) as min_offset from (select ref, record_id, unnest(range((s - 1) >> 14, cast(((e - 1) >> 14) + 1 as bigint))) as w from {_BINNED}) group by 1, 2")
def index_linear_windows(spark, sf):
    return statistics.linear_windows(_binned(spark, sf))


@query("select reference_sequence_id as ref, min(record_id) as first_offset, max(record_id) + 1 as end_offset, count_if(flags & 4 = 0)::bigint as mapped, count_if(flags & 4 <> 0)::bigint as unmapped from alignments where reference_sequence_id >= 0 group by 1")
def index_metadata(spark, sf):
    return statistics.index_metadata(_aln(spark, sf), reference="reference_sequence_id", flags="flags", offset="record_id")


@query("""
with c as (select distinct file_id, alignment_start as a, alignment_start + alignment_span as z from slices where alignment_start >= 0 and alignment_span > 0),
m as (select *, max(z) over (partition by file_id order by a, z rows between unbounded preceding and 1 preceding) as before from c),
g as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by file_id order by a, z rows unbounded preceding) as island from m)
select file_id, min(a) as chunk_start, max(z) as chunk_end from g group by file_id, island""")
def chunk_merge(spark, sf):
    s = table(spark, sf, "slices").where(F.col("alignment_start") >= 0).select("file_id", F.col("alignment_start").alias("chunk_start"), (F.col("alignment_start") + F.col("alignment_span")).alias("chunk_end"))
    return statistics.merged_chunks(s, ["file_id"])


@query(f"""
select file_id as slice, ref, min(s) as start, max(e) - min(s) + 1 as span, count(*) as records from {_BINNED} group by 1, 2""")
def slice_index(spark, sf):
    placed = _aln(spark, sf).where(F.col("alignment_start") >= 1)
    return statistics.slice_index(placed, slice_=F.col("file_id"), reference="reference_sequence_id", start="alignment_start", cigar="cigar")


@query("""
with p as (select file_id, record_id, (case when reference_sequence_id >= 0 then reference_sequence_id else 1099511627776 end, coalesce(alignment_start, 0)) as k from alignments)
select file_id as file, cast(sum(case when k < before then 1 else 0 end) as bigint) as unsorted from (select *, lag(k) over (partition by file_id order by record_id) as before from p) group by 1""")
def unsorted_records(spark, sf):
    return statistics.unsorted_records(_aln(spark, sf), file="file_id", offset="record_id", reference="reference_sequence_id", start="alignment_start", tile=1 << 12)


@query("select reference_sequence_name as name, min(variant_id) as first_offset from variants where reference_sequence_name is not null group by 1")
def names_in_order(spark, sf):
    return statistics.first_appearance(table(spark, sf, "variants"), "reference_sequence_name", "variant_id")


@query("""
select upper(a) as reference_base, upper(b) as read_base, count(*) as n from (
  select unnest(string_split(left(reference_bases, least(length(reference_bases), length(alternate_bases))), '')) as a, unnest(string_split(left(alternate_bases, least(length(reference_bases), length(alternate_bases))), '')) as b
  from variants where regexp_full_match(reference_bases, '[A-Za-z]+') and regexp_full_match(alternate_bases, '[A-Za-z]+')) where upper(a) <> upper(b) group by 1, 2""")
def substitution_histogram(spark, sf):
    v = table(spark, sf, "variants").where(F.col("reference_bases").rlike(r"^[A-Za-z]+\z") & F.col("alternate_bases").rlike(r"^[A-Za-z]+\z"))
    n = F.least(F.length("reference_bases"), F.length("alternate_bases"))
    pairs = v.select(F.explode(F.arrays_zip(F.split(F.left("reference_bases", n), "").alias("a"), F.split(F.left("alternate_bases", n), "").alias("b"))).alias("p")).select("p.a", "p.b")
    return statistics.substitutions(pairs, "a", "b")


# scalar functions ---------------------------------------------------------------------------


@query(rf"select record_id, nullif({_SPAN}, 0) as span, coalesce(list_sum([cast(x as bigint) for x in regexp_extract_all(cigar, '(\d+)[MIS=X]', 1)]), 0)::bigint as read_length, {_END}::bigint as alignment_end from alignments")
def cigar_lengths(spark, sf):
    c = F.col("cigar")
    return _aln(spark, sf).select("record_id", cg.reference_span(c).alias("span"), cg.read_length(c).alias("read_length"), cg.alignment_end(F.col("alignment_start"), c).alias("alignment_end"))


@query(r"select right(op, 1) as op, count(*) as n, cast(sum(cast(left(op, length(op) - 1) as bigint)) as bigint) as bases from (select unnest(regexp_extract_all(cigar, '\d+[MIDNSHP=X]')) as op from alignments) group by 1")
def cigar_ops_explode(spark, sf):
    ops = _aln(spark, sf).select(F.inline(cg.operations(F.col("cigar"))))
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))


@query(r"""
with o as (select record_id, unnest(regexp_extract_all(x, '\d+[MIDNSHP=X]')) as op, generate_subscripts(regexp_extract_all(x, '\d+[MIDNSHP=X]'), 1) as i from (select record_id, cigar || '2M3M1I' as x from alignments where cigar <> '*' and cigar <> '')),
l as (select record_id, i, right(op, 1) as k, cast(left(op, length(op) - 1) as int) as n from o),
g as (select *, sum(case when p is distinct from k then 1 else 0 end) over (partition by record_id order by i) as run from (select *, lag(k) over (partition by record_id order by i) as p from l)),
s as (select record_id, run, any_value(k) as k, sum(n) as n from g group by 1, 2)
select record_id, string_agg(n::varchar || k, '' order by run) as simplified from s group by 1""")
def cigar_simplify(spark, sf):
    a = _aln(spark, sf).where((F.col("cigar") != "*") & (F.col("cigar") != ""))
    return a.select("record_id", cg.text(cg.simplified(cg.operations(F.concat("cigar", F.lit("2M3M1I"))))).alias("simplified"))


@query(f"select record_id, {_COMP.format('seq')} as complement, reverse({_COMP.format('seq')}) as reverse_complement, md5(regexp_replace(upper(seq), '[^!-~]', '', 'g')) as digest from alignments")
def bases_complement_digest(spark, sf):
    s = F.col("seq")
    return _aln(spark, sf).select("record_id", bases.complement(s).alias("complement"), bases.reverse_complement(s).alias("reverse_complement"), bases.normalised_md5(s).alias("digest"))


@query("""
select record_id, cast(list_sum([ascii(x) - 33 for x in string_split(quality_scores, '')]) as bigint) as score_sum, round(list_avg([ascii(x) - 33 for x in string_split(quality_scores, '')]), 6) as score_mean
from alignments where quality_scores not in ('', '*')""")
def phred_sum_mean(spark, sf):
    a = _aln(spark, sf).where(~F.col("quality_scores").isin("", "*"))
    total = bases.score_total(F.col("quality_scores"))
    return a.select("record_id", total.alias("score_sum"), F.round(total / F.length("quality_scores"), 6).alias("score_mean"))


@query(f"""
select read_name as name, case when flags & 16 <> 0 then reverse({_COMP.format('seq')}) else seq end as sequence, case when flags & 16 <> 0 then reverse(quality_scores) else quality_scores end as quality
from alignments where flags & 2305 = 0""")
def reads_export(spark, sf):
    single = _aln(spark, sf).where(~flags.has(F.col("flags"), "is_segmented"))
    return convert.to_reads(single, name="read_name", flags="flags", seq="seq", quality="quality_scores")


@query(f"""
select record_id, (flags & 705) | 4 | case when flags & 1 <> 0 then 8 else 0 end as flags, case when flags & 16 <> 0 then reverse({_COMP.format('seq')}) else seq end as seq
from alignments where flags & 2304 = 0""")
def reset_alignments(spark, sf):
    return convert.reset(_aln(spark, sf), flags="flags", seq="seq", quality="quality_scores").select("record_id", "flags", "seq")


@query("""
with g as (select distinct read_group_id, read_group_name from read_groups)
select read_group_name, count(*) as records from alignments join g using (read_group_id) group by 1""")
def split_by_read_group(spark, sf):
    groups = table(spark, sf, "read_groups")
    known = _aln(spark, sf).join(groups.select("read_group_id").distinct(), "read_group_id", "left_semi")
    split = convert.split_by_group(known, groups, group="read_group_id", key="read_group_id", label="read_group_name")
    return split.groupBy("read_group_name").agg(F.count(F.lit(1)).alias("records"))


@query(" union all ".join(f"select file_id, epoch_us(loaded_at) as loaded_us from {t}" for t in ("alignments", "slices", "features")))
def cat_union(spark, sf):
    a, b, c = (table(spark, sf, t).select("file_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_us")) for t in ("alignments", "slices", "features"))
    return a.unionByName(b).unionByName(c)


# variants -----------------------------------------------------------------------------------


@query("select variant_id from variants where filters = 'PASS'")
def filter_pass(spark, sf):
    return table(spark, sf, "variants").where(variants.is_pass(variants.filters(F.col("filters")))).select("variant_id")


@query("select variant_id, unnest(case when alternate_bases is null or alternate_bases in ('', '.') then [] else string_split(alternate_bases, ',') end) as alternate from variants")
def alt_explode(spark, sf):
    return table(spark, sf, "variants").select("variant_id", F.explode(variants.alternate_bases(F.col("alternate_bases"))).alias("alternate"))


@query("select variant_id, unnest(case when ids is null or ids in ('', '.') then [] else string_split(ids, ';') end) as id from variants")
def ids_split(spark, sf):
    return table(spark, sf, "variants").select("variant_id", F.explode(variants.ids(F.col("ids"))).alias("id"))


_SVLEN = "(select variant_id, arg_max(trim(info), (loaded_at, info)) as v from info_fields where field_key = 'SVLEN' and info is not null group by 1)"


def _with_svlen(spark, sf):
    i = table(spark, sf, "info_fields").where((F.col("field_key") == "SVLEN") & F.col("info").isNotNull())
    last = i.groupBy("variant_id").agg(F.max_by(F.trim("info"), F.struct("loaded_at", "info")).alias("v"))
    return table(spark, sf, "variants").join(last, "variant_id", "left").withColumn("lengths", F.transform(F.split("v", ","), lambda x: x.try_cast("bigint")))


@query("select variant_id, variant_start + length(reference_bases) - 1 as variant_end from variants")
def variant_end_v43(spark, sf):
    return table(spark, sf, "variants").select("variant_id", variants.variant_end(F.col("variant_start"), F.col("reference_bases")).alias("variant_end"))


@query(f"""
select variant_id, variant_start + greatest(length(reference_bases), coalesce(list_max([abs(try_cast(x as bigint)) for x in string_split(s.v, ',')]), 0)) - 1 as variant_end
from variants left join {_SVLEN} s using (variant_id)""")
def variant_end_v45(spark, sf):
    e = variants.variant_end(F.col("variant_start"), F.col("reference_bases"), sv_lengths=F.col("lengths"), version=(4, 5))
    return _with_svlen(spark, sf).select("variant_id", e.alias("variant_end"))


@query("select variant_id from variants where reference_sequence_name = 'scf0000' and variant_start <= 2000000 and variant_start + length(reference_bases) - 1 >= 1000")
def variant_region_filter(spark, sf):
    r = regions.Region.parse("scf0000:1000-2000000")
    v = table(spark, sf, "variants")
    return overlap.region_filter(v, r, name="reference_sequence_name", start=F.col("variant_start"), end=variants.variant_end(F.col("variant_start"), F.col("reference_bases"))).select("variant_id")


@query("select feature_id from features where reference_sequence_name = 'scf0000' and feature_start <= 2000000 and feature_end >= 1000")
def feature_region_filter(spark, sf):
    r = regions.Region.parse("scf0000:1000-2000000")
    return overlap.region_filter(table(spark, sf, "features"), r, name="reference_sequence_name", start=F.col("feature_start"), end=F.col("feature_end")).select("feature_id")


_DP = "field_key = 'DP' and info is not null and regexp_full_match(trim(info), '-?[0-9]{1,9}')"


@query(f"select variant_id, cast(trim(info) as int) as dp, list_max([try_cast(trim(info) as bigint)]) % 2 = 0 as db, round(cast(trim(info) as int) / 1024.0, 6)::double as af from info_fields where {_DP}")
def info_get_typed(spark, sf):
    """Depths of the variants as INFO texts with a flag and a list derived from them."""
    depth = F.trim("info")
    i = table(spark, sf, "info_fields").where((F.col("field_key") == "DP") & F.col("info").isNotNull() & depth.rlike("^-?[0-9]{1,9}$"))
    text = F.concat(F.lit("DP="), depth, F.lit(";AF="), (depth.cast("int") / 1024).cast("decimal(20,10)").cast("string"), F.lit(",."), F.when(depth.cast("bigint") % 2 == 0, ";DB").otherwise(""))
    v = i.select("variant_id", variants.info_map(text).alias("m"))
    af = variants.info_value(F.col("m"), "AF", "A", "Float")
    return v.select("variant_id", variants.info_value(F.col("m"), "DP", "1", "Integer").alias("dp"), variants.info_value(F.col("m"), "DB", "0", "Flag").alias("db"), F.round(F.get(af, F.lit(0)).cast("double"), 6).alias("af"))


# the tables have no samples: genotypes by the number of the variant
_VAR_SQL = "(select variant_id as k, case variant_id % 4 when 0 then '0|1' when 1 then '0/1' when 2 then './.' else '1' end as gt from variants)"


def _var(spark, sf):
    k = F.col("variant_id")
    gt = F.when(k % 4 == 0, "0|1").when(k % 4 == 1, "0/1").when(k % 4 == 2, "./.").otherwise("1")
    return table(spark, sf, "variants").select(k.alias("k"), gt.alias("gt"))


@query(f"""
select k, case when gt = '1' then 1 else 2 end as alleles, case gt when '0|1' then 1 when '0/1' then 1 when '1' then 1 else 0 end as alternates, gt in ('0|1', '1') as phased from {_VAR_SQL}""")
def genotype_parse(spark, sf):
    g = variants.genotype(F.col("gt"))
    return _var(spark, sf).select("k", F.size(g).alias("alleles"), F.size(F.filter(g, lambda c: c["allele"] > 0)).alias("alternates"), F.forall(g, lambda c: c["phased"]).alias("phased"))


@query(f"select k, sample, case sample when 0 then gt else '0/0' end as gt, case sample when 0 then k % 97 else null end as gq from {_VAR_SQL}, (values (0), (1)) s(sample)")
def samples_wide_to_long(spark, sf):
    v = _var(spark, sf).withColumn("samples", F.array(F.concat("gt", F.lit(":"), (F.col("k") % 97).cast("string")), F.lit("0/0")))
    long = v.select("k", F.posexplode("samples").alias("sample", "text")).withColumn("m", variants.sample_map(F.lit("GT:GQ"), F.col("text")))
    return long.select("k", "sample", F.col("m")["GT"].alias("gt"), F.col("m")["GQ"].try_cast("bigint").alias("gq"))


# attributes ---------------------------------------------------------------------------------

_GTF_LINES = "(select line_id, string_split(regexp_replace(line, '\\r$', ''), chr(9)) as f from feature_lines where line is not null and not starts_with(line, '#'))"


@query(f"""select line_id, regexp_extract(f[9], 'gene_id +"([^"]*)"', 1) as gene_id from {_GTF_LINES} where len(f) = 9 and regexp_matches(f[9], '(^|; *)gene_id +"[^"\\\\]+"')""")
def gtf_attributes_get(spark, sf):
    text = F.regexp_replace("line", r"\r\z", "")
    lines = table(spark, sf, "feature_lines").where(~F.col("line").startswith("#")).select("line_id", F.split(text, "\t").alias("f")).where(F.size("f") == 9)
    has = lines.where(F.col("f")[8].rlike(r'(^|; *)gene_id +"[^"\\]+"'))
    return has.select("line_id", F.get(F.try_element_at(at.gtf_attributes(F.col("f")[8]), F.lit("gene_id")), F.lit(0)).alias("gene_id"))


@query("select feature_id, 'f' || feature_id::varchar as id, coalesce(feature_name, '') || ';=' as note, 2 as aliases from features")
def gff_attributes_get(spark, sf):
    f = table(spark, sf, "features")
    text = F.concat(F.lit("ID=f"), F.col("feature_id").cast("string"), F.lit(";Note="), at.percent_encoded(F.concat(F.coalesce("feature_name", F.lit("")), F.lit(";=")), at.FEATURE_RESERVED), F.lit(";Alias=a,b%2Cc;ID=other"))
    m = at.gff_attributes(text)
    return f.select("feature_id", m["ID"][0].alias("id"), m["Note"][0].alias("note"), F.size(m["Alias"]).alias("aliases"))


@query("""select line_id, replace(replace(replace(replace(line, '%', '%25'), ';', '%3B'), '=', '%3D'), ',', '%2C') as encoded, line as decoded from feature_lines where line is not null and regexp_full_match(line, '[\t -~]*')""")
def percent_coding(spark, sf):
    """Whole lines of printable characters, encoded and decoded again; tabs apart, which are encoded too."""
    lines = table(spark, sf, "feature_lines").where(F.col("line").rlike(r"^[\t -~]*\z"))
    coded = at.percent_encoded(F.col("line"))
    return lines.select("line_id", F.replace(coded, F.lit("%09"), F.lit("\t")).alias("encoded"), at.percent_decoded(coded).alias("decoded"))


# coordinates and offsets --------------------------------------------------------------------


@query("""select feature_id, case when feature_end is null then reference_sequence_name || ':' || feature_start::varchar else reference_sequence_name || ':' || feature_start::varchar || '-' || feature_end::varchar end as region,
  reference_sequence_name as name, feature_start as start, feature_end as "end" from features where feature_start >= 1 and (feature_end is null or feature_end >= 1)""")
def region_text_roundtrip(spark, sf):
    f = table(spark, sf, "features").where((F.col("feature_start") >= 1) & (F.col("feature_end").isNull() | (F.col("feature_end") >= 1)))
    f = f.withColumn("region", regions.region_text(F.col("reference_sequence_name"), F.col("feature_start"), F.col("feature_end")))
    return f.withColumn("r", regions.region_columns(F.col("region"))).select("feature_id", "region", "r.name", "r.start", "r.end")


@query("""select feature_id, concat_ws(chr(9), reference_sequence_name, (feature_start - 1)::varchar, feature_end::varchar, coalesce(feature_name, '.'), coalesce(score, 0)::varchar, coalesce(strand, '.')) as line
from features where feature_start >= 1 and feature_end >= feature_start""")
def bed_lines(spark, sf):
    from strandline.sources import text

    f = table(spark, sf, "features").where((F.col("feature_start") >= 1) & (F.col("feature_end") >= F.col("feature_start")))
    line = text.bed_line(F.col("reference_sequence_name"), F.col("feature_start"), F.col("feature_end"), F.col("feature_name"), F.col("score"), F.col("strand"))
    return f.select("feature_id", line.alias("line"))


@query("select reference_sequence_id, 100 + (sequence_length // 2) // 80 * 81 + (sequence_length // 2) % 80 as byte from reference_sequences")
def fai_offset(spark, sf):
    s = table(spark, sf, "reference_sequences")
    middle = F.floor(F.col("sequence_length") / 2).cast("bigint") + 1
    return s.select("reference_sequence_id", offsets.fai_offset(F.lit(100).cast("bigint"), F.lit(80), F.lit(81), middle).alias("byte"))


@query("select record_id, case when length(seq) >= 12 then substr(seq, 3, 10) end as part, case when length(seq) > 10 then left(seq, 10) || chr(10) || substr(seq, 11, 10) || case when length(seq) > 20 then chr(10) || substr(seq, 21, 10) else '' end || case when length(seq) > 30 then chr(10) || substr(seq, 31) else '' end else seq end as wrapped from alignments")
def subsequence_and_wrap(spark, sf):
    s = F.col("seq")
    return _aln(spark, sf).select("record_id", bases.subsequence(s, F.lit(3), F.lit(12)).alias("part"), bases.wrapped(s, 10).alias("wrapped"))


@query("select record_id, record_id * 1000 as coffset, cast(alignment_start % 65536 as int) as uoffset from alignments where alignment_start >= 0")
def virtual_position_roundtrip(spark, sf):
    a = _aln(spark, sf).where(F.col("alignment_start") >= 0)
    p = offsets.unpacked(offsets.virtual_position(F.col("record_id") * 1000, F.col("alignment_start") % 65536))
    return a.select("record_id", p["coffset"].alias("coffset"), p["uoffset"].alias("uoffset"))


@query(rf"""
select record_id, concat_ws(chr(9), case when read_name is null or read_name = '' then '*' else read_name end, flags::varchar, coalesce(d.name, '*'), greatest(coalesce(alignment_start, 0), 0)::varchar, coalesce(mapping_quality, 255)::varchar,
  case when cigar is null or cigar = '' then '*' else cigar end, case when m.name is null then '*' when m.name = d.name then '=' else m.name end, greatest(coalesce(mate_alignment_start, 0), 0)::varchar, coalesce(template_length, 0)::varchar,
  case when seq is null or seq = '' then '*' else seq end, case when quality_scores is null or quality_scores = '' then '*' else quality_scores end) as line
from alignments a left join {_DICT} d on d.ref_id = a.reference_sequence_id left join {_DICT} m on m.ref_id = a.mate_reference_sequence_id""")
def sam_lines(spark, sf):
    from strandline.sources import text

    s = _sequences(spark, sf)
    mate = s.select(F.col("ref_id").alias("mate_id"), F.col("name").alias("mate_rname"))
    a = _aln(spark, sf).join(s, F.col("reference_sequence_id") == F.col("ref_id"), "left").join(mate, F.col("mate_reference_sequence_id") == F.col("mate_id"), "left")
    named = a.select("record_id", F.col("read_name").alias("qname"), "flags", F.col("name").alias("rname"), F.col("alignment_start").alias("pos"), F.col("mapping_quality").alias("mapq"), "cigar", "mate_rname", F.col("mate_alignment_start").alias("mate_pos"), F.col("template_length").alias("tlen"), "seq", F.col("quality_scores").alias("qual"))
    named = named.withColumnRenamed("qname", "name")
    return named.select("record_id", text.sam_line(named).alias("line"))


_SAM_ROW_SQL = f"""
select a.record_id, flags, d.name as rname, case when alignment_start > 0 then alignment_start end as pos, case when mapping_quality <> 255 then mapping_quality end as mapq, case when cigar not in ('', '*') then cigar end as cigar,
  m.name as mate_rname, case when mate_alignment_start > 0 then mate_alignment_start end as mate_pos, coalesce(template_length, 0) as tlen, case when seq not in ('', '*') then seq end as seq,
  case when quality_scores not in ('', '*') and length(quality_scores) = length(seq) then quality_scores end as qual
from alignments a left join {_DICT} d on d.ref_id = a.reference_sequence_id left join {_DICT} m on m.ref_id = a.mate_reference_sequence_id"""


def _typed_alignments(spark, sf):
    """The table's records as typed alignment rows, named by their id; scores of another length than the bases are missing."""
    s = _sequences(spark, sf)
    mate = s.select(F.col("ref_id").alias("mate_id"), F.col("name").alias("mate_rname"))
    a = _aln(spark, sf).join(s, F.col("reference_sequence_id") == F.col("ref_id"), "left").join(mate, F.col("mate_reference_sequence_id") == F.col("mate_id"), "left")
    text_of = lambda c: F.when(~F.col(c).isin("", "*"), F.col(c))
    above = lambda c: F.when(F.col(c) > 0, F.col(c))
    return a.select(
        F.col("record_id").cast("string").alias("name"), "flags", F.col("name").alias("rname"), above("alignment_start").alias("pos"), F.when(F.col("mapping_quality") != 255, F.col("mapping_quality")).alias("mapq"), text_of("cigar").alias("cigar"), "mate_rname",
        above("mate_alignment_start").alias("mate_pos"), F.coalesce("template_length", F.lit(0)).alias("tlen"), text_of("seq").alias("seq"), F.when(F.length("quality_scores") == F.length("seq"), text_of("quality_scores")).alias("qual"),
    )


def _by_id(df):
    return df.select(F.col("name").cast("bigint").alias("record_id"), *[c for c in df.columns if c not in ("name", "tags", "file")])


@query(_SAM_ROW_SQL)
def sam_text_roundtrip(spark, sf):
    from strandline.sources import text

    rows = _typed_alignments(spark, sf)
    return _by_id(text.sam_columns(rows.select(text.sam_line(rows).alias("value"))))


def _header(spark, sf):
    """The dictionary as a header: one record per reference, collected (as any header is)."""
    from strandline.sources.headers import SamHeader

    refs = _sequences(spark, sf).orderBy("ref_id").collect()
    return SamHeader(sequences={r["name"]: {"SN": r["name"], "LN": str(r["length"])} for r in refs})


def _through_files(spark, sf, fmt):
    from strandline.sources import alignments

    rows = _typed_alignments(spark, sf).withColumn("tags", F.lit(None).cast(f"map<string,{tags.TAG_STRUCT}>"))
    folder = scratch(spark, fmt)
    alignments.write_alignments(rows, folder, _header(spark, sf), fmt=fmt)
    return _by_id(alignments.read_alignments(spark, folder))


@query(_SAM_ROW_SQL)
def bam_file_roundtrip(spark, sf):
    return _through_files(spark, sf, "bam")


_MERGED = r"""
o as (select record_id, unnest(regexp_extract_all(replace(replace(cigar, '=', 'M'), 'X', 'M'), '\d+[MIDNSHP]')) as op, generate_subscripts(regexp_extract_all(replace(replace(cigar, '=', 'M'), 'X', 'M'), '\d+[MIDNSHP]'), 1) as i from alignments where flags & 4 = 0),
l as (select record_id, i, right(op, 1) as k, cast(left(op, length(op) - 1) as int) as n from o where cast(left(op, length(op) - 1) as int) > 0),
g as (select *, sum(case when p is distinct from k then 1 else 0 end) over (partition by record_id order by i) as run from (select *, lag(k) over (partition by record_id order by i) as p from l)),
r as (select record_id, run, any_value(k) as k, sum(n) as n from g group by 1, 2),
merged as (select record_id, string_agg(n::varchar || k, '' order by run) as cigar from r group by 1)"""


@query(
    f"with {_MERGED}"
    + _SAM_ROW_SQL.replace("case when mapping_quality <> 255 then", "case when mapping_quality <> 255 and flags & 4 = 0 then").replace("case when cigar not in ('', '*') then cigar end as cigar", "w.cigar")
    + " left join merged w on w.record_id = a.record_id"
)
def cram_file_roundtrip(spark, sf):
    """An unmapped record keeps neither CIGAR nor mapping quality in this format, and ``=`` and ``X`` come back as ``M``."""
    return _through_files(spark, sf, "cram")


@query("""
select variant_id, reference_sequence_name as chrom, case when variant_start > 0 then variant_start end as pos, case when ids is null or ids in ('', '.') then 0 else len(string_split(ids, ';')) end as n_ids, reference_bases as ref,
  case when alternate_bases is null or alternate_bases in ('', '.') then 0 else len(string_split(alternate_bases, ',')) end as n_alt, quality_score as qual, coalesce(filters = 'PASS', false) as pass from variants""")
def vcf_text_roundtrip(spark, sf):
    from strandline.sources import text

    v = table(spark, sf, "variants")
    rows = v.select(
        F.col("reference_sequence_name").alias("chrom"), F.col("variant_start").alias("pos"), variants.ids(F.col("ids")).alias("ids"), F.col("reference_bases").alias("ref"), variants.alternate_bases(F.col("alternate_bases")).alias("alt"), F.col("quality_score").alias("qual"),
        variants.filters(F.col("filters")).alias("filters"), F.create_map(F.lit("VID"), F.col("variant_id").cast("string")).alias("info"),
    )
    back = text.vcf_columns(rows.select(text.vcf_line(rows).alias("value")))
    return back.select(variants.info_value(F.col("info"), "VID", "1", "String").cast("bigint").alias("variant_id"), "chrom", "pos", F.size("ids").alias("n_ids"), "ref", F.size("alt").alias("n_alt"), "qual", variants.is_pass(F.col("filters")).alias("pass"))


@query("""
select feature_id, reference_sequence_name as chrom, feature_start as start, feature_end as "end", case when feature_name not in ('', '.') then feature_name end as name, coalesce(score, 0) as score, case when strand in ('+', '-') then strand end as strand
from features where feature_start >= 1 and feature_end >= feature_start and (strand is null or strand in ('+', '-', '.', ''))""")
def bed_text_roundtrip(spark, sf):
    from strandline.sources import text

    f = table(spark, sf, "features").where((F.col("feature_start") >= 1) & (F.col("feature_end") >= F.col("feature_start")) & (F.col("strand").isNull() | F.col("strand").isin("+", "-", ".", "")))
    name = F.when(F.col("feature_name") != "", F.col("feature_name"))
    strand = F.when(F.col("strand") != "", F.col("strand"))
    line = F.concat_ws("\t", text.bed_line(F.col("reference_sequence_name"), F.col("feature_start"), F.col("feature_end"), name, F.col("score"), strand), F.col("feature_id").cast("string"))
    back = text.bed_columns(f.select(line.alias("value")))
    return back.select(back["other"][0].cast("bigint").alias("feature_id"), "chrom", "start", "end", "name", "score", "strand")


@query("""
select strftime(bin, '%Y-%m-%d %H:%M:%S') as event_window, event_type, n, total
from (select time_bucket(interval '1 hour', make_timestamp(epoch_us(ts))) as bin, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2)""")
def event_windows(spark, sf):
    from strandline.streaming import windows

    e = windows.windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), time="ts", key="event_type", value="value", width="1 hour")
    return e.select(F.date_format("event_window", "yyyy-MM-dd HH:mm:ss").alias("event_window"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
select strftime(bin - i * interval '30 minutes', '%Y-%m-%d %H:%M:%S') as event_window, event_type, count(*) as n, round(sum(value), 4) as total
from (select time_bucket(interval '30 minutes', make_timestamp(epoch_us(ts))) as bin, event_type, value from events), (values (0), (1)) s(i) group by 1, 2""")
def event_windows_sliding(spark, sf):
    from strandline.streaming import windows

    e = windows.windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), time="ts", key="event_type", value="value", width="1 hour", slide="30 minutes")
    return e.select(F.date_format("event_window", "yyyy-MM-dd HH:mm:ss").alias("event_window"), "event_type", "n", F.round("total", 4).alias("total"))
