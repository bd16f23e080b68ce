"""Queries that write the tables of the domain to files of every format and read them back, whole or by region, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import attributes as at
from strandline.functions import modifications, tags, validate, variants
from strandline.plans.catalogue import _DEPTH_SQL, _DICT, _END, _SAM_ROW_SQL, _SPAN, _by_id, _header, _sequences, _typed_alignments
from strandline.session import scratch, table
from strandline.sources import alignments, bam, bgzf, blocked_text, cram, entropy, headers, indexing, storage, text
from strandline.sources import variants as vs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FILES = 4


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# alignments by region -----------------------------------------------------------------------

_PLACED = "reference_sequence_id >= 0 and d.name is not null and alignment_start >= 1"
_REGION = (20000, 500000)


def _sorted_header(spark: SparkSession, sf: str) -> headers.SamHeader:
    h = _header(spark, sf)
    h.hd = {"VN": "1.6", "SO": "coordinate"}
    return headers.SamHeader.parse(str(h))


def _placed(spark: SparkSession, sf: str, header: headers.SamHeader) -> DataFrame:
    """Alignments with a position, sorted as the dictionary and cut into ``FILES`` sorted partitions."""
    rows = _typed_alignments(spark, sf).where(F.col("rname").isNotNull() & F.col("pos").isNotNull()).withColumn("tags", F.lit(None).cast(f"map<string,{tags.TAG_STRUCT}>"))
    place = F.array_position(F.array(*[F.lit(n) for n in header.sequences]), F.col("rname"))
    return rows.withColumn("_place", place).repartitionByRange(FILES, "_place", "pos").sortWithinPartitions("_place", "pos").drop("_place")


def _region_name(spark: SparkSession, sf: str) -> str:
    return _sequences(spark, sf).where("ref_id = 7").first()["name"]


_BY_REGION = f"""
select a.record_id, alignment_start as pos, case when cigar not in ('', '*') then cigar end as cigar from alignments a join {_DICT} d on d.ref_id = a.reference_sequence_id
where {_PLACED} and d.name = (select name from {_DICT} where ref_id = 7) and alignment_start <= {_REGION[1]} and {_END} >= {_REGION[0]}"""


def _by_region(spark: SparkSession, sf: str, fmt: str, kind: str) -> DataFrame:
    header, folder = _sorted_header(spark, sf), scratch(spark, fmt)
    alignments.write_alignments(_placed(spark, sf, header), folder, header, fmt=fmt)
    indexing.build(spark, folder, kind)
    found = alignments.read_alignments(spark, folder, region=f"{_region_name(spark, sf)}:{_REGION[0]}-{_REGION[1]}")
    return found.select(F.col("name").cast("bigint").alias("record_id"), "pos", "cigar")


@query(_BY_REGION)
def bam_region_bai(spark, sf):
    return _by_region(spark, sf, "bam", "bai")


@query(_BY_REGION)
def bam_region_csi(spark, sf):
    return _by_region(spark, sf, "bam", "bam.csi")


@query(_BY_REGION)
def sam_gz_region_tbi(spark, sf):
    return _by_region(spark, sf, "sam.gz", "sam.tbi")


@query(_BY_REGION)
def sam_gz_region_csi(spark, sf):
    return _by_region(spark, sf, "sam.gz", "sam.csi")


@query(_BY_REGION.replace("case when cigar not in ('', '*') then cigar end as cigar", f"case when flags & 4 = 0 then nullif({_SPAN}, 0) end as span").replace(f"{_END} >=", f"case when flags & 4 = 0 then {_END} else alignment_start end >="))
def cram_region_crai(spark, sf):
    """An unmapped record keeps no CIGAR in this format, so it overlaps with its position alone."""
    from strandline.functions.cigar import reference_span

    return _by_region(spark, sf, "cram", "crai").select("record_id", "pos", reference_span(F.col("cigar")).alias("span"))


# whole alignment files ----------------------------------------------------------------------


def _files_back(spark: SparkSession, sf: str, fmt: str, **how) -> DataFrame:
    rows = _typed_alignments(spark, sf).withColumn("tags", F.lit(None).cast(f"map<string,{tags.TAG_STRUCT}>"))
    folder = scratch(spark, fmt.replace(".", ""))
    if how:
        cram.write_cram(rows, folder, _header(spark, sf), **how)
    else:
        alignments.write_alignments(rows, folder, _header(spark, sf), fmt=fmt)
    return alignments.read_alignments(spark, folder)


@query(_SAM_ROW_SQL)
def sam_file_roundtrip(spark, sf):
    """Files of text with a header; the names read back must be in its dictionary."""
    return _by_id(text.in_dictionary(_files_back(spark, sf, "sam"), _header(spark, sf)))


@query(_SAM_ROW_SQL)
def sam_gz_file_roundtrip(spark, sf):
    return _by_id(_files_back(spark, sf, "sam.gz"))


_CRAM_COUNT = f"""
select d.name as rname, flags, count(*) as records, cast(sum(case when flags & 4 = 0 then {_SPAN} else 0 end) as bigint) as span, cast(sum(case when seq not in ('', '*') then length(seq) else 0 end) as bigint) as bases,
  min(md5(coalesce(case when seq not in ('', '*') then seq end, '*'))) as first_digest, max(md5(coalesce(case when quality_scores not in ('', '*') and length(quality_scores) = length(seq) then quality_scores end, '*'))) as last_digest
from alignments a left join {_DICT} d on d.ref_id = a.reference_sequence_id group by all"""


def _cram_counts(df: DataFrame) -> DataFrame:
    from strandline.functions.cigar import reference_span

    span = F.coalesce(reference_span(F.col("cigar")), F.lit(0).cast("bigint"))
    return df.groupBy("rname", "flags").agg(
        F.count(F.lit(1)).alias("records"), F.sum(span).alias("span"), F.sum(F.coalesce(F.length("seq"), F.lit(0)).cast("bigint")).alias("bases"), F.min(F.md5(F.coalesce("seq", F.lit("*")))).alias("first_digest"), F.max(F.md5(F.coalesce("qual", F.lit("*")))).alias("last_digest")
    )


@query(_CRAM_COUNT)
def cram_rans4_roundtrip(spark, sf):
    return _cram_counts(_files_back(spark, sf, "cram", method=entropy.RANS4))


@query(_CRAM_COUNT)
def cram_rans16_roundtrip(spark, sf):
    return _cram_counts(_files_back(spark, sf, "cram", method=entropy.RANS16))


@query(_CRAM_COUNT)
def cram_lzma_roundtrip(spark, sf):
    return _cram_counts(_files_back(spark, sf, "cram", method=entropy.LZMA))


@query("select record_id from alignments where flags & 4 <> 0")
def cram_unmapped(spark, sf):
    return _files_back(spark, sf, "cram").where(F.col("flags").bitwiseAND(4) != 0).select(F.col("name").cast("bigint").alias("record_id"))


@query("select record_id, count(*) as copies from (select record_id from alignments union all select record_id from alignments) group by 1")
def bam_concatenated_reheaded(spark, sf):
    """Two files of all records joined into one under a header with a further comment."""
    folder, header = scratch(spark, "cat"), _header(spark, sf)
    rows = _typed_alignments(spark, sf).withColumn("tags", F.lit(None).cast(f"map<string,{tags.TAG_STRUCT}>")).coalesce(1)
    for part in ("a", "b"):
        bam.write_bam(rows, f"{folder}/{part}", header)
    storage.make_folder(f"{folder}/out")
    bam.concatenate([p for part in ("a", "b") for p in storage.listed(f"{folder}/{part}", (".bam",))], f"{folder}/out/c.bam")
    header.comments.append("joined")
    header.add_program("strandline")
    bam.reheader(f"{folder}/out/c.bam", header, f"{folder}/out/d.bam")
    if not bam.quickcheck(f"{folder}/out/d.bam"):
        raise ValueError("the joined file is not complete")
    back = bam.read_bam(spark, f"{folder}/out/d.bam")
    return back.groupBy(F.col("name").cast("bigint").alias("record_id")).agg(F.count(F.lit(1)).alias("copies"))


_PER_REFERENCE = f"""
select d.name, count_if(flags & 4 = 0)::bigint as mapped, count_if(flags & 4 <> 0)::bigint as unmapped from alignments a join {_DICT} d on d.ref_id = a.reference_sequence_id where {_PLACED} group by 1"""


@query(_PER_REFERENCE)
def bai_metadata(spark, sf):
    """Counts of the index files, added up over the files."""
    header, folder = _sorted_header(spark, sf), scratch(spark, "bai")
    bam.write_bam(_placed(spark, sf, header), folder, header)
    indexing.build(spark, folder, "bai")
    names = spark.createDataFrame(list(enumerate(header.sequences)), "ref_id bigint, name string")
    s = indexing.summary(spark, folder, (".bam",)).drop("name").join(names, "ref_id")
    return s.groupBy("name").agg(F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped")).where("mapped + unmapped > 0")


@query(f"select d.ref_id, d.name, d.length from {_DICT} d")
def sam_header_dictionary(spark, sf):
    """The dictionary through the text of a header and its binary form."""
    h = headers.SamHeader.parse(str(_sorted_header(spark, sf)))
    ids = {r["name"]: r["ref_id"] for r in _sequences(spark, sf).select("name", "ref_id").collect()}
    return spark.createDataFrame([(ids[n], n, int(f["LN"])) for n, f in h.sequences.items()], "ref_id int, name string, length bigint")


@query("select distinct read_group_id, read_group_name from read_groups where read_group_name is not null")
def sam_header_read_groups(spark, sf):
    """Read groups as header records, with a field for their id."""
    rows = table(spark, sf, "read_groups").where("read_group_name is not null").select("read_group_id", "read_group_name").distinct().collect()
    names = {f"{r['read_group_id']}.{r['read_group_name']}": r for r in rows}
    h = headers.SamHeader.parse("@HD\tVN:1.6\n" + "".join(f"@RG\tID:{k}\tPU:{r['read_group_id']}\tSM:{r['read_group_name']}\n" for k, r in names.items()))
    return spark.createDataFrame([(int(f["PU"]), f["SM"]) for f in headers.SamHeader.parse(str(h)).groups.values()], "read_group_id int, read_group_name string")


# variants -----------------------------------------------------------------------------------

_GOOD_VARIANT = "variant_start >= 1 and reference_sequence_name is not null and reference_bases is not null and reference_bases not in ('', '.')"
_VARIANT = (1000, 2000000)


def _vcf_header(spark: SparkSession, sf: str) -> headers.VcfHeader:
    """INFO records of the declared keys, and a contig per sequence of the variants (collected, as any header is)."""
    h = headers.VcfHeader.parse("##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n")
    for r in table(spark, sf, "field_definitions").where("record_kind = 'info'").orderBy("field_key").collect():
        h.insert("INFO", {"ID": r["field_key"], "Number": r["value_count"], "Type": r["value_type"], "Description": "x"})
    h.insert("INFO", {"ID": "VID", "Number": "1", "Type": "String", "Description": "number of the variant"})
    v = table(spark, sf, "variants")
    for r in v.where("filters is not null and filters not in ('', '.', 'PASS')").select(F.explode(F.split("filters", ";")).alias("f")).distinct().orderBy("f").collect():
        if r["f"] != "PASS":
            h.insert("FILTER", {"ID": r["f"], "Description": "x"})
    for r in v.where("reference_sequence_name is not null").select("reference_sequence_name").distinct().orderBy("reference_sequence_name").collect():
        h.insert("contig", {"ID": r[0]})
    return headers.VcfHeader.parse(str(h))


def _variant_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Variants with a position, sorted by sequence and position in ``FILES`` partitions; their INFO holds their number."""
    v = table(spark, sf, "variants").where(_GOOD_VARIANT)
    rows = v.select(
        F.col("reference_sequence_name").alias("chrom"), F.col("variant_start").alias("pos"), variants.ids(F.col("ids")).alias("ids"), F.col("reference_bases").alias("ref"), variants.alternate_bases(F.col("alternate_bases")).alias("alt"), F.col("quality_score").alias("qual"),
        variants.filters(F.col("filters")).alias("filters"), F.create_map(F.lit("VID"), F.col("variant_id").cast("string")).alias("info"), F.lit(None).cast("array<string>").alias("format"), F.lit(None).cast("array<map<string,string>>").alias("samples"),
    )
    return rows.repartitionByRange(FILES, "chrom", "pos").sortWithinPartitions("chrom", "pos")


def _vid() -> Column:
    return variants.info_value(F.col("info"), "VID", "1", "String").cast("bigint").alias("variant_id")


_VARIANT_ROW = f"""
select variant_id, reference_sequence_name as chrom, variant_start as pos, case when ids is null or ids in ('', '.') then 0 else len(string_split(ids, ';')) end as n_ids, reference_bases as ref,
  case when alternate_bases is null or alternate_bases in ('', '.') then 0 else len(string_split(alternate_bases, ',')) end as n_alt, quality_score as qual, coalesce(filters = 'PASS', false) as pass from variants where {_GOOD_VARIANT}"""


def _variants_back(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    folder = scratch(spark, fmt.replace(".", ""))
    vs.write_variants(_variant_rows(spark, sf), folder, _vcf_header(spark, sf), fmt=fmt)
    back = vs.read_variants(spark, folder)
    return back.select(_vid(), "chrom", "pos", F.size("ids").alias("n_ids"), "ref", F.size("alt").alias("n_alt"), "qual", variants.is_pass(F.col("filters")).alias("pass"))


@query(_VARIANT_ROW)
def vcf_file_roundtrip(spark, sf):
    return _variants_back(spark, sf, "vcf")


@query(_VARIANT_ROW)
def vcf_gz_file_roundtrip(spark, sf):
    return _variants_back(spark, sf, "vcf.gz")


@query(_VARIANT_ROW)
def bcf_file_roundtrip(spark, sf):
    return _variants_back(spark, sf, "bcf")


_VARIANT_REGION = f"select variant_id from variants where {_GOOD_VARIANT} and reference_sequence_name = 'scf0000' and variant_start <= {_VARIANT[1]} and variant_start + length(reference_bases) - 1 >= {_VARIANT[0]}"


def _variant_region(spark: SparkSession, sf: str, fmt: str, kind: str) -> DataFrame:
    folder = scratch(spark, fmt.replace(".", ""))
    vs.write_variants(_variant_rows(spark, sf), folder, _vcf_header(spark, sf), fmt=fmt)
    indexing.build(spark, folder, kind)
    return vs.read_variants(spark, folder, region=f"scf0000:{_VARIANT[0]}-{_VARIANT[1]}").select(_vid())


@query(_VARIANT_REGION)
def vcf_gz_region_tbi(spark, sf):
    return _variant_region(spark, sf, "vcf.gz", "vcf.tbi")


@query(_VARIANT_REGION)
def vcf_gz_region_csi(spark, sf):
    return _variant_region(spark, sf, "vcf.gz", "vcf.csi")


@query(_VARIANT_REGION)
def bcf_region_csi(spark, sf):
    return _variant_region(spark, sf, "bcf", "bcf.csi")


@query(f"select variant_id from variants where {_GOOD_VARIANT} and reference_sequence_name = 'scf0000' and variant_start between {_VARIANT[0]} and {_VARIANT[1]}")
def indexed_fields_region(spark, sf):
    """Lines by the fields that the index names: of a variant these are its sequence and first position."""
    folder = scratch(spark, "fields")
    vs.write_variants(_variant_rows(spark, sf), folder, _vcf_header(spark, sf), fmt="vcf.gz")
    indexing.build(spark, folder, "vcf.tbi")
    found = blocked_text.read_indexed_fields(spark, folder, f"scf0000:{_VARIANT[0]}-{_VARIANT[1]}")
    return found.select(F.regexp_extract(F.get("fields", F.lit(7)), r"VID=(\d+)", 1).cast("bigint").alias("variant_id"))


@query(f"select reference_sequence_name as name, count(*) as records from variants where {_GOOD_VARIANT} group by 1")
def tbi_names(spark, sf):
    """Names and counts that the index files hold, added up over the files."""
    folder = scratch(spark, "tbi")
    vs.write_variants(_variant_rows(spark, sf), folder, _vcf_header(spark, sf), fmt="vcf.gz")
    indexing.build(spark, folder, "vcf.tbi")
    return indexing.summary(spark, folder, (".gz",)).groupBy("name").agg(F.sum("mapped").alias("records"))


@query("select field_key, value_count as number, value_type as type from field_definitions where record_kind = 'info'")
def vcf_header_definitions(spark, sf):
    h = _vcf_header(spark, sf)
    rows = [(k, *h.type_of("INFO", k)) for k in h.records["INFO"] if k != "VID"]
    return spark.createDataFrame(rows, "field_key string, number string, type string")


_INFO_ONE = "info is not null and info not in ('', '.') and info not like '%;%' and info not like '%=%' and field_key in (select field_key from field_definitions where record_kind = 'info')"


def _info_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable INFO row as the text of a record's INFO field."""
    keys = table(spark, sf, "field_definitions").where("record_kind = 'info'").select("field_key")
    rows = table(spark, sf, "info_fields").where("info is not null and info not in ('', '.') and info not like '%;%' and info not like '%=%'").join(F.broadcast(keys), "field_key", "left_semi")
    return rows.withColumn("text", F.concat("field_key", F.lit("="), "info"))


@query(f"""
select variant_id, field_key, case field_key when 'DP' then try_cast(info as int) when 'NS' then try_cast(info as int) end as whole, case field_key when 'MQ' then round(try_cast(info as float)::double, 3) when 'BQ' then round(try_cast(info as float)::double, 3) end as real,
  case field_key when 'AC' then len(string_split(info, ',')) when 'CIPOS' then len(string_split(info, ',')) end as elements from info_fields
where {_INFO_ONE} and field_key in ('DP', 'NS', 'MQ', 'BQ', 'AC', 'CIPOS') and (field_key not in ('DP', 'NS') or regexp_full_match(info, '-?[0-9]+')) and (field_key not in ('MQ', 'BQ') or regexp_full_match(info, '-?[0-9]+([.][0-9]+)?'))""")
def info_typed_by_header(spark, sf):
    """INFO columns in the types that the header declares."""
    rows = _info_lines(spark, sf).where("field_key in ('DP', 'NS', 'MQ', 'BQ', 'AC', 'CIPOS') and (field_key not in ('DP', 'NS') or info rlike '^-?[0-9]+$') and (field_key not in ('MQ', 'BQ') or info rlike '^-?[0-9]+([.][0-9]+)?$')")
    df = vs.typed_info(rows.select("variant_id", "field_key", variants.info_map(F.col("text")).alias("info")), _vcf_header(spark, sf), ["DP", "NS", "MQ", "BQ", "AC", "CIPOS"])
    return df.select("variant_id", "field_key", F.coalesce("DP", "NS").alias("whole"), F.round(F.coalesce("MQ", "BQ").cast("double"), 3).alias("real"), F.when(F.col("AC").isNotNull(), F.size("AC")).when(F.col("CIPOS").isNotNull(), F.size("CIPOS")).alias("elements"))


@query(f"select variant_id, field_key, 'NEW=7;' || field_key || '=' || info as with_new, case when field_key = 'DP' then 'DP=1' else field_key || '=' || info || ';DP=1' end as with_depth, '.' as without from info_fields where {_INFO_ONE} and field_key <> 'NEW'")
def info_edits(spark, sf):
    m = variants.info_map(F.col("text"))
    new = variants.info_map(F.concat(F.lit("NEW=1;"), "text"))
    key = F.col("field_key")
    without = F.map_filter(m, lambda k, v: k != key)
    rows = _info_lines(spark, sf)
    return rows.select(
        "variant_id", "field_key", variants.info_text(variants.with_info(new, "NEW", F.lit(7))).alias("with_new"), variants.info_text(variants.with_info(m, "DP", F.lit(1))).alias("with_depth"), variants.info_text(without).alias("without")
    )


@query("""
with v as (select variant_id, case variant_id % 5 when 0 then '0|1' when 1 then '0/1' when 2 then './.' when 3 then '|1/2|3' else '1' end as gt from variants)
select variant_id, case gt when '1' then '1' when '|1/2|3' then '1/2|3' else gt end as short, case gt when '0|1' then '|0|1' when '0/1' then '/0/1' when './.' then '/./.' when '1' then '|1' else gt end as long from v""")
def genotype_text_roundtrip(spark, sf):
    k = F.col("variant_id") % 5
    gt = F.when(k == 0, "0|1").when(k == 1, "0/1").when(k == 2, "./.").when(k == 3, "|1/2|3").otherwise("1")
    calls = variants.genotype(gt)
    return table(spark, sf, "variants").select("variant_id", variants.genotype_text(calls, first_mark=False).alias("short"), variants.genotype_text(calls, first_mark=True).alias("long"))


# features -----------------------------------------------------------------------------------

_GOOD_FEATURE = "feature_start >= 1 and feature_end >= feature_start and reference_sequence_name is not null"
_FEATURE_REGION = f"select feature_id from features where {_GOOD_FEATURE} and reference_sequence_name = 'ctg0007' and feature_start <= 200000 and feature_end >= 1000"


def _feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "features").where(_GOOD_FEATURE)
    rows = f.select(
        F.col("reference_sequence_name").alias("seqid"), F.lit("src").alias("source"), F.lit("gene").alias("type"), F.col("feature_start").alias("start"), F.col("feature_end").alias("end"), F.col("score").cast("float").alias("score"),
        F.when(F.col("strand").isin("+", "-"), F.col("strand")).alias("strand"), F.lit(None).cast("tinyint").alias("phase"), F.create_map(F.lit("ID"), F.array(F.col("feature_id").cast("string")), F.lit("Name"), F.array(F.coalesce("feature_name", F.lit("none")))).alias("attributes"),
    )
    return rows.repartitionByRange(FILES, "seqid", "start").sortWithinPartitions("seqid", "start")


_FEATURE_ROW = f"""
select feature_id, reference_sequence_name as seqid, feature_start as start, feature_end as "end", cast(score as double) as score, case when strand in ('+', '-') then strand end as strand, coalesce(feature_name, 'none') as name from features where {_GOOD_FEATURE}"""


def _feature_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("attributes")["ID"][0].cast("bigint").alias("feature_id"), "seqid", "start", "end", F.col("score").cast("double").alias("score"), "strand", F.col("attributes")["Name"][0].alias("name"))


@query(_FEATURE_ROW)
def gff_file_roundtrip(spark, sf):
    folder = scratch(spark, "gff") + "/out"
    text.write_features(_feature_rows(spark, sf), folder, "gff", directives=["##gff-version 3", "# features"])
    return _feature_columns(text.read_gff(spark, folder))


@query(_FEATURE_ROW)
def gtf_file_roundtrip(spark, sf):
    folder = scratch(spark, "gtf") + "/out"
    text.write_features(_feature_rows(spark, sf), folder, "gtf")
    return _feature_columns(text.read_gtf(spark, folder))


def _feature_region(spark: SparkSession, sf: str, preset: str, kind: str) -> DataFrame:
    folder, rows = scratch(spark, preset), _feature_rows(spark, sf)
    number = F.col("attributes")["ID"][0]
    line = text.feature_line(preset) if preset != "bed" else F.concat_ws("\t", text.bed_line(F.col("seqid"), F.col("start"), F.col("end")), number)
    blocked_text.write_lines(rows, line, folder, ending=f".{preset}.gz")
    indexing.build(spark, folder, kind)
    found = blocked_text.read_region(spark, folder, preset, "ctg0007:1000-200000")
    return found.select((found["other"][0] if preset == "bed" else found["attributes"]["ID"][0]).cast("bigint").alias("feature_id"))


@query(_FEATURE_REGION)
def bed_gz_region_tbi(spark, sf):
    return _feature_region(spark, sf, "bed", "bed.tbi")


@query(_FEATURE_REGION)
def gff_gz_region_csi(spark, sf):
    return _feature_region(spark, sf, "gff", "gff.csi")


@query(_FEATURE_REGION)
def gtf_gz_region_tbi(spark, sf):
    return _feature_region(spark, sf, "gtf", "gtf.tbi")


@query(f"select feature_id, reference_sequence_name as chrom, feature_start as start, feature_end as \"end\" from features where {_GOOD_FEATURE}")
def bed_file_roundtrip(spark, sf):
    folder = scratch(spark, "bed") + "/out"
    rows = _feature_rows(spark, sf)
    line = F.concat_ws("\t", text.bed_line(F.col("seqid"), F.col("start"), F.col("end")), F.col("attributes")["ID"][0])
    text.write_lines(rows, line, folder)
    back = text.read_bed(spark, folder, width=3)
    return back.select(back["other"][0].cast("bigint").alias("feature_id"), "chrom", "start", "end")


@query("select case when starts_with(line, '##') then 'directive' when starts_with(line, '#') then 'comment' else 'record' end as kind, count(*) as lines from feature_lines where line is not null group by 1")
def feature_line_kinds(spark, sf):
    return table(spark, sf, "feature_lines").where("line is not null").groupBy(text.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


@query("""
with d as (select regexp_replace(line, '\\r$', '') as l from feature_lines where starts_with(line, '##'))
select regexp_extract(l, '^##([^ \\t]+)', 1) as key, nullif(regexp_extract(l, '^##[^ \\t]+[ \\t]+(.*?)[ \\t]*$', 1), '') as value, count(*) as lines from d where regexp_extract(l, '^##([^ \\t]+)', 1) <> '' group by all""")
def directives(spark, sf):
    d = at.directive(F.regexp_replace("line", r"\r\z", ""))
    return table(spark, sf, "feature_lines").where(F.col("line").startswith("##")).select(d.alias("d")).where("d is not null").groupBy("d.key", "d.value").agg(F.count(F.lit(1)).alias("lines"))


# sequences and reads ------------------------------------------------------------------------

_HAS_BASES = "seq is not null and seq not in ('', '*')"


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "alignments").where(_HAS_BASES)
    return a.select(F.col("record_id").cast("string").alias("name"), F.lit("of a read").alias("description"), F.col("seq").alias("sequence"))


def _fasta(spark: SparkSession, sf: str) -> str:
    folder = scratch(spark, "fasta") + "/out"
    text.write_lines(_bases(spark, sf), text.fasta_text(20), folder)
    return folder


@query(f"select record_id, 'of a read' as description, seq as sequence, length(seq) as length from alignments where {_HAS_BASES}")
def fasta_file_roundtrip(spark, sf):
    back = text.read_fasta(spark, _fasta(spark, sf))
    return back.select(F.col("name").cast("bigint").alias("record_id"), "description", "sequence", "length")


@query(f"select record_id, substr(seq, 3, 20) as bases from alignments where {_HAS_BASES} and length(seq) >= 3")
def fasta_region_fetch(spark, sf):
    """Bases 3 to 22 of every sequence, by the byte offsets of an index."""
    long = _bases(spark, sf).where(F.length("sequence") >= 3)
    found = indexing.fetch(spark, _fasta(spark, sf), long.select(F.concat("name", F.lit(":3-22")).alias("region")))
    return found.select(F.split("region", ":")[0].cast("bigint").alias("record_id"), F.col("sequence").alias("bases"))


@query(f"select record_id, length(seq) as length, least(length(seq), 20) as line_bases, least(length(seq), 20) + 1 as line_width from alignments where {_HAS_BASES}")
def fasta_index(spark, sf):
    return indexing.fasta_index(spark, _fasta(spark, sf)).select(F.col("name").cast("bigint").alias("record_id"), "length", "line_bases", "line_width")


@query(f"select record_id, generate_subscripts(c, 1) - 1 as chunk, unnest(c) as bases from (select record_id, [substr(seq, 16 * i + 1, 16) for i in range(0, (length(seq) - 1) // 16 + 1)] as c from alignments where {_HAS_BASES})")
def sequence_chunks(spark, sf):
    chunks = text.sequence_chunks(_bases(spark, sf), 16)
    return chunks.select(F.col("name").cast("bigint").alias("record_id"), "chunk", "bases")


@query(f"select record_id, seq as sequence, quality_scores as quality from alignments where {_HAS_BASES} and quality_scores not in ('', '*') and length(quality_scores) = length(seq)")
def fastq_file_roundtrip(spark, sf):
    folder = scratch(spark, "fastq") + "/out"
    reads = table(spark, sf, "alignments").where(f"{_HAS_BASES} and quality_scores not in ('', '*') and length(quality_scores) = length(seq)")
    named = reads.select(F.col("record_id").cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.col("seq").alias("sequence"), F.col("quality_scores").alias("quality"))
    text.write_lines(named, text.fastq_text(), folder)
    return text.read_fastq(spark, folder).select(F.col("name").cast("bigint").alias("record_id"), "sequence", "quality")


@query("select line_id, regexp_replace(line, '\\r$', '') as line from feature_lines where line is not null and line not like '%' || chr(10) || '%'")
def blocked_lines_roundtrip(spark, sf):
    """Lines through block-compressed files that are cut by bytes."""
    folder = scratch(spark, "lines")
    lines = table(spark, sf, "feature_lines").where("line is not null and not contains(line, '\n')")
    blocked_text.write_lines(lines, F.concat_ws("\t", F.col("line_id").cast("string"), "line"), folder)
    back = blocked_text.read_lines(spark, folder)
    return back.select(F.substring_index("value", "\t", 1).cast("bigint").alias("line_id"), F.substr("value", F.instr("value", "\t") + 1).alias("line"))


@query("select record_id, seq from alignments where seq is not null")
def gzi_seek(spark, sf):
    """Every sequence at its uncompressed offset in one blocked file, by the file's index of blocks."""
    import numpy as np
    import pyarrow as pa

    folder = scratch(spark, "gzi")
    rows = table(spark, sf, "alignments").where("seq is not null").select("record_id", "seq").repartitionByRange(FILES, "record_id").sortWithinPartitions("record_id")
    storage.make_folder(folder)

    def write(batches):
        from pyspark import TaskContext

        path = f"{folder}/{TaskContext.get().partitionId()}.{TaskContext.get().taskAttemptId()}.gz"
        at = 0
        with storage.writing(path) as f:
            w = bgzf.Writer(f)
            for b in batches:
                seqs = b.column("seq").to_pylist()
                w.write("".join(seqs).encode())
                sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
                yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array([path] * len(seqs)), pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes)], ["record_id", "file", "offset", "size"])
                at += int(sizes.sum())
            w.close()
        with storage.writing(f"{path}.gzi") as f:
            f.write(bgzf.gzi_bytes(w.index))

    from strandline.session import checkpointed

    spots = checkpointed(rows.mapInArrow(write, "record_id bigint, file string, offset bigint, size bigint"))

    def read(batches):
        held: dict = {}
        for b in batches:
            out = []
            for file, offset, size in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "size"))):
                if file not in held:
                    with storage.reading(f"{file}.gzi") as f:
                        held = {file: (bgzf.parse_gzi(f.read()), storage.reading(file))}
                index, f = held[file]
                out.append(bgzf.read_at(f, index, offset, size).decode() if size else "")
            yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array(out, pa.string())], ["record_id", "seq"])

    return spots.mapInArrow(read, "record_id bigint, seq string")


@query(f"select record_id, name, description from (select record_id, record_id::varchar as name, nullif(coalesce(read_name, ''), '') as description from alignments where coalesce(read_name, '') not like '% %')")
def fasta_definitions(spark, sf):
    a = table(spark, sf, "alignments").where("coalesce(read_name, '') not like '% %'")
    line = F.concat(F.lit(">"), F.col("record_id").cast("string"), F.lit("  "), F.coalesce("read_name", F.lit("")))
    return a.select("record_id", at.definition(line).alias("d")).select("record_id", "d.name", "d.description")


# tags, modifications, names -----------------------------------------------------------------


@query("""
select record_id, tag || ':' || ty || ':' || data as text, tag || ':' || ty || ':' || data || '|XN:i:7' as added, case when tag = 'NH' then 'NH:i:3' else tag || ':' || ty || ':' || data || '|NH:i:3' end as replaced from data_fields
where (ty = 'i' and regexp_full_match(data, '-?[1-9][0-9]{0,8}')) or (ty in ('Z', 'A') and data <> '')""")
def tag_edits(spark, sf):
    """Tags as texts through typed maps, with one added, one replaced."""
    d = table(spark, sf, "data_fields").where("(ty = 'i' and data rlike '^-?[1-9][0-9]{0,8}$') or (ty in ('Z', 'A') and data <> '')")
    m = tags.tag_map(F.array(F.concat_ws(":", "tag", "ty", "data")))
    shown = lambda c: F.array_join(tags.tag_text(c), "|")
    return d.select("record_id", shown(tags.without_tag(tags.with_tag(m, "ZZ", "f", F.lit(0.5)), "ZZ")).alias("text"), shown(tags.with_tag(m, "XN", "i", F.lit(7))).alias("added"), shown(tags.with_tag(m, "NH", "i", F.lit(3))).alias("replaced"))


@query("select tag, count(*) as n, count_if(regexp_full_match(data, '([0-9A-F][0-9A-F])*'))::bigint as hex from data_fields where data is not null and tag is not null group by 1")
def tag_hex(spark, sf):
    d = table(spark, sf, "data_fields").where("data is not null and tag is not null")
    return d.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(tags.is_hex(F.col("data"))).alias("hex"))


@query(f"""
with p as (select record_id, flags & 16 <> 0 as r, seq, list_filter(generate_series(1, length(seq)), lambda i: seq[i] = case when flags & 16 <> 0 then 'G' else 'C' end) as c from alignments where {_HAS_BASES} and flags is not null)
select record_id, case when len(c) >= 3 then case when r then c[len(c)] else c[1] end - 1 end as first, case when len(c) >= 3 then case when r then c[len(c) - 2] else c[3] end - 1 end as second from p where len(c) >= 3""")
def base_modifications(spark, sf):
    """The first and the third cytosine of every read, counted along its original strand."""
    reverse = F.col("flags").bitwiseAND(16) != 0
    a = table(spark, sf, "alignments").where(f"{_HAS_BASES} and flags is not null")
    kind = F.when(reverse, F.lit("G")).otherwise(F.lit("C"))
    a = a.where(F.length("seq") - F.length(F.replace(F.col("seq"), kind, F.lit(""))) >= 3)
    g = F.get(modifications.groups(F.col("seq"), F.lit("C+m,0,1;"), reverse), F.lit(0))
    return a.select("record_id", F.get(g["positions"], F.lit(0)).alias("first"), F.get(g["positions"], F.lit(1)).alias("second"))


@query(r"""select record_id, coalesce(regexp_full_match(seq, '[A-Za-z=.]*'), false) as seq_ok, coalesce(regexp_full_match(quality_scores, '[!-~]*') and length(quality_scores) = length(seq), false) as quality_ok from alignments""")
def validated_fields(spark, sf):
    no = F.lit(False)
    return table(spark, sf, "alignments").select("record_id", F.coalesce(validate.is_sequence(F.col("seq")), no).alias("seq_ok"), F.coalesce(validate.is_quality(F.col("quality_scores"), F.col("seq")), no).alias("quality_ok"))


# streams ------------------------------------------------------------------------------------


@query(_SAM_ROW_SQL)
def streamed_sam_files(spark, sf):
    """Text files taken up as a stream, written by micro-batches and read again."""
    from strandline.streaming import files

    folder = scratch(spark, "stream")
    rows = _typed_alignments(spark, sf)
    text.write_lines(rows, text.sam_line(rows), f"{folder}/in")

    def batch(df: DataFrame, number: int) -> None:
        df.drop("tags", "_corrupt").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    files.write_batches(files.stream_lines(spark, f"{folder}/in", "sam"), batch, f"{folder}/state", available_now=True).awaitTermination()
    return _by_id(spark.read.parquet(f"{folder}/out").drop("batch"))


@query(f"select feature_id, reference_sequence_name as chrom, feature_start as start, feature_end as \"end\" from features where {_GOOD_FEATURE}")
def streamed_bed_files(spark, sf):
    from strandline.streaming import files

    folder = scratch(spark, "stream")
    rows = _feature_rows(spark, sf)
    line = F.concat_ws("\t", text.bed_line(F.col("seqid"), F.col("start"), F.col("end"), F.lit("n"), F.lit(0), F.col("strand")), F.col("attributes")["ID"][0])
    text.write_lines(rows, line, f"{folder}/in")
    files.write_batches(files.stream_lines(spark, f"{folder}/in", "bed", files_per_trigger=2), lambda df, n: df.select("chrom", "start", "end", "other").write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/state", available_now=True).awaitTermination()
    back = spark.read.parquet(f"{folder}/out")
    return back.select(back["other"][0].cast("bigint").alias("feature_id"), "chrom", "start", "end")


@query(_DEPTH_SQL + "select r as reference_sequence_id, unnest(generate_series(p, nxt - 1)) as position, depth from z")
def streamed_depth(spark, sf):
    """Depth per position, kept as the state of a stream of the alignments."""
    from strandline.streaming import windows

    folder = scratch(spark, "stream")
    source = table(spark, sf, "alignments").select("reference_sequence_id", "alignment_start", "cigar", "flags")
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    depth = windows.streamed_depth(stream, name="reference_sequence_id", start="alignment_start", cigar="cigar", flags="flags")
    done = depth.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    done.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _register_sql(spark: SparkSession) -> None:
    from strandline.functions import sql

    sql.register(spark)


@query(r"""
with o as (select record_id, unnest(regexp_extract_all(cigar, '\d+[MIDNSHP=X]')) as op from alignments)
select record_id, count(*) as operations, cast(sum(cast(left(op, length(op) - 1) as bigint)) as bigint) as lengths from o group by 1""")
def sql_cigar_functions(spark, sf):
    _register_sql(spark)
    a = table(spark, sf, "alignments").select("record_id", F.call_function("cigar_operations", F.col("cigar")).alias("o")).where(F.size("o") > 0)
    return a.select("record_id", F.size("o").cast("bigint").alias("operations"), F.aggregate("o", F.lit(0).cast("bigint"), lambda t, x: t + x["len"]).alias("lengths"))


# codecs and counts --------------------------------------------------------------------------


def _through_codec(rows: DataFrame, encode, decode) -> DataFrame:
    """``record_id`` and ``value`` through a codec, the values of a batch as one text with line feeds."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            body = "\n".join(b.column("value").to_pylist()).encode()
            back = decode(encode(body), len(body)).decode().split("\n")
            yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array(back, pa.string())], ["record_id", "value"])

    return rows.mapInArrow(run, "record_id bigint, value string")


_SCORED = "quality_scores is not null and quality_scores <> ''"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "alignments").where(_SCORED).select("record_id", F.col("quality_scores").alias("value"))


def _codec(method: int):
    return lambda spark, sf: _through_codec(_scores(spark, sf), lambda d: entropy.compress(method, d), lambda d, n: entropy.decompress(method, d, n))


for _name, _method in (("codec_rans4", entropy.RANS4), ("codec_rans16", entropy.RANS16), ("codec_range", entropy.RANGE), ("codec_bzip2", entropy.BZIP2)):
    QUERIES[_name] = _codec(_method)
    ORACLES[_name] = f"select record_id, quality_scores as value from alignments where {_SCORED}"


@query("select record_id, read_name as value from alignments where read_name is not null and read_name <> ''")
def codec_names(spark, sf):
    from strandline.sources import record_codecs

    rows = table(spark, sf, "alignments").where("read_name is not null and read_name <> ''").select("record_id", F.col("read_name").alias("value"))
    return _through_codec(rows, lambda d: record_codecs.names_encode(d.split(b"\n")), lambda d, n: record_codecs.names_decode(d).rstrip(b"\0").replace(b"\0", b"\n"))


@query("""
with p as (select distinct record_id, tag from data_fields where record_id is not null and tag is not null),
s as (select record_id, string_agg(tag, ',' order by tag) as tag_set from p group by 1) select tag_set, count(*) as records from s group by 1""")
def tag_sets(spark, sf):
    from strandline.operators import statistics

    return statistics.tag_sets(table(spark, sf, "data_fields"), record="record_id", tag="tag")


@query(f"select file_id, count(*) as records, cast(sum(length(seq)) as bigint) as bases from alignments where {_HAS_BASES} group by 1")
def base_counts(spark, sf):
    return table(spark, sf, "alignments").where(_HAS_BASES).groupBy("file_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("seq")).alias("bases"))


@query(f"select record_id, length(seq) as length, length(seq) + 1 as line_width, length(seq) + 3 as to_scores from alignments where {_HAS_BASES} and quality_scores not in ('', '*') and length(quality_scores) = length(seq)")
def fastq_index(spark, sf):
    """Index records of FASTQ files: how far the scores stand behind the bases."""
    from strandline.sources import sequences

    folder = scratch(spark, "fastqindex")
    reads = table(spark, sf, "alignments").where(f"{_HAS_BASES} and quality_scores not in ('', '*') and length(quality_scores) = length(seq)")
    named = reads.select(F.col("record_id").cast("string").alias("name"), F.lit("d").alias("description"), F.col("seq").alias("sequence"), F.col("quality_scores").alias("quality"))
    text.write_lines(named, text.fastq_text(), folder)
    rows = lambda p: [(n, length, offset, bases, width, scores) for n, length, offset, bases, width, scores in sequences.index_fastq(p)]
    found = indexing._per_file(spark, storage.listed(folder), rows, "name string, length bigint, position bigint, line_bases bigint, line_width bigint, scores bigint")
    return found.select(F.col("name").cast("bigint").alias("record_id"), "length", "line_width", (F.col("scores") - F.col("position")).alias("to_scores"))


_BIN_OF = "case " + " ".join(f"when (s - 1) >> {14 + 3 * (5 - lv)} = (e - 1) >> {14 + 3 * (5 - lv)} then {((1 << 3 * lv) - 1) // 7} + ((s - 1) >> {14 + 3 * (5 - lv)})" for lv in range(5, 0, -1)) + " else 0 end"


@query(f"select record_id, cast(case when s is null then 4680 else ({_BIN_OF}) & 65535 end as int) as bin from (select record_id, case when alignment_start >= 1 then alignment_start end as s, case when alignment_start >= 1 then {_END} end as e from alignments)")
def record_bins(spark, sf):
    """The 16-bit bin that a binary record stores."""
    from strandline.functions import bins
    from strandline.functions.cigar import alignment_end

    start = F.when(F.col("alignment_start") >= 1, F.col("alignment_start"))
    return table(spark, sf, "alignments").select("record_id", bins.bam_bin(start, alignment_end(start, F.col("cigar"))).alias("bin"))


@query(f"select a.record_id, substr(f.seq, 1, 5) as bases from alignments a join alignments f on f.record_id = a.record_id where f.{_HAS_BASES.replace(' and seq', ' and f.seq')}")
def reference_bases_join(spark, sf):
    """Sequences of a FASTA file joined to records by name."""
    a = table(spark, sf, "alignments").select("record_id", F.col("record_id").cast("string").alias("name"))
    return a.join(text.read_fasta(spark, _fasta(spark, sf)), "name").select("record_id", F.substring("sequence", 1, 5).alias("bases"))


@query(f"select record_id from alignments a join {_DICT} d on d.ref_id = a.reference_sequence_id where {_PLACED} and d.name = (select name from {_DICT} where ref_id = 7) and alignment_start <= {_REGION[1]} and {_END} >= {_REGION[0]}")
def streamed_region(spark, sf):
    """The records of a region out of a stream of files."""
    from strandline.functions.cigar import alignment_end
    from strandline.functions.regions import Region
    from strandline.streaming import files

    folder = scratch(spark, "stream")
    rows = _placed(spark, sf, _sorted_header(spark, sf))
    text.write_lines(rows, text.sam_line(rows), f"{folder}/in")
    region = Region.parse(f"{_region_name(spark, sf)}:{_REGION[0]}-{_REGION[1]}")
    stream = files.stream_lines(spark, f"{folder}/in", "sam").where(region.overlaps(F.col("rname"), F.col("pos"), alignment_end(F.col("pos"), F.col("cigar"))))
    files.write_batches(stream, lambda df, n: df.select("name").write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.schema("name string").parquet(f"{folder}/out").select(F.col("name").cast("bigint").alias("record_id"))
