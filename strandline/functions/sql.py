"""Domain functions for SQL: temporary functions whose bodies are expressions, so they stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandline.functions import bases, bins


def _reg2bin() -> str:
    tests = " ".join(f"WHEN shiftright(s - 1, {14 + 3 * (5 - lv)}) = shiftright(e - 1, {14 + 3 * (5 - lv)}) THEN {bins.first_bin(lv)} + shiftright(s - 1, {14 + 3 * (5 - lv)})" for lv in range(5, 0, -1))
    return f"CAST(CASE {tests} ELSE 0 END AS INT)"


def _total(kinds: str) -> str:
    return f"aggregate(regexp_extract_all(c, '([0-9]+)[{kinds}]', 1), 0L, (a, x) -> a + CAST(x AS BIGINT))"


_OPERATIONS = "transform(regexp_extract_all(c, '[0-9]+[MIDNSHP=X]', 0), t -> named_struct('len', CAST(left(t, length(t) - 1) AS INT), 'op', right(t, 1)))"
_JOINED = """aggregate(cigar_operations(c), CAST(array() AS ARRAY<STRUCT<len: INT, op: STRING>>), (a, x) -> CASE WHEN x.len = 0 THEN a
  WHEN size(a) > 0 AND get(a, size(a) - 1).op = x.op THEN concat(slice(a, 1, size(a) - 1), array(named_struct('len', get(a, size(a) - 1).len + x.len, 'op', x.op))) ELSE concat(a, array(x)) END)"""
_ALLELES = "regexp_extract_all(g, '([/|]?)([0-9]+|[.])', 0)"

FUNCTIONS = {
    "cigar_operations(c STRING) RETURNS ARRAY<STRUCT<len: INT, op: STRING>>": _OPERATIONS,
    "cigar_simplified(c STRING) RETURNS STRING": f"CASE WHEN size({_JOINED}) = 0 THEN '*' ELSE array_join(transform({_JOINED}, o -> concat(CAST(o.len AS STRING), o.op)), '') END",
    "genotype(g STRING) RETURNS ARRAY<STRUCT<allele: INT, phased: BOOLEAN>>": (
        f"transform({_ALLELES}, t -> named_struct('allele', try_cast(regexp_extract(t, '([0-9]+)', 1) AS INT), "
        f"'phased', CASE WHEN left(t, 1) IN ('/', '|') THEN left(t, 1) = '|' ELSE NOT exists(slice({_ALLELES}, 2, greatest(size({_ALLELES}), 1)), u -> left(u, 1) = '/') END))"
    ),
    "info_entry(i STRING, k STRING) RETURNS STRING": "try_element_at(str_to_map(i, ';', '='), k)",
    "base_modification_codes(mm STRING) RETURNS ARRAY<STRING>": "transform(filter(split(mm, ';'), g -> g <> ''), g -> regexp_extract(g, '^[A-Z][+-]([a-z]+|[0-9]+)', 1))",
    "cigar_span(c STRING) RETURNS BIGINT": f"nullif({_total('MDN=X')}, 0L)",
    "cigar_read_length(c STRING) RETURNS BIGINT": _total("MIS=X"),
    "reg2bin(s BIGINT, e BIGINT) RETURNS INT": _reg2bin(),
    "has_flag(f INT, bit INT) RETURNS BOOLEAN": "(f & bit) <> 0",
    "is_piled(f INT) RETURNS BOOLEAN": "(f & 1796) = 0",
    "complement(s STRING) RETURNS STRING": f"translate(s, '{bases.FORWARD}', '{bases.COMPLEMENT}')",
    "reverse_complement(s STRING) RETURNS STRING": f"reverse(translate(s, '{bases.FORWARD}', '{bases.COMPLEMENT}'))",
    "intervals_overlap(s1 BIGINT, e1 BIGINT, s2 BIGINT, e2 BIGINT) RETURNS BOOLEAN": "(s1 IS NULL OR e2 IS NULL OR s1 <= e2) AND (s2 IS NULL OR e1 IS NULL OR s2 <= e1)",
    "normalised_md5(s STRING) RETURNS STRING": "md5(regexp_replace(upper(s), '[^!-~]', ''))",
}


def register(spark: SparkSession) -> None:
    """Create (or replace) the functions in the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
