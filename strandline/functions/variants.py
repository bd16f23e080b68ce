"""Variant fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _list(text: Column, sep: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | text.isin("", "."), empty).otherwise(F.split(text, sep))


def ids(text: Column) -> Column:
    return _list(text, ";")


def filters(text: Column) -> Column:
    return _list(text, ";")


def alternate_bases(text: Column) -> Column:
    return _list(text, ",")


def joined(values: Column, sep: str) -> Column:
    """The text of a list, ``.`` if it is missing or empty."""
    return F.when(values.isNull() | (F.size(values) == 0), ".").otherwise(F.array_join(values, sep, "."))


def is_pass(filter_list: Column) -> Column:
    """Exactly ``PASS``; no filters at all are not a pass."""
    return F.coalesce((F.size(filter_list) == 1) & (F.get(filter_list, F.lit(0)) == "PASS"), F.lit(False))


def info_map(text: Column) -> Column:
    """``map<string, string>`` of an INFO text; a key without a value (a flag) has NULL. Repeated keys raise."""
    fields = F.when(text.isNull() | text.isin("", "."), F.array().cast("array<string>")).otherwise(F.split(text, ";"))
    pair = lambda f: F.struct(F.substring_index(f, "=", 1).alias("k"), F.when(F.instr(f, "=") > 0, F.substr(f, F.instr(f, "=") + 1)).alias("v"))
    return F.map_from_entries(F.transform(F.filter(fields, lambda f: f != ""), pair))


#: Spark type of each declared type.
TYPES = {"Integer": "int", "Float": "float", "Flag": "boolean", "Character": "string", "String": "string"}


def info_value(info: Column, key: str, number: str, ty: str) -> Column:
    """A typed INFO value: a flag is its key's presence; ``.`` is missing; a number other than 1 gives an array."""
    raw = F.try_element_at(info, F.lit(key))
    if ty == "Flag":
        return F.map_contains_key(info, key)
    one = lambda v: F.when(v != ".", v).try_cast(TYPES[ty])
    if number == "1":
        return one(raw)
    return F.when(raw != ".", F.transform(F.split(raw, ","), one))


def with_info(info: Column, key: str, value: Column) -> Column:
    """An INFO map with a key set to a text (NULL: a flag); one that is there is replaced in its place."""
    kept = F.coalesce(info, F.expr("cast(map() as map<string,string>)"))
    new = value.cast("string")
    replaced = F.transform_values(kept, lambda k, v: F.when(k == key, new).otherwise(v))
    return F.when(F.map_contains_key(kept, key), replaced).otherwise(F.map_concat(kept, F.create_map(F.lit(key), new)))


def without_info(info: Column, key: str) -> Column:
    """An INFO map without a key, in the same order."""
    return F.map_filter(info, lambda k, v: k != key)


def info_text(info: Column) -> Column:
    """The text of an INFO map, ``.`` if it is missing or empty."""
    text = F.array_join(F.transform(F.map_entries(info), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return F.when(F.coalesce(F.size(info), F.lit(0)) > 0, text).otherwise(".")


def sample_map(format_: Column, sample: Column) -> Column:
    """``map<string, string>`` of a sample column; trailing fields may be left out, ``.`` is NULL."""
    keys, values = F.split(format_, ":"), F.split(sample, ":")
    entries = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.nullif(F.get(values, i), F.lit(".")).alias("v")))
    return F.when(sample != ".", F.map_from_entries(entries)).when(sample.isNotNull(), F.expr("cast(map() as map<string, string>)"))


_ALLELE = r"([/|]?)(\d+|\.)"


def genotype(text: Column) -> Column:
    """``array<struct<allele: int, phased: boolean>>``; a missing allele is NULL.

    The first allele's phasing, if not written, follows from the others: unphased if any of them is.
    """
    marks, alleles = F.regexp_extract_all(text, F.lit(_ALLELE), 1), F.regexp_extract_all(text, F.lit(_ALLELE), 2)
    implied = ~F.exists(F.slice(marks, F.lit(2), F.greatest(F.size(marks), F.lit(1))), lambda m: m == "/")
    return F.transform(
        F.arrays_zip(marks.alias("m"), alleles.alias("a")),
        lambda x: F.struct(x["a"].try_cast("int").alias("allele"), F.when(x["m"] == "", implied).otherwise(x["m"] == "|").alias("phased")),
    )


def genotype_text(calls: Column, *, first_mark: bool) -> Column:
    """The text of a genotype; versions before 4.4 leave out the first phasing mark."""
    mark = lambda c: F.when(c["phased"], "|").otherwise("/")
    allele = lambda c: F.coalesce(c["allele"].cast("string"), F.lit("."))
    return F.array_join(F.transform(calls, lambda c, i: F.concat(mark(c) if first_mark else F.when(i > 0, mark(c)).otherwise(""), allele(c))), "")


def variant_end(start: Column, reference: Column, *, end: Column | None = None, sv_lengths: Column | None = None, sample_lengths: Column | None = None, version: tuple[int, int] = (4, 3)) -> Column:
    """Last position: before 4.5 the INFO END if given, else the reference bases' end; from 4.5 the greatest span
    of the reference bases, ``sv_lengths`` and ``sample_lengths`` (arrays; NULL elements and signs don't count)."""
    span = F.length(reference).cast("bigint")
    if version < (4, 5):
        by_bases = start + span - 1
        return F.coalesce(end.cast("bigint"), by_bases) if end is not None else by_bases
    for lengths in (sv_lengths, sample_lengths):
        if lengths is not None:
            longest = F.array_max(F.transform(F.filter(lengths, lambda v: v.isNotNull()), lambda v: F.abs(v.cast("bigint"))))
            span = F.greatest(span, longest)
    return start + span - 1
