"""Attribute texts of features and percent coding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_decoded(text: Column) -> Column:
    """``%XX`` decoded as UTF-8; ``+`` stays, and a text with a malformed ``%`` comes out as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


#: The characters escaped in variant texts and in feature attributes.
VARIANT_RESERVED = "%:;=,\r\n\t"
FEATURE_RESERVED = "%;=&,\t\n\r"


def percent_encoded(text: Column, reserved: str = VARIANT_RESERVED) -> Column:
    """The reserved characters as ``%XX``, ``%`` first."""
    out = text
    for c in sorted(reserved, key=lambda c: c != "%"):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def gff_attributes(text: Column) -> Column:
    """``map<string, array<string>>`` of ``key=value[,value]`` fields parted by ``;``.

    Values are split at commas before decoding, so ``%2C`` stays in its element. NULL, empty and ``.`` give
    an empty map; of repeated keys the first counts; fields without ``=`` are left out.
    """
    fields = F.filter(F.split(text, ";"), lambda f: F.instr(f, "=") > 0)
    keys = F.transform(fields, lambda f: percent_decoded(F.trim(F.substring_index(f, "=", 1))))
    values = F.transform(fields, lambda f: F.transform(F.split(F.substr(f, F.instr(f, "=") + 1), ","), lambda v: percent_decoded(v)))
    return _first_of_each(F.when(text.isNull() | text.isin("", "."), None).otherwise(F.arrays_zip(keys.alias("k"), values.alias("v"))))


def _first_of_each(pairs: Column) -> Column:
    """Map of an array of ``k``/``v`` structs, the first of a repeated key."""
    empty = F.expr("cast(map() as map<string, array<string>>)")
    kept = F.aggregate(pairs, empty, lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    return F.coalesce(kept, empty)


_PAIR = r'([A-Za-z0-9_.-]+)[ \t]+(?:"((?:[^"\\]|\\.)*)"|([^ \t";]+))'


def _unescaped(v: Column) -> Column:
    return F.regexp_replace(v, r'\\(["\\])', "$1")


def gtf_attributes(text: Column) -> Column:
    """``map<string, array<string>>`` of ``key "value";`` fields; values of a repeated key in order, escapes resolved."""
    keys = F.regexp_extract_all(text, F.lit(_PAIR), 1)
    quoted, bare = F.regexp_extract_all(text, F.lit(_PAIR), 2), F.regexp_extract_all(text, F.lit(_PAIR), 3)
    pairs = F.arrays_zip(keys.alias("k"), F.zip_with(quoted, bare, lambda q, b: F.when(b != "", b).otherwise(_unescaped(q))).alias("v"))
    distinct = F.array_distinct(keys)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def gtf_text(attributes: Column) -> Column:
    """The text of a map of arrays, keys in the map's order."""
    quote = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('";'))
    fields = F.flatten(F.transform(F.map_entries(attributes), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(" "), quote(v)))))
    return F.array_join(fields, " ")


def gff_text(attributes: Column) -> Column:
    """The text of a map of arrays, percent-encoded; ``.`` if there are none."""
    enc = lambda v: percent_encoded(v, FEATURE_RESERVED)
    fields = F.transform(F.map_entries(attributes), lambda e: F.concat(enc(e["key"]), F.lit("="), F.array_join(F.transform(e["value"], enc), ",")))
    return F.when(F.size(attributes) > 0, F.array_join(fields, ";")).otherwise(".")


def directive(line: Column) -> Column:
    """Struct ``key``/``value`` of a ``##key value`` line (``value`` NULL if absent); NULL for other lines."""
    key, value = F.regexp_extract(line, r"^##(\S+)", 1), F.regexp_extract(line, r"^##\S+\s+(.*?)\s*$", 1)
    return F.when(line.startswith("##") & (key != ""), F.struct(key.alias("key"), F.nullif(value, F.lit("")).alias("value")))


def definition(line: Column, mark: str = ">") -> Column:
    """Struct ``name``/``description`` of a definition line, cut at the first blank."""
    body = F.regexp_replace(line, f"^{mark}", "")
    rest = F.regexp_extract(body, r"^\S+\s+(.*)$", 1)
    return F.struct(F.regexp_extract(body, r"^(\S*)", 1).alias("name"), F.nullif(rest, F.lit("")).alias("description"))
