"""Alignment tags ``TG:T:value`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_STRUCT = "struct<type:string,i:bigint,f:float,s:string,ai:array<bigint>,af:array<float>>"


def _value(ty: Column, raw: Column) -> Column:
    subtype, items = F.substring(raw, 1, 1), F.slice(F.split(raw, ","), F.lit(2), F.greatest(F.size(F.split(raw, ",")), F.lit(1)))
    whole, real = (ty == "B") & (subtype != "f"), (ty == "B") & (subtype == "f")
    return F.struct(
        F.when(ty == "B", F.concat(ty, subtype)).otherwise(ty).alias("type"),
        F.when(ty == "i", raw.try_cast("bigint")).alias("i"),
        F.when(ty == "f", raw.try_cast("float")).alias("f"),
        F.when(ty.isin("A", "Z", "H"), raw).alias("s"),
        F.when(whole, F.transform(items, lambda v: v.try_cast("bigint"))).alias("ai"),
        F.when(real, F.transform(items, lambda v: v.try_cast("float"))).alias("af"),
    )


def tag_map(fields: Column) -> Column:
    """``map<string, TAG_STRUCT>`` of an array of tag texts; a repeated tag raises."""
    return F.map_from_entries(F.transform(fields, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), _value(F.substring(t, 4, 1), F.substr(t, F.lit(6))).alias("v"))))


def tag_text(tags: Column) -> Column:
    """Array of the texts of a tag map."""

    def one(e: Column) -> Column:
        v = e["value"]
        items = F.coalesce(F.array_join(v["ai"].cast("array<string>"), ","), F.array_join(v["af"].cast("array<string>"), ","))
        text = F.coalesce(v["i"].cast("string"), v["f"].cast("string"), v["s"], F.concat(F.right(v["type"], F.lit(1)), F.when(items != "", F.concat(F.lit(","), items)).otherwise("")))
        return F.concat(e["key"], F.lit(":"), F.left(v["type"], F.lit(1)), F.lit(":"), text)

    return F.transform(F.map_entries(tags), one)


def is_hex(text: Column) -> Column:
    return text.rlike(r"^(?:[0-9A-F]{2})*+\z")


def integer_tag(tags: Column, tag: str) -> Column:
    """An integer tag; NULL where it is missing, an error where it has another type."""
    v = F.try_element_at(tags, F.lit(tag))
    return F.when(v.isNull(), F.lit(None).cast("bigint")).when(v["type"] == "i", v["i"]).otherwise(F.raise_error(F.concat(F.lit(f"{tag} is no integer: "), v["type"])).cast("bigint"))


def _typed(ty: str, value: Column) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(ty).alias("type"),
        (value if ty == "i" else null).cast("bigint").alias("i"),
        (value if ty == "f" else null).cast("float").alias("f"),
        (value if ty in "AZH" else null).cast("string").alias("s"),
        (value if ty[0] == "B" and ty[1] != "f" else null).cast("array<bigint>").alias("ai"),
        (value if ty == "Bf" else null).cast("array<float>").alias("af"),
    )


def with_tag(tags: Column, tag: str, ty: str, value: Column) -> Column:
    """A tag map with a tag set to a value of type ``i``, ``f``, ``A``, ``Z``, ``H`` or ``B`` and a subtype; one that is there is replaced in its place."""
    new = _typed(ty, value)
    kept = F.coalesce(tags, F.expr(f"cast(map() as map<string,{TAG_STRUCT}>)"))
    replaced = F.transform_values(kept, lambda k, v: F.when(k == tag, new).otherwise(v))
    return F.when(F.map_contains_key(kept, tag), replaced).otherwise(F.map_concat(kept, F.create_map(F.lit(tag), new)))


def without_tag(tags: Column, tag: str) -> Column:
    """A tag map without a tag, in the same order."""
    return F.map_filter(tags, lambda k, v: k != tag)
