"""Attribute-value rows into wide typed tables, by column-block pivoting.

The rows are read once. They are first reduced to one row per entity and attribute (combined on the
map side and spread by both, so an entity that holds most of the rows is in no single task), and then
exchanged once by entity. Inside that partitioning nothing moves any more: the declared attributes are divided into
blocks of about the square root of their number, every block is pivoted by an aggregation by entity
and block, and the blocks of an entity are joined side by side by an aggregation by entity. A row so
meets the columns of its own block only, and a block only its peers, however many attributes there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]+\z"
FLOAT = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"

#: State of a value: missing values are neither valid nor invalid.
MISSING, INVALID, VALID = 0, 1, 2


@dataclass(frozen=True)
class Attribute:
    """A declared attribute: its key, its count (``1``, another number, ``A``, ``.``) and its type."""

    key: str
    value_count: str = "1"
    value_type: str = "String"

    @property
    def is_flag(self) -> bool:
        return self.value_type == "Flag"

    @property
    def is_list(self) -> bool:
        return not self.is_flag and self.value_count != "1"

    def _element_valid(self, v: Column) -> Column:
        match self.value_type:
            case "Integer":
                n = v.try_cast("bigint")
                return v.rlike(INTEGER) & n.isNotNull() & n.between(-(2**31), 2**31 - 1)
            case "Float":
                return v.rlike(FLOAT)
            case "Character":
                return F.char_length(v) == 1
        return F.lit(True)

    def _element(self, v: Column) -> Column:
        match self.value_type:
            case "Integer":
                return v.try_cast("int")
            case "Float":
                return v.try_cast("double")
        return v

    @property
    def form(self) -> str:
        """What the check of a value depends on, as text."""
        return "Flag" if self.is_flag else self.value_type + ("[]" if self.is_list else "")

    def state(self, raw: Column) -> Column:
        """``MISSING``, ``INVALID`` or ``VALID`` for a raw value."""
        v = F.trim(raw)
        if self.is_flag:
            return F.when(v.isNull() | (v == ""), VALID).otherwise(INVALID)
        if self.is_list:
            ok = F.forall(F.split(v, ","), lambda e: (e == ".") | F.coalesce(self._element_valid(e), F.lit(False)))
        else:
            ok = F.coalesce(self._element_valid(v), F.lit(False))
        return F.when(v.isNull() | v.isin("", "."), MISSING).when(ok, VALID).otherwise(INVALID)

    def typed(self, raw: Column) -> Column:
        """The value of a valid raw value; ``.`` inside a list is a NULL element."""
        v = F.trim(raw)
        if self.is_flag:
            return F.lit(True)
        if self.is_list:
            return F.transform(F.split(v, ","), lambda e: F.when(e != ".", self._element(e)))
        return self._element(v)


def attributes(definitions: DataFrame, kind: str | None = None) -> list[Attribute]:
    """The declarations of ``kind``, one per key; the number of keys is that of the columns to come."""
    if kind is not None:
        definitions = definitions.where(F.col("record_kind") == kind)
    rows = (
        definitions.where(F.col("field_key").isNotNull())
        .groupBy("field_key")
        .agg(F.min(F.struct(F.coalesce("value_count", F.lit("1")).alias("c"), F.coalesce("value_type", F.lit("String")).alias("t"))).alias("d"))
        .orderBy("field_key")
        .collect()
    )
    return [Attribute(r.field_key, r.d.c, r.d.t) for r in rows]


def _cells(rows: DataFrame, declared: Sequence[Attribute], size: int, entity: str, attribute: str, value: str, order: str | None) -> DataFrame:
    """One row per entity ``_e`` and key ``_k``: best state ``_s``, winning raw value ``_v`` (NULL if none is valid), block ``_b`` and place in it ``_i``."""
    rank = F.col(order) if order else F.lit(None).cast("timestamp")
    base = rows.select(F.col(entity).alias("_e"), F.col(attribute).alias("_k"), F.col(value).alias("_v"), rank.alias("_o"))
    base = base.where(F.col("_e").isNotNull() & F.col("_k").isNotNull())
    # the declarations, as many as the result has columns, are held by every task
    held = [(a.key, n // size, n % size, a.form) for n, a in enumerate(declared)]
    base = base.join(F.broadcast(rows.sparkSession.createDataFrame(held, "_k string, _b int, _i int, _f string")), "_k", "left")
    text = F.trim("_v")
    state = F.when(F.col("_f").isNull(), F.when(text.isNull() | text.isin("", "."), MISSING).otherwise(VALID))
    for form, a in {a.form: a for a in declared}.items():
        state = state.when(F.col("_f") == form, a.state(F.col("_v")))
    valid = F.col("_s") == VALID
    best = F.max_by(F.when(valid, F.coalesce("_v", F.lit(""))), F.when(valid, F.struct("_o", "_v")))
    return base.withColumn("_s", state).groupBy("_e", "_k").agg(F.max("_s").alias("_s"), best.alias("_v"), F.max("_b").alias("_b"), F.max("_i").alias("_i"))


def pivot_blocks(
    rows: DataFrame,
    declared: Sequence[Attribute],
    *,
    entity: str,
    attribute: str,
    value: str,
    order: str | None = None,
    block_size: int | None = None,
    extras: bool = True,
) -> DataFrame:
    """One row per entity of ``rows``: a typed column for every declared attribute.

    Of several valid values of a cell the one with the greatest ``order`` wins, ties go to
    the greatest raw value; invalid and missing values never displace a valid one. Further columns:

    * ``_invalid``: sorted keys whose cell is empty although an invalid value was given,
    * ``_extras`` (if ``extras``): map of undeclared keys to their latest non-missing value as given.

    Rows with a NULL entity or key are left out; other columns of ``rows`` are ignored.
    An entity with only such or undeclared rows still comes out, with NULL cells. Keys are
    compared as written. An empty input gives no rows. A declared key may not be named like
    the entity column, ``_invalid`` or ``_extras``. ``block_size``: attributes per block.
    """
    taken = {entity, "_invalid", "_extras"} & {a.key for a in declared}
    if taken:
        raise ValueError(f"declared keys clash with output columns: {sorted(taken)}")
    size = block_size or max(1, math.ceil(math.sqrt(len(declared))))
    blocks = range(math.ceil(len(declared) / size))
    cells = _cells(rows, declared, size, entity, attribute, value, order)
    # the one exchange by entity; whatever follows groups by entity first and stays in its partitions
    placed = cells.repartition("_e")
    slots = [F.first(F.when(F.col("_i") == i, F.col("_v")), ignorenulls=True).alias(f"v{i}") for i in range(size)]
    unusable = F.collect_list(F.when(F.col("_s") == INVALID, F.col("_k"))).alias("_bad")
    other = F.collect_list(F.when(F.col("_b").isNull() & F.col("_v").isNotNull(), F.struct("_k", "_v"))).alias("_other")
    pivoted = placed.groupBy("_e", "_b").agg(*slots, unusable, other)
    pivoted = pivoted.select("_e", "_b", F.struct(*[f"v{i}" for i in range(size)]).alias("_block"), "_bad", "_other")
    joined = pivoted.groupBy("_e").agg(
        *[F.first(F.when(F.col("_b") == b, F.col("_block")), ignorenulls=True).alias(f"_b{b}") for b in blocks],
        F.array_sort(F.flatten(F.collect_list("_bad"))).alias("_invalid"),
        F.first(F.when(F.col("_b").isNull(), F.col("_other")), ignorenulls=True).alias("_other"),
    )
    out = [F.col("_e").alias(entity)]
    for n, a in enumerate(declared):
        raw = F.col(f"_b{n // size}.v{n % size}")
        out.append(F.when(raw.isNotNull(), a.typed(raw)).alias(a.key))
    out.append(F.col("_invalid"))
    if extras:
        out.append(F.when(F.size("_other") > 0, F.map_from_entries(F.array_sort("_other"))).alias("_extras"))
    return joined.select(*out)


def unusable_cells(wide: DataFrame, entity: str, kind: str) -> DataFrame:
    """The cells of a pivoted table left empty although an invalid value was given."""
    return wide.select(F.lit(kind).alias("record_kind"), F.col(entity).alias("record_id"), F.explode("_invalid").alias("field_key"))
