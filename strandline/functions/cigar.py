"""CIGAR strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSUMES_READ = "MIS=X"
CONSUMES_REFERENCE = "MDN=X"


def _total(cigar: Column, kinds: str) -> Column:
    lengths = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), 1)
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def reference_span(cigar: Column) -> Column:
    """Reference bases covered; NULL for NULL, ``*`` and operations that cover none."""
    return F.nullif(_total(cigar, CONSUMES_REFERENCE), F.lit(0))


def read_length(cigar: Column) -> Column:
    """Bases of the read that the operations consume; 0 for ``*``."""
    return _total(cigar, CONSUMES_READ)


def alignment_end(start: Column, cigar: Column) -> Column:
    """Last covered position; the start itself where nothing is covered."""
    return start + F.coalesce(reference_span(cigar), F.lit(1)) - 1


def operations(cigar: Column) -> Column:
    """Array of ``len``/``op`` structs in order; empty for ``*``."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), 0), lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("len"), F.right(t, F.lit(1)).alias("op")))


def is_valid(cigar: Column) -> Column:
    """Whether the text is ``*`` or a sequence of operations."""
    return cigar.rlike(r"^(?:\*|(?:[0-9]+[MIDNSHP=X])++)\z")


def simplified(ops: Column) -> Column:
    """Operations with adjacent ones of a kind joined and empty ones dropped."""
    none = F.array().cast("array<struct<len:int,op:string>>")

    def step(done: Column, x: Column) -> Column:
        return (
            F.when(x["len"] == 0, done)
            .when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["op"] == x["op"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct((F.get(done, F.size(done) - 1)["len"] + x["len"]).alias("len"), x["op"].alias("op")))))
            .otherwise(F.concat(done, F.array(F.struct(x["len"].alias("len"), x["op"].alias("op")))))
        )

    return F.aggregate(ops, none, step)


def text(ops: Column) -> Column:
    """The text of operations, ``*`` if there are none."""
    joined = F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return F.when(F.size(ops) == 0, "*").otherwise(joined)
