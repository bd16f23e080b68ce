"""Base modifications (MM and ML tags) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.bases import complement

#: One-letter codes of modifications.
CODES = {"m": "5mC", "h": "5hmC", "f": "5fC", "c": "5caC", "g": "5hmU", "e": "5fU", "b": "5caU", "a": "6mA", "o": "8oxoG", "n": "Xao"}

GROUP = "struct<base:string,strand:string,modifications:array<string>,status:string,positions:array<int>>"


def groups(seq: Column, mm: Column, reverse: Column) -> Column:
    """Array of groups of an MM text: base, strand, modification codes, status and 0-based positions in ``seq``.

    Counts skip unmodified bases of the group's kind, counted along the original strand: from the end and
    on the complement where ``reverse``.
    """
    texts = F.filter(F.split(mm, ";"), lambda g: g != "")

    def one(g: Column) -> Column:
        head, skips = F.substring_index(g, ",", 1), F.slice(F.split(g, ","), F.lit(2), F.greatest(F.size(F.split(g, ",")), F.lit(1)))
        base, strand, codes, status = (F.regexp_extract(head, r"^([A-Z])([+-])([a-z]+|[0-9]+)([.?]?)$", i) for i in (1, 2, 3, 4))
        n = F.length(seq)
        wanted = F.when(reverse, complement(base)).otherwise(base)
        at = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(reverse, n - i + 1).otherwise(i)), lambda i: (base == "N") | (F.upper(F.substr(seq, i, F.lit(1))) == wanted))
        # the k-th modified base is the (skip_1 + ... + skip_k + k)-th base of its kind
        ends = F.transform(skips, lambda s, k: F.aggregate(F.slice(skips, F.lit(1), k + 1), F.lit(0), lambda a, v: a + v.try_cast("int") + 1))
        positions = F.transform(ends, lambda e: F.get(at, e - 1) - 1)
        mods = F.when(codes.rlike("^[0-9]+$"), F.array(codes)).otherwise(F.filter(F.split(codes, ""), lambda c: c != ""))
        return F.struct(base.alias("base"), strand.alias("strand"), mods.alias("modifications"), F.nullif(status, F.lit("")).alias("status"), positions.alias("positions"))

    return F.when(F.length(seq) > 0, F.transform(texts, one))
