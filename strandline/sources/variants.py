"""Variants of any format: the format is told by the first bytes, or by the name when writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.regions import Region
from strandline.functions.variants import info_value, variant_end
from strandline.sources import bcf, blocked_text, text
from strandline.sources.alignments import format_of
from strandline.sources.headers import VcfHeader


def read_variants(spark: SparkSession, path: str, *, region: str | None = None) -> DataFrame:
    """Variants of a file or folder, of a region if given; an index beside a compressed file is used."""
    kind = format_of(path)
    if kind == "vcf.gz":
        if region is not None:
            return blocked_text.read_region(spark, path, "vcf", region).drop("file")
        return text.vcf_columns(blocked_text.read_lines(spark, path))
    if kind in ("bcf", "bcf.raw"):
        return bcf.read_bcf(spark, path, region=region)
    if kind != "vcf":
        raise ValueError(f"{kind} is not supported for variants")
    df = text.read_vcf(spark, path).drop("file")
    if region is None:
        return df
    end = F.try_element_at(F.col("info"), F.lit("END")).try_cast("bigint")
    return df.where(Region.parse(region).overlaps(F.col("chrom"), F.col("pos"), variant_end(F.col("pos"), F.col("ref"), end=end)))


def write_variants(df: DataFrame, path: str, header: VcfHeader, *, fmt: str | None = None) -> None:
    """A folder of files in ``fmt`` (``bcf``, ``vcf`` or ``vcf.gz``), by default after the ending of ``path``."""
    fmt = fmt or ("vcf.gz" if path.endswith(".vcf.gz") else path.rsplit(".", 1)[-1])
    if fmt == "bcf":
        bcf.write_bcf(df, path, header)
    elif fmt == "vcf":
        text.write_lines(df, text.vcf_line(df), path, header=str(header).rstrip("\n"))
    elif fmt == "vcf.gz":
        blocked_text.write_lines(df, text.vcf_line(df), path, ending=".vcf.gz", header=str(header))
    else:
        raise ValueError(f"unknown format {fmt!r}")


def typed_info(df: DataFrame, header: VcfHeader, keys: Sequence[str] | None = None) -> DataFrame:
    """``df`` with a typed column per INFO key in place of the map ``info``: number and type as the header declares or the version reserves.

    ``keys``: all that the header declares, if not given; a key that is neither declared nor reserved is one String.
    """
    keys = list(header.records["INFO"]) if keys is None else keys
    return df.select("*", *[info_value(F.col("info"), k, *header.type_of("INFO", k)).alias(k) for k in keys]).drop("info")


def sample_column(df: DataFrame, header: VcfHeader, sample: str, key: str) -> Column:
    """One FORMAT field of a named sample, typed as the header declares or the version reserves; NULL where a record lacks it."""
    if sample not in header.samples:
        raise ValueError(f"no sample {sample!r}")
    fields = F.get(F.col("samples"), F.lit(header.samples.index(sample)))
    return info_value(fields, key, *header.type_of("FORMAT", key))
