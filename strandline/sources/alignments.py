"""Alignments of any format: the format is told by the first bytes, or by the name when writing."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.cigar import alignment_end
from strandline.functions.regions import Region
from strandline.sources import bam, blocked_text, cram, storage, text
from strandline.sources.headers import SamHeader


def detected(head: bytes) -> str:
    """``sam``, ``sam.gz``, ``bam``, ``bam.raw``, ``bcf``, ``cram``, ``vcf`` or ``vcf.gz`` of a file's first bytes."""
    packed = head[:2] == b"\x1f\x8b"
    plain = head
    if packed:
        d = zlib.decompressobj(31)
        plain = d.decompress(head, 64)
    for magic, name in ((b"BAM\1", "bam"), (b"BCF", "bcf")):
        if plain.startswith(magic):
            return name if packed else f"{name}.raw"
    if plain.startswith(b"CRAM"):
        if packed:
            raise ValueError("a CRAM file can't be compressed again")
        return "cram"
    kind = "vcf" if plain.startswith(b"##fileformat=VCF") else "sam"
    return f"{kind}.gz" if packed else kind


def format_of(path: str) -> str:
    """The format of a file, or of the first file of a folder."""
    with storage.reading(storage.listed(path)[0]) as f:
        return detected(f.read(65536))


def read_alignments(spark: SparkSession, path: str, *, region: str | None = None, reference: str | None = None) -> DataFrame:
    """Alignments of a file or folder, of a region if given; an index beside a compressed file is used."""
    kind = format_of(path)
    if kind in ("bam", "bam.raw"):
        return bam.read_bam(spark, path, region=region)
    if kind == "cram":
        return cram.read_cram(spark, path, reference=reference, region=region)
    if kind == "sam.gz" and _blocked(path):
        if region is not None:
            return blocked_text.read_region(spark, path, "sam", region).drop("file")
        return text.sam_columns(blocked_text.read_lines(spark, path))
    if kind not in ("sam", "sam.gz"):
        raise ValueError(f"{kind} is not supported for alignments")
    df = text.read_sam(spark, path).drop("file")
    return df if region is None else df.where(Region.parse(region).overlaps(F.col("rname"), F.col("pos"), alignment_end(F.col("pos"), F.col("cigar"))))


def _blocked(path: str) -> bool:
    """Whether the compressed files are made of blocks, so that they can be cut."""
    with storage.reading(storage.listed(path)[0]) as f:
        return f.read(18)[12:14] == b"BC"


def write_alignments(df: DataFrame, path: str, header: SamHeader, *, fmt: str | None = None) -> None:
    """A folder of files in ``fmt`` (``bam``, ``cram``, ``sam`` or ``sam.gz``), by default after the ending of ``path``."""
    fmt = fmt or ("sam.gz" if path.endswith(".sam.gz") else path.rsplit(".", 1)[-1])
    if fmt == "bam":
        bam.write_bam(df, path, header)
    elif fmt == "cram":
        cram.write_cram(df, path, header)
    elif fmt == "sam":
        text.write_lines(df, text.sam_line(df), path, header=str(header).rstrip("\n"))
    elif fmt == "sam.gz":
        blocked_text.write_lines(df, text.sam_line(df), path, ending=".sam.gz", header=str(header))
    else:
        raise ValueError(f"unknown format {fmt!r}")
