"""Indexes of many files at once, one task a file, and indexes as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.sources import bam, bcf, blocked_text, cram, sequences, storage

_BUILDERS: dict[str, Callable[[str], str]] = {
    "bai": bam.write_index,
    "bam.csi": lambda p: bam.write_index(p, csi=True),
    "bcf.csi": bcf.write_index,
    "crai": cram.write_crai,
    **{f"{preset}.tbi": (lambda p, preset=preset: blocked_text.write_index(p, preset)) for preset in ("sam", "vcf", "bed", "gff", "gtf")},
    **{f"{preset}.csi": (lambda p, preset=preset: blocked_text.write_index(p, preset, csi=True)) for preset in ("sam", "vcf", "bed", "gff", "gtf")},
}


def _write_fai(path: str) -> str:
    with storage.writing(f"{path}.fai") as f:
        f.write(sequences.fai_text(sequences.index_fasta(path)).encode())
    return f"{path}.fai"


_BUILDERS["fai"] = _write_fai


def _per_file(spark: SparkSession, paths: Sequence[str], rows: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                if found := list(rows(p)):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found)], names)

    files = spark.createDataFrame(pa.table({"file": pa.array(list(paths), pa.string())}))
    return files.repartitionByRange(max(1, len(paths)), "file").mapInArrow(run, schema)


def build(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Index the files of a folder or pattern beside them, one task a file; returns the paths of the indexes, one per file.

    ``kind``: ``bai``, ``bam.csi``, ``bcf.csi``, ``crai``, ``fai``, or a preset of blocked text (``sam``, ``vcf``, ``bed``, ``gff``,
    ``gtf``) with ``.tbi`` or ``.csi``. A file that is not sorted raises.
    """
    ending = {"bai": (".bam",), "bam.csi": (".bam",), "bcf.csi": (".bcf",), "crai": (".cram",), "fai": (".fa", ".fasta", ".txt")}.get(kind, (".gz", ".bgz"))
    write = _BUILDERS[kind]
    return [r[0] for r in _per_file(spark, storage.listed(path, ending), lambda p: [(write(p),)], "index string").collect()]


def _index_rows(path: str) -> Iterator[tuple]:
    index = bam.index_of(path) if path.endswith(".bam") else blocked_text.index_of(path)
    if index is None:
        raise ValueError(f"no index beside {path}")
    names = index.header.names if index.header else [None] * len(index.references)
    for i, r in enumerate(index.references):
        mapped, unmapped = (int(r.metadata[2]), int(r.metadata[3])) if r.metadata else (0, 0)
        yield path, i, names[i] or "", len(r.bins), sum(len(c) for c in r.bins.values()), mapped, unmapped, int(index.unplaced or 0)


def summary(spark: SparkSession, path: str, endings: tuple[str, ...]) -> DataFrame:
    """The indexes beside the files of a folder as a table: per file and reference its number and name (empty where the index has none),
    bins, chunks, mapped and unmapped records, and the file's unplaced records."""
    schema = "file string, ref_id bigint, name string, bins bigint, chunks bigint, mapped bigint, unmapped bigint, unplaced bigint"
    return _per_file(spark, storage.listed(path, endings), _index_rows, schema)


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """Index records of the FASTA files of a folder or pattern, one task a file."""
    rows = lambda p: [(r.name, r.length, r.position, r.line_bases, r.line_width, p) for r in sequences.index_fasta(p)]
    return _per_file(spark, storage.listed(path), rows, "name string, length bigint, position bigint, line_bases bigint, line_width bigint, file string")


def fetch(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """Bases of ``region`` texts from the FASTA files of a folder: the index is a table that is joined, and only the wanted bytes are read.

    ``regions`` has ``region``; a name that no file has gives no row, an end beyond a sequence is clipped.
    """
    from pyspark.sql import functions as F

    from strandline.functions.regions import region_columns

    index = fasta_index(spark, path).select(F.col("name").alias("_name"), "length", "position", "line_bases", "line_width", "file")
    wanted = regions.select("region", region_columns(F.col("region")).alias("_r")).join(index, F.col("_r.name") == F.col("_name"))
    wanted = wanted.select("region", "_r.start", "_r.end", "_name", "length", "position", "line_bases", "line_width", "file")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, start, end, name, length, position, bases, width, file in zip(*(c.to_pylist() for c in b.columns)):
                out.append(sequences.fetch(file, sequences.FaiRecord(name, length, position, bases, width), start, end))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["region", "sequence"])

    return wanted.mapInArrow(get, "region string, sequence string")
