"""Text formats as native plans: ``spark.read.text`` and column expressions, so unused fields cost nothing.

Readers take a batch of paths; the ``*_columns`` functions work on any frame with a ``value`` column of
lines, so they serve streams as well. ``mode="PERMISSIVE"`` turns an unreadable field into NULL and
keeps the line in ``_corrupt``; ``mode="FAILFAST"`` raises where the first column of a malformed line is read
(as column pruning drops the check with the column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import attributes as at
from strandline.functions import bases, tags, validate, variants
from strandline.functions import cigar as cg
from strandline.sources.headers import SamHeader

TAB = "\t"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, without a carriage return at the end."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), F.col("_metadata.file_path").alias("file"))


def _field(i: int) -> Column:
    return F.get(F.col("_f"), F.lit(i))


def _unless(c: Column, *missing: str) -> Column:
    return F.when(~c.isin(*missing), c)


def _finish(df: DataFrame, bad: Column, mode: str, columns: list[Column], keep: list[str], *names: str) -> DataFrame:
    if mode == "FAILFAST":
        # in the projection, where the split of the line is evaluated once; a filter would repeat it for every field
        error = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("string")
        return df.select(F.when(bad, error).otherwise(columns[0]).alias(names[0]), *columns[1:], *keep)
    if mode != "PERMISSIVE":
        raise ValueError("mode is PERMISSIVE or FAILFAST")
    return df.select(*columns, *keep, F.when(bad, F.col("value")).alias("_corrupt"))


# SAM ----------------------------------------------------------------------------------------


def sam_columns(df: DataFrame, *, mode: str = "FAILFAST", keep: list[str] | None = None) -> DataFrame:
    """Alignments of lines in ``value``; header lines are left out, ``=`` takes the record's own reference."""
    keep = keep or []
    df = df.where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("_f", F.split("value", TAB))
    ints = {i: _field(i).try_cast("bigint") for i in (1, 3, 4, 7, 8)}
    rname = _unless(_field(2), "*")
    bad = (F.size("_f") < 11)
    for i, c in ints.items():
        bad = bad | c.isNull()
    bad = bad | ~F.coalesce(cg.is_valid(_field(5)), F.lit(False)) | ~ints[1].between(0, 65535) | ~ints[4].between(0, 255)
    bad = bad | ((_field(10) != "*") & (_field(9) != "*") & (F.length(_field(10)) != F.length(_field(9))))
    columns = [
        _unless(_field(0), "*").alias("name"), ints[1].cast("int").alias("flags"), rname.alias("rname"), F.when(ints[3] > 0, ints[3]).alias("pos"), F.when(ints[4] != 255, ints[4]).cast("smallint").alias("mapq"),
        _unless(_field(5), "*").alias("cigar"), F.when(_field(6) == "=", rname).otherwise(_unless(_field(6), "*")).alias("mate_rname"), F.when(ints[7] > 0, ints[7]).alias("mate_pos"), ints[8].cast("int").alias("tlen"),
        _unless(_field(9), "*").alias("seq"), _unless(_field(10), "*").alias("qual"), tags.tag_map(F.slice("_f", 12, 2**30)).alias("tags"),
    ]
    return _finish(df, F.coalesce(bad, F.lit(True)), mode, columns, keep, "name")


def read_sam(spark: SparkSession, path: str | list[str], *, mode: str = "FAILFAST") -> DataFrame:
    return sam_columns(lines(spark, path), mode=mode, keep=["file"])


def in_dictionary(df: DataFrame, header: SamHeader) -> DataFrame:
    """Alignments whose references, their own and the mate's, must be in the header's dictionary; another name raises."""
    known = list(header.sequences)

    def checked(c: str) -> Column:
        error = F.raise_error(F.concat(F.lit("not in the dictionary: "), F.col(c))).cast("string")
        return F.when(F.col(c).isNull() | F.col(c).isin(known), F.col(c)).otherwise(error)

    return df.withColumns({c: checked(c) for c in ("rname", "mate_rname")})


def sam_line(df: DataFrame, *, strict: bool = False) -> Column:
    """The line of an alignment row (columns as ``read_sam`` gives them; ``tags`` may be absent).

    ``strict`` raises for names, bases and scores that the format can't hold, and for a CIGAR of another read length.
    """
    star = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), "*").otherwise(F.col(c))
    number = lambda c, d: F.greatest(F.coalesce(F.col(c), F.lit(d)), F.lit(0)).cast("string")
    mate = F.when(F.col("mate_rname").isNull(), "*").when(F.col("mate_rname") == F.col("rname"), "=").otherwise(F.col("mate_rname"))
    if strict:
        name, seq, qual, ops = (F.col(c) for c in ("name", "seq", "qual", "cigar"))
        fits = seq.isNull() | (seq == "") | (cg.read_length(ops) == 0) | (cg.read_length(ops) == F.length(seq))
        star_of = {
            "name": validate.checked(name, validate.is_read_name(name), "read name"),
            "seq": validate.checked(seq, validate.is_sequence(seq), "sequence"),
            "qual": validate.checked(qual, validate.is_quality(qual, seq) | (qual == ""), "quality scores"),
            "cigar": validate.checked(ops, F.coalesce(cg.is_valid(ops) & fits, F.lit(False)) | (ops == ""), "CIGAR"),
        }
        star = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), "*").otherwise(star_of.get(c, F.col(c)))
    fields = [star("name"), F.col("flags").cast("string"), star("rname"), number("pos", 0), number("mapq", 255), star("cigar"), mate, number("mate_pos", 0), F.coalesce("tlen", F.lit(0)).cast("string"), star("seq"), star("qual")]
    body = F.concat_ws(TAB, *fields)
    if "tags" not in df.columns:
        return body
    extra = F.array_join(tags.tag_text(F.col("tags")), TAB)
    return F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.concat(body, F.lit(TAB), extra)).otherwise(body)


# VCF ----------------------------------------------------------------------------------------


def vcf_columns(df: DataFrame, *, mode: str = "FAILFAST", keep: list[str] | None = None) -> DataFrame:
    """Variants of lines in ``value``; INFO and samples stay maps of texts (typed by ``info_value``)."""
    keep = keep or []
    df = df.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("_f", F.split("value", TAB))
    pos, qual = _field(1).try_cast("bigint"), _field(5)
    real = qual.try_cast("float")
    bad = (F.size("_f") < 8) | pos.isNull() | (pos < 0) | ((qual != ".") & real.isNull())
    samples = F.when(F.size("_f") > 9, F.transform(F.slice("_f", 10, 2**30), lambda s: variants.sample_map(_field(8), s)))
    columns = [
        _field(0).alias("chrom"), F.when(pos > 0, pos).alias("pos"), variants.ids(_field(2)).alias("ids"), _field(3).alias("ref"), variants.alternate_bases(_field(4)).alias("alt"), F.when(qual != ".", real).alias("qual"),
        variants.filters(_field(6)).alias("filters"), variants.info_map(_field(7)).alias("info"), F.when(F.size("_f") > 8, F.split(_field(8), ":")).alias("format"), samples.alias("samples"),
    ]
    return _finish(df, F.coalesce(bad, F.lit(True)), mode, columns, keep, "chrom")


def read_vcf(spark: SparkSession, path: str | list[str], *, mode: str = "FAILFAST") -> DataFrame:
    return vcf_columns(lines(spark, path), mode=mode, keep=["file"])


def vcf_line(df: DataFrame) -> Column:
    """The line of a variant row (columns as ``read_vcf`` gives them; ``format`` and ``samples`` may be absent)."""
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    fields = [F.col("chrom"), F.coalesce("pos", F.lit(0)).cast("string"), variants.joined(F.col("ids"), ";"), F.col("ref"), variants.joined(F.col("alt"), ","), F.coalesce(F.col("qual").cast("string"), F.lit(".")), variants.joined(F.col("filters"), ";"), F.when(info != "", info).otherwise(".")]
    body = F.concat_ws(TAB, *fields)
    if "samples" not in df.columns:
        return body
    one = lambda s: F.array_join(F.transform(F.col("format"), lambda k: F.coalesce(F.try_element_at(s, k), F.lit("."))), ":")
    more = F.concat_ws(TAB, F.array_join("format", ":"), F.array_join(F.transform("samples", one), TAB))
    return F.when(F.col("format").isNotNull(), F.concat_ws(TAB, body, more)).otherwise(body)


# BED ----------------------------------------------------------------------------------------


def bed_columns(df: DataFrame, *, width: int = 6, mode: str = "FAILFAST", keep: list[str] | None = None) -> DataFrame:
    """Features of lines with ``width`` (3 to 6) standard fields; further fields go to ``other``. Starts become 1-based."""
    if width not in (3, 4, 5, 6):
        raise ValueError("the width is 3 to 6")
    keep = keep or []
    df = df.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("_f", F.split("value", TAB))
    start, end = _field(1).try_cast("bigint"), _field(2).try_cast("bigint")
    bad = (F.size("_f") < width) | start.isNull() | (start < 0) | end.isNull()
    columns = [_field(0).alias("chrom"), (start + 1).alias("start"), F.when(end != 0, end).alias("end")]
    if width > 3:
        columns.append(_unless(_field(3), ".").alias("name"))
    if width > 4:
        score = _field(4).try_cast("int")
        bad = bad | score.isNull() | ~score.between(0, 65535)
        columns.append(score.alias("score"))
    if width > 5:
        bad = bad | ~_field(5).isin("+", "-", ".")
        columns.append(_unless(_field(5), ".").alias("strand"))
    columns.append(F.slice("_f", width + 1, 2**30).alias("other"))
    return _finish(df, F.coalesce(bad, F.lit(True)), mode, columns, keep, "chrom")


def read_bed(spark: SparkSession, path: str | list[str], *, width: int = 6, mode: str = "FAILFAST") -> DataFrame:
    return bed_columns(lines(spark, path), width=width, mode=mode, keep=["file"])


def bed_line(chrom: Column, start: Column, end: Column, name: Column | None = None, score: Column | None = None, strand: Column | None = None) -> Column:
    fields = [chrom, (start - 1).cast("string"), F.coalesce(end, F.lit(0)).cast("string")]
    if name is not None:
        fields.append(F.coalesce(name, F.lit(".")))
    if score is not None:
        fields.append(F.coalesce(score, F.lit(0)).cast("string"))
    if strand is not None:
        fields.append(F.coalesce(strand, F.lit(".")))
    return F.concat_ws(TAB, *fields)


# GFF3 and GTF -------------------------------------------------------------------------------


def line_kind(value: Column) -> Column:
    """``directive``, ``comment`` or ``record``."""
    return F.when(value.startswith("##"), "directive").when(value.startswith("#"), "comment").otherwise("record")


def feature_columns(df: DataFrame, *, kind: str, mode: str = "FAILFAST", keep: list[str] | None = None) -> DataFrame:
    """Features of GFF3 (``kind="gff"``) or GTF (``kind="gtf"``) lines."""
    keep = keep or []
    df = df.where(~F.col("value").startswith("#") & F.col("value").rlike(r"\S")).withColumn("_f", F.split("value", TAB))
    start, end, score, phase = _field(3).try_cast("bigint"), _field(4).try_cast("bigint"), _field(5).try_cast("float"), _field(7).try_cast("tinyint")
    strands = ("+", "-", ".", "?") if kind == "gff" else ("+", "-", ".")
    bad = (F.size("_f") != 9) | start.isNull() | end.isNull() | (start < 1) | ((_field(5) != ".") & score.isNull()) | ~_field(6).isin(*strands) | ((_field(7) != ".") & ~F.coalesce(phase.between(0, 2), F.lit(False)))
    parsed = at.gff_attributes(_field(8)) if kind == "gff" else at.gtf_attributes(_field(8))
    name = at.percent_decoded if kind == "gff" else (lambda c: c)
    columns = [
        name(_field(0)).alias("seqid"), name(_unless(_field(1), ".")).alias("source"), name(_field(2)).alias("type"), start.alias("start"), end.alias("end"), F.when(_field(5) != ".", score).alias("score"),
        _unless(_field(6), ".").alias("strand"), F.when(_field(7) != ".", phase).alias("phase"), parsed.alias("attributes"),
    ]
    return _finish(df, F.coalesce(bad, F.lit(True)), mode, columns, keep, "seqid")


def read_gff(spark: SparkSession, path: str | list[str], *, mode: str = "FAILFAST") -> DataFrame:
    """GFF3 records up to the ``##FASTA`` directive of each file.

    The directive is looked up per file first (one pass over the first bytes of lines); only files that hold one
    are cut, by the position of their lines, and the others are read splittably.
    """
    raw = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    cut = [r["file"] for r in raw.where(F.col("value").startswith("##FASTA")).select("file").distinct().collect()]
    plain = raw.where(~F.col("file").isin(cut)) if cut else raw
    if cut:
        whole = spark.read.text(cut, wholetext=True).select(F.split(F.regexp_replace("value", r"(?s)(?:\A|\n)##FASTA.*", ""), "\r?\n").alias("ls"), F.col("_metadata.file_path").alias("file"))
        plain = plain.unionByName(whole.select(F.explode("ls").alias("value"), "file"))
    return feature_columns(plain, kind="gff", mode=mode, keep=["file"])


def read_gtf(spark: SparkSession, path: str | list[str], *, mode: str = "FAILFAST") -> DataFrame:
    return feature_columns(lines(spark, path), kind="gtf", mode=mode, keep=["file"])


def feature_line(kind: str) -> Column:
    """The line of a feature row; a GFF3 ``CDS`` without a phase raises."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    phase = dot("phase")
    if kind == "gff":
        phase = F.when((F.col("type") == "CDS") & F.col("phase").isNull(), F.raise_error(F.lit("a CDS needs a phase")).cast("string")).otherwise(phase)
    text = at.gff_text(F.col("attributes")) if kind == "gff" else at.gtf_text(F.col("attributes"))
    enc = (lambda c: at.percent_encoded(c, at.FEATURE_RESERVED)) if kind == "gff" else (lambda c: c)
    return F.concat_ws(TAB, enc(F.col("seqid")), enc(dot("source")), enc(F.col("type")), F.col("start").cast("string"), F.col("end").cast("string"), dot("score"), dot("strand"), phase, text)


# FASTA and FASTQ ----------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sequences: ``name``, ``description``, ``sequence``, ``length``, ``file``; records are split inside the scan."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\r", "").alias("value"), F.col("_metadata.file_path").alias("file")).where(F.col("value").rlike(r"\S"))
    head = at.definition(F.substring_index("value", "\n", 1))
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.substr("value", F.instr("value", "\n") + 1), r"\s", "")).otherwise("")
    return raw.select(head["name"].alias("name"), head["description"].alias("description"), body.alias("sequence"), F.length(body).cast("bigint").alias("length"), "file")


def sequence_chunks(sequences: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Long sequences as pieces of ``width`` bases: ``name``, ``chunk`` (from 0), ``bases``."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("sequence") - 1) / width), F.lit(0)).cast("int"))
    return sequences.select("name", F.explode(starts).alias("chunk"), "sequence").select("name", "chunk", F.substr("sequence", F.col("chunk") * width + 1, F.lit(width)).alias("bases"))


def fasta_text(width: int = 80) -> Column:
    head = F.when(F.col("description").isNull(), F.col("name")).otherwise(F.concat_ws(" ", "name", "description"))
    return F.concat(F.lit(">"), head, F.lit("\n"), bases.wrapped(F.col("sequence"), width))


def read_fastq(spark: SparkSession, path: str | list[str], *, mode: str = "FAILFAST") -> DataFrame:
    """Reads of four-line records: ``name``, ``description``, ``sequence``, ``quality``, ``file``.

    Plain files are cut by bytes: a task owns the records that begin in its range, and finds the first by a definition line
    with bases, a plus line and as many scores after it. A compressed file is one task.
    """
    from strandline.sources.fastq import FastqSource

    spark.dataSource.register(FastqSource)
    paths = [path] if isinstance(path, str) else path
    return spark.read.format("strandline_fastq").option("paths", "\n".join(paths)).option("strict", str(mode == "FAILFAST")).load()


def fastq_text(separator: str = " ") -> Column:
    head = F.when(F.col("description").isNull(), F.col("name")).otherwise(F.concat(F.col("name"), F.lit(separator), F.col("description")))
    return F.concat(F.lit("@"), head, F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality"))


def write_features(df: DataFrame, path: str, kind: str, *, directives: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Features as GFF3 or GTF files, each beginning with the given directive and comment lines."""
    for line in directives:
        if not line.startswith("#") or "\n" in line:
            raise ValueError(f"neither a directive nor a comment: {line!r}")
    write_lines(df, feature_line(kind), path, header="\n".join(directives), mode=mode)


def write_lines(df: DataFrame, line: Column, path: str, *, header: str = "", mode: str = "errorifexists") -> None:
    """One text file per partition; every file begins with ``header`` (lines without a final line feed), if given."""
    out = df.select(line.alias("value"))
    if header:

        def headed(batches):
            import pyarrow as pa

            first = True
            for b in batches:
                if first:
                    yield pa.RecordBatch.from_arrays([pa.array([header])], schema=b.schema)
                    first = False
                yield b
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])

        out = out.mapInArrow(headed, "value string")
    out.write.mode(mode).text(path)
