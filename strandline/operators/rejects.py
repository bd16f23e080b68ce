"""Rows that fail to parse: a permissive read under an explicit schema, then the reasons.

``from_csv`` reads every line under ``SCHEMA`` and keeps the raw text of what it could not read: lines
with another number of columns, bounds that are no 32-bit integers, scores that are no numbers. Its
clean rows are loaded from its fields, after one check of what the reader is loose about (signs,
``NaN``, digits of other scripts, scores beyond the range of a double, the grammar of the attributes).
Only lines that either of them refuses are split and classified by count, casts and quoting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.pivot import FLOAT

SCHEMA = "seqname string, source string, feature string, start int, end int, score double, strand string, frame string, attributes string, _corrupt string"
FIELDS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
COLUMNS = len(FIELDS)
POSITION_MAX = 2**31 - 1

_KEY_VALUE = r'[A-Za-z0-9_]++ ++(?:"[^"\\]*+(?:\\["\\][^"\\]*+)*+"|[^ ";]++)'
#: Possessive throughout, so that the matcher loops instead of recursing on long texts.
ATTRIBUTES = rf"^ *+{_KEY_VALUE} *+(?:; *+{_KEY_VALUE} *+)*+;?+ *+\z"
#: A quoted run that is opened and never closed.
_QUOTES_BALANCED = r'^[^"]*+(?:"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"[^"]*+)*+\z'


#: What the reader takes too lightly in the columns before the attributes.
_STRICT = rf"^[^\t]++\t[^\t]++\t[^\t]++\t[0-9]++\t[0-9]++\t(?:[.]|{FLOAT[1:-2]})\t[-+.]\t[012.]\t"


def _position(text: Column) -> Column:
    n = F.when(text.rlike(r"^0*+[0-9]{1,10}\z"), text.try_cast("bigint"))
    return F.when(n.between(1, POSITION_MAX), n)


def _finite(score: Column) -> Column:
    return F.abs(score) < float("inf")


def _reason(f: list[Column], columns: Column) -> Column:
    """Why a line that was refused is no record; ``unreadable`` if no other reason applies."""
    start, end = _position(f[3]), _position(f[4])
    return (
        F.when(columns != COLUMNS, "column_count")
        .when((f[0] == "") | (f[1] == "") | (f[2] == ""), "empty_field")
        .when(start.isNull(), "invalid_start")
        .when(end.isNull(), "invalid_end")
        .when(start > end, "start_after_end")
        .when((f[5] != ".") & ~(f[5].rlike(FLOAT) & F.coalesce(_finite(f[5].try_cast("double")), F.lit(False))), "invalid_score")
        .when(~f[6].isin("+", "-", "."), "invalid_strand")
        .when(~f[7].isin("0", "1", "2", "."), "invalid_frame")
        .when(~f[8].rlike(_QUOTES_BALANCED), "broken_quoting")
        .when(~f[8].rlike(ATTRIBUTES), "invalid_attributes")
        .otherwise("unreadable")
    )


def parsed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with the typed fields in ``_row``, and in ``_reason`` why a line is no record.

    Lines that are NULL, start with ``#`` or hold only blanks and tabs are left out: they are
    neither records nor failures. A carriage return at the end is not part of a line.
    ``_raw`` is the text of a failed line and NULL otherwise. Reasons, the first that applies:
    ``column_count``, ``empty_field``, ``invalid_start``, ``invalid_end``, ``start_after_end``,
    ``invalid_score`` (also a number without a finite value, such as ``1e999``), ``invalid_strand``, ``invalid_frame``,
    ``broken_quoting``, ``invalid_attributes``, ``unreadable`` (nothing above, yet the reader refuses the line).
    All other columns are kept.
    """
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    staged = lines.withColumn("_text", text).where(F.col("_text").isNotNull() & ~F.col("_text").startswith("#") & F.col("_text").rlike(r"[^ \t]"))
    options = {"sep": "\t", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": "", "escape": "", "comment": "", "maxCharsPerColumn": "-1", "nullValue": ".", "lineSep": "\n"}
    read = staged.withColumn("_csv", F.from_csv(F.col("_text"), SCHEMA, options))
    c = {n: F.col(f"_csv.{n}") for n in FIELDS}
    loaded = (
        F.col("_csv._corrupt").isNull()
        & (c["start"] >= 1)
        & (c["start"] <= c["end"])
        & (c["score"].isNull() | _finite(c["score"]))
        & F.col("_text").rlike(_STRICT)
        & c["attributes"].rlike(ATTRIBUTES)
    )
    read = read.withColumn("_loaded", F.coalesce(loaded, F.lit(False)))
    split = F.split(F.when(~F.col("_loaded"), F.coalesce("_csv._corrupt", "_text")), "\t")
    f = [F.get("_f", F.lit(i)) for i in range(COLUMNS)]
    # ``.`` is a name like any other in the first columns
    row = F.struct(*[F.coalesce(c[n], F.lit(".")).alias(n) for n in FIELDS[:3]], *[c[n].alias(n) for n in FIELDS[3:7]], c["frame"].try_cast("tinyint").alias("frame"), c["attributes"].alias("attributes"))
    return (
        read.withColumn("_f", split)
        .withColumn("_reason", F.when(~F.col("_loaded"), _reason(f, F.size("_f"))))
        .withColumn("_row", F.when(F.col("_loaded"), row))
        .withColumn("_raw", F.when(~F.col("_loaded"), F.coalesce("_csv._corrupt", "_text")))
        .drop("_text", "_csv", "_f", "_loaded")
    )


def valid_rows(lines: DataFrame, keep: list[str], line: str = "line") -> DataFrame:
    """The typed records of ``lines`` with the columns ``keep`` before them (a clash of names is an error)."""
    if set(FIELDS) & set(keep):
        raise ValueError("kept columns clash with the fields of a record")
    return parsed_lines(lines, line).where(F.col("_reason").isNull()).select(*keep, *[F.col(f"_row.{n}").alias(n) for n in FIELDS])


def rejected_rows(lines: DataFrame, keep: list[str], line: str = "line") -> DataFrame:
    """The lines of ``lines`` that are no valid record: ``keep``, ``reason`` and the raw text ``raw``."""
    return parsed_lines(lines, line).where(F.col("_reason").isNotNull()).select(*keep, F.col("_reason").alias("reason"), F.col("_raw").alias("raw"))
