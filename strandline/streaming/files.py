"""Files as streams: the readers' column plans on ``readStream``, and sinks per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.sources import text

_COLUMNS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sam": lambda df: text.sam_columns(df, mode="PERMISSIVE"),
    "vcf": lambda df: text.vcf_columns(df, mode="PERMISSIVE"),
    "bed": lambda df: text.bed_columns(df, mode="PERMISSIVE"),
    "gff": lambda df: text.feature_columns(df, kind="gff", mode="PERMISSIVE"),
    "gtf": lambda df: text.feature_columns(df, kind="gtf", mode="PERMISSIVE"),
}


def stream_lines(spark: SparkSession, folder: str, fmt: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Records of the files that arrive in ``folder``; unreadable lines come out in ``_corrupt``, so they don't end the stream."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _COLUMNS[fmt](reader.load(folder).select(F.regexp_replace("value", r"\r\z", "").alias("value")))


def write_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Hand every micro-batch to ``write`` (with its number, for idempotent output)."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
