"""Filters on streams.

A filter is stateless, so it runs on every micro-batch as on a table; order is kept within a batch by
_seq, the place of a record in the micro-batch. Event-time windows and watermarks are Spark's own and are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.api import Filter
from pathloom.plans import lanes
from pathloom.plans.native import NotNative
from pathloom.plans.numbering import SEQ


def read_json_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder, one JSON value a line. files_per_trigger bounds a micro-batch."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).where(F.trim("value") != "")


def apply_filter(stream: DataFrame, filter_: Filter, keep: tuple[str, ...] = ()) -> DataFrame:
    """The filter on every record: native columns where it can be, else value and error (JSON texts)."""
    texts = [c for c in stream.columns if c not in keep]
    if texts != ["value"]:
        try:
            return filter_.apply(stream, "native")
        except NotNative:
            pass
    lanes.ship(stream)
    # Spark numbers no rows of a stream: its tasks number theirs, by partition and place, within the micro-batch.
    rows = lanes.as_json(stream).select("value").mapInArrow(_numbered, f"{SEQ} long, value string")
    return rows.mapInArrow(lanes.evaluated(filter_, False), lanes.OUT).select(SEQ, "_out", "value", "error")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        seq = pa.array(range(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([seq, batch.column(0)], names=[SEQ, "value"])


def watermarked(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need an instant: a time without zone is read in the session's zone."""
    if dict(stream.dtypes)[time] == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late)


def windowed_counts(stream: DataFrame, time: str, keys: list[str | Column], width: str, slide: str | None = None, late: str = "10 minutes", **sums: str) -> DataFrame:
    """Counts and sums for each event-time window and key; rows later than ``late`` are left out."""
    own = watermarked(stream, time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return own.groupBy(window, *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def sessions(stream: DataFrame, time: str, keys: list[str | Column], gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts for each session: events of a key no further apart than ``gap``."""
    return watermarked(stream, time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def write_lines(outputs: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Outputs as text files, exactly once; ``once`` stops when what is there is read."""
    values = outputs.where("value is not null").select("value") if "value" in outputs.columns else outputs.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    writer = values.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
