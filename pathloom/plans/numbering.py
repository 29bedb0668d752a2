"""Positions and running sums over a whole DataFrame without one task that holds it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEQ = "_seq"


def sequenced(df: DataFrame) -> DataFrame:
    """df with _seq, its rows' order as read: partition, then place in it."""
    return df if SEQ in df.columns else df.withColumn(SEQ, F.monotonically_increasing_id())


#: What an evaluating task is dealt: some seconds of Python.
TASK_ROWS = 50_000


def dealt(df: DataFrame, most: int = TASK_ROWS) -> DataFrame:
    """df of a file scan with _seq, over tasks of about ``most`` rows at most.

    A scan splits files by bytes, but a row group is one task's whatever its size, and the others stay empty. The rows
    of each task are counted first (of Parquet, from the footers); where one has too many, all are dealt by _seq.
    """
    counts = [n for _, n in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    cores, total, own = df.sparkSession.sparkContext.defaultParallelism, sum(counts), sequenced(df)
    if max(counts, default=0) <= min(most, 2 * total // cores):
        return own
    return own.repartition(max(cores, -(-total // most)), SEQ)


def part(seq: str = SEQ) -> Column:
    return F.shiftright(F.col(seq), 33)


def running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over this row and all before by (bucket, order).

    Buckets are totalled first (one row each); rows are ordered only within their bucket.
    """
    df = df.withColumns({"_bucket": bucket, **{f"_x_{n}": c for n, c in sums.items()}})
    totals = df.groupBy("_bucket").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    up = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(up), F.lit(0)).alias(f"_base_{n}") for n in sums])
    inner = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    within = df.withColumns({f"_w_{n}": F.sum(f"_x_{n}").over(inner) for n in sums})
    joined = within.join(bases, F.col("_bucket").eqNullSafe(F.col("_b")), "left")
    out = joined.withColumns({n: F.coalesce(F.col(f"_w_{n}"), F.lit(0)) + F.col(f"_base_{n}") for n in sums})
    return out.drop("_bucket", "_b", *[f"{p}_{n}" for n in sums for p in ("_x", "_w", "_base")])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with each row's number from 0 in reading order."""
    out = running(sequenced(df), part(), [F.col(SEQ)], {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see: under spark.checkpoint.dir, or a temporary one where all run here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.gettempdir()
    return f"{found.rstrip('/')}/pathloom-{name}-{uuid.uuid4().hex}"


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted, with _seq its rows' new order: written range by range to the shared folder and read back.

    Spark's sampled ranges spread any kind of key, hot ones too as the order ends in _seq; but they may differ when a
    plan runs again, so what is numbered is a table that stays.
    """
    path = scratch(df.sparkSession, "sorted")
    made = df.orderBy(*order).withColumn(SEQ, F.monotonically_increasing_id())
    made.write.parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)
