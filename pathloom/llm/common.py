"""Shared plumbing: the cluster's shared folder, staged tables, prefix sums, worker set-up."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they share the driver's disk; elsewhere use --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)


def ship_file(spark: SparkSession, path: str) -> None:
    """Bring a file of the driver's to every executor, where SparkFiles.get finds it by its last name."""
    sc = spark.sparkContext
    if not any(f.rsplit("/", 1)[-1] == os.path.basename(path) for f in sc.listFiles):
        sc.addFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or one of our own where it is unset and all run here."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pathloom-")
        sc.setCheckpointDir(found)
    return f"{str(found).rstrip('/')}/pathloom"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: the lineage ends there, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    return len(_written)


def discard(spark: SparkSession, first: int, last: int) -> None:
    """Remove the staged folders numbered first to last - 1, once nothing reads them any more."""
    for i in range(first, last):
        path = spark._jvm.org.apache.hadoop.fs.Path(_written[i])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def running_before(df: DataFrame, keys: list[str], coarse: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out = the sum of value in earlier rows of the same keys, by (coarse, order).

    Two levels, so that no task holds a whole key: totals of each (keys, coarse) are summed first,
    then rows are ordered only within one coarse bucket.
    """
    totals = df.groupBy(*keys, coarse).agg(F.sum(value).alias("_bucket_sum"))
    up = W.partitionBy(*keys).orderBy(coarse).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        *[F.col(k).alias(f"_b_{k}") for k in [*keys, coarse]],
        F.coalesce(F.sum("_bucket_sum").over(up), F.lit(0)).alias("_base"),
    )
    inner = W.partitionBy(*keys, coarse).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in [*keys, coarse]]
    joined = within.join(bases, on, "left")
    return joined.select(*df.columns, (F.col("_within") + F.col("_base")).cast("long").alias(out))
