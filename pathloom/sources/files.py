"""Reading JSON in any framing, and writing filter outputs as text.

Every reader gives _seq (order of reading) and value (one JSON text a row) or error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.values import JsonTextError, parse, pretty, quoted, text, value_at
from pathloom.plans.lanes import ship
from pathloom.plans.numbering import SEQ, sequenced

VALUES = f"{SEQ} long, _sub long, value string, error string"
_ARROW = pa.schema([(SEQ, pa.int64()), ("_sub", pa.int64()), ("value", pa.string()), ("error", pa.string())])


def split_values(whole: str, repair: bool) -> Iterator[tuple[str | None, str | None]]:
    """(text, error) of each value in a text; after a wrong value reading goes on at the next line."""
    at = 1 if whole.startswith("﻿") else 0
    while True:
        while at < len(whole) and whole[at] in " \t\r\n":
            at += 1
        if at >= len(whole):
            return
        try:
            value, at = value_at(whole, at, repair)
            yield text(value), None
        except JsonTextError as e:
            yield None, f"parse error: {e.message}"
            line = whole.find("\n", max(at, e.at))
            if line < 0:
                return
            at = line + 1


def _splitter(repair: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for n, (value, error) in enumerate(split_values(whole or "", repair)):
                    rows.append((seq, n, value, error))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return run


def parsed_values(texts: DataFrame, repair: bool = True) -> DataFrame:
    """texts (value) -> one row for every JSON value in them: _seq, _sub, value, error."""
    ship(texts)
    return sequenced(texts).select(SEQ, "value").mapInArrow(_splitter(repair), VALUES)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON value a line; blank lines are passed over. Splittable, so files of any size."""
    return sequenced(spark.read.text(path)).where(F.trim("value") != "").select(SEQ, "value")


def read_records(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Objects of a known schema, one a line, as typed columns for the native lane. A line that isn't one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_values(spark: SparkSession, path: str | list[str], repair: bool = True) -> DataFrame:
    """Concatenated or pretty-printed values; a file is read whole by one task."""
    return parsed_values(spark.read.text(path, wholetext=True), repair)


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line as a JSON string."""
    lines = sequenced(spark.read.text(path))
    wrapped = F.to_json(F.struct(F.col("value").alias("x")), {"ignoreNullFields": "false"})
    return lines.select(SEQ, F.substring(wrapped, F.lit(6), F.length(wrapped) - 6).alias("value"))


def read_raw_whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The whole input as one JSON string, files by name, without its last line end: one value, so one task makes it."""
    named = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    files = named.agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("files"))
    return read_raw_from(files.select(F.array_join(F.transform("files", lambda f: f["value"]), "").alias("value")))


def read_raw_from(df: DataFrame) -> DataFrame:
    cut = F.regexp_replace("value", r"\n\z", "")
    wrapped = F.to_json(F.struct(cut.alias("x")), {"ignoreNullFields": "false"})
    return df.select(F.lit(0).cast("long").alias(SEQ), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6).alias("value"))


def null_input(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias(SEQ), F.lit("null").alias("value"))


def shaped(value: str, indent: int | str | None = None, raw: bool = False, sort_keys: bool = False, colour: bool = False) -> str:
    """One output as it is written: compact without indent; raw strings unquoted."""
    if indent is None and not raw and not sort_keys and not colour:
        return value
    v = parse(value)
    if raw and isinstance(v, str):
        return v
    return pretty(v, indent if indent is not None else 0, sort_keys, colour) if indent is not None or colour else text(v, sort_keys)


def _shaper(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": pa.array([shaped(v, **options) for v in batch.column(0).to_pylist()], pa.string())})

    return run


def write_text(outputs: DataFrame, path: str, **options: object) -> None:
    """Outputs (_seq, _out, value) in order as text files; options as of shaped()."""
    ship(outputs)
    ordered = outputs.where("value is not null").orderBy(SEQ, "_out").select("value")
    (ordered.mapInArrow(_shaper(options), "value string") if options else ordered).write.text(path)


def last_status(outputs: DataFrame) -> int:
    """Exit status by the last output: 0 true, 1 false or null, 4 none; 5 if any record failed."""
    row = outputs.agg(
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.struct(SEQ, "_out"))).alias("last"),
        F.count("value").alias("n"),
    ).first()
    if row["errors"]:
        return 5
    return 4 if not row["n"] else 1 if row["last"] in ("null", "false") else 0


def quoted_text(s: str) -> str:
    return quoted(s)


def argument(value: str, as_json: bool) -> object:
    """--arg and --argjson."""
    return json.loads(value) if as_json else value
