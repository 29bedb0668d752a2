"""The evaluator inside Spark: JSON texts in, ordered outputs and errors out, in Arrow batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.values import JsonError, JsonTextError, parse, text
from pathloom.plans.native import pipes
from pathloom.plans.numbering import SEQ, sequenced
from pathloom.plans.syntax import parse as parse_filter

OUT = f"{SEQ} long, _out long, value string, error string"
_ARROW = pa.schema([(SEQ, pa.int64()), ("_out", pa.int64()), ("value", pa.string()), ("error", pa.string())])
ROWS = 4096
ROOT = str(Path(__file__).resolve().parents[2])


def ship(df: DataFrame) -> None:
    """Let Python workers import this package where they share the driver's disk; elsewhere use --py-files."""
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)


def evaluated(filter_, repair: bool):
    """Batches (_seq, value) -> batches of OUT. Outputs are handed on in parts, so long streams don't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        outputs = filter_.bound()

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, schema=_ARROW)

        for batch in batches:
            for seq, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 0
                try:
                    for out in outputs(parse(value if value is not None else "null", repair)):
                        rows.append((seq, n, str(out) if type(out) is int else text(out), None))
                        n += 1
                        if len(rows) >= ROWS:
                            yield flush()
                except JsonTextError as e:
                    rows.append((seq, n, None, f"parse error: {e.message}"))
                except JsonError as e:
                    rows.append((seq, n, None, e.message))
                except RecursionError:
                    rows.append((seq, n, None, "nested too deeply"))
            if len(rows) >= ROWS:
                yield flush()
        if rows:
            yield flush()

    return run


def widened(t: T.DataType) -> T.DataType:
    """The type with doubles for floats: a float's shortest digits, read as a double, are another number."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(widened(t.elementType), t.containsNull)
    if isinstance(t, T.MapType):
        return T.MapType(widened(t.keyType), widened(t.valueType), t.valueContainsNull)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, widened(f.dataType), f.nullable) for f in t])
    return T.DoubleType() if isinstance(t, T.FloatType) else t


def as_json(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as JSON texts in column value. A lone string column named value is JSON text already."""
    own = [c for c in df.columns if c not in (SEQ, *keep)]
    if own == ["value"] and df.schema["value"].dataType.simpleString() == "string":
        return df
    types = {f.name: (f.dataType, widened(f.dataType)) for f in df.schema}
    cols = [F.col(f"`{c}`") if types[c][0] == types[c][1] else F.col(f"`{c}`").cast(types[c][1]).alias(c) for c in own]
    packed = F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return df.select(*[c for c in (SEQ, *keep) if c in df.columns], packed.alias("value"))


def interpreted(filter_, df: DataFrame, repair: bool = False, prefilter: bool = True) -> DataFrame:
    """Every row through the evaluator: _seq, _out, value, error."""
    ship(df)
    rows = as_json(sequenced(df)).select(SEQ, "value")
    if prefilter and (condition := harvested(parse_filter(filter_.source))) is not None:
        rows = rows.where(condition)
    return rows.mapInArrow(evaluated(filter_, repair), OUT)


# -- literal prefilter -----------------------------------------------------------------------------
# A record may only be passed over unread where reading it would give nothing: no output, no type error,
# no parse error. That is certain for a flat object without escapes whose one field of that name is a string.

_PLAIN = re.compile(r"[A-Za-z0-9 _,:;=@#%&<>~-]{2,}\Z")
_STRING = r'"[^"\\\x00-\x1f]*"'
_FIELD = rf"{_STRING}: ?(?:{_STRING}|-?(?:0|[1-9][0-9]{{0,14}})(?:\.[0-9]{{1,15}})?|true|false|null)"
_FLAT = rf"\A\{{{_FIELD}(?:, ?{_FIELD})*\}}\z"
#: Java's patterns recurse with every field: longer records are read.
SHORT = 2000


def needed(node: tuple) -> list[tuple[str, str]]:
    """(field, text): any record for which the condition holds has the text in that string field of its own."""
    if node[0] == "and":
        return needed(node[2])  # the right side is read only where the left one holds
    found = None
    if node[0] == "binary" and node[2] == "==":
        found = node[3], node[4]
    steps = pipes(node)
    if len(steps) == 2 and steps[1][0] == "call" and steps[1][2] in ("test", "contains", "startswith", "endswith") and len(steps[1][3]) == 1:
        found = steps[0], steps[1][3][0]
    if found and found[0][0] == "field" and found[0][2][0] == "identity" and found[1][0] == "literal" and isinstance(found[1][2], str):
        return [(found[0][3], found[1][2])]
    return []


def harvested(program: dict) -> Column | None:
    """Which texts must be read for a leading select; None: all."""
    if program["defs"] or program["imports"]:
        return None
    first = pipes(program["body"])[0]
    if first[0] != "call" or first[2] != "select" or len(first[3]) != 1:
        return None
    wanted = [(k, t) for k, t in needed(first[3][0]) if _PLAIN.match(t) and re.fullmatch(r"\w+", k, re.A)]
    if not wanted:
        return None
    (name, text_), value = wanted[0], F.col("value")
    known = (F.length(value) < SHORT) & value.rlike(_FLAT) & (F.regexp_count(value, F.lit(f'"{name}":')) == 1) & value.rlike(f'"{name}": ?"')
    return value.contains(text_) | ~F.coalesce(known, F.lit(False))
