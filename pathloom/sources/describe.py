"""Schema inference: types, optional fields and array elements of a set of JSON records.

Each task folds its records into one small tree (fields with type bits and presence counts); trees merge
associatively, level by level over Spark's tree aggregation, so no task sees all records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.values import JsonTextError, kind, parse
from pathloom.plans.lanes import as_json, ship

ORDER = ("null", "boolean", "number", "string", "array", "object")
DEPTH = 12
EIGHT = 8


def seen(tree: dict, v: object, depth: int) -> None:
    """tree: n (times seen), t (types), f (fields), e (elements). depth: levels still followed, 0 none."""
    tree["n"] = tree.get("n", 0) + 1
    k = kind(v)
    tree["t"] = tree.get("t", 0) | 1 << ORDER.index(k)
    if k == "object":
        tree["o"] = tree.get("o", 0) + 1
    if depth == 0:
        return
    if k == "object":
        for name, x in v.items():
            seen(tree.setdefault("f", {}).setdefault(name, {}), x, depth - 1)
    elif k == "array":
        for x in v:
            seen(tree.setdefault("e", {}), x, depth - 1)


def merge(a: dict, b: dict) -> dict:
    out = {"n": a.get("n", 0) + b.get("n", 0), "t": a.get("t", 0) | b.get("t", 0), "o": a.get("o", 0) + b.get("o", 0)}
    if "f" in a or "f" in b:
        fa, fb = a.get("f", {}), b.get("f", {})
        out["f"] = {k: merge(fa[k], fb[k]) if k in fa and k in fb else fa.get(k) or fb[k] for k in [*fa, *(k for k in fb if k not in fa)]}
    if "e" in a or "e" in b:
        out["e"] = merge(a["e"], b["e"]) if "e" in a and "e" in b else a.get("e") or b["e"]
    return out


def names(bits: int) -> object:
    own = [n for i, n in enumerate(ORDER) if bits >> i & 1]
    return own[0] if len(own) == 1 else own


def shown(tree: dict, sort_keys: bool = False) -> object:
    """A field's schema: its type, or an object where there is more to say."""
    out: dict = {"type": names(tree["t"])}
    if tree.get("f"):
        items = sorted(tree["f"].items()) if sort_keys else tree["f"].items()
        out["fields"] = {}
        for name, t in items:
            own = shown(t, sort_keys)
            if t["n"] < tree["o"]:
                own = {**(own if isinstance(own, dict) else {"type": own}), "optional": True}
            out["fields"][name] = own
    if tree.get("e"):
        out["elements"] = shown(tree["e"], sort_keys)
    return out["type"] if len(out) == 1 else out


def report(tree: dict, sort_keys: bool = False) -> dict:
    if not tree.get("n"):
        return {"type": "empty", "count": 0}
    own = shown(tree, sort_keys)
    return {**(own if isinstance(own, dict) else {"type": own}), "count": tree["n"]}


def describe_values(values: Iterator, depth: int = DEPTH, sort_keys: bool = False) -> dict:
    """In one process: depth 0 is without limit."""
    tree: dict = {}
    for v in values:
        seen(tree, v, depth or -1)
    return report(tree, sort_keys)


def _folded(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: dict = {}
        for batch in batches:
            for v in batch.column(0).to_pylist():
                try:
                    seen(tree, parse(v), depth or -1)
                except JsonTextError:
                    continue
        yield pa.RecordBatch.from_pydict({"tree": pa.array([json.dumps(tree)], pa.string())})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree: dict = {}
    for batch in batches:
        for t in batch.column(0).to_pylist():
            tree = merge(tree, json.loads(t))
    yield pa.RecordBatch.from_pydict({"tree": pa.array([json.dumps(tree)], pa.string())})


def described(df: DataFrame, depth: int = DEPTH, sort_keys: bool = True) -> DataFrame:
    """One row: the schema of df's records as JSON text."""
    ship(df)
    trees = as_json(df).select("value").mapInArrow(_folded(depth), "tree string")
    n = trees.rdd.getNumPartitions()
    while n > EIGHT:  # merge eight to one until few are left; a shuffle between, so that the scan keeps its tasks
        n = -(-n // EIGHT)
        trees = trees.repartition(n).mapInArrow(_merged, "tree string")
    rows = trees.collect()  # at most eight trees, each as large as the schema
    tree: dict = {}
    for r in rows:
        tree = merge(tree, json.loads(r[0]))
    return df.sparkSession.createDataFrame([(json.dumps(report(tree, sort_keys), ensure_ascii=False, separators=(",", ":")),)], "schema string").select(F.col("schema"))
