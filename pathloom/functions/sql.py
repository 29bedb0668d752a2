"""The filter language inside Spark SQL: a function giving all outputs as an array, and a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.api import Filter
from pathloom.functions.values import JsonError, JsonTextError, parse, text

_filters: dict[str, Filter] = {}


def _filter(source: str) -> Filter:
    if source not in _filters:
        if len(_filters) > 64:
            _filters.clear()
        _filters[source] = Filter(source)
    return _filters[source]


@F.pandas_udf(T.ArrayType(T.StringType()))
def path_query(values: pd.Series, sources: pd.Series) -> pd.Series:
    """path_query(json, filter): all outputs as JSON texts; null where the text or the filter raises."""

    def one(value: str | None, source: str) -> list[str] | None:
        try:
            return [text(x) for x in _filter(source).run(parse(value if value is not None else "null"))]
        except (JsonError, JsonTextError):
            return None

    return pd.Series([one(v, s) for v, s in zip(values, sources)], dtype=object)


class PathRows:
    """path_rows(json, filter): a row (pos, value) for each output, for LATERAL joins."""

    def eval(self, value: str, source: str):
        try:
            for i, x in enumerate(_filter(source).run(parse(value if value is not None else "null"))):
                yield i, text(x)
        except (JsonError, JsonTextError):
            return


def register(spark: SparkSession) -> None:
    spark.udf.register("path_query", path_query)
    spark.udtf.register("path_rows", F.udtf(PathRows, returnType="pos int, value string"))
