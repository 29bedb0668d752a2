"""compile() -> Filter: evaluate JSON texts, or apply a filter to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.values import JsonError, parse, text, values_of
from pathloom.operators.evaluate import Code, Compiler, Halt
from pathloom.plans import lanes, planner
from pathloom.plans.native import NotNative
from pathloom.plans.numbering import SEQ
from pathloom.plans.syntax import FilterSyntaxError
from pathloom.plans.syntax import parse as parse_filter

GATHERED_ROWS = 200_000

__all__ = ["Filter", "FilterSyntaxError", "Halt", "JsonError", "compile", "validate"]


class Filter:
    """A filter text with its named values. Small and picklable: workers compile it themselves."""

    def __init__(self, source: str, named: dict | None = None, positional: list | None = None, search: tuple[str, ...] = (), tables: tuple[str, ...] = ()):
        self.source, self.named, self.positional, self.search = source, dict(named or {}), list(positional or []), tuple(search)
        self.tables = tuple(tables)  # names that slurp() binds to DataFrames
        self._made: tuple[Code, dict] | None = None
        self._inputs: Iterator | None = None
        self.code  # noqa: B018  raises FilterSyntaxError at once

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": None, "_inputs": None}

    @property
    def code(self) -> Code:
        if self._made is None:
            ids = {name: -1 - i for i, name in enumerate([*self.named, "ARGS", *self.tables])}
            compiler = Compiler(self.search, lambda: self._inputs if self._inputs is not None else iter(()))
            code = compiler.program(self.source, ids)
            env = {ids[k]: v for k, v in self.named.items()}
            env[ids["ARGS"]] = {"positional": self.positional, "named": self.named}
            self._made = code, env
        return self._made[0]

    def run(self, value: object, inputs: Iterator | None = None) -> Iterator:
        """Outputs for one value, lazily; raises JsonError at the first error. inputs: what ``input`` reads."""
        self._inputs = inputs
        code = self.code
        yield from code.many(value, self._made[1])

    def bound(self) -> Callable[[object], Iterator]:
        """run() without inputs, made ready once for many values."""
        self._inputs = None
        code, env = self.code, self._made[1]
        one = code.one
        return (lambda value: (one(value, env),)) if one is not None else lambda value: code.many(value, env)

    def eval(self, json_text: str) -> list[str]:
        """Compact texts of all outputs for one JSON text."""
        return [text(x) for x in self.run(parse(json_text))]

    def eval_all(self, json_text: str) -> list[str]:
        """The same for every value of a text."""
        return [text(x) for v in values_of(json_text) for x in self.run(v)]


    # -- DataFrames ------------------------------------------------------------------------------

    def apply(self, df: DataFrame, lane: str = "auto") -> DataFrame:
        """The filter on every record of df. lane: native, evaluator or auto.

        Native: typed columns. Evaluator: columns _seq, _out, value (JSON text) and error; a column
        ``value`` of strings is read as JSON texts, other rows as records.
        """
        texts = [f for f in df.schema if f.name != SEQ]
        as_text = len(texts) == 1 and texts[0].name == "value" and texts[0].dataType.simpleString() == "string"
        if lane == "native" or lane == "auto" and not as_text:
            try:
                return planner.over_rows(parse_filter(self.source), df, self.named)
            except NotNative:
                if lane == "native":
                    raise
        return lanes.interpreted(self, df)

    def slurp(self, df: DataFrame, tables: dict[str, DataFrame] | None = None, gather: int = GATHERED_ROWS) -> DataFrame:
        """The filter on df as one array; tables are read as $name[].

        Recognised forms run distributed. Others need the array itself in one task, which is done only
        for a df of at most ``gather`` rows (counted first); a larger one raises NotNative.
        """
        try:
            return planner.over_table(parse_filter(self.source), df, tables, self.named)
        except NotNative:
            if tables or df.count() > gather:
                raise
        rows = lanes.as_json(lanes.sequenced(df))
        one = rows.agg(F.array_sort(F.collect_list(F.struct(SEQ, "value"))).alias("rows"))
        packed = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["value"]), ","), F.lit("]"))
        return lanes.interpreted(self, one.select(F.lit(0).cast("long").alias(SEQ), packed.alias("value")), prefilter=False)


def compile(source: str, named: dict | None = None, positional: list | None = None, search: tuple[str, ...] = ()) -> Filter:  # noqa: A001
    return Filter(source, named, positional, search)


def validate(source: str, search: tuple[str, ...] = ()) -> dict | None:
    """None if the filter compiles, else the error as a dict: kind, message, offset, line, column."""
    try:
        Filter(source, search=search)
    except FilterSyntaxError as e:
        before = source[: e.offset]
        return {"kind": e.kind, "message": e.message, "offset": e.offset, "line": before.count("\n") + 1, "column": e.offset - (before.rfind("\n") + 1) + 1}
    return None


def from_file(path: str, **kwargs: object) -> Filter:
    """A filter read from a file on the driver."""
    return Filter(Path(path).read_text().rstrip("\r\n"), **kwargs)
