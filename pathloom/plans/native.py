"""Filters on typed columns, as Catalyst expressions.

``Typed`` is a Column with its Spark type. SQL NULL stands for JSON null; a value that would raise in
the evaluator (a wrong operand, a zero divisor) is NULL here, so one bad record doesn't end a job.
What can't be expressed raises NotNative, and the planner takes the evaluator instead.
Predicates are built apart from values: in a filter, NULL counts as false and comparisons stay in the
form that scans can push down.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.patterns import PatternError, compiled

BOOL, LONG, DOUBLE, STRING = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()
NULL = T.NullType()


class NotNative(Exception):
    """The evaluator has to do this."""


class Typed(NamedTuple):
    col: Column
    type: T.DataType
    value: object = None  # of a literal


class Row:
    """The input of a filter: a record of columns, or one value."""

    def __init__(self, fields: dict[str, Typed] | None = None, value: Typed | None = None, variables: dict[str, Typed] | None = None):
        self.fields, self.value, self.variables = fields, value, variables or {}

    def on(self, value: Typed) -> "Row":
        return Row(None, value, self.variables)

    def having(self, name: str, value: Typed) -> "Row":
        return Row(self.fields, self.value, {**self.variables, name: value})

    @classmethod
    def of(cls, schema: T.StructType, prefix: Column | None = None, variables: dict | None = None) -> "Row":
        return cls({f.name: Typed(F.col(f"`{f.name}`") if prefix is None else prefix[f.name], f.dataType) for f in schema}, None, variables)


def family(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.NumericType,)):
        return "number"
    if isinstance(t, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "string"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "null" if isinstance(t, T.NullType) else "other"


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def literal(v: object) -> Typed:
    if v is None:
        return Typed(F.lit(None), NULL, None)
    if isinstance(v, bool):
        return Typed(F.lit(v), BOOL, v)
    if isinstance(v, int):
        return Typed(F.lit(v).cast("long"), LONG, v)
    if isinstance(v, float):
        return Typed(F.lit(v), DOUBLE, v)
    if isinstance(v, str):
        return Typed(F.lit(v), STRING, v)
    raise NotNative("literal")


def plain(x: Typed) -> Typed:
    """Times are ISO texts in JSON."""
    if is_time(x.type):
        col = x.col.cast("timestamp_ntz") if not isinstance(x.type, T.TimestampType) else x.col
        return Typed(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING)
    return x


def number(x: Typed) -> Typed:
    if family(x.type) != "number":
        raise NotNative("a number is needed")
    if isinstance(x.type, (T.LongType, T.DoubleType)):
        return x
    whole = isinstance(x.type, T.IntegralType)
    return Typed(x.col.cast("long" if whole else "double"), LONG if whole else DOUBLE, x.value)


def joint(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a value that is either."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if family(a) == family(b) == "number":
        return LONG if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else DOUBLE
    if family(a) == family(b) == "string":
        return STRING
    raise NotNative("values of two types")


def as_type(x: Typed, t: T.DataType) -> Column:
    return x.col if x.type == t else plain(x).col if t == STRING else x.col.cast(t)


def truthy(x: Typed) -> Column:
    return F.coalesce(x.col, F.lit(False)) if family(x.type) == "boolean" else x.col.isNotNull()


def to_text(x: Typed) -> Column:
    """tostring: strings as they are, else JSON text."""
    x = plain(x)
    f = family(x.type)
    if f == "string":
        return F.coalesce(x.col, F.lit("null"))
    if isinstance(x.type, T.IntegralType) or f == "boolean":
        return F.coalesce(x.col.cast("string"), F.lit("null"))
    if f == "number":
        d = x.col.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(d.isNull() | F.isnan(d), "null").when(whole, F.when(d == 0, "0").otherwise(F.floor(d).cast("string"))).otherwise(F.to_json(F.struct(d.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(d.alias("x")))) - 6))
    if f == "null":
        return F.lit("null")
    raise NotNative("text of a container")


ORDER = ("null", "boolean", "number", "string", "array", "object")


def compared(op: str, a: Typed, b: Typed) -> Column:
    """A comparison that is never NULL: null sorts below everything, other families by their order."""
    if is_time(a.type) and isinstance(b.value, str):
        b = Typed(F.try_to_timestamp(F.regexp_replace(F.lit(b.value), "Z$", "")).cast("timestamp_ntz"), T.TimestampNTZType(), b.value)
        a = Typed(a.col.cast("timestamp_ntz"), T.TimestampNTZType())
    elif is_time(b.type) and isinstance(a.value, str):
        return compared({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), b, a)
    elif is_time(a.type) != is_time(b.type):
        a, b = plain(a), plain(b)
    fa, fb = family(a.type), family(b.type)
    if "other" in (fa, fb) or isinstance(a.type, T.MapType) or isinstance(b.type, T.MapType):
        raise NotNative("comparison")
    if fa == "null" or fb == "null":
        x, flip = (b, True) if fa == "null" else (a, False)
        if flip:
            op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        null = x.col.isNull() if fa != fb else F.lit(True)
        return {"==": null, "!=": ~null, "<": F.lit(False), "<=": null, ">": ~null, ">=": F.lit(True)}[op]
    if fa != fb:
        below = ORDER.index(fa) < ORDER.index(fb)
        both = a.col.isNotNull() & b.col.isNotNull()
        less = F.when(both, F.lit(below)).otherwise(a.col.isNull() & b.col.isNotNull())
        same = a.col.isNull() & b.col.isNull()
        return {"==": same, "!=": ~same, "<": less, "<=": less | same, ">": ~(less | same), ">=": ~less}[op]
    x, y = a.col, b.col
    if b.value is not None or a.value is not None:  # one side is never null: forms that scans push down
        left, right, o = (x, y, op) if b.value is not None else (y, x, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op))
        own = a if b.value is not None else b
        never = own.value is not None
        if o == "==":
            return left == right if never else F.coalesce(left == right, F.lit(False))
        if o == "!=":
            return left != right if never else F.coalesce(left != right, F.lit(True))
        if o in (">", ">="):
            return F.coalesce(left > right if o == ">" else left >= right, F.lit(False))
        return (left < right if o == "<" else left <= right) | left.isNull()
    if op in ("==", "!="):
        return x.eqNullSafe(y) if op == "==" else ~x.eqNullSafe(y)
    if op in (">", ">="):
        return compared({">": "<", ">=": "<="}[op], b, a)
    strict = F.when(x.isNull(), y.isNotNull()).when(y.isNull(), F.lit(False)).otherwise(x < y)
    return strict if op == "<" else strict | x.eqNullSafe(y)


def predicate(node: tuple, row: Row) -> Column:
    """node as a filter's condition: NULL is false."""
    kind = node[0]
    if kind == "and":
        return predicate(node[2], row) & predicate(node[3], row)
    if kind == "or":
        return predicate(node[2], row) | predicate(node[3], row)
    if kind == "binary" and node[2] in ("==", "!=", "<", "<=", ">", ">="):
        a, b = value(node[3], row), value(node[4], row)
        fa, fb = family(a.type), family(b.type)
        if fa == fb and b.value is not None and not is_time(a.type) and node[2] in ("==", ">", ">="):
            return {"==": a.col == b.col, ">": a.col > b.col, ">=": a.col >= b.col}[node[2]]
        if is_time(a.type) and isinstance(b.value, str) and node[2] in (">", ">="):
            moment = F.lit(b.value.removesuffix("Z")).cast("timestamp_ntz")
            return a.col > moment if node[2] == ">" else a.col >= moment
        if is_time(a.type) and isinstance(b.value, str) and node[2] in ("<", "<="):
            moment = F.lit(b.value.removesuffix("Z")).cast("timestamp_ntz")
            return (a.col < moment if node[2] == "<" else a.col <= moment) | a.col.isNull()
        return compared(node[2], a, b)
    if kind == "pipe" and node[3][0] == "call" and node[3][2] == "not":
        return ~predicate(node[2], row)
    if kind == "call" and node[2] == "IN" and len(node[3]) == 1 and row.value is not None:
        options = [value(x, row) for x in commas(node[3][0])]
        if all(o.value is not None and family(o.type) == family(row.value.type) for o in options):
            return row.value.col.isin([o.value for o in options])
    return truthy(value(node, row))


def commas(node: tuple) -> list[tuple]:
    return commas(node[2]) + commas(node[3]) if node[0] == "comma" else [node]


def pipes(node: tuple) -> list[tuple]:
    return pipes(node[2]) + pipes(node[3]) if node[0] == "pipe" else [node]


# -- values ----------------------------------------------------------------------------------------


def value(node: tuple, row: Row) -> Typed:
    """The one value of a node; NotNative if it has none or several, or no typed form."""
    f = _NODES.get(node[0])
    if f is None:
        raise NotNative(node[0])
    return f(node, row)


def current(row: Row) -> Typed:
    if row.value is not None:
        return row.value
    parts = [x.col.alias(n) for n, x in row.fields.items()]
    return Typed(F.struct(*parts), T.StructType([T.StructField(n, x.type) for n, x in row.fields.items()]))


def get(x: Typed, name: str) -> Typed:
    if isinstance(x.type, T.StructType):
        for f in x.type:
            if f.name == name:
                return Typed(x.col[name], f.dataType)
        return literal(None)
    if isinstance(x.type, T.MapType) and isinstance(x.type.keyType, T.StringType):
        return Typed(F.try_element_at(x.col, F.lit(name)), x.type.valueType)
    if isinstance(x.type, T.NullType):
        return x
    raise NotNative("a field of a scalar")


def _field(node: tuple, row: Row) -> Typed:
    if node[2][0] == "identity" and row.value is None:
        return row.fields.get(node[3]) or literal(None)
    return get(value(node[2], row), node[3])


def _index(node: tuple, row: Row) -> Typed:
    x, k = value(node[2], row), value(node[3], row)
    if isinstance(k.value, str):
        return get(x, k.value)
    if isinstance(x.type, T.ArrayType) and family(k.type) == "number":
        i = F.floor(k.col).cast("int")
        at = F.when(i < 0, F.size(x.col) + i).otherwise(i) if not isinstance(k.value, int) or k.value < 0 else i
        return Typed(F.get(x.col, at), x.type.elementType)
    if isinstance(x.type, T.MapType) and family(k.type) == "string":
        return Typed(F.try_element_at(x.col, k.col), x.type.valueType)
    raise NotNative("index")


def _slice(node: tuple, row: Row) -> Typed:
    x = plain(value(node[2], row))
    n = F.length(x.col) if family(x.type) == "string" else F.size(x.col)
    if family(x.type) not in ("string", "array"):
        raise NotNative("slice")

    def bound(part: tuple | None, default: Column, up: bool) -> Column:
        if part is None:
            return default
        k = number(value(part, row))
        i = (F.ceil(k.col) if up else F.floor(k.col)).cast("int")
        return F.greatest(F.lit(0), F.least(n, F.when(i < 0, i + n).otherwise(i)))

    low, high = bound(node[3], F.lit(0), False), bound(node[4], n, True)
    size = F.greatest(F.lit(0), high - low)
    out = F.substring(x.col, low + 1, size) if family(x.type) == "string" else F.slice(x.col, low + 1, size)
    return Typed(F.when(x.col.isNotNull(), out), x.type)


def _binary(node: tuple, row: Row) -> Typed:
    op, a, b = node[2], value(node[3], row), value(node[4], row)
    if op in ("==", "!=", "<", "<=", ">", ">="):
        return Typed(compared(op, a, b), BOOL)
    a, b = plain(a), plain(b)
    fa, fb = family(a.type), family(b.type)
    if op == "+":
        if fa == "null":
            return b
        if fb == "null":
            return a
        if fa == fb == "number":
            a, b = number(a), number(b)
            t = joint(a.type, b.type)
            return Typed(_added(a, b, a.col + b.col), t)
        if fa == fb and fa in ("string", "array") and (fa == "string" or a.type == b.type):
            return Typed(_added(a, b, F.concat(a.col, b.col)), a.type)
        if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
            out = {f.name: Typed(a.col[f.name], f.dataType) for f in a.type} | {f.name: Typed(b.col[f.name], f.dataType) for f in b.type}
            return record(out)
        raise NotNative("+")
    if op == "-":
        if fa == fb == "number":
            a, b = number(a), number(b)
            return Typed(a.col - b.col, joint(a.type, b.type))
        if fa == fb == "array" and a.type == b.type:
            return Typed(F.filter(a.col, lambda x: ~F.exists(b.col, lambda y: x.eqNullSafe(y))), a.type)
        raise NotNative("-")
    if op == "*":
        if fa == fb == "number":
            a, b = number(a), number(b)
            return Typed(a.col * b.col, joint(a.type, b.type))
        if {fa, fb} == {"string", "number"}:
            s, n = (a, b) if fa == "string" else (b, a)
            return Typed(F.when(n.col >= 0, F.repeat(s.col, F.floor(n.col).cast("int"))), STRING)
        raise NotNative("*")
    if op == "/":
        if fa == fb == "number":
            return Typed(F.try_divide(a.col.cast("double"), b.col.cast("double")), DOUBLE)
        if fa == fb == "string" and isinstance(b.value, str) and b.value:
            return Typed(_split(a.col, b.value), T.ArrayType(STRING))
        raise NotNative("/")
    if fa == fb == "number":
        x, y = a.col.cast("long"), F.abs(b.col.cast("long"))
        return Typed(F.when(y != 0, x % y), LONG)
    raise NotNative(op)


def _added(a: Typed, b: Typed, both: Column) -> Column:
    """null + x is x."""
    if a.value is not None and b.value is not None:
        return both
    if b.value is not None:
        return F.coalesce(both, b.col.cast(joint(a.type, b.type)))
    if a.value is not None:
        return F.coalesce(both, a.col.cast(joint(a.type, b.type)))
    return F.coalesce(both, a.col, b.col)


def _split(col: Column, by: str) -> Column:
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, "\\Q" + by.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1))


def record(parts: dict[str, Typed]) -> Typed:
    if not parts:
        raise NotNative("an empty object")
    cols = [(x.col if family(x.type) != "null" else F.lit(None).cast("string")).alias(n) for n, x in parts.items()]
    return Typed(F.struct(*cols), T.StructType([T.StructField(n, x.type if family(x.type) != "null" else STRING) for n, x in parts.items()]))


def entries(node: tuple, row: Row) -> dict[str, Typed]:
    out: dict[str, Typed] = {}
    for k, x in node[2]:
        key = value(k, row)
        if not isinstance(key.value, str):
            raise NotNative("a computed key")
        out[key.value] = plain(value(x, row))
    return out


def _object(node: tuple, row: Row) -> Typed:
    return record(entries(node, row))


def _array(node: tuple, row: Row) -> Typed:
    if node[2] is None:
        raise NotNative("an empty array")
    parts = commas(node[2])
    if len(parts) == 1 and (made := stream(parts[0], row)) is not None:
        return made
    items = [plain(value(p, row)) for p in parts]
    t = items[0].type
    for x in items[1:]:
        t = joint(t, x.type)
    return Typed(F.array(*[as_type(x, t) for x in items]), T.ArrayType(t))


def stream(node: tuple, row: Row) -> Typed | None:
    """The outputs of a generator as an array; None if node is no generator known here."""
    steps = pipes(node)
    at = next((i for i, s in enumerate(steps) if s[0] == "iterate" or s[0] == "call" and s[2] in ("range", "scan", "splits")), None)
    if at is None:
        return None
    for s in steps[:at]:
        row = row.on(value(s, row))
    steps = steps[at:]
    first = steps[0]
    if first[0] == "iterate":
        x = value(first[2], row)
        if isinstance(x.type, T.MapType):
            x = Typed(F.map_values(x.col), T.ArrayType(x.type.valueType))
    elif first[0] == "call" and first[2] == "range" and len(first[3]) in (1, 2, 3):
        x = _range(first, row)
    elif first[0] == "call" and first[2] in ("scan", "splits") and len(first[3]) in (1, 2):
        x = _segments(first, row)
    else:
        return None
    if not isinstance(x.type, T.ArrayType):
        raise NotNative("iteration over no array")
    return through(x, steps[1:], row)


def through(x: Typed, steps: list[tuple], row: Row) -> Typed:
    """An array of a stream after further steps on each of its values."""
    for step in steps:
        x = _onward(x, step, row)
    return x


def _onward(x: Typed, step: tuple, row: Row) -> Typed:
    t = x.type.elementType
    if step[0] == "call" and step[2] == "select" and len(step[3]) == 1:
        return Typed(F.filter(x.col, lambda e: F.coalesce(predicate(step[3][0], row.on(Typed(e, t))), F.lit(False))), x.type)
    if step[0] == "call" and step[2] == "empty":
        return Typed(F.slice(x.col, 1, 0), x.type)
    if step[0] == "iterate" and step[2][0] == "identity" and isinstance(t, T.ArrayType):
        return Typed(F.flatten(F.filter(x.col, lambda e: e.isNotNull())), t)
    held: list[T.DataType] = []

    def one(e: Column) -> Column:
        made = plain(value(step, row.on(Typed(e, t))))
        held.append(made.type)
        return made.col if family(made.type) != "null" else F.lit(None).cast("string")

    return Typed(F.transform(x.col, one), T.ArrayType(held[-1]))


def _range(node: tuple, row: Row) -> Typed:
    parts = [number(value(a, row)) for a in node[3]]
    if any(not isinstance(p.type, T.LongType) for p in parts):
        raise NotNative("range of fractions")
    low, high = (literal(0), parts[0]) if len(parts) == 1 else parts[:2]
    step = parts[2] if len(parts) == 3 else literal(1)
    if not isinstance(step.value, int) or step.value == 0:
        raise NotNative("range by a computed step")
    last = high.col - (1 if step.value > 0 else -1)
    some = low.col < high.col if step.value > 0 else low.col > high.col
    return Typed(F.when(some, F.sequence(low.col, last, step.col)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))


def pattern(node: tuple, row: Row, flags: tuple | None, keep: str = "ixs") -> str:
    """A Java pattern with inline flags; the reference syntax without backreferences or lookaround."""
    p = value(node, row)
    f = value(flags, row).value if flags else ""
    if not isinstance(p.value, str) or not isinstance(f, str) or set(f) - set(keep) - {"g"}:
        raise NotNative("a computed pattern")
    try:
        compiled(p.value, f)
    except PatternError as e:
        raise NotNative(str(e)) from None
    inline = "".join(sorted(set(f) & set("ixs")))
    return (f"(?{inline})" if inline else "") + p.value


def _segments(node: tuple, row: Row) -> Typed:
    x = plain(current(row))
    if family(x.type) != "string":
        raise NotNative(node[2])
    p = pattern(node[3][0], row, node[3][1] if len(node[3]) > 1 else None)
    own = compiled(value(node[3][0], row).value, "")[0]
    if node[2] == "scan":
        if own.groups or own.match(""):
            raise NotNative("scan with groups")
        return Typed(F.regexp_extract_all(x.col, F.lit(p), 0), T.ArrayType(STRING))
    if own.match(""):
        raise NotNative("splits at nothing")
    return Typed(F.split(x.col, p, -1), T.ArrayType(STRING))


def _interpolate(node: tuple, row: Row) -> Typed:
    parts = []
    for p in node[3]:
        if isinstance(p, str):
            parts.append(F.lit(p))
        else:
            x = value(p, row)
            parts.append(_encoded(node[2], x) if node[2] else to_text(x))
    return Typed(F.concat(*parts), STRING)


def _encoded(name: str, x: Typed) -> Column:
    if name == "text":
        return to_text(x)
    if name == "json":
        return _json(x)
    if name in ("csv", "tsv"):
        if not isinstance(x.type, T.ArrayType):
            raise NotNative(name)
        t = x.type.elementType

        def cell(e: Column) -> Column:
            own = Typed(e, t)
            if family(t) == "string":
                if name == "csv":
                    s = F.concat(F.lit('"'), F.replace(e, F.lit('"'), F.lit('""')), F.lit('"'))
                else:
                    s = e
                    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                        s = F.replace(s, F.lit(a), F.lit(b))
                return F.coalesce(s, F.lit(""))
            return F.when(e.isNull(), "").otherwise(to_text(own))

        return F.array_join(F.transform(x.col, cell), "," if name == "csv" else "\t")
    s = to_text(x)
    if name == "html":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return s
    if name == "uri":
        s = F.url_encode(s)
        for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return s
    if name == "sh":
        return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'")) if family(plain(x).type) == "string" else s
    if name == "base64":
        return F.replace(F.base64(s.cast("binary")), F.lit("\r\n"), F.lit(""))
    raise NotNative(f"@{name}")


def _json(x: Typed) -> Column:
    x = plain(x)
    if family(x.type) == "string":
        wrapped = F.to_json(F.struct(x.col.alias("x")), {"ignoreNullFields": "false"})
        return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    return to_text(x)


def _alternative(node: tuple, row: Row) -> Typed:
    a, b = plain(value(node[2], row)), plain(value(node[3], row))
    if family(a.type) == "null":
        return b
    if family(b.type) == "null" and family(a.type) != "boolean":
        return a
    t = joint(a.type, b.type)
    return Typed(F.coalesce(as_type(a, t), as_type(b, t)) if family(t) != "boolean" else F.when(truthy(a), a.col).otherwise(b.col), t)


def _if(node: tuple, row: Row) -> Typed:
    yes, no = plain(value(node[3], row)), plain(value(node[4], row))
    t = joint(yes.type, no.type)
    return Typed(F.when(predicate(node[2], row), as_type(yes, t)).otherwise(as_type(no, t)), t)


def _bind(node: tuple, row: Row) -> Typed:
    if len(node[3]) != 1 or node[3][0][0] != "var":
        raise NotNative("destructuring")
    return value(node[4], row.having(node[3][0][1], value(node[2], row)))


def _var(node: tuple, row: Row) -> Typed:
    if node[2] not in row.variables:
        raise NotNative(f"${node[2]}")
    return row.variables[node[2]]


def _pipe(node: tuple, row: Row) -> Typed:
    return value(node[3], row.on(value(node[2], row)))


def _reduce(node: tuple, row: Row) -> Typed:
    """A fold over an array whose state keeps its type."""
    if len(node[3]) != 1 or node[3][0][0] != "var":
        raise NotNative("reduce")
    items, start = stream(node[2], row), value(node[4][0], row)
    if items is None or family(start.type) not in ("number", "string", "boolean"):
        raise NotNative("reduce")
    name = node[3][0][1]
    for t in (start.type, DOUBLE):  # a whole start may grow a fraction
        col, kind = _fold(items, start, node[4][1], name, t, row)
        if kind == t:
            return Typed(col, t)
    raise NotNative("reduce over changing types")


def _fold(items: Typed, start: Typed, update: tuple, name: str, t: T.DataType, row: Row) -> tuple[Column, T.DataType]:
    kinds: list[T.DataType] = []

    def step(acc: Column, x: Column) -> Column:
        made = value(update, row.on(Typed(acc, t)).having(name, Typed(x, items.type.elementType)))
        kinds.append(made.type)
        return made.col

    return F.aggregate(items.col, start.col.cast(t), step), kinds[-1]


# -- calls -----------------------------------------------------------------------------------------


def _strings(f: Callable[[Column], Column], t: T.DataType = STRING) -> Callable:
    def run(x: Typed) -> Typed:
        x = plain(x)
        if family(x.type) != "string":
            raise NotNative("a string is needed")
        return Typed(f(x.col), t)

    return run


def _doubles(f: Callable[[Column], Column]) -> Callable:
    return lambda x: Typed(f(number(x).col.cast("double")), DOUBLE)


def _wholes(f: Callable[[Column], Column]) -> Callable:
    def run(x: Typed) -> Typed:
        x = number(x)
        return x if x.type == LONG else Typed(f(x.col).cast("long"), LONG)

    return run


def _length(x: Typed) -> Typed:
    x = plain(x)
    f = family(x.type)
    if f == "string":
        return Typed(F.coalesce(F.length(x.col), F.lit(0)).cast("long"), LONG)
    if f == "array" or isinstance(x.type, T.MapType):
        return Typed(F.when(x.col.isNull(), 0).otherwise(F.size(x.col)).cast("long"), LONG)
    if isinstance(x.type, T.StructType):
        return literal(len(x.type))
    if f == "number":
        return Typed(F.coalesce(F.abs(number(x).col), F.lit(0).cast(number(x).type)), number(x).type)
    raise NotNative("length")


def _type(x: Typed) -> Typed:
    f = family(x.type)
    if f == "other":
        raise NotNative("type")
    return Typed(F.when(x.col.isNull(), "null").otherwise(f), STRING)


def _tonumber(x: Typed) -> Typed:
    if family(x.type) == "number":
        return number(x)
    return Typed(F.when(x.col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.try_cast(x.col, DOUBLE) if hasattr(F, "try_cast") else x.col.try_cast("double")), DOUBLE)


def _arrays(f: Callable[[Typed], Typed]) -> Callable:
    def run(x: Typed) -> Typed:
        if not isinstance(x.type, T.ArrayType):
            raise NotNative("an array is needed")
        return f(x)

    return run


def _add(x: Typed) -> Typed:
    e = x.type.elementType
    some = F.filter(x.col, lambda v: v.isNotNull())
    if family(e) == "number":
        t = LONG if isinstance(e, T.IntegralType) else DOUBLE
        return Typed(F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast(t), lambda a, v: a + v.cast(t))), t)
    if family(e) == "string":
        return Typed(F.when(F.size(some) > 0, F.array_join(some, "")), STRING)
    if isinstance(e, T.ArrayType):
        return Typed(F.when(F.size(some) > 0, F.flatten(some)), e)
    raise NotNative("add")


def _quantified(every: bool) -> Callable:
    def run(x: Typed) -> Typed:
        return Typed((F.forall if every else F.exists)(x.col, lambda e: truthy(Typed(e, x.type.elementType))), BOOL)

    return run


def _keys(x: Typed) -> Typed:
    if isinstance(x.type, T.StructType):
        return Typed(F.array(*[F.lit(n) for n in sorted(f.name for f in x.type)]), T.ArrayType(STRING))
    if isinstance(x.type, T.MapType):
        return Typed(F.sort_array(F.map_keys(x.col)), T.ArrayType(STRING))
    return Typed(F.when(F.size(x.col) > 0, F.sequence(F.lit(0).cast("long"), F.size(x.col).cast("long") - 1)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))


def _seconds(x: Typed) -> Typed:
    if is_time(x.type):
        return Typed(F.unix_seconds(x.col.cast("timestamp")), LONG)
    return Typed(F.unix_seconds(F.try_to_timestamp(x.col, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))), LONG)


def moment(x: Typed) -> Column:
    """A number of seconds, or a time, as a timestamp."""
    if is_time(x.type):
        return x.col.cast("timestamp")
    if family(x.type) == "number":
        return F.timestamp_micros((x.col * 1000000).cast("long"))
    raise NotNative("a date is needed")


def _gmtime(x: Typed) -> Typed:
    t = moment(x)
    parts = [F.year(t), F.month(t) - 1, F.day(t), F.hour(t), F.minute(t), F.second(t), F.dayofweek(t) - 1, F.dayofyear(t) - 1]
    return Typed(F.array(*[p.cast("long") for p in parts]), T.ArrayType(LONG))


_CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "Z": "'UTC'", "p": "a", "I": "hh", "D": "MM/dd/yy", "R": "HH:mm"}


def date_pattern(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i + 1 : i + 2] not in _CODES:
                raise NotNative("a date code")
            out += _CODES[fmt[i + 1]]
            i += 2
        else:
            out += "''" if fmt[i] == "'" else f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


UNARY: dict[str, Callable[[Typed], Typed]] = {
    "not": lambda x: Typed(~truthy(x), BOOL), "length": _length, "type": _type, "tostring": lambda x: Typed(to_text(x), STRING), "tojson": lambda x: Typed(_json(x), STRING), "tonumber": _tonumber,
    "utf8bytelength": _strings(lambda c: F.octet_length(c).cast("long"), LONG),
    "ascii_downcase": _strings(lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
    "ascii_upcase": _strings(lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "trim": _strings(lambda c: F.regexp_replace(c, r"^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$", "")),
    "ltrim": _strings(lambda c: F.regexp_replace(c, r"^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+", "")),
    "rtrim": _strings(lambda c: F.regexp_replace(c, r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$", "")),
    "floor": _wholes(F.floor), "ceil": _wholes(F.ceil), "round": _wholes(F.round),
    "sqrt": _doubles(F.sqrt), "cbrt": _doubles(F.cbrt), "exp": _doubles(F.exp), "exp2": _doubles(lambda c: F.pow(F.lit(2.0), c)), "exp10": _doubles(lambda c: F.pow(F.lit(10.0), c)),
    "log": _doubles(F.ln), "log2": _doubles(F.log2), "log10": _doubles(F.log10), "sin": _doubles(F.sin), "cos": _doubles(F.cos), "tan": _doubles(F.tan), "asin": _doubles(F.asin), "acos": _doubles(F.acos), "atan": _doubles(F.atan),
    "fabs": _doubles(F.abs), "rint": _doubles(F.rint), "nearbyint": _doubles(F.rint), "trunc": _doubles(lambda c: F.signum(c) * F.floor(F.abs(c))),
    "abs": lambda x: Typed(F.abs(number(x).col), number(x).type),
    "isnan": lambda x: Typed(F.isnan(number(x).col.cast("double")), BOOL), "isinfinite": lambda x: Typed(F.abs(number(x).col.cast("double")) == F.lit(float("inf")), BOOL),
    "add": _arrays(_add), "min": _arrays(lambda x: Typed(F.array_min(x.col), x.type.elementType)), "max": _arrays(lambda x: Typed(F.array_max(x.col), x.type.elementType)),
    "sort": _arrays(lambda x: Typed(F.sort_array(x.col), x.type)), "unique": _arrays(lambda x: Typed(F.sort_array(F.array_distinct(x.col)), x.type)),
    "reverse": lambda x: Typed(F.reverse(x.col), x.type), "first": _arrays(lambda x: Typed(F.get(x.col, F.lit(0)), x.type.elementType)), "last": _arrays(lambda x: Typed(F.try_element_at(x.col, F.lit(-1)), x.type.elementType)),
    "flatten": _arrays(lambda x: Typed(F.flatten(x.col), x.type.elementType) if isinstance(x.type.elementType, T.ArrayType) else x),
    "any": _arrays(_quantified(False)), "all": _arrays(_quantified(True)), "keys": _keys,
    "todate": lambda x: Typed(F.date_format(moment(x), "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING), "fromdate": _seconds, "fromdateiso8601": _seconds, "gmtime": _gmtime,
    "explode": _strings(lambda c: F.transform(F.filter(F.split(c, ""), lambda s: s != ""), lambda s: F.ascii(s).cast("long")), T.ArrayType(LONG)),
}
UNARY["todateiso8601"] = UNARY["todate"]


def _call(node: tuple, row: Row) -> Typed:
    name, args = node[2], node[3]
    if not args:
        if name in UNARY:
            return UNARY[name](current(row))
        if name == "nan":
            return Typed(F.lit(float("nan")), DOUBLE)
        if name == "infinite":
            return Typed(F.lit(float("inf")), DOUBLE)
        if name == "now":
            return Typed(F.unix_micros(F.current_timestamp()) / 1e6, DOUBLE)
        raise NotNative(name)
    if name == "map" and len(args) == 1:
        x = current(row)
        if isinstance(x.type, T.ArrayType):
            return through(x, pipes(args[0]), row)
        raise NotNative("map")
    if name in ("any", "all") and len(args) == 1:
        x = current(row)
        if not isinstance(x.type, T.ArrayType):
            raise NotNative(name)
        test = lambda e: F.coalesce(predicate(args[0], row.on(Typed(e, x.type.elementType))), F.lit(False))
        return Typed((F.exists if name == "any" else F.forall)(x.col, test), BOOL)
    if name in ("test", "capture") and len(args) in (1, 2):
        x = plain(current(row))
        if name == "test" and family(x.type) == "string":
            return Typed(F.coalesce(x.col.rlike(pattern(args[0], row, args[1] if len(args) > 1 else None)), F.lit(False)), BOOL)
        raise NotNative(name)
    if name in ("sub", "gsub") and len(args) in (2, 3):
        x, new = plain(current(row)), value(args[1], row.on(literal(None)))
        if name == "gsub" and family(x.type) == "string" and isinstance(new.value, str):
            return Typed(F.regexp_replace(x.col, pattern(args[0], row, args[2] if len(args) > 2 else None), new.value.replace("\\", "\\\\").replace("$", "\\$")), STRING)
        raise NotNative(name)
    if name == "select":
        raise NotNative("select is no single value")
    x = plain(current(row)) if name not in ("strftime", "has", "strflocaltime") else current(row)
    if name == "IN" and len(args) == 1:
        options = [value(o, row) for o in commas(args[0])]
        if all(o.value is not None and family(o.type) == family(x.type) for o in options):
            return Typed(F.coalesce(x.col.isin([o.value for o in options]), F.lit(False)), BOOL)
        raise NotNative(name)
    given = [value(a, row) for a in args]
    if len(given) == 1:
        a = given[0]
        strings = family(x.type) == "string" and family(a.type) == "string"
        if name in ("startswith", "endswith") and strings:
            return Typed(x.col.startswith(a.col) if name == "startswith" else x.col.endswith(a.col), BOOL)
        if name == "ltrimstr" and strings:
            return Typed(F.when(x.col.startswith(a.col), F.substring(x.col, F.length(a.col) + 1, F.length(x.col))).otherwise(x.col), STRING)
        if name == "rtrimstr" and strings:
            return Typed(F.when(x.col.endswith(a.col) & (F.length(a.col) > 0), F.substring(x.col, F.lit(1), F.length(x.col) - F.length(a.col))).otherwise(x.col), STRING)
        if name == "split" and strings and isinstance(a.value, str):
            return Typed(_split(x.col, a.value) if a.value else F.filter(F.split(x.col, ""), lambda s: s != ""), T.ArrayType(STRING))
        if name == "join" and isinstance(x.type, T.ArrayType) and isinstance(a.value, str):
            t = x.type.elementType
            return Typed(F.array_join(F.transform(x.col, lambda e: F.when(e.isNull(), "").otherwise(to_text(Typed(e, t)))), a.value), STRING)
        if name == "contains" and strings:
            return Typed(x.col.contains(a.col), BOOL)
        if name == "contains" and isinstance(x.type, T.ArrayType) and isinstance(a.type, T.ArrayType) and family(x.type.elementType) == family(a.type.elementType) == "number":
            return Typed(F.forall(a.col, lambda e: F.exists(x.col, lambda y: y == e)), BOOL)
        if name == "inside" and strings:
            return Typed(a.col.contains(x.col), BOOL)
        if name == "index" and strings:
            return Typed(F.when(F.locate(a.value, x.col) > 0, F.locate(a.value, x.col) - 1).cast("long"), LONG)
        if name == "has" and isinstance(x.type, T.StructType) and isinstance(a.value, str):
            return literal(any(f.name == a.value for f in x.type))
        if name == "has" and isinstance(x.type, T.ArrayType) and family(a.type) == "number":
            return Typed((a.col >= 0) & (a.col < F.size(x.col)), BOOL)
        if name == "flatten" and a.value in (0, 1) and isinstance(x.type, T.ArrayType):
            return x if a.value == 0 else UNARY["flatten"](x)
        if name in ("strftime", "strflocaltime") and isinstance(a.value, str):
            return Typed(F.date_format(moment(x), date_pattern(a.value)), STRING)
        if name == "nth" and isinstance(x.type, T.ArrayType):
            return Typed(F.get(x.col, a.col.cast("int")), x.type.elementType)
    if len(given) == 2 and name in ("pow", "atan2", "hypot"):
        a, b = (number(g).col.cast("double") for g in given)
        return Typed({"pow": F.pow, "atan2": F.atan2, "hypot": F.hypot}[name](a, b), DOUBLE)
    if len(given) == 2 and name in ("ldexp", "scalb", "scalbln"):
        a, b = (number(g).col.cast("double") for g in given)
        return Typed(a * F.pow(F.lit(2.0), b), DOUBLE)
    if len(given) == 3 and name == "fma":
        a, b, c = (number(g).col.cast("double") for g in given)
        return Typed(a * b + c, DOUBLE)
    raise NotNative(f"{name}/{len(args)}")


def _assign(node: tuple, row: Row) -> Typed:
    """A plain field of a record set or updated."""
    op, left, right = node[2], node[3], node[4]
    x = current(row)
    if left[0] != "field" or left[2][0] != "identity" or not isinstance(x.type, T.StructType):
        raise NotNative("assignment")
    name = left[3]
    old = get(x, name)
    if op == "=":
        new = value(right, row)
    elif op == "|=":
        new = value(right, row.on(old))
    elif op == "//=":
        new = value(("alternative", 0, left, right), row)
    else:
        new = value(("binary", 0, op[:-1], left, right), row)
    parts = {f.name: Typed(x.col[f.name], f.dataType) for f in x.type}
    return record({**parts, name: new})


_NODES: dict[str, Callable[[tuple, Row], Typed]] = {
    "identity": lambda n, r: current(r), "literal": lambda n, r: literal(n[2]), "field": _field, "index": _index, "slice": _slice, "binary": _binary, "object": _object, "array": _array,
    "interpolate": _interpolate, "format": lambda n, r: Typed(_encoded(n[2], current(r)), STRING), "alternative": _alternative, "if": _if, "bind": _bind, "var": _var, "pipe": _pipe, "reduce": _reduce,
    "call": _call, "assign": _assign,
    "and": lambda n, r: Typed(predicate(n[2], r) & predicate(n[3], r), BOOL), "or": lambda n, r: Typed(predicate(n[2], r) | predicate(n[3], r), BOOL),
    "negate": lambda n, r: (lambda x: Typed(-x.col, x.type, None if x.value is None else -x.value))(number(value(n[2], r))),
    "try": lambda n, r: value(n[2], r) if n[3] is None or n[3][0] == "call" and n[3][2] == "empty" else _no("catch"),
}


def _no(what: str) -> Typed:
    raise NotNative(what)
