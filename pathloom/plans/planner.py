"""Filters over whole DataFrames.

``over_rows`` runs a filter on every record; ``over_table`` runs it on the DataFrame as one array (slurp).
Recognised forms become filters, projections, explodes, shuffled aggregations, joins, windows and
sorts; nothing gathers the array. Where a step isn't expressible NotNative is raised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.plans import native as N
from pathloom.plans.native import NotNative, Row, Typed, commas, literal, pipes, plain, predicate, truthy, value
from pathloom.plans.numbering import SEQ, dealt, in_order, numbered, part, running, sequenced

HIDDEN = "_var_"
#: Nested loops: rows of the outer stream a task gets, and of the inner one that every executor may hold.
LOOP_ROWS, HELD_ROWS = 10_000, 1_000_000


@dataclass
class Rows:
    """A stream of values, one a row. single: the value is the one column ``value``, else the row is a record."""

    df: DataFrame
    single: bool = False
    names: dict[str, str] = field(default_factory=dict)  # variables and their hidden columns
    sorted_by: tuple = ()
    tables: dict = field(default_factory=dict)

    def shown(self) -> list[str]:
        return [c for c in self.df.columns if c != SEQ and not c.startswith(HIDDEN)]

    def row(self) -> Row:
        types = {f.name: f.dataType for f in self.df.schema}
        variables = {n: Typed(F.col(f"`{c}`"), types[c]) for n, c in self.names.items()}
        if self.single:
            return Row(None, Typed(F.col("value"), types["value"]), variables)
        return Row({c: Typed(F.col(f"`{c}`"), types[c]) for c in self.shown()}, None, variables)

    def kept(self) -> list[Column]:
        """Hidden columns that every projection carries on."""
        return [F.col(f"`{c}`") for c in self.df.columns if c == SEQ or c.startswith(HIDDEN)]

    def to(self, x: Typed) -> "Rows":
        x = plain(x)
        if isinstance(x.type, T.StructType):
            df = self.df.select(x.col.alias("_r"), *self.kept())
            return replace(self, df=df.select(*[F.col(f"_r.`{f.name}`").alias(f.name) for f in x.type], *self.kept()), single=False)
        col = x.col if N.family(x.type) != "null" else F.lit(None).cast("string")
        return replace(self, df=self.df.select(col.alias("value"), *self.kept()), single=True)

    def record(self, parts: dict[str, Typed]) -> "Rows":
        cols = [(x.col if N.family(x.type) != "null" else F.lit(None).cast("string")).alias(n) for n, x in parts.items()]
        return replace(self, df=self.df.select(*cols, *self.kept()), single=False)


@dataclass
class Whole:
    """The array of all rows."""

    rows: Rows


@dataclass
class Groups:
    """What group_by gives: an array of arrays, by keys."""

    rows: Rows
    keys: list[tuple]


@dataclass
class Lookup:
    """INDEX(rows; key): one row for each key text."""

    rows: Rows
    key: tuple


def result(state: object) -> DataFrame:
    if isinstance(state, Whole):
        state = state.rows
    if isinstance(state, Rows):
        df = state.df
        if state.sorted_by:
            df = df.orderBy(*state.sorted_by)
        return df.select(*[F.col(f"`{c}`") for c in state.shown()])
    raise NotNative("groups as a result")


# -- streams ---------------------------------------------------------------------------------------


def step(state: object, node: tuple) -> object:
    if isinstance(state, Rows):
        return on_rows(state, node)
    if isinstance(state, Whole):
        return on_whole(state, node)
    if isinstance(state, Groups):
        return on_groups(state, node)
    raise NotNative("step")


def through(state: object, nodes: list[tuple]) -> object:
    for node in nodes:
        if node[0] == "bind" and len(pipes(node)) == 1:
            return bound(state, node)
        state = step(state, node)
    return state


def bound(state: object, node: tuple) -> object:
    """source as $x | body."""
    if len(node[3]) != 1 or node[3][0][0] != "var":
        raise NotNative("destructuring")
    name, source, body = node[3][0][1], node[2], node[4]
    if isinstance(state, Whole) and source[0] == "call" and source[2] == "INDEX":
        rows = state.rows
        items, key = (rows_of(source[3][0], rows), source[3][1]) if len(source[3]) == 2 else (rows, source[3][0])
        tables = {**rows.tables, name: Lookup(items, key)}
        return through(Whole(replace(rows, tables=tables)), pipes(body))
    if isinstance(state, Whole) and source[0] == "identity":
        return lagged(state.rows, name, pipes(body))
    if isinstance(state, Whole) and source[0] == "iterate" and source[2][0] == "identity":
        return matched(state.rows, name, pipes(body))
    if not isinstance(state, Rows):
        raise NotNative("a binding of the whole array")
    steps = pipes(source)
    inner, hidden = state, f"{HIDDEN}{name}"
    if steps[0][0] == "iterate":  # one row for each value, the record stays
        x = value(steps[0][2], state.row())
        if not isinstance(x.type, T.ArrayType):
            raise NotNative("iteration over no array")
        inner = replace(state, df=state.df.withColumn(hidden, F.explode(x.col)))
        if len(steps) > 1:
            raise NotNative("a longer source")
    else:
        inner = replace(state, df=state.df.withColumn(hidden, plain(value(source, state.row())).col))
    inner.names = {**state.names, name: hidden}
    return through(inner, pipes(body))


def replaced(node: object, change: Callable[[tuple], object]) -> object:
    """The tree with every node that change gives something for replaced by it."""
    if not isinstance(node, tuple):
        return node
    made = change(node) if node and isinstance(node[0], str) else None
    return tuple(replaced(x, change) for x in node) if made is None else made


def mentions(node: object, name: str) -> bool:
    return isinstance(node, tuple) and (node[:1] == ("var",) and node[-1] == name or any(mentions(x, name) for x in node))


def chained(steps: list[tuple]) -> tuple:
    out = steps[-1]
    for step_ in reversed(steps[:-1]):
        out = ("pipe", step_[1], step_, out)
    return out


def lagged(rows: Rows, name: str, steps: list[tuple]) -> Rows:
    """. as $a | range(1; length) | ... $a[.] ... $a[. - 1]: every value but the first beside the one before it.

    Within a part of the order the value before is the window's; the first of a part takes the last value of the
    part before, a row a part.
    """
    length = steps[0][3][1] if steps[0][0] == "call" and steps[0][2] == "range" and len(steps[0][3]) == 2 else ("none",)
    counted = pipes(length)
    whole = counted[-1][:1] == ("call",) and counted[-1][2] == "length" and (len(counted) == 1 or counted[0][:1] == ("var",) and counted[0][2] == name and len(counted) == 2)
    if not whole or steps[0][3][0][:1] != ("literal",) or steps[0][3][0][2] != 1 or len(steps) < 2:
        raise NotNative("a binding of the whole array")

    def place(node: tuple) -> tuple | None:
        if node[0] != "index" or node[2][:1] != ("var",) or node[2][2] != name:
            return None
        if node[3][0] == "identity":
            return ("var", node[1], "_now")
        if node[3][0] == "binary" and node[3][2] == "-" and node[3][3][0] == "identity" and node[3][4][0] == "literal" and node[3][4][2] == 1:
            return ("var", node[1], "_before")
        return None

    body = replaced(chained(steps[1:]), place)
    if mentions(body, name):
        raise NotNative("the whole array beside its values")
    wanted = [fields_of(body, lambda n, v=v: n[0] == "var" and n[-1] == v) for v in ("_now", "_before")]
    packed = F.col("value") if rows.single else struct_of(rows.shown(), None if None in wanted else wanted[0] | wanted[1])
    df = in_order(rows.df, list(rows.sorted_by)) if rows.sorted_by else sequenced(rows.df)
    now, before = f"{HIDDEN}_now", f"{HIDDEN}_before"
    df = numbered(df.select(SEQ, packed.alias(now)), "value").withColumn("_part", part())
    inner = W.partitionBy("_part").orderBy(SEQ)
    df = df.withColumns({before: F.lag(now).over(inner), "_first": F.row_number().over(inner) == 1})
    last = df.groupBy(F.col("_part").alias("_p")).agg(F.max_by(now, SEQ).alias("_last"))
    last = last.select("_p", F.lag("_last").over(W.orderBy("_p")).alias("_last"))
    df = df.join(last, F.col("_part") == F.col("_p"), "left").withColumn(before, F.when(F.col("_first"), F.col("_last")).otherwise(F.col(before)))
    df = df.where("value >= 1").select(SEQ, "value", now, before)
    return through(Rows(df, single=True, names={"_now": now, "_before": before}, tables=rows.tables), pipes(body))


def join_keys(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Both sides of an equality; 32-bit integers as longs that are never null, as joins are fastest on such (null equals null here)."""
    if all(isinstance(x.type, (T.IntegerType, T.ShortType, T.ByteType)) for x in (a, b)):
        return tuple(F.coalesce(x.col.cast("long"), F.lit(1 << 40)) for x in (a, b))
    return a.col, b.col


def matched(rows: Rows, name: str, steps: list[tuple]) -> Rows:
    """.[] as $x | $t[] | select(... == $x...) | ...: a nested loop whose condition has an equality is a join.

    A key may have many rows on both sides, so tasks aren't cut by it: the outer rows are dealt evenly, and each task
    has all inner rows. A larger inner table is left to Spark's sort-merge join.
    """
    if len(steps) < 2 or steps[0][0] != "iterate" or steps[0][2][0] != "var" or steps[1][0] != "call" or steps[1][2] != "select":
        raise NotNative("a nested loop")
    inner = rows_of(steps[0], rows)
    if inner.single or rows.single:
        raise NotNative("a nested loop over values")
    alls, todo, keys = [], [steps[1][3][0]], []
    while todo:
        node = todo.pop()
        todo += [node[2], node[3]] if node[0] == "and" else []
        alls += [] if node[0] == "and" else [node]
    rest = []
    for node in alls:
        sides = (node[3], node[4]) if node[0] == "binary" and node[2] == "==" else (None, None)
        mine = [x for x in sides if x is not None and mentions(x, name)]
        if len(mine) == 1 and not reads_state(mine[0]):
            keys.append((mine[0], sides[1] if sides[0] is mine[0] else sides[0]))
        else:
            rest.append(node)
    if not keys:
        raise NotNative("a nested loop without an equality")
    body = rest + steps[2:]
    wanted = fields_of(tuple(body), lambda n: n[0] == "var" and n[-1] == name)
    hidden = f"{HIDDEN}{name}"
    pairs = [join_keys(plain(value(with_item(a, name), rows.row())), plain(value(b, inner.row()))) for a, b in keys]
    left = dealt(rows.df, LOOP_ROWS).select(struct_of(rows.shown(), wanted).alias(hidden), *[a.alias(f"_l{i}") for i, (a, _) in enumerate(pairs)])
    right = inner.df.select(*[F.col(f"`{c}`") for c in inner.shown()], *[b.alias(f"_r{i}") for i, (_, b) in enumerate(pairs)])
    if right.count() <= HELD_ROWS:
        right = F.broadcast(right)
    certain = [not (left.schema[f"_l{i}"].nullable or right.schema[f"_r{i}"].nullable) for i in range(len(keys))]
    same = [F.col(f"_l{i}") == F.col(f"_r{i}") if sure else F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i, sure in enumerate(certain)]
    joined = right.join(left, reduce(lambda a, b: a & b, same)).drop(*[f"_{s}{i}" for s in "lr" for i in range(len(keys))])
    out = Rows(joined, names={**inner.names, name: hidden}, tables=rows.tables)
    return through(out, [("call", n[1], "select", (n,)) for n in rest] + steps[2:])


def on_rows(rows: Rows, node: tuple) -> object:
    kind, row = node[0], rows.row()
    if kind == "identity":
        return rows
    if kind == "call" and node[2] == "select" and len(node[3]) == 1:
        if (joined := semi(rows, node[3][0])) is not None:
            return joined
        return replace(rows, df=rows.df.where(predicate(node[3][0], row)))
    if kind == "call" and node[2] == "empty":
        return replace(rows, df=rows.df.where(F.lit(False)))
    if kind == "call" and node[2] in N_SELECTORS and not node[3] and not row.fields:
        return replace(rows, df=rows.df.where(N_SELECTORS[node[2]](row.value)))
    if kind == "object" and all(k[0] == "literal" for k, _ in node[2]):
        try:
            return rows.record(N.entries(node, row))
        except NotNative:
            return fanned(rows, node)
    if (items := N.stream(node, row)) is not None:
        df = rows.df.select(*rows.kept(), F.explode(items.col).alias("value"))
        return unpacked(replace(rows, df=df, single=True))
    if kind == "field" or kind == "index" or kind == "iterate":
        if kind == "iterate":
            x = value(node[2], row)
            raise NotNative(f"iteration over {x.type.simpleString()}")
        return rows.to(value(node, row))
    if kind == "comma":
        branches = [plain(value(c, row)) for c in commas(node)]
        t = branches[0].type
        for b in branches[1:]:
            t = N.joint(t, b.type)
        df = rows.df.select(*rows.kept(), F.explode(F.array(*[N.as_type(b, t) for b in branches])).alias("value"))
        return unpacked(replace(rows, df=df, single=True))
    if kind == "if" and node[4][0] == "call" and node[4][2] == "empty":
        return on_rows(replace(rows, df=rows.df.where(predicate(node[2], row))), node[3])
    if kind == "pipe":
        return through(rows, pipes(node))
    return rows.to(value(node, row))


N_SELECTORS = {
    "numbers": lambda x: F.lit(N.family(x.type) == "number") & x.col.isNotNull(), "strings": lambda x: F.lit(N.family(x.type) == "string") & x.col.isNotNull(), "booleans": lambda x: F.lit(N.family(x.type) == "boolean") & x.col.isNotNull(),
    "nulls": lambda x: x.col.isNull(), "values": lambda x: x.col.isNotNull(), "arrays": lambda x: F.lit(N.family(x.type) == "array") & x.col.isNotNull(),
    "objects": lambda x: F.lit(N.family(x.type) == "object") & x.col.isNotNull(), "scalars": lambda x: F.lit(N.family(x.type) not in ("array", "object")) | x.col.isNull(),
    "iterables": lambda x: F.lit(N.family(x.type) in ("array", "object")) & x.col.isNotNull(),
}


def fanned(rows: Rows, node: tuple) -> Rows:
    """An object constructor with one generator among its values: the product over it."""
    row, made, at = rows.row(), {}, None
    for k, x in node[2]:
        try:
            made[k[2]] = plain(value(x, row))
        except NotNative:
            items = N.stream(x, row)
            if items is None or at is not None:
                raise
            at, made[k[2]] = k[2], items
    if at is None:
        raise NotNative("object")
    df = rows.df.withColumn(f"{HIDDEN}fan", F.explode(made[at].col))
    own = replace(rows, df=df)
    parts = {n: x if n != at else Typed(F.col(f"{HIDDEN}fan"), made[at].type.elementType) for n, x in made.items()}
    out = own.record(parts)
    return replace(out, df=out.df.drop(f"{HIDDEN}fan"))


def unpacked(rows: Rows) -> Rows:
    """Rows of one struct column are records."""
    t = rows.df.schema["value"].dataType
    if not isinstance(t, T.StructType):
        return rows
    return replace(rows, df=rows.df.select(*[F.col(f"value.`{f.name}`").alias(f.name) for f in t], *rows.kept()), single=False)


def rows_of(node: tuple, here: Rows) -> Rows:
    """A stream that reads a named table ($t[] | ...), or this one (.[] | ...)."""
    steps = pipes(node)
    first = steps[0]
    if first[0] != "iterate":
        raise NotNative("a stream of rows")
    if first[2][0] == "var" and isinstance(here.tables.get(first[2][2]), DataFrame):
        start = Rows(here.tables[first[2][2]], tables=here.tables)
    elif first[2][0] == "identity":
        start = replace(here)
    else:
        raise NotNative("a stream of rows")
    out = through(start, steps[1:])
    if not isinstance(out, Rows):
        raise NotNative("a stream of rows")
    return out


def semi(rows: Rows, condition: tuple) -> Rows | None:
    """select(.k | IN($t[] | .k)), and its negation with not: semi and anti joins. None if the condition is something else."""
    steps = pipes(condition)
    negated = len(steps) == 3 and steps[2][0] == "call" and steps[2][2] == "not"
    if len(steps) - negated != 2 or steps[1][0] != "call" or steps[1][2] != "IN" or len(steps[1][3]) != 1:
        return None
    try:
        other = rows_of(steps[1][3][0], rows)
    except NotNative:
        return None
    if not other.single:
        raise NotNative("IN of records")
    key = plain(value(steps[0], rows.row()))
    keys = other.df.select(F.col("value").alias("_in"))
    return replace(rows, df=rows.df.join(keys, key.col.eqNullSafe(F.col("_in")), "left_anti" if negated else "left_semi"))


# -- the whole array ---------------------------------------------------------------------------------


def on_whole(whole: Whole, node: tuple) -> object:
    rows, kind = whole.rows, node[0]
    row = rows.row()
    if kind == "identity":
        return whole
    if kind == "iterate":
        inner = through(whole, pipes(node[2]))
        if isinstance(inner, Whole):
            return inner.rows
        raise NotNative("iteration")
    if kind == "array" and node[2] is not None:
        made = through(whole, pipes(node[2]))
        if isinstance(made, Rows):
            return Whole(made)
        raise NotNative("an array of arrays")
    if kind == "pipe":
        return through(whole, pipes(node))
    if kind == "slice":
        return sliced(through(whole, pipes(node[2])), node)
    if kind in ("index", "field") and node[2][0] != "identity":
        inner = through(whole, pipes(node[2]))
        if isinstance(inner, (Whole, Rows)):
            return step(inner, (kind, node[1], ("identity", node[1]), node[3]))
    if kind == "index" and isinstance(node[3][2] if node[3][0] == "literal" else None, int):
        k = node[3][2]
        one = sliced(whole, ("slice", 0, None, ("literal", 0, k), ("literal", 0, k + 1) if k != -1 else None))
        return one.rows
    if kind == "binary" and node[2] in ("+", "-"):
        return set_operation(whole, node)
    if kind == "reduce":
        return folded(rows, node)
    if kind == "foreach":
        return running_fold(rows, node)
    if kind == "bind":
        return bound(whole, node)
    if kind == "call":
        name, args = node[2], node[3]
        if name == "map" and len(args) == 1:
            out = through(rows, pipes(args[0]))
            if isinstance(out, Rows):
                return Whole(out)
            raise NotNative("map")
        if name == "group_by" and len(args) == 1:
            return Groups(rows, commas(args[0]))
        if name in ("sort", "sort_by"):
            return sorted_(rows, commas(args[0]) if args else [("identity", 0)])
        if name == "reverse":
            if not rows.sorted_by:
                own = replace(rows, df=sequenced(rows.df))
                return Whole(replace(own, sorted_by=(F.col(SEQ).desc(),)))
            return Whole(replace(rows, sorted_by=tuple(flipped(c) for c in rows.sorted_by)))
        if name in ("unique", "unique_by"):
            return unique(rows, commas(args[0]) if args else [("identity", 0)])
        if name in ("first", "last") and not args:
            return on_whole(whole, ("index", 0, ("identity", 0), ("literal", 0, 0 if name == "first" else -1)))
        if name == "limit" and len(args) == 2 and args[0][0] == "literal":
            return sliced(Whole(rows_of(args[1], rows)), ("slice", 0, None, None, args[0])).rows
        if name == "first" and len(args) == 1:
            return sliced(Whole(rows_of(args[0], rows)), ("slice", 0, None, None, ("literal", 0, 1))).rows
        if name == "skip" and len(args) == 2 and args[0][0] == "literal":
            return sliced(Whole(rows_of(args[1], rows)), ("slice", 0, None, args[0], None)).rows
        if name == "JOIN":
            return lookup_join(rows, args)
        if name == "to_entries" and not args:
            own = numbered(in_order(rows.df, list(rows.sorted_by)) if rows.sorted_by else rows.df, "key")
            packed = F.col("value") if rows.single else F.struct(*[F.col(f"`{c}`") for c in rows.shown()])
            return Whole(Rows(own.select("key", packed.alias("value"), SEQ), tables=rows.tables))
        if name == "range" and len(args) in (1, 2, 3):
            raise NotNative("range")
    return Whole_value(rows, node)


def Whole_value(rows: Rows, node: tuple) -> Rows:
    """A value computed from the whole array: one global aggregation."""
    return aggregated(rows, [], node)


def flipped(c: Column) -> Column:
    return F.col("_flip") if c is None else _Order.flip(c)


class _Order:
    """Sort columns remember their direction, so reverse can turn them."""

    made: dict[int, tuple[Column, bool]] = {}

    @classmethod
    def of(cls, c: Column, up: bool) -> Column:
        out = c.asc_nulls_first() if up else c.desc_nulls_last()
        cls.made[id(out)] = (c, up, out)
        return out

    @classmethod
    def flip(cls, out: Column) -> Column:
        if id(out) not in cls.made:
            raise NotNative("reverse")
        c, up, _ = cls.made[id(out)]
        return cls.of(c, not up)


def sorted_(rows: Rows, keys: list[tuple]) -> Whole:
    """sort_by: keys become hidden columns; ties keep the order of reading."""
    df, order = sequenced(rows.df), []
    for i, k in enumerate(keys):
        up = k[0] != "negate"
        x = plain(value(k if up else k[2], rows.row()))
        if N.family(x.type) in ("object", "other") or not up and N.family(x.type) != "number":
            raise NotNative("sort key")
        name = f"{HIDDEN}sort{i}_{len(df.columns)}"
        df = df.withColumn(name, x.col)
        order.append(_Order.of(F.col(name), up))
    return Whole(replace(rows, df=df, sorted_by=(*order, _Order.of(F.col(SEQ), True))))


def sliced(whole: object, node: tuple) -> Whole:
    """.[a:b] of the (sorted) array: offset and limit, or from the end the reverse of one."""
    if not isinstance(whole, Whole):
        raise NotNative("slice")

    def bound(n: tuple | None) -> int | None:
        if n is None:
            return None
        if n[0] == "negate" and n[2][0] == "literal" and isinstance(n[2][2], int):
            return -n[2][2]
        if n[0] == "literal" and (n[2] is None or isinstance(n[2], int)):
            return n[2]
        raise NotNative("a computed slice")

    low, high = bound(node[3]) or 0, bound(node[4])
    rows = whole.rows
    df = rows.df if rows.sorted_by else sequenced(rows.df)
    order = rows.sorted_by or (_Order.of(F.col(SEQ), True),)
    if low < 0 or (high is not None and high < 0):
        if high is None or (low < 0 and high < 0):
            back = tuple(_Order.flip(c) for c in order)
            out = df.orderBy(*back).offset(-(high or 0)).limit((high or 0) - low)
            return Whole(replace(rows, df=out, sorted_by=order))
        raise NotNative("a slice from both ends")
    out = df.orderBy(*order)
    out = out.offset(low) if low else out
    out = out.limit(max(0, high - low)) if high is not None else out
    return Whole(replace(rows, df=out, sorted_by=order))


def unique(rows: Rows, keys: list[tuple]) -> Whole:
    """The first row of every key, sorted by key."""
    row = rows.row()
    made = [plain(value(k, row)) for k in keys]
    names = [f"{HIDDEN}key{i}" for i in range(len(made))]
    if keys == [("identity", 0)]:
        own = rows.shown()
        df = rows.df.select(*[F.col(f"`{c}`") for c in own]).distinct()
        return Whole(replace(rows, df=df, sorted_by=tuple(_Order.of(F.col(f"`{c}`"), True) for c in sorted(own))))
    df = sequenced(rows.df).withColumns({n: x.col for n, x in zip(names, made)})
    # A rank, not an aggregate of whole rows: what is not used later is not read.
    place = F.row_number().over(W.partitionBy(*names).orderBy(SEQ))
    df = df.withColumn(f"{HIDDEN}place", place).where(F.col(f"{HIDDEN}place") == 1).drop(f"{HIDDEN}place")
    return Whole(replace(rows, df=df, sorted_by=tuple(_Order.of(F.col(n), True) for n in names)))


def set_operation(whole: Whole, node: tuple) -> Whole:
    """a + b: both arrays; a - b: what of a isn't in b."""
    sides = []
    for n in (node[3], node[4]):
        if n[0] == "array" and n[2] is not None and pipes(n[2])[0][0] == "iterate" and pipes(n[2])[0][2][0] == "var":
            sides.append(rows_of(n[2], whole.rows))
        else:
            made = through(whole, pipes(n))
            if not isinstance(made, Whole):
                return Whole_value(whole.rows, node)
            sides.append(made.rows)
    a, b = sides
    if not (a.single and b.single):
        raise NotNative("set operation on records")
    if node[2] == "+":
        return Whole(replace(a, df=a.df.select("value").unionByName(b.df.select("value")), sorted_by=(), names={}))
    gone = b.df.select(F.col("value").alias("_gone"))
    return Whole(replace(a, df=a.df.join(gone, F.col("value").eqNullSafe(F.col("_gone")), "left_anti")))


def lookup_join(rows: Rows, args: tuple) -> object:
    """JOIN($index; stream; key; projection): a left join on the key's text; unmatched rows pair with null."""
    if args[0][0] != "var" or not isinstance(rows.tables.get(args[0][2]), Lookup):
        raise NotNative("JOIN without an INDEX")
    index = rows.tables[args[0][2]]
    left = rows if len(args) == 2 else rows_of(args[1], rows)
    key, last = (args[1], None) if len(args) == 2 else (args[2], args[3] if len(args) == 4 else None)
    wanted = [fields_of(substituted(last), lambda n, side=side: n[0] == "field" and n[-1] == side) if last else None for side in ("_left", "_right")]
    own = sequenced(index.rows.df)
    packed = struct_of(index.rows.shown(), wanted[1])
    text = N.to_text(value(index.key, index.rows.row()))
    right = own.groupBy(text.alias("_key")).agg(F.max_by(packed, F.col(SEQ)).alias("_right"))
    mine = struct_of(left.shown(), wanted[0]) if not left.single else F.col("value")
    probe = left.df.select(N.to_text(value(key, left.row())).alias("_probe"), mine.alias("_left"))
    joined = probe.join(right, F.col("_probe") == F.col("_key"), "left")
    pair = PairRow(Typed(F.col("_left"), joined.schema["_left"].dataType), Typed(F.col("_right"), joined.schema["_right"].dataType))
    base = Rows(joined, tables=rows.tables)
    if last is None:
        out = replace(base, df=joined.select(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")).alias("value")), single=True)
        return Whole(out) if len(args) == 2 else out
    made = plain(value(substituted(last), Row({"_left": pair.left, "_right": pair.right})))
    out = base.to(made)
    return replace(out, df=out.df)


def fields_of(node: object, base: Callable[[tuple], bool]) -> set | None:
    """Names of the fields that are read of a base; None if it is read whole."""
    if not isinstance(node, tuple) or not node:
        return set()
    if len(node) == 4 and node[0] == "field" and isinstance(node[2], tuple) and base(node[2]):
        return {node[3]}
    if isinstance(node[0], str) and len(node) > 2 and base(node):
        return None
    parts = [fields_of(x, base) for x in node]
    return None if None in parts else set().union(*parts)


def struct_of(names: list[str], wanted: set | None) -> Column:
    """The columns as one, without those that nobody reads (one stays, so that there is a row to tell from none)."""
    kept = [c for c in names if wanted is None or c in wanted] or names[:1]
    return F.struct(*[F.col(f"`{c}`") for c in kept])


@dataclass
class PairRow:
    left: Typed
    right: Typed


def substituted(node: object) -> object:
    """.[0] and .[1] of a joined pair as fields of the joined row."""
    if isinstance(node, tuple):
        if len(node) == 4 and node[0] == "index" and node[2] == ("identity", node[2][1]) and node[3][0] == "literal" and node[3][2] in (0, 1):
            return ("field", node[1], ("identity", node[1]), "_left" if node[3][2] == 0 else "_right")
        return tuple(substituted(x) for x in node)
    return node


# -- folds -------------------------------------------------------------------------------------------


def only_sum(node: tuple, name: str) -> tuple | None:
    """. + e, where e doesn't read the state: e."""
    if node[0] == "binary" and node[2] == "+" and node[3][0] == "identity" and not reads_state(node[4]):
        return node[4]
    return None


def reads_state(node: object) -> bool:
    if isinstance(node, tuple):
        if node and node[0] == "identity":
            return True
        if node and node[0] in ("field", "index") and node[2][0] == "var":
            return False
        return any(reads_state(x) for x in node if isinstance(x, tuple))
    return False


def with_item(node: object, name: str) -> object:
    """$x.a as .a: the fold's variable is the row."""
    if isinstance(node, tuple):
        if len(node) == 3 and node[0] == "var" and node[2] == name:
            return ("identity", node[1])
        return tuple(with_item(x, name) for x in node)
    return node


def fold_parts(rows: Rows, node: tuple) -> tuple[Rows, str, Typed, tuple]:
    if len(node[3]) != 1 or node[3][0][0] != "var":
        raise NotNative("destructuring fold")
    items = rows_of(node[2], rows)
    start = value(node[4][0], Row({}))
    return items, node[3][0][1], start, node[4][1]


def folded(rows: Rows, node: tuple) -> Rows:
    """reduce: sums and counts are aggregations."""
    items, name, start, update = fold_parts(rows, node)
    e = only_sum(update, name)
    if e is None or N.family(start.type) != "number":
        raise NotNative("reduce")
    x = N.number(value(with_item(e, name), items.row()))
    total = F.coalesce(F.sum(x.col), F.lit(0)) + start.col
    return Rows(items.df.agg(total.alias("value")), single=True, tables=rows.tables)


def running_fold(rows: Rows, node: tuple) -> Rows:
    """foreach with a sum: a running total in the array's order."""
    items, name, start, update = fold_parts(rows, node)
    e = only_sum(update, name)
    if e is None or N.family(start.type) != "number":
        raise NotNative("foreach")
    x = N.number(value(with_item(e, name), items.row()))
    wanted = set() if len(node[4]) == 2 else fields_of(node[4][2], lambda n: n[0] == "var" and n[-1] == name)
    df = sequenced(items.df).withColumn("_state", F.coalesce(x.col, F.lit(0)))
    if items.sorted_by:
        if not items.single:  # what is written is what is read later
            hidden = [c for c in df.columns if c.startswith(HIDDEN) or c in (SEQ, "_state")]
            df = df.select(*hidden, *[F.col(f"`{c}`") for c in items.shown() if c not in hidden and (wanted is None or c in wanted)])
        df = in_order(df, list(items.sorted_by))
    out = running(df, part(), [F.col(SEQ)], {"_state": F.col("_state")})
    state = (F.col("_state") + start.col).cast("long" if x.type == N.LONG and start.type == N.LONG else "double")
    out = out.withColumn("_state", state)
    if len(node[4]) == 2:
        return replace(items, df=out.select(F.col("_state").alias("value")), single=True, names={}, sorted_by=())
    t = out.schema["_state"].dataType
    hidden = f"{HIDDEN}{name}"
    packed = struct_of([c for c in items.shown() if c in out.columns] or ["_state"], wanted) if not items.single else F.col("value")
    own = out.select(F.col("_state"), packed.alias(hidden))
    base = Rows(own, tables=rows.tables, names={name: hidden})
    made = plain(value(node[4][2], Row(None, Typed(F.col("_state"), t), {name: Typed(F.col(hidden), own.schema[hidden].dataType)})))
    out_rows = base.to(made)
    return replace(out_rows, df=out_rows.df.drop(hidden), names={})


# -- groups ------------------------------------------------------------------------------------------


def on_groups(groups: Groups, node: tuple) -> object:
    if node[0] == "call" and node[2] == "map" and len(node[3]) == 1:
        steps = pipes(node[3][0])
        made = aggregated(groups.rows, groups.keys, node[3][0]) if not tail_filters(steps) else None
        if made is None:
            cut = len(steps) - tail_filters(steps)
            made = through(aggregated(groups.rows, groups.keys, joined(steps[:cut])), steps[cut:])
        return Whole(made)
    if node[0] == "call" and node[2] == "length":
        keys = [plain(value(k, groups.rows.row())).col.alias(f"k{i}") for i, k in enumerate(groups.keys)]
        return Rows(groups.rows.df.select(*keys).distinct().agg(F.count("*").alias("value")), single=True)
    if node[0] == "iterate" and node[2][0] == "identity":
        return GroupRows(groups)
    raise NotNative("groups")


class GroupRows(Groups):
    """.[] of groups: the next step aggregates each."""

    def __init__(self, groups: Groups):
        super().__init__(groups.rows, groups.keys)


def tail_filters(steps: list[tuple]) -> int:
    """How many trailing steps are selects on what an aggregating object made."""
    n = 0
    while n < len(steps) - 1 and steps[-1 - n][0] == "call" and steps[-1 - n][2] == "select":
        n += 1
    return n if n and steps[-1 - n][0] == "object" else 0


def joined(steps: list[tuple]) -> tuple:
    out = steps[-1]
    for s in reversed(steps[:-1]):
        out = ("pipe", 0, s, out)
    return out


class Aggregates:
    """Collects the aggregations of an expression over a group and gives back what remains of it."""

    def __init__(self, rows: Rows, keys: list[tuple]):
        self.rows, self.row, self.keys = rows, rows.row(), [unplaced(k) for k in keys]
        self.made: list[tuple[Column, str]] = []
        self.ordered = False

    def add(self, col: Column) -> tuple:
        name = f"agg{len(self.made)}"
        self.made.append((col, name))
        return ("var", 0, name)

    def own(self, node: tuple) -> Typed:
        return plain(value(node, self.row))

    def rewrite(self, node: tuple) -> tuple:
        found = self.found(node)
        if found is not None:
            return found
        kind = node[0]
        if kind in ("literal", "format"):
            return node
        if kind == "binary":
            return (*node[:3], self.rewrite(node[3]), self.rewrite(node[4]))
        if kind in ("and", "or", "alternative"):
            return (*node[:2], self.rewrite(node[2]), self.rewrite(node[3]))
        if kind == "if":
            return (*node[:2], *map(self.rewrite, node[2:5]))
        if kind == "negate":
            return (*node[:2], self.rewrite(node[2]))
        if kind == "object":
            return (*node[:2], tuple((k, self.rewrite(x)) for k, x in node[2]))
        if kind == "array" and node[2] is not None:
            parts = [self.rewrite(c) for c in commas(node[2])]
            out = parts[0]
            for p in parts[1:]:
                out = ("comma", 0, out, p)
            return (*node[:2], out)
        if kind == "interpolate":
            return (*node[:3], tuple(p if isinstance(p, str) else self.rewrite(p) for p in node[3]))
        if kind == "pipe":  # an aggregate, then steps on its value
            steps = pipes(node)
            for cut in range(len(steps) - 1, 0, -1):
                head = self.found(joined(steps[:cut])) or (self.rewrite(joined(steps[:cut])) if cut == 1 and steps[0][0] in ("object", "binary") else None)
                if head is not None:
                    return ("pipe", 0, head, joined(steps[cut:]))
        raise NotNative(f"{kind} over a group")

    def found(self, node: tuple) -> tuple | None:
        """An aggregation, as a variable."""
        steps = pipes(node)
        first = steps[0]
        if first[0] == "array" and first[2] is not None:  # [.[] | f] is map(f)
            inner = pipes(first[2])
            if inner[0][0] == "iterate" and inner[0][2][0] == "identity":
                first = ("call", 0, "map", (joined(inner[1:]) if inner[1:] else ("identity", 0),))
        if first[0] == "call" and first[2] == "map" and len(first[3]) == 1 and len(steps) > 1:
            return self.mapped(pipes(first[3][0]), steps[1:])
        if len(steps) == 1 and node[0] == "call":
            name, args = node[2], node[3]
            if name == "length":
                return self.add(F.count(F.lit(1)))
            if name == "add" and len(args) == 1:
                inner = pipes(args[0])
                if inner[0][0] == "iterate" and inner[0][2][0] == "identity":
                    return self.mapped(inner[1:] or [("identity", 0)], [("call", 0, "add", ())])
            if name in ("any", "all") and len(args) == 1:
                test = F.coalesce(predicate(args[0], self.row), F.lit(False))
                return self.add(F.coalesce((F.bool_or if name == "any" else F.bool_and)(test), F.lit(name == "all")))
            if name in ("add", "min", "max") and not args:
                return self.mapped([("identity", 0)], [node])
        place = self.placed(node)
        if place is not None:
            which, rest = place
            if which == "first" and unplaced(rest) in self.keys:
                return ("var", 0, f"key{self.keys.index(unplaced(rest))}")
            return self.chosen(which, rest)
        return None

    def placed(self, node: tuple) -> tuple[object, tuple] | None:
        """.[0].a, min_by(f).a, sort_by(f)[0].a and the like: (which row, what of it)."""
        path: list[tuple] = []
        while True:
            if node[0] == "pipe" and node[2][0] == "call" and node[2][2] == "sort_by" and (own := rooted(node[3], node[2])) is not None:
                node = own
            elif node[0] == "pipe":
                head, tail = node[2], node[3]
                path.insert(0, tail)
                node = head
            elif node[0] == "field" and node[2][0] != "identity":
                path.insert(0, ("field", 0, ("identity", 0), node[3]))
                node = node[2]
            else:
                break
        rest = joined(path) if path else ("identity", 0)
        if node[0] == "call" and node[2] in ("min_by", "max_by") and len(node[3]) == 1:
            return (node[2], node[3][0]), rest
        if node[0] == "call" and node[2] in ("first", "last") and not node[3]:
            return node[2], rest
        if node[0] == "index" and node[3][0] in ("literal", "negate"):
            k = node[3][2] if node[3][0] == "literal" else -node[3][2][2]
            if k in (0, -1):
                if node[2][0] == "identity":
                    return ("first" if k == 0 else "last"), rest
                if node[2][0] == "call" and node[2][2] == "sort_by":
                    return ("min_by" if k == 0 else "last_by", node[2][3][0]), rest
        return None

    def chosen(self, which: object, rest: tuple) -> tuple:
        self.ordered = True
        x = self.own(rest) if rest[0] != "identity" or self.rows.single else Typed(F.struct(*[F.col(f"`{c}`") for c in self.rows.shown()]), None)
        if isinstance(which, str):
            return self.add((F.min_by if which == "first" else F.max_by)(x.col, F.col(SEQ)))
        key = F.struct(*[self.own(k).col for k in commas(which[1])], F.col(SEQ).alias("_s"))
        return self.add((F.min_by if which[0] == "min_by" else F.max_by)(x.col, key))

    def mapped(self, inner: list[tuple], after: list[tuple]) -> tuple | None:
        """map(select(p) | f) | add and its kin."""
        condition = F.lit(True)
        row = self.row
        while inner and inner[0][0] == "call" and inner[0][2] == "select":
            condition = condition & F.coalesce(predicate(inner[0][3][0], row), F.lit(False))
            inner = inner[1:]
        last = after[0]
        if last[0] != "call" or last[3]:
            return None
        name = last[2]
        rest = joined(inner) if inner else ("identity", 0)
        made: tuple | None = None
        if name == "length":
            made = self.add(F.count_if(condition))
        elif name in ("unique", "sort") and inner:
            x = self.own(rest)
            some = F.when(condition, x.col)
            if name == "unique" and len(after) > 1 and after[1][0] == "call" and after[1][2] == "length":
                made, after = self.add(F.count_distinct(some) + F.coalesce(F.max(F.when(condition & x.col.isNull(), 1).otherwise(0)), F.lit(0))), after[1:]
            else:
                made = self.add(F.sort_array((F.collect_set if name == "unique" else F.collect_list)(some)))
        elif name in ("add", "min", "max"):
            x = self.own(rest)
            some = F.when(condition, x.col)
            if name == "add":
                if N.family(x.type) != "number":
                    return None
                made = self.add(F.sum(some))
            else:
                made = self.add((F.min if name == "min" else F.max)(some))
        elif name in ("any", "all"):
            test = F.when(condition, truthy(self.own(rest)))
            made = self.add(F.coalesce((F.bool_or if name == "any" else F.bool_and)(test), F.lit(name == "all")))
        if made is None:
            return None
        return ("pipe", 0, made, joined(after[1:])) if after[1:] else made


def rooted(node: tuple, base: tuple) -> tuple | None:
    """A chain of fields and indexes on base instead of its input."""
    if node[0] == "identity":
        return base
    if node[0] in ("field", "index"):
        inner = rooted(node[2], base)
        return inner and (node[0], node[1], inner, node[3])
    return None


def unplaced(node: object) -> object:
    """A node without its positions, for comparison."""
    if isinstance(node, tuple):
        if node and isinstance(node[0], str) and len(node) > 1 and isinstance(node[1], int) and node[0] != "var":
            return (node[0], 0, *map(unplaced, node[2:]))
        return tuple(map(unplaced, node))
    return node


def aggregated(rows: Rows, keys: list[tuple], node: tuple) -> Rows:
    """node for every group (or, without keys, for the whole array) as one aggregation."""
    found = Aggregates(rows, keys)
    rest = found.rewrite(node)
    df = sequenced(rows.df) if found.ordered else rows.df
    grouped = df.groupBy(*[found.own(k).col.alias(f"key{i}") for i, k in enumerate(keys)])
    columns = [c.alias(n) for c, n in found.made] or [F.count(F.lit(1)).alias("agg0")]
    out = grouped.agg(*columns)
    variables = {f.name: Typed(F.col(f.name), f.dataType) for f in out.schema}
    made = Rows(out, tables=rows.tables)
    if rest[0] == "object":
        return made.record(N.entries(rest, Row({}, None, variables)))
    return made.to(value(rest, Row({}, None, variables)))


# -- entry points --------------------------------------------------------------------------------------


def _program(source: dict) -> tuple:
    if source["defs"] or source["imports"]:
        raise NotNative("definitions")
    return source["body"]


def over_rows(program: dict, df: DataFrame, named: dict | None = None) -> DataFrame:
    """The filter on every record of df."""
    rows = Rows(df)
    body = with_constants(_program(program), named or {})
    return result(through(rows, pipes(body)))


def over_table(program: dict, df: DataFrame, tables: dict[str, DataFrame] | None = None, named: dict | None = None) -> DataFrame:
    """The filter on df as one array; $name[] reads the other tables."""
    body = with_constants(_program(program), named or {})
    state: object = Whole(Rows(df, tables=dict(tables or {})))
    for node in pipes(body):
        if isinstance(state, GroupRows):
            state = aggregated(state.rows, state.keys, node)
        elif node[0] == "bind":
            state = bound(state, node)
            break
        else:
            state = step(state, node)
    return result(state)


def with_constants(node: object, named: dict) -> object:
    """Named scalar values in place of their variables."""
    if isinstance(node, tuple):
        if len(node) == 3 and node[0] == "var" and node[2] in named:
            v = named[node[2]]
            if isinstance(v, (list, dict)):
                raise NotNative("a container as a named value")
            return ("literal", node[1], v)
        return tuple(with_constants(x, named) for x in node)
    return node


__all__ = ["NotNative", "literal", "over_rows", "over_table"]
