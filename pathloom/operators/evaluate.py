"""The evaluator: programs compiled to Python generators, ordered outputs for every input.

This lane defines the semantics. A node compiles to a generator function ``run(value, env)``; nodes that
always give one value also to a plain function, which their parents prefer. Paths compile on demand
to generators of (path, value). ``env`` maps the ids of variables to values and those of closures
to (closure, env) pairs; ids are unique to their definition, so scoping is static.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import count
from pathlib import Path

from pathloom.functions import patterns
from pathloom.functions.scalars import BINARY, FORMATS, MATH2, MATH3, SELECTORS, UNARY, WITH_ONE, add, cut, delpaths, described, extreme, fail, field, getpath, group, iterated, negate, plain, setpath, subvalues, tostring, array, by_keys
from pathloom.functions.values import Big, JsonError, equal, is_number, kind, text, truthy, values_of
from pathloom.plans.syntax import FilterSyntaxError, parse

_ids = count(1)


class Break(Exception):
    def __init__(self, mark: object):
        super().__init__()
        self.mark = mark


class Halt(Exception):
    """halt and halt_error: the value to report and the exit status."""

    def __init__(self, value: object, status: int, silent: bool = False):
        super().__init__()
        self.value, self.status, self.silent = value, status, silent


class Code:
    """A compiled node. one: plain function if the node always gives one value. path: made when asked for."""

    __slots__ = ("many", "one", "_path", "walked")

    def __init__(self, many: Callable | None = None, one: Callable | None = None, path: Callable[[], Callable] | None = None):
        self.one, self._path, self.walked = one, path, None
        self.many = many or (lambda v, env: iter((one(v, env),)))

    @property
    def path(self) -> Callable:
        """generator (path, value, env) -> (path or None for a computed value, value)"""
        if self.walked is None:
            self.walked = self._path() if self._path else self._computed
        return self.walked

    def _computed(self, p: tuple | None, v: object, env: dict) -> Iterator[tuple]:
        for x in self.many(v, env):
            yield None, x


def _step(p: tuple | None, v: object, k: object) -> tuple:
    if p is None:
        fail(f"Invalid path expression with result {_clipped(v)}")
    return (*p, k)


def _clipped(v: object) -> str:
    s = text(v)
    raw = s.encode()
    return s if len(raw) <= 30 else raw[:27].decode(errors="ignore") + "..."


class Scope:
    """Names in sight while compiling: functions by (name, arity), variables, labels."""

    def __init__(self, functions: dict, variables: dict, labels: dict):
        self.functions, self.variables, self.labels = functions, variables, labels

    def grown(self, functions: dict | None = None, variables: dict | None = None, labels: dict | None = None) -> "Scope":
        return Scope({**self.functions, **(functions or {})}, {**self.variables, **(variables or {})}, {**self.labels, **(labels or {})})


class Function:
    __slots__ = ("ids", "values", "code", "closure")

    def __init__(self, closure: int | None = None):
        self.ids: list[int] = []
        self.values: list[bool] = []
        self.code: Code | None = None
        self.closure = closure  # a parameter: its id in env


class Compiler:
    def __init__(self, search: tuple[str, ...] = (), inputs: Callable[[], Iterator] | None = None):
        self.search, self.inputs, self.loading = search, inputs, []

    def program(self, src: str, variables: dict[str, int]) -> Code:
        tree = parse(src)
        if tree["module"] and not isinstance(constant(tree["module"]), dict):
            raise FilterSyntaxError("Module metadata must be an object")
        scope = self.imported(tree["imports"], Scope({}, dict(variables), {}), self.search)
        return self.defined(tree["defs"], scope, tree["body"])

    def defined(self, defs: list, scope: Scope, body: tuple) -> Code:
        for d in defs:
            scope = self.define(d, scope)
        return self.code(body, scope)

    # -- modules -------------------------------------------------------------------------------

    def find(self, name: str, suffix: str, search: tuple[str, ...]) -> Path:
        last = name.rpartition("/")[2]
        for folder in search:
            for path in (Path(folder, f"{name}{suffix}"), Path(folder, name, f"{last}{suffix}")):
                if path.is_file():
                    return path
        raise FilterSyntaxError(f"module not found: {name}", 0, "module_not_found")

    def imported(self, directives: list, scope: Scope, search: tuple[str, ...], home: str | None = None) -> Scope:
        for word, name, alias, meta, at in directives:
            own = search
            extra = constant(meta) if meta else {}
            if not isinstance(extra, dict):
                raise FilterSyntaxError("Module metadata must be an object", at)
            if isinstance(extra.get("search"), (str, list)):
                asked = [extra["search"]] if isinstance(extra["search"], str) else extra["search"]
                own = (*(str(Path(home or (search[0] if search else "."), s)) for s in asked), *search)
            if alias and alias.startswith("$"):
                path = self.find(name, ".json", own)
                data = list(values_of(path.read_text()))
                key = next(_ids)
                self.constants = {**getattr(self, "constants", {}), key: data}
                scope = scope.grown(variables={alias[1:]: key, f"{alias[1:]}::{alias[1:]}": key})
                continue
            found = self.module(name, own)
            prefix = f"{alias}::" if alias else ""
            scope = scope.grown(functions={(prefix + n, k): f for (n, k), f in found.functions.items() if "::" not in n or not alias}, variables={} if alias else found.variables)
        return scope

    def module(self, name: str, search: tuple[str, ...]) -> Scope:
        path = self.find(name, ".jq", search)
        if str(path) in self.loading:
            raise FilterSyntaxError(f"module {name} imports itself", 0, "module_cycle")
        self.loading.append(str(path))
        try:
            source = path.read_text()
            tree = parse(source + "\n.")
            scope = self.imported(tree["imports"], Scope({}, {}, {}), (str(path.parent), *search), str(path.parent))
            own: dict = {}
            for d in tree["defs"]:
                scope = self.define(d, scope)
                own[(d[2], len(d[3]))] = scope.functions[(d[2], len(d[3]))]
            included = {k: f for w, n, a, m, _ in tree["imports"] if w == "include" for k, f in self.module(n, (str(path.parent), *search)).functions.items()}
            data = {k: v for k, v in scope.variables.items()}
            return Scope({**included, **own}, data, {})
        finally:
            self.loading.pop()

    def modulemeta(self, v: object) -> dict:
        if not isinstance(v, str):
            fail("modulemeta input module name must be a string")
        try:
            path = self.find(v, ".jq", self.search)
        except FilterSyntaxError as e:
            fail(e.message)
        tree = parse(path.read_text() + "\n.")
        out = dict(constant(tree["module"])) if tree["module"] else {}
        out["deps"] = []
        for word, name, alias, meta, _ in tree["imports"]:
            dep = dict(constant(meta)) if meta else {}
            if alias:
                dep["as"] = alias.lstrip("$")
            dep["is_data"] = bool(alias and alias.startswith("$"))
            dep["relpath"] = name
            out["deps"].append(dep)
        out["defs"] = [f"{d[2]}/{len(d[3])}" for d in tree["defs"]]
        return out

    # -- functions -----------------------------------------------------------------------------

    def define(self, d: tuple, scope: Scope) -> Scope:
        _, _, name, params, body = d
        f = Function()
        inner = scope.grown(functions={(name, len(params)): f})
        for p in params:
            f.ids.append(next(_ids))
            f.values.append(p.startswith("$"))
            closure = Function(closure=f.ids[-1])
            if p.startswith("$"):
                key = next(_ids)
                f.ids[-1] = (f.ids[-1], key)
                inner = inner.grown(functions={(p[1:], 0): closure}, variables={p[1:]: key})
            else:
                inner = inner.grown(functions={(p, 0): closure})
        f.code = Code()  # known before its body is compiled: it may call itself
        made = self.code(body, inner)
        f.code.many, f.code.one, f.code._path = made.many, None, lambda: made.path
        return scope.grown(functions={(name, len(params)): f})

    def called(self, f: Function, args: list[Code]) -> Code:
        if f.closure is not None:
            key = f.closure

            def many(v: object, env: dict) -> Iterator:
                code, own = env[key]
                return code.many(v, own)

            def path() -> Callable:
                def walk(p: tuple | None, v: object, env: dict) -> Iterator:
                    code, own = env[key]
                    return code.path(p, v, own)

                return walk

            return Code(many, path=path)
        code = f.code

        def frames(v: object, env: dict, i: int, own: dict) -> Iterator[dict]:
            if i == len(args):
                yield own
                return
            key = f.ids[i]
            if not f.values[i]:
                yield from frames(v, env, i + 1, {**own, key: (args[i], env)})
                return
            for x in args[i].many(v, env):
                yield from frames(v, env, i + 1, {**own, key[0]: (Code(one=lambda _v, _e, x=x: x), env), key[1]: x})

        if not args:
            return Code(lambda v, env: code.many(v, env), path=lambda: lambda p, v, env: code.path(p, v, env))
        if not any(f.values):

            def direct(v: object, env: dict) -> Iterator:
                own = dict(env)
                for key, a in zip(f.ids, args):
                    own[key] = (a, env)
                return code.many(v, own)

            def walk_direct(p: tuple | None, v: object, env: dict) -> Iterator:
                own = dict(env)
                for key, a in zip(f.ids, args):
                    own[key] = (a, env)
                return code.path(p, v, own)

            return Code(direct, path=lambda: walk_direct)

        def many(v: object, env: dict) -> Iterator:
            for own in frames(v, env, 0, env):
                yield from code.many(v, own)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for own in frames(v, env, 0, env):
                yield from code.path(p, v, own)

        return Code(many, path=lambda: walk)

    # -- nodes ---------------------------------------------------------------------------------

    def code(self, node: tuple, scope: Scope) -> Code:
        return getattr(self, f"_{node[0]}")(node, scope)

    def _identity(self, node: tuple, scope: Scope) -> Code:
        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            yield p, v

        return Code(one=lambda v, env: v, path=lambda: walk)

    def _literal(self, node: tuple, scope: Scope) -> Code:
        x = node[2]
        if x is None:  # null is a path of no steps
            return Code(one=lambda v, env: None, path=lambda: lambda p, v, env: iter(((None, None),)))
        return Code(one=lambda v, env: x)

    def _loc(self, node: tuple, scope: Scope) -> Code:
        return Code(one=lambda v, env: {"file": "<top-level>", "line": 1})

    def _var(self, node: tuple, scope: Scope) -> Code:
        name = node[2]
        if name == "ENV":
            own = dict(os.environ)  # of the process that runs it
            return Code(one=lambda v, env: own)
        if name not in scope.variables:
            raise FilterSyntaxError(f"${name} is not defined", node[1], "undefined_variable")
        key = scope.variables[name]
        if key in getattr(self, "constants", {}):
            data = self.constants[key]
            return Code(one=lambda v, env: data)
        return Code(one=lambda v, env: env[key])

    def _field(self, node: tuple, scope: Scope) -> Code:
        return self.indexed(self.code(node[2], scope), Code(one=lambda v, env, k=node[3]: k))

    def _index(self, node: tuple, scope: Scope) -> Code:
        return self.indexed(self.code(node[2], scope), self.code(node[3], scope))

    def indexed(self, term: Code, key: Code) -> Code:
        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for q, x in term.path(p, v, env):
                for k in key.many(v, env):
                    yield _step(q, x, k) if q is not None else _bad(x, k), field(x, k)

        def many(v: object, env: dict) -> Iterator:
            for x in term.many(v, env):
                for k in key.many(v, env):
                    yield field(x, k)

        one = None
        if term.one and key.one:
            a, b = term.one, key.one
            one = lambda v, env: field(a(v, env), b(v, env))
        return Code(many if not one else None, one, lambda: walk)

    def _slice(self, node: tuple, scope: Scope) -> Code:
        term = self.code(node[2], scope)
        none = Code(one=lambda v, env: None)
        low = self.code(node[3], scope) if node[3] else none
        high = self.code(node[4], scope) if node[4] else none

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for q, x in term.path(p, v, env):
                for b in high.many(v, env):
                    for a in low.many(v, env):
                        k = {"start": a, "end": b}
                        yield _step(q, x, k) if q is not None else _bad(x, k), cut(x, a, b)

        def many(v: object, env: dict) -> Iterator:
            for x in term.many(v, env):
                for b in high.many(v, env):
                    for a in low.many(v, env):
                        yield cut(x, a, b)

        one = None
        if term.one and low.one and high.one:
            one = lambda v, env: cut(term.one(v, env), low.one(v, env), high.one(v, env))
        return Code(many if not one else None, one, lambda: walk)

    def _iterate(self, node: tuple, scope: Scope) -> Code:
        term = self.code(node[2], scope)

        def many(v: object, env: dict) -> Iterator:
            for x in term.many(v, env):
                yield from iterated(x)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for q, x in term.path(p, v, env):
                if q is None:
                    fail(f"Invalid path expression near attempt to iterate through {_clipped(x)}")
                items = list(x.items()) if isinstance(x, dict) else list(enumerate(iterated(x) if x is not None else []))
                for k, y in items:
                    yield (*q, k), y

        return Code(many, path=lambda: walk)

    def _pipe(self, node: tuple, scope: Scope) -> Code:
        a, b = self.code(node[2], scope), self.code(node[3], scope)

        def many(v: object, env: dict) -> Iterator:
            for x in a.many(v, env):
                yield from b.many(x, env)

        def after(v: object, env: dict) -> Iterator:
            return b.many(a.one(v, env), env)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for q, x in a.path(p, v, env):
                yield from b.path(q, x, env)

        one = (lambda v, env: b.one(a.one(v, env), env)) if a.one and b.one else None
        return Code(None if one else after if a.one else many, one, lambda: walk)

    def _comma(self, node: tuple, scope: Scope) -> Code:
        a, b = self.code(node[2], scope), self.code(node[3], scope)

        def many(v: object, env: dict) -> Iterator:
            yield from a.many(v, env)
            yield from b.many(v, env)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            yield from a.path(p, v, env)
            yield from b.path(p, v, env)

        return Code(many, path=lambda: walk)

    def _negate(self, node: tuple, scope: Scope) -> Code:
        a = self.code(node[2], scope)
        if node[2][0] == "literal" and is_number(node[2][2]):
            x = negate(node[2][2])
            return Code(one=lambda v, env: x)
        if a.one:
            return Code(one=lambda v, env: negate(a.one(v, env)))
        return Code(lambda v, env: (negate(x) for x in a.many(v, env)))

    def _binary(self, node: tuple, scope: Scope) -> Code:
        f, a, b = BINARY[node[2]], self.code(node[3], scope), self.code(node[4], scope)
        if a.one and b.one:
            x, y = a.one, b.one
            return Code(one=lambda v, env: f(x(v, env), y(v, env)))

        def many(v: object, env: dict) -> Iterator:
            for r in b.many(v, env):
                for left in a.many(v, env):
                    yield f(left, r)

        return Code(many)

    def _and(self, node: tuple, scope: Scope) -> Code:
        return self.logic(node, scope, False)

    def _or(self, node: tuple, scope: Scope) -> Code:
        return self.logic(node, scope, True)

    def logic(self, node: tuple, scope: Scope, ends: bool) -> Code:
        a, b = self.code(node[2], scope), self.code(node[3], scope)
        if a.one and b.one:
            return Code(one=lambda v, env: ends if truthy(a.one(v, env)) == ends else truthy(b.one(v, env)))

        def many(v: object, env: dict) -> Iterator:
            for x in a.many(v, env):
                if truthy(x) == ends:
                    yield ends
                else:
                    for y in b.many(v, env):
                        yield truthy(y)

        return Code(many)

    def _alternative(self, node: tuple, scope: Scope) -> Code:
        a, b = self.code(node[2], scope), self.code(node[3], scope)

        def many(v: object, env: dict) -> Iterator:
            found = False
            try:
                for x in a.many(v, env):
                    if truthy(x):
                        found = True
                        yield x
            except JsonError:
                pass
            if not found:
                yield from b.many(v, env)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            found = False
            try:
                for q, x in a.path(p, v, env):
                    if truthy(x):
                        found = True
                        yield q, x
            except JsonError:
                pass
            if not found:
                yield from b.path(p, v, env)

        def one(v: object, env: dict) -> object:
            try:
                x = a.one(v, env)
                if truthy(x):
                    return x
            except JsonError:
                pass
            return b.one(v, env)

        single = a.one and b.one
        return Code(None if single else many, one if single else None, lambda: walk)

    def _if(self, node: tuple, scope: Scope) -> Code:
        test, yes, no = (self.code(n, scope) for n in node[2:5])

        def many(v: object, env: dict) -> Iterator:
            for x in test.many(v, env):
                yield from (yes if truthy(x) else no).many(v, env)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for x in test.many(v, env):
                yield from (yes if truthy(x) else no).path(p, v, env)

        one = None
        if test.one and yes.one and no.one:
            one = lambda v, env: (yes if truthy(test.one(v, env)) else no).one(v, env)
        return Code(None if one else many, one, lambda: walk)

    def _try(self, node: tuple, scope: Scope) -> Code:
        body = self.code(node[2], scope)
        handler = self.code(node[3], scope) if node[3] else None

        def caught(e: JsonError, env: dict) -> Iterator:
            if isinstance(e.value, dict) and e.value.get("__jq") is not None:
                raise e
            return handler.many(e.value, env) if handler else iter(())

        def many(v: object, env: dict) -> Iterator:
            try:
                yield from body.many(v, env)
            except JsonError as e:
                error = e
            else:
                return
            yield from caught(error, env)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            try:
                yield from body.path(p, v, env)
            except JsonError as e:
                error = e
            else:
                return
            for x in caught(error, env):
                yield None, x

        return Code(many, path=lambda: walk)

    def _label(self, node: tuple, scope: Scope) -> Code:
        key = next(_ids)
        body = self.code(node[3], scope.grown(labels={node[2]: key}))

        def many(v: object, env: dict) -> Iterator:
            mark = object()
            try:
                yield from body.many(v, {**env, key: mark})
            except Break as e:
                if e.mark is not mark:
                    raise

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            mark = object()
            try:
                yield from body.path(p, v, {**env, key: mark})
            except Break as e:
                if e.mark is not mark:
                    raise

        return Code(many, path=lambda: walk)

    def _break(self, node: tuple, scope: Scope) -> Code:
        if node[2] not in scope.labels:
            raise FilterSyntaxError(f"$*label-{node[2]} is not defined", node[1], "undefined_label")
        key = scope.labels[node[2]]

        def many(v: object, env: dict) -> Iterator:
            raise Break(env[key])
            yield

        return Code(many, path=lambda: lambda p, v, env: many(v, env))

    def _let(self, node: tuple, scope: Scope) -> Code:
        return self.code(node[3], self.define(node[2], scope))

    def _array(self, node: tuple, scope: Scope) -> Code:
        if node[2] is None:
            return Code(one=lambda v, env: [])
        inner = self.code(node[2], scope)
        return Code(one=lambda v, env: list(inner.many(v, env)))

    def _object(self, node: tuple, scope: Scope) -> Code:
        entries = [(self.code(k, scope), self.code(x, scope)) for k, x in node[2]]
        if all(k.one and x.one for k, x in entries):
            pairs = [(k.one, x.one) for k, x in entries]

            def one(v: object, env: dict) -> dict:
                out = {}
                for k, x in pairs:
                    key = k(v, env)
                    if not isinstance(key, str):
                        fail(f"Cannot use {described(key)} as object key")
                    out[key] = x(v, env)
                return out

            return Code(one=one)

        def spread(v: object, env: dict, i: int, out: dict) -> Iterator[dict]:
            """Earlier entries vary slowest."""
            if i == len(entries):
                yield out
                return
            k, x = entries[i]
            for key in k.many(v, env):
                if not isinstance(key, str):
                    fail(f"Cannot use {described(key)} as object key")
                for value in x.many(v, env):
                    yield from spread(v, env, i + 1, {**out, key: value})

        return Code(lambda v, env: spread(v, env, 0, {}))

    def _interpolate(self, node: tuple, scope: Scope) -> Code:
        encode = FORMATS[node[2]] if node[2] else tostring
        parts = [p if isinstance(p, str) else self.code(p, scope) for p in node[3]]
        if all(isinstance(p, str) or p.one for p in parts):
            return Code(one=lambda v, env: "".join([p if isinstance(p, str) else encode(p.one(v, env)) for p in parts]))

        def build(v: object, env: dict, i: int) -> Iterator[str]:
            """Later parts vary slowest."""
            if i < 0:
                yield ""
                return
            p = parts[i]
            for s in (p,) if isinstance(p, str) else map(encode, p.many(v, env)):
                for before in build(v, env, i - 1):
                    yield before + s

        return Code(lambda v, env: build(v, env, len(parts) - 1))

    def _format(self, node: tuple, scope: Scope) -> Code:
        f = FORMATS[node[2]]
        return Code(one=lambda v, env: f(v))

    # -- bindings ------------------------------------------------------------------------------

    def pattern(self, p: tuple, scope: Scope, ids: dict[str, int]) -> tuple[Callable, Scope]:
        """(generator (value, input, env) -> env with the pattern's variables, scope). Keys may use variables bound before."""
        if p[0] == "var":
            key = ids[p[1]]
            return (lambda x, v, env: iter(({**env, key: x},))), scope.grown(variables={p[1]: key})
        if p[0] == "array":
            steps = []
            for i, q in enumerate(p[1]):
                inner, scope = self.pattern(q, scope, ids)
                steps.append((i, inner))

            def spread(x: object, v: object, env: dict, at: int = 0) -> Iterator[dict]:
                if at == 0 and x is not None and not isinstance(x, list):
                    fail(f"Cannot index {kind(x)} with number")
                if at == len(steps):
                    yield env
                    return
                i, inner = steps[at]
                for own in inner(field(x, i), v, env):
                    yield from spread(x, v, own, at + 1)

            return spread, scope
        entries = []
        for key_node, also, q in p[1]:
            key = self.code(key_node, scope)
            if also:
                scope = scope.grown(variables={also: ids[also]})
            inner = None
            if q:
                inner, scope = self.pattern(q, scope, ids)
            entries.append((key, ids[also] if also else None, inner))

        def open_(x: object, v: object, env: dict, at: int = 0) -> Iterator[dict]:
            if at == len(entries):
                yield env
                return
            key, also, inner = entries[at]
            for k in key.many(v, env):
                if not isinstance(k, str):
                    fail(f"Cannot index {kind(x)} with {kind(k)}")
                own = field(x, k)
                bound = {**env, also: own} if also else env
                if inner is None:
                    yield from open_(x, v, bound, at + 1)
                else:
                    for e in inner(own, v, bound):
                        yield from open_(x, v, e, at + 1)

        return open_, scope

    def binder(self, patterns_: tuple, scope: Scope) -> tuple[list[Callable], Scope, dict]:
        ids = {name: next(_ids) for p in patterns_ for name in variables(p)}
        everything = scope.grown(variables=ids if len(patterns_) > 1 else None)
        made = []
        for p in patterns_:
            bind, after = self.pattern(p, everything, ids)
            made.append(bind)
        return made, everything if len(patterns_) > 1 else after, dict.fromkeys(ids.values()) if len(patterns_) > 1 else {}

    def _bind(self, node: tuple, scope: Scope) -> Code:
        source = self.code(node[2], scope)
        binds, inner, nulls = self.binder(node[3], scope)
        body = self.code(node[4], inner)
        if len(binds) == 1 and node[3][0][0] == "var" and source.one:
            key = inner.variables[node[3][0][1]]
            one = (lambda v, env: body.one(v, {**env, key: source.one(v, env)})) if body.one else None
            return Code(None if one else lambda v, env: body.many(v, {**env, key: source.one(v, env)}), one, lambda: lambda p, v, env: body.path(p, v, {**env, key: source.one(v, env)}))

        def tried(run: Callable[[dict], Iterator], x: object, v: object, env: dict) -> Iterator:
            """The first pattern whose binding and body raise nothing; the last one's error stands."""
            for i, bind in enumerate(binds):
                try:
                    for own in bind(x, v, {**env, **nulls}):
                        yield from run(own)
                    return
                except JsonError:
                    if i == len(binds) - 1:
                        raise

        def many(v: object, env: dict) -> Iterator:
            for x in source.many(v, env):
                yield from tried(lambda own: body.many(v, own), x, v, env)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for x in source.many(v, env):
                yield from tried(lambda own: body.path(p, v, own), x, v, env)

        return Code(many, path=lambda: walk)

    def _reduce(self, node: tuple, scope: Scope) -> Code:
        source, (init_node, step_node) = self.code(node[2], scope), node[4]
        binds, inner, nulls = self.binder(node[3], scope)
        init, step = self.code(init_node, scope), self.code(step_node, inner)

        def each(v: object, env: dict, run: Callable[[dict], None]) -> None:
            for x in source.many(v, env):
                for i, bind in enumerate(binds):
                    try:
                        for own in bind(x, v, {**env, **nulls}):
                            run(own)
                        break
                    except JsonError:
                        if i == len(binds) - 1:
                            raise

        def many(v: object, env: dict) -> Iterator:
            for start in init.many(v, env):
                state = [start]

                def run(own: dict) -> None:
                    if step.one:
                        state[0] = step.one(state[0], own)
                        return
                    last, found = None, False
                    for last in step.many(state[0], own):
                        found = True
                    state[0] = last if found else None

                each(v, env, run)
                yield state[0]

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for start in init.path(p, v, env):
                state = [start]

                def run(own: dict) -> None:
                    last = (None, None)
                    for last in step.path(*state[0], own):
                        pass
                    state[0] = last

                each(v, env, run)
                yield state[0]

        return Code(many, path=lambda: walk)

    def _foreach(self, node: tuple, scope: Scope) -> Code:
        source, parts = self.code(node[2], scope), node[4]
        binds, inner, nulls = self.binder(node[3], scope)
        init, step = self.code(parts[0], scope), self.code(parts[1], inner)
        last = self.code(parts[2], inner) if len(parts) == 3 else None

        def run(start: tuple, v: object, env: dict, paths: bool) -> Iterator:
            state = start
            for x in source.many(v, env):
                for i, bind in enumerate(binds):
                    try:
                        for own in bind(x, v, {**env, **nulls}):
                            outs = step.path(*state, own) if paths else ((None, y) for y in step.many(state[1], own))
                            for state in outs:
                                if last is None:
                                    yield state
                                elif paths:
                                    yield from last.path(*state, own)
                                else:
                                    for y in last.many(state[1], own):
                                        yield None, y
                        break
                    except JsonError:
                        if i == len(binds) - 1:
                            raise

        def many(v: object, env: dict) -> Iterator:
            for start in init.many(v, env):
                for _, y in run((None, start), v, env, False):
                    yield y

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for start in init.path(p, v, env):
                yield from run(start, v, env, True)

        return Code(many, path=lambda: walk)

    # -- assignment ----------------------------------------------------------------------------

    def _assign(self, node: tuple, scope: Scope) -> Code:
        op, left, right = node[2], self.code(node[3], scope), self.code(node[4], scope)

        def paths(v: object, env: dict) -> Iterator[list]:
            for p, x in left.path((), v, env):
                if p is None:
                    fail(f"Invalid path expression with result {_clipped(x)}")
                yield list(p)

        def plain_assign(v: object, env: dict) -> Iterator:
            for x in right.many(v, env):
                out = v
                for p in list(paths(v, env)):
                    out = setpath(out, p, x)
                yield out

        def update(v: object, env: dict) -> object:
            out, gone = v, []
            for p in list(paths(v, env)):
                for x in right.many(getpath(out, p), env):
                    out = setpath(out, p, x)
                    break
                else:
                    gone.append(p)
            return delpaths(out, gone) if gone else out

        if op == "=":
            return Code(plain_assign)
        if op == "|=":
            return Code(one=update)
        f = BINARY.get(op[:-1])

        def compound(v: object, env: dict) -> Iterator:
            for x in right.many(v, env):
                out = v
                for p in list(paths(v, env)):
                    own = getpath(out, p)
                    if f is None:
                        out = out if truthy(own) else setpath(out, p, x)
                    else:
                        out = setpath(out, p, f(own, x))
                yield out

        return Code(compound)

    # -- calls ---------------------------------------------------------------------------------

    def _call(self, node: tuple, scope: Scope) -> Code:
        name, args, n = node[2], node[3], len(node[3])
        if f := scope.functions.get((name, n)):
            return self.called(f, [self.code(a, scope) for a in args])
        if n == 0 and name in UNARY:
            g = UNARY[name]
            if name in ("first", "last"):
                k = 0 if name == "first" else -1
                return self.indexed(self._identity(node, scope), Code(one=lambda v, env: k))
            return Code(one=lambda v, env: g(v))
        if n == 0 and name in SELECTORS:
            test = SELECTORS[name]
            return Code(lambda v, env: iter((v,) if test(v) else ()), path=lambda: lambda p, v, env: iter(((p, v),) if test(v) else ()))
        special = getattr(self, f"call_{name}_{n}", None) or (getattr(self, f"call_{name}", None))
        codes = [self.code(a, scope) for a in args]
        if special:
            made = special(*codes) if getattr(self, f"call_{name}_{n}", None) else special(codes)
            if made is not None:
                return made
        if n == 1 and name in WITH_ONE:
            g, a = WITH_ONE[name], codes[0]
            if name == "getpath":
                return self.getpath(a)
            if a.one:
                return Code(one=lambda v, env: g(v, a.one(v, env)))
            return Code(lambda v, env: (g(v, x) for x in a.many(v, env)))
        if n == 2 and name in MATH2:
            return self.product(MATH2[name], codes)
        if n == 3 and name in MATH3:
            return self.product(MATH3[name], codes)
        if n == 0:
            if "::" in name:
                raise FilterSyntaxError(f"{name}/0 is not defined", node[1], "undefined_function")
            return self._field((None, node[1], ("identity", node[1]), name), scope)  # a bare unknown word is a field
        raise FilterSyntaxError(f"{name}/{n} is not defined", node[1], "undefined_function")

    def product(self, f: Callable, codes: list[Code]) -> Code:
        """f over all combinations of arguments, the last varying slowest."""
        if all(c.one for c in codes):
            return Code(one=lambda v, env: f(*[c.one(v, env) for c in codes]))

        def build(v: object, env: dict, i: int) -> Iterator[tuple]:
            if i < 0:
                yield ()
                return
            for x in codes[i].many(v, env):
                for before in build(v, env, i - 1):
                    yield (*before, x)

        return Code(lambda v, env: (f(*xs) for xs in build(v, env, len(codes) - 1)))

    def getpath(self, a: Code) -> Code:
        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for path in a.many(v, env):
                if p is None:
                    fail(f"Invalid path expression with result {_clipped(v)}")
                try:
                    x = getpath(v, path)
                except JsonError:
                    x = None
                yield (*p, *path), x

        def many(v: object, env: dict) -> Iterator:
            for path in a.many(v, env):
                yield getpath(v, path)

        return Code(many, path=lambda: walk)

    def call_empty_0(self) -> Code:
        return Code(lambda v, env: iter(()), path=lambda: lambda p, v, env: iter(()))

    def call_error_0(self) -> Code:
        def one(v: object, env: dict) -> object:
            raise JsonError(v)

        return Code(one=one, path=lambda: lambda p, v, env: iter((one(v, env),)))

    def call_error_1(self, a: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            for x in a.many(v, env):
                raise JsonError(x)
            yield from ()

        return Code(many, path=lambda: lambda p, v, env: many(v, env))

    def call_select_1(self, f: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            for x in f.many(v, env):
                if truthy(x):
                    yield v

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for x in f.many(v, env):
                if truthy(x):
                    yield p, v

        return Code(many, path=lambda: walk)

    def call_recurse_0(self) -> Code:
        def many(v: object, env: dict) -> Iterator:
            work = [v]
            while work:
                x = work.pop()
                yield x
                if isinstance(x, (list, dict)):
                    work.extend(reversed(iterated(x)))

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for q, x in subvalues(v):
                yield (None if p is None else (*p, *q)), x

        return Code(many, path=lambda: walk)

    def call_recurse_1(self, f: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            yield v
            for x in f.many(v, env):
                yield from many(x, env)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            yield p, v
            for q, x in f.path(p, v, env):
                yield from walk(q, x, env)

        return Code(many, path=lambda: walk)

    def call_recurse_2(self, f: Code, test: Code) -> Code:
        return self.call_recurse_1(self.piped(f, self.call_select_1(test)))

    def piped(self, a: Code, b: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            for x in a.many(v, env):
                yield from b.many(x, env)

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for q, x in a.path(p, v, env):
                yield from b.path(q, x, env)

        return Code(many, path=lambda: walk)

    def call_map_1(self, f: Code) -> Code:
        if f.one:
            return Code(one=lambda v, env: [f.one(x, env) for x in iterated(v)])
        return Code(one=lambda v, env: [y for x in iterated(v) for y in f.many(x, env)])

    def call_map_values_1(self, f: Code) -> Code:
        def one(v: object, env: dict) -> object:
            if isinstance(v, dict):
                out = {}
                for k, x in v.items():
                    for y in f.many(x, env):
                        out[k] = y
                        break
                return out
            out = []
            for x in iterated(v):
                for y in f.many(x, env):
                    out.append(y)
                    break
            return out

        return Code(one=one)

    def call_path_1(self, f: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            for p, x in f.path((), v, env):
                if p is None:
                    fail(f"Invalid path expression with result {_clipped(x)}")
                yield list(p)

        return Code(many)

    def call_paths(self, codes: list[Code]) -> Code | None:
        if len(codes) > 1:
            return None

        def many(v: object, env: dict) -> Iterator:
            for p, x in subvalues(v):
                if p and (not codes or any(truthy(y) for y in codes[0].many(x, env))):
                    yield list(p)

        return Code(many)

    def call_leaf_paths_0(self) -> Code:
        return Code(lambda v, env: (list(p) for p, x in subvalues(v) if p and not isinstance(x, (list, dict))))

    def call_del_1(self, f: Code) -> Code:
        paths = self.call_path_1(f)
        return Code(one=lambda v, env: delpaths(v, list(paths.many(v, env))))

    def call_setpath_2(self, a: Code, b: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            for x in b.many(v, env):
                for p in a.many(v, env):
                    if not isinstance(p, list):
                        fail("Path must be specified as an array")
                    yield setpath(v, p, x)

        return Code(many)

    def call_pick_1(self, f: Code) -> Code:
        paths = self.call_path_1(f)

        def one(v: object, env: dict) -> object:
            out = None
            for p in paths.many(v, env):
                out = setpath(out, p, getpath(v, p))
            return out

        return Code(one=one)

    def call_with_entries_1(self, f: Code) -> Code:
        to, from_ = UNARY["to_entries"], UNARY["from_entries"]
        return Code(one=lambda v, env: from_([y for x in to(v) for y in f.many(x, env)]))

    def call_add_1(self, f: Code) -> Code:
        def one(v: object, env: dict) -> object:
            out: object = None
            for x in f.many(v, env):
                out = add(out, x)
            return out

        return Code(one=one)

    def call_any(self, codes: list[Code]) -> Code | None:
        return self.quantified(codes, True)

    def call_all(self, codes: list[Code]) -> Code | None:
        return self.quantified(codes, False)

    def quantified(self, codes: list[Code], ends: bool) -> Code | None:
        if len(codes) not in (1, 2):
            return None
        test = codes[-1]
        items = codes[0].many if len(codes) == 2 else lambda v, env: iterated(v)

        def one(v: object, env: dict) -> bool:
            for x in items(v, env):
                for y in test.many(x, env):
                    if truthy(y) == ends:
                        return ends
            return not ends

        return Code(one=one)

    def call_isempty_1(self, f: Code) -> Code:
        def one(v: object, env: dict) -> bool:
            for _ in f.many(v, env):
                return False
            return True

        return Code(one=one)

    def call_IN(self, codes: list[Code]) -> Code | None:
        if len(codes) == 1:
            return Code(one=lambda v, env: any(equal(v, x) for x in codes[0].many(v, env)))
        if len(codes) == 2:
            return Code(one=lambda v, env: any(equal(y, x) for y in codes[0].many(v, env) for x in codes[1].many(v, env)))
        return None

    def call_INDEX(self, codes: list[Code]) -> Code | None:
        if len(codes) not in (1, 2):
            return None
        items = codes[0].many if len(codes) == 2 else lambda v, env: iterated(v)

        def one(v: object, env: dict) -> dict:
            return {tostring(k): x for x in items(v, env) for k in codes[-1].many(x, env)}

        return Code(one=one)

    def call_JOIN(self, codes: list[Code]) -> Code | None:
        def pair(x: object, table: object, env: dict) -> Iterator:
            for k in key.many(x, env):
                yield [x, field(table, k)]

        if len(codes) == 2:
            key = codes[1]
            return Code(lambda v, env: ([y for x in iterated(v) for y in pair(x, t, env)] for t in codes[0].many(v, env)))
        if len(codes) in (3, 4):
            key, last = codes[2], codes[3] if len(codes) == 4 else None

            def many(v: object, env: dict) -> Iterator:
                for t in codes[0].many(v, env):
                    for x in codes[1].many(v, env):
                        for y in pair(x, t, env):
                            yield from last.many(y, env) if last else (y,)

            return Code(many)
        return None

    def keyed(self, f: Code) -> Callable:
        return lambda v, env: [list(f.many(x, env)) for x in v]

    def call_sort_by_1(self, f: Code) -> Code:
        keys = self.keyed(f)
        return Code(one=lambda v, env: [x for _, _, x in by_keys(array(v), keys(array(v), env))])

    def call_group_by_1(self, f: Code) -> Code:
        keys = self.keyed(f)
        return Code(one=lambda v, env: group(array(v, "grouped, as it is not an array"), keys(v, env)))

    def call_unique_by_1(self, f: Code) -> Code:
        keys = self.keyed(f)
        return Code(one=lambda v, env: [g[0] for g in group(array(v, "grouped, as it is not an array"), keys(v, env))])

    def call_min_by_1(self, f: Code) -> Code:
        keys = self.keyed(f)
        return Code(one=lambda v, env: extreme(array(v), keys(v, env), 1))

    def call_max_by_1(self, f: Code) -> Code:
        keys = self.keyed(f)
        return Code(one=lambda v, env: extreme(array(v), keys(v, env), -1))

    def call_range(self, codes: list[Code]) -> Code | None:
        if len(codes) not in (1, 2, 3):
            return None
        zero, unit = Code(one=lambda v, env: 0), Code(one=lambda v, env: 1)
        low, high, step = [zero, codes[0], unit] if len(codes) == 1 else [*codes, unit][:3]

        def many(v: object, env: dict) -> Iterator:
            for a in low.many(v, env):
                for b in high.many(v, env):
                    for s in step.many(v, env):
                        if not (is_number(a) and is_number(b) and is_number(s)):
                            fail("Range bounds must be numeric")
                        a_, b_, s_ = plain(a), plain(b), plain(s)
                        if type(a_) is int and type(b_) is int and type(s_) is int and s_:
                            yield from range(a_, b_, s_)
                            continue
                        x = a_
                        while x < b_ if s_ > 0 else x > b_ if s_ < 0 else False:
                            yield x
                            x += s_

        return Code(many)

    def counted(self, n: object, what: str) -> float:
        if not is_number(n):
            fail(f"{what} count must be a number")
        if plain(n) < 0:
            fail("nth doesn't support negative indices" if what == "nth" else f"{what} doesn't support negative count")
        return plain(n)

    def call_limit_2(self, n: Code, f: Code) -> Code:
        def taken(n_: object, outs: Callable[[], Iterator]) -> Iterator:
            k = self.counted(n_, "limit")
            if k > 0:
                for x in outs():
                    yield x
                    k -= 1
                    if k <= 0:
                        break

        def many(v: object, env: dict) -> Iterator:
            for k in n.many(v, env):
                yield from taken(k, lambda: f.many(v, env))

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for k in n.many(v, env):
                yield from taken(k, lambda: f.path(p, v, env))

        return Code(many, path=lambda: walk)

    def call_skip_2(self, n: Code, f: Code) -> Code:
        def left(k: float, outs: Iterator) -> Iterator:
            for x in outs:
                if k > 0:
                    k -= 1
                else:
                    yield x

        def many(v: object, env: dict) -> Iterator:
            for k in n.many(v, env):
                yield from left(self.counted(k, "skip"), f.many(v, env))

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for k in n.many(v, env):
                yield from left(self.counted(k, "skip"), f.path(p, v, env))

        return Code(many, path=lambda: walk)

    def call_first_1(self, f: Code) -> Code:
        def first(outs: Iterator) -> Iterator:
            for x in outs:
                yield x
                return

        return Code(lambda v, env: first(f.many(v, env)), path=lambda: lambda p, v, env: first(f.path(p, v, env)))

    def call_last_1(self, f: Code) -> Code:
        def last(outs: Iterator) -> Iterator:
            found = False
            for x in outs:
                found = True
            if found:
                yield x

        return Code(lambda v, env: last(f.many(v, env)), path=lambda: lambda p, v, env: last(f.path(p, v, env)))

    def call_nth(self, codes: list[Code]) -> Code | None:
        if len(codes) == 1:
            return self.indexed(Code(one=lambda v, env: v, path=lambda: lambda p, v, env: iter(((p, v),))), codes[0])
        if len(codes) != 2:
            return None
        n, f = codes

        def at(k: float, outs: Iterator) -> Iterator:
            for x in outs:
                if k < 1:
                    yield x
                    return
                k -= 1

        def many(v: object, env: dict) -> Iterator:
            for k in n.many(v, env):
                yield from at(self.counted(k, "nth"), f.many(v, env))

        def walk(p: tuple | None, v: object, env: dict) -> Iterator:
            for k in n.many(v, env):
                yield from at(self.counted(k, "nth"), f.path(p, v, env))

        return Code(many, path=lambda: walk)

    def call_until_2(self, test: Code, step: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            if test.one and step.one:
                while not truthy(test.one(v, env)):
                    v = step.one(v, env)
                yield v
                return
            for x in test.many(v, env):
                if truthy(x):
                    yield v
                else:
                    for y in step.many(v, env):
                        yield from many(y, env)

        return Code(many)

    def call_while_2(self, test: Code, step: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            if test.one and step.one:
                while truthy(test.one(v, env)):
                    yield v
                    v = step.one(v, env)
                return
            for x in test.many(v, env):
                if truthy(x):
                    yield v
                    for y in step.many(v, env):
                        yield from many(y, env)

        return Code(many)

    def call_repeat_1(self, f: Code) -> Code:
        def many(v: object, env: dict) -> Iterator:
            while True:
                found = False
                for x in f.many(v, env):
                    found = True
                    yield x
                if not found:
                    return

        return Code(many)

    def call_walk_1(self, f: Code) -> Code:
        def inner(v: object, env: dict) -> object:
            if isinstance(v, list):
                return [y for x in v for y in first(x, env)]
            if isinstance(v, dict):
                out = {}
                for k, x in v.items():
                    for y in first(x, env):
                        out[k] = y
                return out
            return v

        def first(v: object, env: dict) -> Iterator:
            for y in f.many(inner(v, env), env):
                yield y
                return

        return Code(lambda v, env: f.many(inner(v, env), env))

    def call_env_0(self) -> Code:
        own = dict(os.environ)
        return Code(one=lambda v, env: own)

    def call_builtins_0(self) -> Code:
        return Code(one=lambda v, env: builtin_names())

    def call_input_0(self) -> Code:
        def one(v: object, env: dict) -> object:
            for x in self.inputs() if self.inputs else ():
                return x
            raise JsonError("break")

        return Code(one=one)

    def call_inputs_0(self) -> Code:
        return Code(lambda v, env: self.inputs() if self.inputs else iter(()))

    def call_halt_0(self) -> Code:
        def one(v: object, env: dict) -> object:
            raise Halt(None, 0, True)

        return Code(one=one)

    def call_halt_error(self, codes: list[Code]) -> Code | None:
        if len(codes) > 1:
            return None

        def many(v: object, env: dict) -> Iterator:
            for n in codes[0].many(v, env) if codes else (5,):
                raise Halt(v, int(plain(n)))
            yield from ()

        return Code(many)

    def call_modulemeta_0(self) -> Code:
        return Code(one=lambda v, env: self.modulemeta(v))

    def call_splits(self, codes: list[Code]) -> Code | None:
        if len(codes) not in (1, 2):
            return None

        def segments(v: object, re_: object, letters: object) -> Iterator:
            at = 0
            for m in patterns.matches(v, re_, letters, True):
                yield v[at : m.start()]
                at = m.end()
            yield v[at:]

        return self.flagged(codes, segments)

    def call_split_2(self, re_: Code, letters: Code) -> Code:
        made = self.call_splits([re_, letters])
        return Code(one=lambda v, env: list(made.many(v, env)))

    def flagged(self, codes: list[Code], run: Callable[[object, object, object], Iterator]) -> Code:
        """run(input, pattern, flags) for all patterns and flags; a pattern may be [pattern, flags]."""
        none = Code(one=lambda v, env: None)
        re_, letters = codes[0], codes[1] if len(codes) > 1 else none

        def many(v: object, env: dict) -> Iterator:
            for f in letters.many(v, env):
                for r in re_.many(v, env):
                    if isinstance(r, list) and len(codes) == 1:
                        yield from run(v, r[0] if r else None, r[1] if len(r) > 1 else None)
                    else:
                        yield from run(v, r, f)

        return Code(many)

    def call_test(self, codes: list[Code]) -> Code | None:
        def run(v: object, r: object, f: object) -> Iterator:
            yield any(True for _ in patterns.matches(v, r, f))

        return self.flagged(codes, run) if len(codes) in (1, 2) else None

    def call_match(self, codes: list[Code]) -> Code | None:
        return self.flagged(codes, lambda v, r, f: map(patterns.described_match, patterns.matches(v, r, f))) if len(codes) in (1, 2) else None

    def call_capture(self, codes: list[Code]) -> Code | None:
        return self.flagged(codes, lambda v, r, f: map(patterns.captured, patterns.matches(v, r, f))) if len(codes) in (1, 2) else None

    def call_scan(self, codes: list[Code]) -> Code | None:
        return self.flagged(codes, lambda v, r, f: map(patterns.scanned, patterns.matches(v, r, f, True))) if len(codes) in (1, 2) else None

    def call_sub(self, codes: list[Code]) -> Code | None:
        return self.replaced(codes, False) if len(codes) in (2, 3) else None

    def call_gsub(self, codes: list[Code]) -> Code | None:
        return self.replaced(codes, True) if len(codes) in (2, 3) else None

    def replaced(self, codes: list[Code], every: bool) -> Code:
        re_, new, letters = codes[0], codes[1], codes[2] if len(codes) == 3 else Code(one=lambda v, env: None)

        def build(v: str, found: list, i: int, env: dict) -> Iterator[str]:
            """Text up to match i with replacements; several replacements give several texts."""
            if i < 0:
                yield ""
                return
            start = found[i - 1].end() if i else 0
            for s in new.many(patterns.captured(found[i]), env):
                if not isinstance(s, str):
                    fail(f"{described(patterns.captured(found[i]))} cannot be added to a string")
                for before in build(v, found, i - 1, env):
                    yield before + v[start : found[i].start()] + s

        def many(v: object, env: dict) -> Iterator:
            for f in letters.many(v, env):
                for r in re_.many(v, env):
                    found = list(patterns.matches(v, r, f, every))
                    end = v[found[-1].end() :] if found else ""
                    if not found:
                        yield v
                        continue
                    if len(found) > 300 and new.one:  # no recursion over many matches
                        parts, at = [], 0
                        for m in found:
                            parts += [v[at : m.start()], new.one(patterns.captured(m), env)]
                            at = m.end()
                        yield "".join(parts) + end
                        continue
                    for s in build(v, found, len(found) - 1, env):
                        yield s + end

        return Code(many)

    def call_getpath_1(self, a: Code) -> Code:
        return self.getpath(a)


def _bad(v: object, k: object) -> None:
    fail(f"Invalid path expression near attempt to access element {text(k)} of {_clipped(v)}")


def variables(p: tuple) -> list[str]:
    if p[0] == "var":
        return [p[1]]
    if p[0] == "array":
        return [x for q in p[1] for x in variables(q)]
    return [x for _, also, q in p[1] for x in ([also] if also else []) + (variables(q) if q else [])]


def constant(node: tuple) -> object:
    """The value of a constant node, for module metadata."""
    if node[0] == "literal":
        return node[2]
    if node[0] == "object":
        out = {}
        for k, v in node[2]:
            if k[0] != "literal":
                raise FilterSyntaxError("Module metadata must be constant", node[1])
            out[k[2]] = constant(v)
        return out
    if node[0] == "array":
        items: list = []
        x = node[2]
        while x is not None and x[0] == "comma":
            items.insert(0, constant(x[3]))
            x = x[2]
        return ([constant(x)] if x is not None else []) + items
    if node[0] == "negate":
        return negate(constant(node[2]))
    raise FilterSyntaxError("Module metadata must be constant", node[1])


def builtin_names() -> list[str]:
    out = [f"{n}/0" for n in (*UNARY, *SELECTORS)] + [f"{n}/1" for n in WITH_ONE] + [f"{n}/2" for n in MATH2] + [f"{n}/3" for n in MATH3]
    many = {"paths": (0, 1), "any": (1, 2), "all": (1, 2), "IN": (1, 2), "INDEX": (1, 2), "JOIN": (2, 3, 4), "range": (1, 2, 3), "nth": (1, 2), "halt_error": (0, 1), "splits": (1, 2), "test": (1, 2), "match": (1, 2), "capture": (1, 2), "scan": (1, 2), "sub": (2, 3), "gsub": (2, 3)}
    for attribute in dir(Compiler):
        if attribute.startswith("call_") and attribute[-1].isdigit():
            name, _, n = attribute[5:].rpartition("_")
            out.append(f"{name}/{n}")
    out += [f"{name}/{n}" for name, ns in many.items() for n in ns]
    return sorted(set(out))
