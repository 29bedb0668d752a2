"""Scalar functions of the filter language on JSON values, by family. Each takes the input and its arguments."""

from __future__ import annotations

import base64
import math
import re
import sys
import time
from calendar import timegm
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from urllib.parse import quote

from pathloom.functions.values import Big, JsonError, JsonTextError, compare, equal, float_text, integer, is_number, kind, order_key, shown, text, truthy, values_of

LARGEST_TEXT = 1 << 29
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def fail(message: str) -> None:
    raise JsonError(message)


def described(v: object, most: int = 14) -> str:
    return f"{kind(v)} ({shown(v, most)})"


# -- arithmetic ----------------------------------------------------------------------------------


def plain(v: object) -> int | float:
    return float(v) if isinstance(v, Big) else v


def overflowed(n: int) -> int:
    if not -(1 << 63) <= n < 1 << 63:
        fail("integer overflow")
    return n


def add(a: object, b: object) -> object:
    if is_number(a) and is_number(b):
        a, b = plain(a), plain(b)
        return overflowed(a + b) if type(a) is int and type(b) is int else a + b
    if a is None:
        return b
    if b is None:
        return a
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
        return a + b
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **b}
    fail(f"{described(a)} and {described(b)} cannot be added")


def subtract(a: object, b: object) -> object:
    if is_number(a) and is_number(b):
        a, b = plain(a), plain(b)
        return overflowed(a - b) if type(a) is int and type(b) is int else a - b
    if isinstance(a, list) and isinstance(b, list):
        return [x for x in a if not any(equal(x, y) for y in b)]
    fail(f"{described(a)} and {described(b)} cannot be subtracted")


def merged(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def repeated(s: str, n: int | float) -> str | None:
    if n != n or n < 0:
        return None
    times = int(min(n, 1 << 40))
    if len(s) * times > LARGEST_TEXT:
        fail("Repeat string result too long")
    return s * times


def multiply(a: object, b: object) -> object:
    if is_number(a) and is_number(b):
        a, b = plain(a), plain(b)
        return overflowed(a * b) if type(a) is int and type(b) is int else a * b
    if isinstance(a, str) and is_number(b):
        return repeated(a, plain(b))
    if is_number(a) and isinstance(b, str):
        return repeated(b, plain(a))
    if isinstance(a, dict) and isinstance(b, dict):
        return merged(a, b)
    fail(f"{described(a)} and {described(b)} cannot be multiplied")


def divide(a: object, b: object) -> object:
    if is_number(a) and is_number(b):
        a, b = plain(a), plain(b)
        if b == 0:
            fail(f"{described(a)} and {described(b)} cannot be divided because the divisor is zero")
        return a // b if type(a) is int and type(b) is int and a % b == 0 else a / b
    if isinstance(a, str) and isinstance(b, str):
        return split(a, b)
    fail(f"{described(a)} and {described(b)} cannot be divided")


def _whole(v: int | float) -> int:
    if type(v) is int:
        return v
    return (1 << 63) - 1 if v >= 2.0**63 else -(1 << 63) if v <= -(2.0**63) else int(v)


def modulo(a: object, b: object) -> object:
    if is_number(a) and is_number(b):
        a, b = plain(a), plain(b)
        if a != a or b != b:
            return math.nan
        x, y = _whole(a), _whole(b)
        if y == 0:
            fail(f"{described(a)} and {described(b)} cannot be divided (remainder) because the divisor is zero")
        r = abs(x) % abs(y)
        return -r if x < 0 else r
    fail(f"{described(a)} and {described(b)} cannot be divided")


def negate(v: object) -> object:
    if not is_number(v):
        fail(f"{described(v)} cannot be negated")
    return integer(-v) if type(v) is int else -v


BINARY: dict[str, Callable] = {
    "+": add, "-": subtract, "*": multiply, "/": divide, "%": modulo,
    "==": equal, "!=": lambda a, b: not equal(a, b),
    "<": lambda a, b: compare(a, b) < 0, "<=": lambda a, b: compare(a, b) <= 0,
    ">": lambda a, b: compare(a, b) > 0, ">=": lambda a, b: compare(a, b) >= 0,
}


# -- paths ---------------------------------------------------------------------------------------


def field(v: object, k: object) -> object:
    """v[k] for any kinds."""
    if isinstance(k, str):
        if isinstance(v, dict):
            return v.get(k)
        if v is None:
            return None
        fail(f"Cannot index {kind(v)} with {described(k, 30)}")
    if isinstance(k, bool):
        fail(f"Cannot index {kind(v)} with boolean")
    if isinstance(k, (int, float, Big)):
        if isinstance(v, list):
            k = plain(k)
            if k != k or math.isinf(k):
                return None
            i = math.floor(k)
            return v[i] if -len(v) <= i < len(v) else None
        if v is None:
            return None
        fail(f"Cannot index {kind(v)} with {described(k)}")
    if isinstance(k, dict):
        if v is None:
            return None
        return cut(v, k.get("start"), k.get("end"))
    if isinstance(k, list) and isinstance(v, list):
        return indices(v, k)
    if v is None and k is None:
        return None
    fail(f"Cannot index {kind(v)} with {kind(k)}")


def span(n: int, low: object, high: object) -> tuple[int, int]:
    def bound(x: object, default: int, round_: Callable) -> int:
        if x is None:
            return default
        if not is_number(x):
            fail("Start and end indices of an array slice must be numbers")
        x = plain(x)
        if x != x:
            return default
        x = max(-1e18, min(1e18, x))
        i = round_(x)
        return max(0, min(n, i + n if x < 0 else i))

    a, b = bound(low, 0, math.floor), bound(high, n, math.ceil)
    return a, max(a, b)


def cut(v: object, low: object, high: object) -> object:
    if v is None:
        return None
    if not isinstance(v, (str, list)):
        fail(f"Cannot index {kind(v)} with object")
    a, b = span(len(v), low, high)
    return v[a:b]


def iterated(v: object) -> list:
    if isinstance(v, list):
        return v
    if isinstance(v, dict):
        return list(v.values())
    fail(f"Cannot iterate over {described(v)}" if v is not None else "Cannot iterate over null")


def getpath(v: object, path: object) -> object:
    if not isinstance(path, list):
        fail("Path must be specified as an array")
    for k in path:
        if v is None:
            return None
        v = field(v, k)
    return v


def put(v: object, k: object, new: object) -> object:
    if isinstance(k, str):
        if v is not None and not isinstance(v, dict):
            fail(f"Cannot index {kind(v)} with {described(k, 30)}")
        return {**(v or {}), k: new}
    if isinstance(k, dict):
        if isinstance(v, str):
            fail("Cannot update string slices")
        if v is not None and not isinstance(v, list):
            fail(f"Cannot update field at object index of {kind(v)}")
        if not isinstance(new, list):
            fail("A slice of an array can only be assigned another array")
        a, b = span(len(v or []), k.get("start"), k.get("end"))
        return (v or [])[:a] + new + (v or [])[b:]
    if is_number(k):
        if v is not None and not isinstance(v, list):
            fail(f"Cannot index {kind(v)} with {described(k)}")
        k = plain(k)
        if k != k:
            fail("Cannot set array element at NaN index")
        i, own = math.floor(max(-1e18, min(1e18, k))), list(v or [])
        if i < 0:
            i += len(own)
            if i < 0:
                fail("Out of bounds negative array index")
        if i > 536870911:
            fail("Array index too large")
        own += [None] * (i + 1 - len(own))
        own[i] = new
        return own
    if isinstance(v, list):
        fail(f"Cannot update field at {'array' if isinstance(k, list) else kind(k)} index of array")
    fail(f"Invalid path component: cannot index {kind(v)} with {kind(k)}" if v is not None else f"Invalid path component {kind(k)}")


def setpath(v: object, path: list, new: object, at: int = 0) -> object:
    if at == len(path):
        return new
    k = path[at]
    inner = field(v, k) if v is not None else None
    if is_number(k) and plain(k) != plain(k):
        inner = None
    return put(v, k, setpath(inner, path, new, at + 1))


def delkeys(v: object, keys: list) -> object:
    """Without the given keys, all at once."""
    if v is None or not keys:
        return v
    if isinstance(v, dict):
        for k in keys:
            if not isinstance(k, str):
                fail(f"Cannot delete field at object index of {'array' if isinstance(k, dict) else 'object'}" if not is_number(k) else "Cannot delete field at array index of object")
        gone = set(keys)
        return {k: x for k, x in v.items() if k not in gone}
    if isinstance(v, list):
        drop: set[int] = set()
        for k in keys:
            if isinstance(k, dict):
                drop.update(range(*span(len(v), k.get("start"), k.get("end"))))
            elif is_number(k):
                k = plain(k)
                if k == k and not math.isinf(k):
                    i = math.floor(k)
                    drop.add(i + len(v) if i < 0 else i)
            else:
                fail("Cannot delete field at object index of array" if isinstance(k, str) else f"Cannot delete field at {kind(k)} index of array")
        return [x for i, x in enumerate(v) if i not in drop]
    k = keys[0]
    fail(f"Cannot delete field at {'object' if isinstance(k, str) else 'array'} index of {kind(v)}")


def delpaths(v: object, paths: object) -> object:
    if not isinstance(paths, list):
        fail("Paths must be specified as an array")
    for p in paths:
        if not isinstance(p, list):
            fail("Path must be specified as an array")
    return _without(v, paths)


def _without(v: object, paths: list[list]) -> object:
    """v without all paths at once: what lies deeper goes first, then this level's keys together."""
    if v is None or any(not p for p in paths):
        return None
    below: list[tuple[object, list]] = []
    for p in paths:
        if len(p) > 1:
            own = next((rest for k, rest in below if equal(k, p[0])), None)
            if own is None:
                below.append((p[0], own := []))
            own.append(p[1:])
    for k, rest in below:
        inner = field(v, k)
        if inner is not None:
            v = put(v, k, _without(inner, rest))
    return delkeys(v, [p[0] for p in paths if len(p) == 1])


def subvalues(v: object, path: tuple = ()):
    """(path, value) of v and everything below it, parents first."""
    yield path, v
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield from subvalues(x, (*path, i))
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from subvalues(x, (*path, k))


# -- collections ---------------------------------------------------------------------------------


def length(v: object) -> object:
    if v is None:
        return 0
    if isinstance(v, bool):
        fail(f"{described(v)} has no length")
    if isinstance(v, (int, float)):
        return abs(v)
    if isinstance(v, Big):
        return Big(abs(v.value))
    return len(v)


def keys(v: object) -> list:
    if isinstance(v, dict):
        return sorted(v)
    if isinstance(v, list):
        return list(range(len(v)))
    fail(f"{described(v)} has no keys")


def array(v: object, what: str = "sorted, as it is not an array") -> list:
    if not isinstance(v, list):
        fail(f"{described(v)} cannot be {what}")
    return v


def has(v: object, k: object) -> bool:
    if isinstance(v, dict) and isinstance(k, str):
        return k in v
    if isinstance(v, list) and is_number(k):
        k = plain(k)
        return k == k and 0 <= k < len(v)
    fail(f"Cannot check whether {kind(v)} has a {'string' if isinstance(k, str) else kind(k)} key")


def contains(a: object, b: object) -> bool:
    if kind(a) != kind(b):
        fail(f"{described(a)} and {described(b)} cannot have their containment checked")
    return _contains(a, b)


def _contains(a: object, b: object) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], x) for k, x in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_contains(y, x) for y in a) for x in b)
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    return equal(a, b)


def flatten(v: object, depth: object = math.inf) -> list:
    if is_number(depth) and plain(depth) < 0:
        fail("flatten depth must not be negative")
    out: list = []
    most, work = plain(depth), [iter(iterated(v))]
    while work:
        for x in work[-1]:
            if isinstance(x, list) and len(work) <= most:
                work.append(iter(x))
                break
            out.append(x)
        else:
            work.pop()
    return out


def sort(v: object) -> list:
    return sorted(array(v), key=order_key)


def by_keys(v: object, keyed: list) -> list[tuple]:
    return sorted(zip(keyed, range(len(v)), v), key=lambda t: (order_key(t[0]), t[1]))


def group(v: list, keyed: list) -> list[list]:
    out: list[list] = []
    last: object = None
    for k, _, x in by_keys(v, keyed):
        if out and compare(k, last) == 0:
            out[-1].append(x)
        else:
            out.append([x])
            last = k
    return out


def unique(v: object) -> list:
    return [g[0] for g in group(array(v), v)]


def extreme(v: list, keyed: list, sign: int) -> object:
    """The first least (sign 1) or the last greatest (sign -1)."""
    best = None
    for i, k in enumerate(keyed):
        if best is None or sign * compare(k, keyed[best]) < 0 or sign < 0 and compare(k, keyed[best]) == 0:
            best = i
    return None if best is None else v[best]


def as_doubles(v: object) -> object:
    """Numbers beyond the doubles as infinities."""
    if isinstance(v, Big):
        return float(v)
    if isinstance(v, list):
        return [as_doubles(x) for x in v]
    return {k: as_doubles(x) for k, x in v.items()} if isinstance(v, dict) else v


def tojson(v: object) -> str:
    out = text(v)
    return text(as_doubles(v)) if "E" in out else out  # only they are written with a capital


def to_entries(v: object) -> list:
    if isinstance(v, list):
        return [{"key": k, "value": x} for k, x in enumerate(v)]
    if not isinstance(v, dict):
        fail(f"{described(v)} has no keys")
    return [{"key": k, "value": x} for k, x in v.items()]


def from_entries(v: object) -> dict:
    out = {}
    for e in iterated(v):
        key = None
        for name in ("key", "k", "name", "Name", "Key", "K"):
            own = field(e, name)
            if own is not None and (own is not False or key is None):
                key = own
                if own is not False:
                    break
        value = next((e[n] for n in ("value", "v", "Value", "V") if isinstance(e, dict) and n in e), None)
        if key is None:
            key = "null"
        elif isinstance(key, bool) or is_number(key):
            key = text(key)
        elif not isinstance(key, str):
            fail(f"Cannot use {described(key)} as object key")
        out[key] = value
    return out


def transpose(v: object) -> list:
    rows = array(v)
    n = max((len(r) for r in rows), default=0)
    return [[r[i] if i < len(r) else None for r in rows] for i in range(n)]


def indices(v: object, x: object) -> object:
    if v is None:
        return None
    if isinstance(v, str) and isinstance(x, str):
        out, at = [], v.find(x) if x else -1
        while at >= 0:
            out.append(at)
            at = v.find(x, at + 1)
        return out if x else None
    if isinstance(v, list) and isinstance(x, list):
        n = len(x)
        return [i for i in range(len(v) - n + 1) if all(equal(a, b) for a, b in zip(v[i : i + n], x))] if n else None
    if isinstance(v, list):
        return [i for i, y in enumerate(v) if equal(y, x)]
    return field(v, x)


def bsearch(v: object, x: object) -> int:
    if not isinstance(v, list):
        fail(f"{described(v)} cannot be searched from")
    lo, hi = 0, len(v)
    while lo < hi:
        mid = (lo + hi) // 2
        c = compare(v[mid], x)
        if c == 0:
            return mid
        lo, hi = (mid + 1, hi) if c < 0 else (lo, mid)
    return -1 - lo


# -- strings -------------------------------------------------------------------------------------


def string(v: object, what: str) -> str:
    if not isinstance(v, str):
        fail(f"{described(v)} {what}")
    return v


def tostring(v: object) -> str:
    return v if isinstance(v, str) else text(v)


_NUMERAL = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z", re.A)


def tonumber(v: object) -> object:
    if is_number(v):
        return v
    if not isinstance(v, str):
        fail(f"{described(v, 30)} cannot be parsed as a number")
    if v in ("nan", "NaN"):
        return math.nan
    if not _NUMERAL.match(v):
        fail(f"{described(v, 30)} cannot be parsed as a number")
    if re.fullmatch(r"[+-]?\d+", v) and -(1 << 63) <= int(v) < 1 << 63:
        return int(v)
    return float(v)


def toboolean(v: object) -> bool:
    if isinstance(v, bool):
        return v
    if v in ("true", "false") and isinstance(v, str):
        return v == "true"
    fail(f"{described(v, 30)} cannot be parsed as a boolean")


def split(s: str, by: str) -> list:
    if not s:
        return []
    return list(s) if not by else s.split(by)


def split1(v: object, by: object) -> list:
    if not isinstance(v, str) or not isinstance(by, str):
        fail("split input and separator must be strings")
    return split(v, by)


def join(v: object, by: object) -> object:
    items = iterated(v)
    if not items:
        return ""
    if not isinstance(by, str):
        fail(f"{described(items[0])} and {described(by)} cannot be added" if by is not None or len(items) > 1 else "")
    out: list[str] = []
    done = ""
    for i, x in enumerate(items):
        if isinstance(x, (list, dict)):
            done = by.join(out) + (by if i else "")
            fail(f"{described(done)} and {described(x)} cannot be added")
        out.append("" if x is None else tostring(x))
    return by.join(out)


def trimmed(v: object, left: bool, right: bool) -> str:
    if not isinstance(v, str):
        fail("trim input must be a string")
    v = v.lstrip(SPACES) if left else v
    return v.rstrip(SPACES) if right else v


def trimstr(v: object, s: object, left: bool, right: bool, name: str) -> object:
    if not isinstance(v, str) or not isinstance(s, str):
        fail(f"{'endswith' if right and not left else 'startswith'}() requires string inputs")
    if left and s and v.startswith(s):
        v = v[len(s) :]
    if right and s and v.endswith(s):
        v = v[: len(v) - len(s)]
    return v


def affix(v: object, s: object, name: str) -> bool:
    if not isinstance(v, str) or not isinstance(s, str):
        fail(f"{name}() requires string inputs")
    return v.startswith(s) if name == "startswith" else v.endswith(s)


def implode(v: object) -> str:
    if not isinstance(v, list):
        fail("implode input must be an array")
    out = []
    for c in v:
        if not is_number(c) or plain(c) != plain(c):
            fail(f"{described(c)} can't be imploded,unicode codepoint needs to be numeric")
        n = plain(c)
        n = int(n) if n == n and not math.isinf(n) else -1
        out.append(chr(n) if 0 <= n < 0xD800 or 0xE000 <= n < 0x110000 else "�")
    return "".join(out)


_LOWER = {c: c + 32 for c in range(65, 91)}
_UPPER = {c: c - 32 for c in range(97, 123)}


def ascii_case(v: object, table: dict, name: str) -> str:
    if not isinstance(v, str):
        fail(f"{name} input must be a string")
    return v.translate(table)


def ascii_(v: object) -> object:
    if is_number(v):
        return chr(int(plain(v)))
    return ord(string(v, "cannot be converted")[0])


# -- encoders ------------------------------------------------------------------------------------


def _row(v: object, name: str, quote_: Callable[[str], str]) -> list[str]:
    if not isinstance(v, list):
        fail(f"{described(v)} cannot be {name}-formatted, only an array can be")
    out = []
    for x in v:
        if isinstance(x, (list, dict)):
            fail(f"{described(x)} is not valid in a {name} row")
        out.append("" if x is None else quote_(x) if isinstance(x, str) else text(x))
    return out


def _shell(v: object) -> str:
    if isinstance(v, (list, dict)):
        fail(f"{described(v)} can not be escaped for shell")
    return "'" + v.replace("'", "'\\''") + "'" if isinstance(v, str) else text(v)


_HTML = str.maketrans({"<": "&lt;", ">": "&gt;", "&": "&amp;", "'": "&apos;", '"': "&quot;"})


def _unpercent(v: object) -> str:
    from urllib.parse import unquote_to_bytes

    s = tostring(v)
    if re.search(r"%(?![0-9A-Fa-f]{2})", s):
        fail(f"{described(s)} is not a valid uri encoding")
    try:
        return unquote_to_bytes(s).decode("utf-8")
    except UnicodeDecodeError:
        fail(f"{described(s)} is not a valid uri encoding")


def _unbase64(v: object) -> str:
    s = tostring(v)
    kept = s.rstrip("=")
    if re.search(r"[^A-Za-z0-9+/]", kept) or len(kept) % 4 == 1 and kept != "" and len(kept) < 2:
        fail(f"{described(s)} is not valid base64 data")
    usable = kept[: len(kept) - (len(kept) % 4 == 1)]
    return base64.b64decode(usable + "=" * (-len(usable) % 4)).decode("utf-8", "replace")


FORMATS: dict[str, Callable[[object], str]] = {
    "text": tostring,
    "json": text,
    "csv": lambda v: ",".join(_row(v, "csv", lambda s: '"' + s.replace('"', '""') + '"')),
    "tsv": lambda v: "\t".join(_row(v, "tsv", lambda s: s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r"))),
    "html": lambda v: tostring(v).translate(_HTML),
    "uri": lambda v: quote(tostring(v), safe="~", errors="replace"),
    "urid": _unpercent,
    "sh": lambda v: " ".join(map(_shell, v)) if isinstance(v, list) else _shell(v),
    "base64": lambda v: base64.b64encode(tostring(v).encode()).decode(),
    "base64d": _unbase64,
}


def fromjson(v: object) -> object:
    s = string(v, "only strings can be parsed")
    if not s.strip(" \t\r\n"):
        fail("Expected JSON value")
    try:
        found = list(values_of(s, deepest=10_000))
    except JsonTextError as e:
        line = s.count("\n", 0, e.at) + 1
        column = e.at - (s.rfind("\n", 0, e.at) + 1)
        fail(f"{e.message} at line {line},{' ' if 'string' in e.message else ''}column {column} (while parsing '{s}')")
    if len(found) != 1:
        fail(f"Unexpected extra JSON values (while parsing '{s}')")
    return found[0]


# -- mathematics ---------------------------------------------------------------------------------


def num(v: object) -> float:
    if not is_number(v):
        fail(f"{described(v)} number required")
    return plain(v)


def guarded(f: Callable) -> Callable:
    def run(*args: object) -> float:
        xs = [float(num(a)) for a in args]
        try:
            return f(*xs)
        except OverflowError:
            return math.inf
        except (ValueError, ZeroDivisionError):
            return math.nan

    return run


def rounded(f: Callable) -> Callable:
    """floor, ceil and round give integers where a double is exact."""

    def run(v: object) -> object:
        x = num(v)
        if type(x) is int or x != x or math.isinf(x):
            return x
        n = f(x)
        return n if abs(n) < 1 << 63 else float(n)

    return run


def _log(f: Callable) -> Callable:
    return lambda x: -math.inf if x == 0 else f(x)


def _j(n: int) -> Callable[[float], float]:
    """Bessel function of the first kind by its integral, composite Simpson."""

    def run(x: float) -> float:
        m = 2 * int(200 + abs(x))
        h = math.pi / m
        total = sum((1 if i in (0, m) else 4 if i % 2 else 2) * math.cos(n * i * h - x * math.sin(i * h)) for i in range(m + 1))
        return total * h / 3 / math.pi

    return run


def _rint(x: float) -> float:
    return x if x != x or math.isinf(x) else math.copysign(float(round(x)), x)


def _logb(x: float) -> float:
    return -math.inf if x == 0 else math.inf if math.isinf(x) else float(math.frexp(x)[1] - 1)


def _significand(x: float) -> float:
    return x if x == 0 or math.isinf(x) or x != x else math.frexp(x)[0] * 2


def absolute(v: object) -> object:
    if isinstance(v, str):
        return v
    if isinstance(v, Big):
        return Big(abs(v.value))
    if not is_number(v):
        fail(f"{described(v)} has no absolute value")
    return v if v == 0 and type(v) is not float else abs(v)


MATH1: dict[str, Callable] = {
    "floor": rounded(math.floor), "ceil": rounded(math.ceil), "round": rounded(lambda x: int(math.copysign(math.floor(abs(x) + 0.5), x))),
    "fabs": guarded(abs), "sqrt": guarded(math.sqrt), "cbrt": guarded(math.cbrt), "exp": guarded(math.exp), "exp2": guarded(lambda x: 2.0**x), "exp10": guarded(lambda x: 10.0**x),
    "log": guarded(_log(math.log)), "log2": guarded(_log(math.log2)), "log10": guarded(_log(math.log10)),
    "sin": guarded(math.sin), "cos": guarded(math.cos), "tan": guarded(math.tan), "asin": guarded(math.asin), "acos": guarded(math.acos), "atan": guarded(math.atan),
    "sinh": guarded(math.sinh), "cosh": guarded(math.cosh), "tanh": guarded(math.tanh), "asinh": guarded(math.asinh), "acosh": guarded(math.acosh), "atanh": guarded(math.atanh),
    "rint": guarded(_rint), "nearbyint": guarded(_rint), "trunc": guarded(lambda x: x if x != x or math.isinf(x) else float(math.trunc(x))),
    "significand": guarded(_significand), "logb": guarded(_logb), "j0": guarded(_j(0)), "j1": guarded(_j(1)), "lgamma": guarded(math.lgamma), "tgamma": guarded(math.gamma),
    "abs": absolute,
}
MATH2: dict[str, Callable] = {
    "pow": guarded(math.pow), "atan2": guarded(math.atan2), "hypot": guarded(math.hypot), "remainder": guarded(math.remainder), "drem": guarded(math.remainder),
    "ldexp": guarded(lambda a, b: math.ldexp(a, int(b))), "scalb": guarded(lambda a, b: math.ldexp(a, int(b))), "scalbln": guarded(lambda a, b: math.ldexp(a, int(b))),
    "fmod": guarded(math.fmod), "fmin": guarded(min), "fmax": guarded(max),
}
MATH3: dict[str, Callable] = {"fma": guarded(lambda a, b, c: a * b + c)}


# -- dates, all in UTC ---------------------------------------------------------------------------

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_INT = {int}


#: How many times and formats are remembered by a worker, each.
KNOWN = 8192


@lru_cache(KNOWN)
def _parts(seconds: int) -> tuple:
    t = _EPOCH + timedelta(seconds=seconds)
    return t.year, t.month - 1, t.day, t.hour, t.minute, t.second, (t.weekday() + 1) % 7, t.timetuple().tm_yday - 1


def gmtime(v: object) -> list:
    if type(v) is int and 0 <= v < 1 << 36:
        return list(_parts(v))
    if not is_number(v):
        fail("gmtime() requires a number")
    x = plain(v)
    whole = math.floor(x)
    try:
        t = _EPOCH + timedelta(seconds=whole)
    except OverflowError:
        fail("error converting number of seconds since epoch to datetime")
    seconds: object = t.second + (x - whole) if type(x) is float and x != whole else t.second
    return [t.year, t.month - 1, t.day, t.hour, t.minute, seconds, (t.weekday() + 1) % 7, t.timetuple().tm_yday - 1]


def _broken(v: object, name: str) -> list:
    if is_number(v):
        v = gmtime(v)
    if not isinstance(v, list):
        fail(f"{name} requires array of 6 numbers" if name == "mktime" else f"{name}/1 requires parsed datetime inputs")
    if not all(is_number(x) for x in v):
        fail(f"{name} requires parsed datetime inputs" if name == "mktime" else f"{name}/1 requires parsed datetime inputs")
    own = [plain(x) for x in v] + [0, 0, 1, 0, 0, 0][len(v) :]
    return own


_seconds = lru_cache(KNOWN)(lambda year, month, *rest: timegm((year, month + 1, *rest)))


def mktime(v: object) -> int:
    if not isinstance(v, list):
        fail("mktime requires array of 6 numbers")
    if len(v) > 5 and set(map(type, v)) == _INT and 0 <= v[1] < 12:
        return _seconds(*v[:6])
    own = _broken(v, "mktime")
    return timegm((int(own[0]), int(own[1]) + 1, int(own[2]), int(own[3]), int(own[4]), int(own[5]))) if 0 <= own[1] < 12 else timegm((int(own[0]) + int(own[1]) // 12, int(own[1]) % 12 + 1, int(own[2]), int(own[3]), int(own[4]), int(own[5])))


def strftime(v: object, fmt: object, name: str = "strftime") -> str:
    if not is_number(v) and not isinstance(v, list):
        fail(f"{name}/1 requires parsed datetime inputs")
    if not isinstance(fmt, str):
        fail(f"{name}/1 requires a string format")
    if type(v) is int and 0 <= v < 1 << 36:
        return _formatted(v, fmt)
    return _formatted(mktime(_broken(v, name)), fmt)


@lru_cache(KNOWN)
def _formatted(seconds: int, fmt: str) -> str:
    t = _EPOCH + timedelta(seconds=seconds)
    return t.strftime(_DIRECTIVE.sub(lambda m: _OWN[m[1]](t) if m[1] in _OWN else m[0], fmt))


_DIRECTIVE = re.compile(r"%(.)")
#: Directives that Python's strftime lacks or leaves to the platform.
_OWN: dict[str, Callable[[datetime], str]] = {
    "Z": lambda t: "UTC", "z": lambda t: "+0000", "e": lambda t: f"{t.day:2d}", "k": lambda t: f"{t.hour:2d}", "l": lambda t: f"{(t.hour + 11) % 12 + 1:2d}",
    "s": lambda t: str(int((t - _EPOCH).total_seconds())), "T": lambda t: "%H:%M:%S", "D": lambda t: "%m/%d/%y", "F": lambda t: f"{t.year}-%m-%d", "R": lambda t: "%H:%M",
    "h": lambda t: "%b", "n": lambda t: "\n", "t": lambda t: "\t", "C": lambda t: f"{t.year // 100:02d}", "r": lambda t: "%I:%M:%S %p", "c": lambda t: f"%a %b {t.day:2d} %H:%M:%S %Y",
    "x": lambda t: "%m/%d/%y", "X": lambda t: "%H:%M:%S", "u": lambda t: str(t.isoweekday()),
}


def strptime(v: object, fmt: object) -> list:
    if not isinstance(v, str):
        fail(f"strptime/1 requires string inputs and arguments")
    if not isinstance(fmt, str):
        fail("strptime/1 requires string inputs and arguments")
    return list(_read(v, fmt))


#: Numbers of fixed width, told apart by what stands between them: such texts need no general parser.
_WIDTHS = {"Y": "([0-9]{4})", "m": "([0-9]{2})", "d": "([0-9]{2})", "H": "([0-9]{2})", "M": "([0-9]{2})", "S": "([0-9]{2})"}
_UNITS = ["Y", "m", "d", "H", "M", "S"]


@lru_cache(256)
def _fixed(fmt: str) -> tuple[Callable, list[int]] | None:
    """What matches the format's plain texts, and where year to second are in it; None: the general parser only."""
    pieces = re.split(r"%(.)", fmt.replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d").replace("%R", "%H:%M"), flags=re.S)
    between, units = pieces[::2], pieces[1::2]
    if units[-1:] == ["Z"] and between[-1] == "":
        units, between = units[:-1], [*between[:-2], between[-2] + "Z"]
    if sorted(units) != sorted(_UNITS[: len(units)]) or len(units) < 3 or not all(re.fullmatch(r"[-/:.,_TZ]+", x) for x in between[1:-1]) or not re.fullmatch(r"[TZ]?", between[-1]) or between[0]:
        return None
    shape = "".join(_WIDTHS[u] + re.escape(x) for u, x in zip(units, between[1:]))
    return re.compile(shape + r"\Z").match, [units.index(u) for u in _UNITS[: len(units)]]


@lru_cache(KNOWN)
def _read(v: str, fmt: str) -> tuple:
    known = _fixed(fmt)
    if known and (m := known[0](v)):
        try:
            t = datetime(*[int(m[i + 1]) for i in known[1]])
            return t.year, t.month - 1, t.day, t.hour, t.minute, t.second, (t.weekday() + 1) % 7, t.timetuple().tm_yday - 1
        except ValueError:
            pass  # the general parser says what is wrong
    own = re.sub(r"%(.)", lambda m: {"T": "%H:%M:%S", "D": "%m/%d/%y", "F": "%Y-%m-%d", "R": "%H:%M", "e": "%d", "h": "%b", "Z": "%Z"}.get(m[1], m[0]), fmt)
    source = v
    if "%Z" in own:  # a literal Z stands for UTC
        own = own.replace("%Z", "")
        source = re.sub(r"(?:Z|UTC|GMT|[A-Z]{3,4})\s*$", "", v)
    try:
        t = datetime.strptime(source.strip() if own != fmt else source, own.strip() if own != fmt else own)
    except ValueError:
        fail(f'date "{v}" does not match format "{fmt}"')
    return (t.year, t.month - 1, t.day, t.hour, t.minute, t.second + t.microsecond / 1e6 if t.microsecond else t.second, (t.weekday() + 1) % 7, t.timetuple().tm_yday - 1)


ISO = "%Y-%m-%dT%H:%M:%SZ"


def todate(v: object) -> str:
    if not is_number(v) and not isinstance(v, list):
        fail("strftime/1 requires parsed datetime inputs")
    return strftime(v, ISO)


def fromdate(v: object) -> int:
    if not isinstance(v, str):
        fail("strptime/1 requires string inputs and arguments")
    return mktime(strptime(v, ISO))


# -- the tables ----------------------------------------------------------------------------------


def _stderr(v: object, mark: bool) -> object:
    print(text(["DEBUG:", v]) if mark else text(v), file=sys.stderr, end="\n" if mark else "")
    return v


def _sum(v: object) -> object:
    out: object = None
    for x in iterated(v):
        out = add(out, x)
    return out


#: name -> function of the input alone
UNARY: dict[str, Callable] = {
    "length": length, "utf8bytelength": lambda v: len(string(v, "only strings have UTF-8 byte length").encode("utf-8", "surrogatepass")), "not": lambda v: not truthy(v),
    "keys": keys, "keys_unsorted": lambda v: list(v) if isinstance(v, dict) else keys(v), "type": kind, "add": _sum,
    "any": lambda v: any(map(truthy, iterated(v))), "all": lambda v: all(map(truthy, iterated(v))),
    "min": lambda v: extreme(array(v, "iterated over"), v, 1), "max": lambda v: extreme(array(v, "iterated over"), v, -1), "sort": sort, "unique": unique,
    "flatten": flatten, "reverse": lambda v: [] if v is None else v[::-1] if isinstance(v, (str, list)) else fail(f"Cannot reverse {described(v)}"),
    "to_entries": to_entries, "from_entries": from_entries, "transpose": transpose,
    "tostring": tostring, "tonumber": tonumber, "toboolean": toboolean, "tojson": tojson, "fromjson": fromjson,
    "ascii_downcase": lambda v: ascii_case(v, _LOWER, "ascii_downcase"), "ascii_upcase": lambda v: ascii_case(v, _UPPER, "ascii_upcase"), "ascii": ascii_,
    "explode": lambda v: [ord(c) for c in string(v, "cannot be exploded")], "implode": implode,
    "trim": lambda v: trimmed(v, True, True), "ltrim": lambda v: trimmed(v, True, False), "rtrim": lambda v: trimmed(v, False, True),
    "first": lambda v: field(v, 0), "last": lambda v: field(v, -1),
    "nan": lambda v: math.nan, "infinite": lambda v: math.inf, "isnan": lambda v: num(v) != num(v), "isinfinite": lambda v: math.isinf(num(v)),
    "isnormal": lambda v: math.isfinite(num(v)) and abs(num(v)) >= sys.float_info.min, "have_decnum": lambda v: False, "have_literal_numbers": lambda v: False,
    "gmtime": gmtime, "mktime": mktime, "todate": todate, "todateiso8601": todate, "fromdate": fromdate, "fromdateiso8601": fromdate, "now": lambda v: time.time(),
    "debug": lambda v: _stderr(v, True), "stderr": lambda v: _stderr(v, False),
    **MATH1,
}
#: name -> function of the input and one argument
WITH_ONE: dict[str, Callable] = {
    "has": has, "in": lambda v, o: has(o, v), "contains": contains, "inside": lambda v, o: contains(o, v), "flatten": flatten,
    "split": split1, "join": join, "startswith": lambda v, s: affix(v, s, "startswith"), "endswith": lambda v, s: affix(v, s, "endswith"),
    "ltrimstr": lambda v, s: trimstr(v, s, True, False, "ltrimstr"), "rtrimstr": lambda v, s: trimstr(v, s, False, True, "rtrimstr"), "trimstr": lambda v, s: trimstr(v, s, True, True, "trimstr"),
    "indices": indices, "index": lambda v, x: (indices(v, x) or [None])[0], "rindex": lambda v, x: (indices(v, x) or [None])[-1], "bsearch": bsearch,
    "getpath": getpath, "delpaths": delpaths, "strftime": strftime, "strflocaltime": lambda v, f: strftime(v, f, "strflocaltime"), "strptime": strptime,
    "debug": lambda v, m: (_stderr(m, True), v)[1],
}
SELECTORS: dict[str, Callable[[object], bool]] = {
    "arrays": lambda v: isinstance(v, list), "objects": lambda v: isinstance(v, dict), "iterables": lambda v: isinstance(v, (list, dict)), "booleans": lambda v: isinstance(v, bool),
    "numbers": is_number, "normals": lambda v: is_number(v) and math.isfinite(plain(v)) and abs(plain(v)) >= sys.float_info.min, "strings": lambda v: isinstance(v, str),
    "nulls": lambda v: v is None, "values": lambda v: v is not None, "scalars": lambda v: not isinstance(v, (list, dict)),
}
