"""JSON values: types, total order, number text, tolerant parsing, compact and pretty text.

A value is None, bool, int (64 bits), float, Big (a literal beyond the range of doubles), str, list or
dict (keys keep their order). These functions define what both lanes must agree on.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from functools import cmp_to_key, lru_cache, total_ordering

MAX_DOUBLE = 1.7976931348623157e308
EXACT = 1 << 53
DEEPEST_INPUT = 512
DEEPEST_TEXT = 10_000


class JsonError(Exception):
    """A value raised by a filter; any JSON value can be one."""

    def __init__(self, value: object):
        super().__init__(value)
        self.value = value

    @property
    def message(self) -> str:
        return self.value if isinstance(self.value, str) else text(self.value) + " (not a string)"


@total_ordering
class Big:
    """A number that no double holds, kept as text and compared exactly."""

    __slots__ = ("value",)

    def __init__(self, value: str | Decimal):
        self.value = Decimal(value)

    def __float__(self) -> float:
        return math.copysign(math.inf, self.value)

    def __neg__(self) -> "Big":
        return Big(-self.value)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Big) and self.value == other.value

    def __lt__(self, other: "Big") -> bool:
        return self.value < other.value

    def __hash__(self) -> int:
        return hash(self.value)

    def __str__(self) -> str:
        sign, digits, power = self.value.as_tuple()
        digits = "".join(map(str, digits)).rstrip("0") or "0"
        power += len(self.value.as_tuple().digits) - len(digits)
        power += len(digits) - 1
        mantissa = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        return f"{'-' if sign else ''}{mantissa}E{'+' if power >= 0 else ''}{power}"


def kind(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float, Big)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def is_number(v: object) -> bool:
    return isinstance(v, (int, float, Big)) and not isinstance(v, bool)


def truthy(v: object) -> bool:
    return v is not None and v is not False


def integer(v: int) -> int | float:
    """Results stay 64-bit integers; beyond that they become doubles."""
    return v if -(1 << 63) <= v < 1 << 63 else float(v)


def _rank(v: object) -> int:
    if v is None:
        return 0
    if v is False:
        return 1
    if v is True:
        return 2
    return 3 if isinstance(v, (int, float, Big)) else 4 if isinstance(v, str) else 5 if isinstance(v, list) else 6


def compare(a: object, b: object) -> int:
    """null < false < true < numbers < strings < arrays < objects; nan is below every number."""
    if type(a) is str and type(b) is str:
        return (a > b) - (a < b)
    ra, rb = _rank(a), _rank(b)
    if ra != rb:
        return -1 if ra < rb else 1
    if ra < 3:
        return 0
    if ra == 3:
        if isinstance(a, float) and a != a:
            return -1
        if isinstance(b, float) and b != b:
            return 1
        if isinstance(a, Big) or isinstance(b, Big):
            a, b = (x.value if isinstance(x, Big) else Decimal(x) for x in (a, b))
        elif type(a) is int and type(b) is int and (abs(a) > EXACT or abs(b) > EXACT):
            a, b = float(a), float(b)  # numbers are doubles to each other, however they are kept
        return (a > b) - (a < b)
    if ra == 4:
        return (a > b) - (a < b)
    if ra == 5:
        for x, y in zip(a, b):
            if c := compare(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    ka, kb = sorted(a), sorted(b)
    if ka != kb:
        return -1 if ka < kb else 1
    for k in ka:
        if c := compare(a[k], b[k]):
            return c
    return 0


order_key = cmp_to_key(compare)


def equal(a: object, b: object) -> bool:
    if isinstance(a, float) and a != a:
        return False
    return compare(a, b) == 0


# -- text ----------------------------------------------------------------------------------------


def float_text(v: float) -> str:
    """Shortest digits of 17; scientific outside 1e-5 < v < 1e17; nan is null, infinities are the largest double."""
    if v != v:
        return "null"
    v = max(-MAX_DOUBLE, min(MAX_DOUBLE, v))
    if v == 0:
        return "-0" if math.copysign(1, v) < 0 else "0"
    shown = repr(abs(v))
    mantissa, _, power = shown.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    digits = whole + part
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    n = len(digits)
    sign = "-" if v < 0 else ""
    if point <= -4 or point > n + 15:
        e = point - 1
        return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'-' if e < 0 else '+'}{abs(e):02d}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if point >= n:
        return sign + digits + "0" * (point - n)
    return f"{sign}{digits[:point]}.{digits[point:]}"


_SPECIAL = re.compile(r'[\x00-\x1f"\\\x7f]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(s: str) -> str:
    if _SPECIAL.search(s) is None:
        return f'"{s}"'
    return '"' + _SPECIAL.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


def text(v: object, sort_keys: bool = False, depth: int = 0) -> str:
    """Compact JSON."""
    if type(v) is str:
        return quoted(v)
    if type(v) is int:
        return str(v)
    if v is None:
        return "null"
    if v is True:
        return "true"
    if v is False:
        return "false"
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return float_text(v)
    if isinstance(v, Big):
        return str(v)
    if isinstance(v, list) and len(v) == 1 or depth > 900:
        return _deep_text(v, sort_keys)
    if isinstance(v, list):
        return "[" + ",".join([text(x, sort_keys, depth + 1) for x in v]) + "]"
    items = sorted(v.items()) if sort_keys else v.items()
    return "{" + ",".join([_name(k) + (quoted(x) if type(x) is str else str(x) if type(x) is int else text(x, sort_keys, depth + 1)) for k, x in items]) + "}"


@lru_cache(1024)
def _name(k: str) -> str:
    return quoted(k) + ":"


def _deep_text(v: object, sort_keys: bool) -> str:
    """The same without recursion, for deep values; below DEEPEST_TEXT levels a mark stands for the rest."""
    out: list[str] = []
    work: list = [(v, 0)]
    while work:
        x, depth = work.pop()
        if depth < 0:
            out.append(x)
        elif isinstance(x, (list, dict)) and depth > DEEPEST_TEXT:
            out.append('"<skipped: too deep>"')
        elif isinstance(x, list):
            out.append("[")
            work.append(("]", -1))
            for i in range(len(x) - 1, -1, -1):
                work.append((x[i], depth + 1))
                if i:
                    work.append((",", -1))
        elif isinstance(x, dict):
            out.append("{")
            work.append(("}", -1))
            items = sorted(x.items()) if sort_keys else list(x.items())
            for i in range(len(items) - 1, -1, -1):
                work.append((items[i][1], depth + 1))
                work.append((("," if i else "") + quoted(items[i][0]) + ":", -1))
        else:
            out.append(text(x))
    return "".join(out)


_COLOURS = {"null": "0;90", "false": "0;39", "true": "0;39", "number": "0;39", "string": "0;32", "array": "1;39", "object": "1;39", "key": "34;1"}


def pretty(v: object, indent: int | str = 2, sort_keys: bool = False, colour: bool = False, level: int = 0) -> str:
    """Indented JSON; indent 0 is compact; a string indents by itself (a tab)."""
    step = indent if isinstance(indent, str) else " " * indent

    def paint(s: str, k: str) -> str:
        return f"\x1b[{_COLOURS[k]}m{s}\x1b[0m" if colour else s

    if isinstance(v, (list, dict)) and v:
        line = "\n" + step * (level + 1) if step else ""
        last = "\n" + step * level if step else ""
        k = kind(v)
        if isinstance(v, list):
            parts = [line + pretty(x, indent, sort_keys, colour, level + 1) for x in v]
            return paint("[", k) + ",".join(parts) + last + paint("]", k)
        items = sorted(v.items()) if sort_keys else v.items()
        gap = ": " if step else ":"
        parts = [f"{line}{paint(quoted(key), 'key')}{gap}{pretty(x, indent, sort_keys, colour, level + 1)}" for key, x in items]
        return paint("{", k) + ",".join(parts) + last + paint("}", k)
    k = kind(v)
    return paint(text(v), k if k != "boolean" else text(v))


def shown(v: object, most: int = 14) -> str:
    """A value in an error message; texts of more bytes than fit are cut, containers later than scalars."""
    s = text(v)
    raw = s.encode()
    most = 30 if isinstance(v, (list, dict)) else most
    return s if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "..."


# -- parsing -------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\s,\[\]{}:\"]+")
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
_LOOSE_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
_BLANK = re.compile(r"[ \t\r\n]*")
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
_NAMES = {"null": None, "true": True, "false": False, "nan": math.nan, "NaN": math.nan, "-nan": math.nan, "-NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf, "infinity": math.inf, "-infinity": -math.inf}


class JsonTextError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.message, self.at = message, at


def input_number(s: str) -> int | float:
    """Input integers beyond 2**53 are doubles, as are out-of-range numbers."""
    if re.fullmatch(r"-?\d+", s) and len(s) < 400:
        n = int(s)
        if abs(n) <= EXACT:
            return -0.0 if s.startswith("-") and n == 0 else n
    return max(-MAX_DOUBLE, min(MAX_DOUBLE, float(s)))


def _text_string(s: str, at: int) -> tuple[str, int]:
    """The string from after its opening quote."""
    parts: list[str] = []
    while True:
        m = _PLAIN.match(s, at)
        parts.append(m[0])
        at = m.end()
        if at >= len(s):
            raise JsonTextError("Unfinished string", at)
        c = s[at]
        if c == '"':
            return "".join(parts), at + 1
        if c != "\\":
            parts.append(c)  # control characters are let through
            at += 1
            continue
        e = s[at + 1 : at + 2]
        if e == "u":
            code = s[at + 2 : at + 6]
            if not re.fullmatch(r"[0-9a-fA-F]{4}", code):
                raise JsonTextError("Invalid escape", at)
            n, at = int(code, 16), at + 6
            if 0xD800 <= n < 0xDC00 and re.match(r"\\u[dD][c-fC-F][0-9a-fA-F]{2}", s[at : at + 6]):
                n, at = 0x10000 + (n - 0xD800 << 10) + int(s[at + 2 : at + 6], 16) - 0xDC00, at + 6
            parts.append("�" if 0xD800 <= n < 0xE000 else chr(n))
        else:
            short = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(e)
            if short is None:
                raise JsonTextError("Invalid escape", at)
            parts.append(short)
            at += 2


def value_at(s: str, at: int, repair: bool = False, deepest: int = DEEPEST_INPUT) -> tuple[object, int]:
    """The JSON value that starts at or after ``at``, and where it ends. repair closes containers at the end of the text."""
    stack: list = []  # [container, key]
    while True:
        at = _BLANK.match(s, at).end()
        if at >= len(s):
            if stack and repair and not (isinstance(stack[-1][0], dict) and stack[-1][1] is not None):
                value = _closed(stack)
                return value, at
            raise JsonTextError("Unfinished JSON term", at)
        c = s[at]
        done = True
        value: object = None
        if c == "{" or c == "[":
            if len(stack) >= deepest:
                raise JsonTextError("Exceeds depth limit for parsing", at)
            stack.append([{} if c == "{" else [], None])
            at = _BLANK.match(s, at + 1).end()
            if s[at : at + 1] == ("}" if c == "{" else "]"):
                value, at = stack.pop()[0], at + 1
            else:
                done = False
        elif c == '"':
            value, at = _text_string(s, at + 1)
        elif m := _WORD.match(s, at):
            word = m[0]
            if word in _NAMES:
                value = _NAMES[word]
            elif re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", word):
                value = input_number(word)
            else:
                raise JsonTextError("Invalid numeric literal" + (" at EOF" if m.end() == len(s) else ""), m.end())
            at = m.end()
        else:
            raise JsonTextError(f"Unexpected {c}", at)
        while True:
            if done:
                if not stack:
                    return value, at
                top = stack[-1]
                if isinstance(top[0], list):
                    top[0].append(value)
                else:
                    top[0][top[1]] = value
                    top[1] = None
                at = _BLANK.match(s, at).end()
                c = s[at : at + 1]
                if c == ",":
                    at = _BLANK.match(s, at + 1).end()
                    if at >= len(s):
                        raise JsonTextError("Unfinished JSON term", at)
                elif c == ("]" if isinstance(top[0], list) else "}"):
                    value, at = stack.pop()[0], at + 1
                    continue
                elif not c and repair:
                    return _closed(stack), at
                else:
                    raise JsonTextError("Unfinished JSON term" if not c else f"Unexpected {c}", at)
            if stack and isinstance(stack[-1][0], dict):
                at = _BLANK.match(s, at).end()
                if at >= len(s) and repair and not done:
                    return _closed(stack), at
                if s[at : at + 1] == "'":
                    raise JsonTextError("Invalid string literal; expected \", but got '", at + 4)
                if s[at : at + 1] != '"':
                    raise JsonTextError("Object keys must be strings", at)
                stack[-1][1], at = _text_string(s, at + 1)
                at = _BLANK.match(s, at).end()
                if s[at : at + 1] != ":":
                    raise JsonTextError("Objects must consist of key:value pairs", at)
                at += 1
            break


def _closed(stack: list) -> object:
    value = stack.pop()[0]
    while stack:
        top = stack.pop()
        if isinstance(top[0], list):
            top[0].append(value)
        elif top[1] is not None:
            top[0][top[1]] = value
        value = top[0]
    return value


def values_of(s: str, repair: bool = False, deepest: int = DEEPEST_INPUT):
    """All values of a text: lines, concatenated or pretty-printed. Raises at the first wrong one."""
    at = 1 if s.startswith("﻿") else 0
    while True:
        at = _BLANK.match(s, at).end()
        if at >= len(s):
            return
        value, at = value_at(s, at, repair, deepest)
        yield value


def _shrunk(v: str) -> int | float:
    if len(v) < 16 and v != "-0":  # below 2**53 whatever the digits
        return int(v)
    return input_number(v)


_FAST = json.JSONDecoder(parse_int=_shrunk, parse_float=lambda x: max(-MAX_DOUBLE, min(MAX_DOUBLE, float(x))), parse_constant=lambda x: _NAMES[x])


def parse(s: str, repair: bool = False) -> object:
    """One value, nothing after it. The C decoder does well-formed texts; the tolerant parser the rest."""
    if "\\ud" not in s and "\\uD" not in s and s.count("[") + s.count("{") <= DEEPEST_INPUT:
        try:
            return _FAST.decode(s)
        except (ValueError, RecursionError):
            pass
    found = list(values_of(s, repair))
    if len(found) != 1:
        raise JsonTextError("Unexpected extra JSON values" if found else "Expected JSON value", len(s))
    return found[0]
