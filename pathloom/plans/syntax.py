"""Lexer and parser of the filter language. Nodes are tuples: (kind, position, ...)."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

KEYWORDS = {"def", "as", "if", "then", "elif", "else", "end", "try", "catch", "reduce", "foreach", "label", "import", "include", "and", "or", "__loc__", "module"}
_SPACE = re.compile(r"(?:[ \t\r\n]+|#(?:[^\n\\]|\\.|\\\r?\n)*)*")
_NUMBER = re.compile(r"(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)*")
_FIELD = re.compile(r"\.([A-Za-z_][A-Za-z0-9_]*)")
_OPERATORS = ("?//=", "//=", "?//", "|=", "+=", "-=", "*=", "/=", "%=", "==", "!=", "<=", ">=", "//", "..", "|", ",", "+", "-", "*", "/", "%", "=", "<", ">", "(", ")", "[", "]", "{", "}", ":", ";", ".", "?")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
FORMATS = ("text", "json", "csv", "tsv", "html", "uri", "urid", "sh", "base64", "base64d")


class FilterSyntaxError(ValueError):
    """A filter that doesn't compile: kind, message and where it stands in the text."""

    def __init__(self, message: str, offset: int = 0, kind: str = "query_syntax_error"):
        super().__init__(message)
        self.message, self.offset, self.kind = message, offset, kind


class Token(NamedTuple):
    kind: str  # op, name, keyword, number, string, field, var, format, end
    value: object
    at: int


def _string(src: str, at: int) -> tuple[list, int]:
    """Parts of a string literal from after its opening quote: texts and ('expr', tokens)."""
    parts: list = []
    text: list[str] = []
    start = at
    while True:
        if at >= len(src):
            raise FilterSyntaxError("unterminated string", start)
        c = src[at]
        if c == '"':
            parts.append("".join(text))
            return parts, at + 1
        if c != "\\":
            text.append(c)
            at += 1
            continue
        e = src[at + 1 : at + 2]
        if e == "(":
            parts.append("".join(text))
            text = []
            tokens, at = tokens_of(src, at + 2, nested=True)
            parts.append(tokens)
        elif e == "u":
            code = src[at + 2 : at + 6]
            if not re.fullmatch(r"[0-9a-fA-F]{4}", code):
                raise FilterSyntaxError("invalid \\u escape", at)
            n, at = int(code, 16), at + 6
            low = re.match(r"\\u([dD][c-fC-F][0-9a-fA-F]{2})", src[at:])
            if 0xD800 <= n < 0xDC00 and low:
                n, at = 0x10000 + (n - 0xD800 << 10) + int(low[1], 16) - 0xDC00, at + 6
            text.append("�" if 0xD800 <= n < 0xE000 else chr(n))
        elif e in _ESCAPES and e:
            text.append(_ESCAPES[e])
            at += 2
        else:
            raise FilterSyntaxError(f"invalid escape \\{e}", at)


def tokens_of(src: str, at: int = 0, nested: bool = False) -> tuple[list[Token], int]:
    out: list[Token] = []
    depth = 0
    while True:
        at = _SPACE.match(src, at).end()
        if at >= len(src):
            if nested:
                raise FilterSyntaxError("unterminated interpolation", at)
            out.append(Token("end", None, at))
            return out, at
        c = src[at]
        if c == '"':
            parts, end = _string(src, at + 1)
            out.append(Token("string", parts, at))
            at = end
            continue
        if (c.isdigit() or c == ".") and (m := _NUMBER.match(src, at)):
            out.append(Token("number", m[0], at))
            at = m.end()
            continue
        if c == "." and (m := _FIELD.match(src, at)):
            out.append(Token("field", m[1], at))
            at = m.end()
            continue
        if c == "$" and (m := _NAME.match(src, _SPACE.match(src, at + 1).end())):
            out.append(Token("var", m[0], at))
            at = m.end()
            continue
        if c == "@" and (m := _NAME.match(src, at + 1)):
            out.append(Token("format", m[0], at))
            at = m.end()
            continue
        if m := _NAME.match(src, at):
            out.append(Token("keyword" if m[0] in KEYWORDS else "name", m[0], at))
            at = m.end()
            continue
        op = next((o for o in _OPERATORS if src.startswith(o, at)), None)
        if op is None:
            raise FilterSyntaxError(f"unexpected character {c!r}", at)
        depth += (op == "(") - (op == ")")
        if nested and depth < 0:
            out.append(Token("end", None, at))
            return out, at + 1
        out.append(Token("op", op, at))
        at += len(op)


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.i, self.binds = tokens, 0, True

    @property
    def next(self) -> Token:
        return self.tokens[self.i]

    def take(self) -> Token:
        token = self.tokens[self.i]
        self.i += token.kind != "end"
        return token

    def has(self, *values: str, kind: str = "op") -> bool:
        return self.next.kind == kind and self.next.value in values

    def got(self, value: str, kind: str = "op") -> bool:
        if self.has(value, kind=kind):
            self.i += 1
            return True
        return False

    def need(self, value: str, kind: str = "op") -> Token:
        if not self.has(value, kind=kind):
            raise self.wrong(f"expected {value}")
        return self.take()

    def wrong(self, message: str = "syntax error") -> FilterSyntaxError:
        t = self.next
        shown = "end of filter" if t.kind == "end" else repr(t.value)
        return FilterSyntaxError(f"{message}, found {shown}", t.at)

    # -- programs --------------------------------------------------------------------------------

    def program(self) -> dict:
        """{'module': metadata node or None, 'imports': [...], 'defs': [...], 'body': node}."""
        out: dict = {"module": None, "imports": [], "defs": [], "body": None}
        if self.got("module", "keyword"):
            out["module"] = self.term()
            self.need(";")
        while self.has("import", "include", kind="keyword"):
            out["imports"].append(self.directive())
        while self.has("def", kind="keyword"):
            out["defs"].append(self.definition())
        if self.next.kind == "end":
            out["body"] = ("identity", self.next.at)
        else:
            out["body"] = self.pipe()
        if self.next.kind != "end":
            raise self.wrong()
        return out

    def directive(self) -> tuple:
        word = self.take()
        if self.next.kind != "string" or len(self.next.value) != 1:
            raise self.wrong("Import path must be constant")
        path, alias, meta = self.take().value[0], None, None
        if word.value == "import":
            self.need("as", "keyword")
            if self.next.kind not in ("var", "name"):
                raise self.wrong("expected a name")
            alias = ("$" if self.next.kind == "var" else "") + self.take().value
        if not self.has(";"):
            meta = self.term()
        self.need(";")
        return word.value, path, alias, meta, word.at

    def definition(self) -> tuple:
        at = self.need("def", "keyword").at
        if self.next.kind not in ("name", "keyword"):
            raise self.wrong("expected a function name")
        name, params = self.take().value, []
        if self.got("("):
            while True:
                if self.next.kind not in ("name", "var", "keyword"):
                    raise self.wrong("expected a parameter")
                t = self.take()
                params.append(("$" if t.kind == "var" else "") + t.value)
                if not self.got(";"):
                    break
            self.need(")")
        self.need(":")
        body = self.pipe()
        self.need(";")
        return "def", at, name, tuple(params), body

    # -- expressions, loosest first --------------------------------------------------------------

    def pipe(self, comma: bool = True) -> tuple:
        if self.has("def", kind="keyword"):
            d = self.definition()
            return "let", d[1], d, self.pipe(comma)
        if self.has("label", kind="keyword"):
            at = self.take().at
            name = self.variable()
            self.need("|")
            return "label", at, name, self.pipe(comma)
        left = self.comma() if comma else self.assignment()
        if self.has("|"):
            at = self.take().at
            return "pipe", at, left, self.pipe(comma)
        return left

    def comma(self) -> tuple:
        left = self.assignment()
        while self.has(","):
            at = self.take().at
            left = ("comma", at, left, self.assignment())
        return left

    def assignment(self) -> tuple:
        left = self.alternative()
        if self.has("=", "|=", "+=", "-=", "*=", "/=", "%=", "//="):
            op = self.take()
            right = self.alternative()
            if self.has("=", "|=", "+=", "-=", "*=", "/=", "%=", "//="):
                raise self.wrong()
            return "assign", op.at, op.value, left, right
        return left

    def alternative(self) -> tuple:
        left = self.bound()
        if self.has("//"):  # right-associative, like reading "or else"
            at = self.take().at
            return "alternative", at, left, self.alternative()
        return left

    def bound(self) -> tuple:
        left = self.disjunction()
        if self.binds and self.has("as", kind="keyword"):
            at = self.take().at
            patterns = self.patterns()
            self.need("|")
            return "bind", at, left, patterns, self.pipe()
        return left

    def disjunction(self) -> tuple:
        left = self.conjunction()
        while self.has("or", kind="keyword"):
            left = ("or", self.take().at, left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.comparison()
        while self.has("and", kind="keyword"):
            left = ("and", self.take().at, left, self.comparison())
        return left

    def comparison(self) -> tuple:
        left = self.additive()
        while self.has("==", "!=", "<", "<=", ">", ">="):
            op = self.take()
            left = ("binary", op.at, op.value, left, self.additive())
        return left

    def additive(self) -> tuple:
        left = self.multiplicative()
        while self.has("+", "-"):
            op = self.take()
            left = ("binary", op.at, op.value, left, self.multiplicative())
        return left

    def multiplicative(self) -> tuple:
        left = self.unary()
        while self.has("*", "/", "%"):
            op = self.take()
            left = ("binary", op.at, op.value, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.has("-"):
            return "negate", self.take().at, self.unary()
        return self.term()

    def patterns(self) -> tuple:
        out = [self.pattern()]
        while self.got("?//"):
            out.append(self.pattern())
        return tuple(out)

    def apart(self, parse_: Callable[[], tuple], binds: bool = True) -> tuple:
        """What stands in brackets (where ``as`` binds again) or, with binds false, before reduce's ``as``."""
        before, self.binds = self.binds, binds
        try:
            return parse_()
        finally:
            self.binds = before

    def term(self) -> tuple:
        return self.suffixes(self.primary())

    def suffixes(self, term: tuple) -> tuple:
        while True:
            t = self.next
            if t.kind == "field":
                self.take()
                term = ("field", t.at, term, t.value)
            elif self.has("?"):
                self.take()
                term = ("try", t.at, term, None)
            elif self.has(".") and self.tokens[self.i + 1].kind == "string":
                self.take()
                term = ("index", t.at, term, self.string(None))
            elif self.has(".") and self.tokens[self.i + 1][:2] == ("op", "["):
                self.take()
                term = self.apart(lambda own=term: self.bracket(own))
            elif self.has("["):
                term = self.apart(lambda own=term: self.bracket(own))
            else:
                return term

    def bracket(self, term: tuple) -> tuple:
        at = self.need("[").at
        if self.got("]"):
            return "iterate", at, term
        if self.got(":"):
            high = self.pipe()
            self.need("]")
            return "slice", at, term, None, high
        low = self.pipe()
        if self.got(":"):
            high = None if self.has("]") else self.pipe()
            self.need("]")
            return "slice", at, term, low, high
        self.need("]")
        return "index", at, term, low

    def variable(self) -> str:
        if self.next.kind != "var":
            raise self.wrong("expected a variable")
        return self.take().value

    def string(self, fmt: str | None) -> tuple:
        t = self.take()
        parts = tuple(p if isinstance(p, str) else _sub(p) for p in t.value)
        if len(parts) == 1:
            return "literal", t.at, parts[0]
        return "interpolate", t.at, fmt, parts

    def primary(self) -> tuple:
        t = self.next
        if t.kind == "number":
            self.take()
            return "literal", t.at, number(t.value)
        if t.kind == "string":
            return self.string(None)
        if t.kind == "format":
            self.take()
            if t.value not in FORMATS:
                raise FilterSyntaxError(f"{t.value} is not a valid format", t.at, "unknown_format")
            if self.next.kind == "string":
                return self.string(t.value)
            return "format", t.at, t.value
        if t.kind == "field":
            self.take()
            return "field", t.at, ("identity", t.at), t.value
        if t.kind == "var":
            self.take()
            return ("loc", t.at) if t.value == "__loc__" else ("var", t.at, t.value)
        if t.kind == "op":
            if t.value == ".":
                self.take()
                here = ("identity", t.at)
                if self.next.kind == "string":
                    return "index", t.at, here, self.string(None)
                return here
            if t.value == "..":
                self.take()
                return "call", t.at, "recurse", ()
            if t.value == "(":
                self.take()
                inner = self.apart(self.pipe)
                self.need(")")
                return inner
            if t.value == "[":
                self.take()
                if self.got("]"):
                    return "array", t.at, None
                inner = self.apart(self.pipe)
                self.need("]")
                return "array", t.at, inner
            if t.value == "{":
                return self.apart(self.object)
            if t.value == "-":
                return self.unary()
        if t.kind == "keyword":
            if t.value == "if":
                return self.apart(self.conditional)
            if t.value == "try":
                self.take()
                body = self.term()
                handler = self.term() if self.got("catch", "keyword") else ("call", t.at, "empty", ())
                return "try", t.at, body, handler
            if t.value in ("reduce", "foreach"):
                self.take()
                source = self.apart(self.alternative, False)
                self.need("as", "keyword")
                patterns = self.patterns()
                self.need("(")
                parts = [self.apart(self.pipe)]
                while self.got(";"):
                    parts.append(self.apart(self.pipe))
                self.need(")")
                if not (len(parts) == 2 or t.value == "foreach" and len(parts) == 3):
                    raise self.wrong()
                return t.value, t.at, source, patterns, tuple(parts)
            if t.value == "def":
                d = self.definition()
                return "let", d[1], d, self.pipe()
            if t.value == "label":
                return self.pipe()
        if t.kind == "name" or t.kind == "keyword" and t.value in ("__loc__",):
            self.take()
            if t.value == "break" and self.next.kind == "var":
                return "break", t.at, self.take().value
            if t.value in ("true", "false", "null") and not self.has("("):
                return "literal", t.at, {"true": True, "false": False, "null": None}[t.value]
            args: list = []
            if self.got("("):
                args.append(self.apart(self.pipe))
                while self.got(";"):
                    args.append(self.apart(self.pipe))
                self.need(")")
            return "call", t.at, t.value, tuple(args)
        raise self.wrong()

    def conditional(self) -> tuple:
        at = self.take().at
        test = self.pipe()
        self.need("then", "keyword")
        yes = self.pipe()
        if self.has("elif", kind="keyword"):
            return "if", at, test, yes, self.conditional()
        no = self.pipe() if self.got("else", "keyword") else ("identity", at)
        self.need("end", "keyword")
        return "if", at, test, yes, no

    def object(self) -> tuple:
        at = self.need("{").at
        entries: list = []
        while not self.has("}"):
            t = self.next
            key: tuple
            value: tuple | None = None
            if t.kind == "var":
                self.take()
                name = t.value.rpartition("::")[2]
                own = ("loc", t.at) if t.value == "__loc__" else ("var", t.at, t.value)
                if self.got(":"):
                    entries.append((own, self.entry_value()))
                else:
                    entries.append((("literal", t.at, name), own))
            else:
                if t.kind in ("name", "keyword"):
                    self.take()
                    key = ("literal", t.at, t.value)
                elif t.kind == "number":
                    raise FilterSyntaxError("Object keys must be strings", t.at)
                elif t.kind == "string":
                    key = self.string(None)
                elif t.kind == "format":
                    self.take()
                    if self.next.kind != "string":
                        raise self.wrong()
                    key = self.string(t.value)
                elif self.got("("):
                    key = self.pipe()
                    self.need(")")
                    if key[0] == "literal" and not isinstance(key[2], str) or key[0] in ("array", "object"):
                        raise FilterSyntaxError("Object keys must be strings", t.at)
                    if not self.has(":"):
                        raise self.wrong()
                else:
                    raise self.wrong()
                if self.got(":"):
                    value = self.entry_value()
                entries.append((key, value if value is not None else ("index", t.at, ("identity", t.at), key)))
            if not self.got(","):
                break
        self.need("}")
        return "object", at, tuple(entries)

    def entry_value(self) -> tuple:
        left = self.alternative()
        while self.has("|"):
            left = ("pipe", self.take().at, left, self.alternative())
        return left

    def pattern(self) -> tuple:
        t = self.next
        if t.kind == "var":
            self.take()
            return "var", t.value
        if self.got("["):
            parts = [self.pattern()]
            while self.got(","):
                parts.append(self.pattern())
            self.need("]")
            return "array", tuple(parts)
        self.need("{")
        entries: list = []
        while True:
            t = self.next
            also = None
            if t.kind == "var":
                self.take()
                key, also = ("literal", t.at, t.value), t.value
            elif t.kind in ("name", "keyword"):
                self.take()
                key = ("literal", t.at, t.value)
            elif t.kind == "string":
                key = self.string(None)
            elif self.got("("):
                key = self.apart(self.pipe)
                self.need(")")
                if key[0] == "literal" and not isinstance(key[2], str):
                    raise FilterSyntaxError("Object keys must be strings", t.at)
            else:
                raise self.wrong()
            inner = None
            if self.got(":"):
                inner = self.pattern()
            elif also is None:
                raise self.wrong("expected :")
            entries.append((key, also, inner))
            if not self.got(","):
                break
        self.need("}")
        return "object", tuple(entries)


def _sub(tokens: list[Token]) -> tuple:
    p = Parser(tokens)
    out = p.pipe()
    if p.next.kind != "end":
        raise p.wrong()
    return out


def number(text: str) -> object:
    """An exact 64-bit integer, a double, or, beyond its range, a Big."""
    from pathloom.functions.values import Big

    if re.fullmatch(r"\d+", text) and int(text) < 1 << 63:
        return int(text)
    value = float(text)
    return Big(text) if value in (float("inf"), float("-inf")) else value


def parse(src: str) -> dict:
    """The program of a filter text; raises FilterSyntaxError."""
    if len(src) > 1 << 20:
        raise FilterSyntaxError("filter is longer than 1 MiB")
    try:
        return Parser(tokens_of(src)[0]).program()
    except RecursionError:
        raise FilterSyntaxError("filter is nested too deeply") from None
