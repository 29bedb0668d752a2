"""Regular-expression functions: matches with code-point offsets, and what is built on them."""

from __future__ import annotations

from functools import lru_cache

import regex

from pathloom.functions.scalars import described, fail

_LETTERS = {"i": regex.I, "x": regex.X, "m": regex.M, "s": regex.S, "g": 0, "n": 0}
_BEYOND = regex.compile(r"(?<!\\)(?:\\\\)*(?:\\[1-9]|\\k<|\(\?(?:=|!|<=|<!|>|R|&|\d|P=|P>))")


class PatternError(ValueError):
    pass


@lru_cache(maxsize=256)
def compiled(pattern: str, letters: str) -> tuple[regex.Pattern, bool, bool]:
    """(pattern, all matches, skip empty ones). Patterns that need backtracking are refused."""
    flags = 0
    for c in letters:
        if c not in _LETTERS:
            raise PatternError(f"{letters} is not a valid modifier string")
        flags |= _LETTERS[c]
    if _BEYOND.search(pattern):
        raise PatternError(f"{pattern} (at offset 0) is not a valid regex: backreferences and lookaround aren't supported")
    try:
        return regex.compile(pattern, flags | regex.V0), "g" in letters, "n" in letters
    except regex.error as e:
        raise PatternError(f"{pattern} (at offset {e.pos or 0}) is not a valid regex: {e.msg}") from None


def matches(v: object, pattern: object, letters: object, every: bool = False):
    """Match objects of the text, first or all."""
    if not isinstance(v, str):
        fail(f"{described(v)} cannot be matched, as it is not a string")
    if not isinstance(pattern, str):
        fail(f"{described(pattern)} cannot be matched, as it is not a string")
    if letters is not None and not isinstance(letters, str):
        fail(f"{described(letters)} is not a string")
    try:
        found, all_, full = compiled(pattern, letters or "")
    except PatternError as e:
        fail(str(e))
    for m in found.finditer(v):
        if full and not m.group():
            continue
        yield m
        if not (all_ or every):
            return


def names(m: regex.Match) -> list[str | None]:
    by = {i: n for n, i in m.re.groupindex.items()}
    return [by.get(i) for i in range(1, m.re.groups + 1)]


def described_match(m: regex.Match) -> dict:
    captures = []
    for i, name in enumerate(names(m), 1):
        s = m.group(i)
        captures.append({"offset": m.start(i), "length": len(s or ""), "string": s, "name": name})
    return {"offset": m.start(), "length": len(m.group()), "string": m.group(), "captures": captures}


def captured(m: regex.Match) -> dict:
    return {n: m.group(i) for i, n in enumerate(names(m), 1) if n is not None}


def scanned(m: regex.Match) -> object:
    return list(m.groups()) if m.re.groups else m.group()
