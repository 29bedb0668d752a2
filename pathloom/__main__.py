"""Command line: python -m pathloom [options] FILTER [FILE...]

Values from files or standard input run through the filter; with --spark, files are read and written by
Spark. Exit status: 2 usage or system, 3 filter, 4 no output with -e, 1 last output false or null
with -e, 5 a run-time error.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from pathlib import Path

from pathloom.api import Filter, FilterSyntaxError, Halt, JsonError, validate
from pathloom.functions.values import JsonTextError, parse, pretty, text, values_of
from pathloom.sources.describe import DEPTH, describe_values

VERSION = "0.1.0"
USAGE = """usage: python -m pathloom [options] FILTER [FILE...]
  -n, --null-input      run once on null        -R, --raw-input    lines as strings
  -s, --slurp           all values as an array  -r, --raw-output   strings without quotes
  -j, --join-output     -r without line ends    -c, --compact-output
  -S, --sort-keys       -C / -M colour on / off -e, --exit-status  status by the last output
  --tab, --indent N     (0 to 8)                -f, --from-file F  filter from a file
  --arg N V, --argjson N J, --slurpfile N F, --rawfile N F, --args ..., --jsonargs ...
  --describe, --depth N schema of the input     --validate, --json-errors
  --spark, -t, --threads N                      --unbuffered  -h, --help  -V, --version"""
SHORT = {"n": "null-input", "R": "raw-input", "s": "slurp", "r": "raw-output", "j": "join-output", "c": "compact-output", "S": "sort-keys", "C": "color-output", "M": "monochrome-output", "e": "exit-status", "h": "help", "V": "version"}
WITH_VALUE = {"tab": 0, "indent": 1, "from-file": 1, "arg": 2, "argjson": 2, "slurpfile": 2, "rawfile": 2, "depth": 1, "threads": 1}
FLAGS = {*SHORT.values(), "describe", "validate", "json-errors", "spark", "unbuffered", "args", "jsonargs"}


class Usage(Exception):
    pass


def options(argv: list[str]) -> tuple[dict, list[str]]:
    """(options, filter and files)."""
    out: dict = {"named": {}, "positional": []}
    rest: list[str] = []
    mode, i, only = "files", 0, False
    while i < len(argv):
        a = argv[i]
        i += 1
        if only or not a.startswith("-") or a == "-":
            if rest and mode != "files" or mode != "files" and ("from-file" in out):
                out["positional"].append(value_of(a) if mode == "jsonargs" else a)
            else:
                rest.append(a)
            continue
        if a == "--":
            only = True
            continue
        names = [a[2:]] if a.startswith("--") else ["from-file" if c == "f" else "threads" if c == "t" else SHORT.get(c, "") for c in a[1:]]
        for name in names:
            if name in ("args", "jsonargs"):
                mode = name
            elif name in WITH_VALUE:
                n = WITH_VALUE[name]
                own = argv[i : i + n]
                if len(own) < n:
                    raise Usage(f"--{name} takes {n} value(s)")
                i += n
                if name in ("arg", "argjson", "slurpfile", "rawfile"):
                    out["named"][own[0]] = bound(name, own[1])
                else:
                    out[name] = own[0] if n else True
            elif name in FLAGS:
                out[name] = True
            else:
                raise Usage(f"unknown option {a}")
    return out, rest


def value_of(s: str) -> object:
    try:
        return parse(s)
    except JsonTextError as e:
        raise Usage(f"invalid JSON text {s}: {e.message}") from None


def bound(name: str, s: str) -> object:
    if name == "arg":
        return s
    if name == "argjson":
        return value_of(s)
    try:
        whole = Path(s).read_text()
    except OSError as e:
        raise Usage(f"{s}: {e.strerror}") from None
    return whole if name == "rawfile" else list(values_of(whole))


def texts(files: list[str]) -> Iterator[str]:
    if not files:
        yield sys.stdin.read()
    for f in files:
        yield sys.stdin.read() if f == "-" else Path(f).read_text()


def inputs(o: dict, files: list[str], errors: list[str]) -> Iterator:
    """Values in order; a wrong record is noted and reading goes on at the next line."""
    from pathloom.sources.files import split_values

    if "raw-input" in o:
        whole = "".join(texts(files))
        if "slurp" in o:
            yield whole.removesuffix("\n")
        else:
            yield from whole.splitlines() if whole else ()
        return
    found = (x for t in texts(files) for x in split_values(t, True))
    if "slurp" in o:
        values = []
        for value, error in found:
            if error:
                errors.append(error)
            else:
                values.append(parse(value))
        yield values
        return
    for value, error in found:
        if error:
            errors.append(error)
            print(f"pathloom: {error}", file=sys.stderr)
        else:
            yield parse(value)


def main(argv: list[str]) -> int:
    try:
        o, rest = options(argv)
        if "help" in o:
            print(USAGE)
            return 0
        if "version" in o:
            print(f"pathloom {VERSION}")
            return 0
        if "from-file" in o:
            source = Path(o["from-file"]).read_text().rstrip("\r\n")
        elif "describe" in o:
            source = "."
        elif rest:
            source = rest.pop(0)
        else:
            raise Usage("a filter is needed")
        indent: object = "\t" if "tab" in o else int(o.get("indent", 2))
        if isinstance(indent, int) and not 0 <= indent <= 8:
            raise Usage("--indent takes 0 to 8")
    except (Usage, OSError, ValueError) as e:
        print(f"pathloom: {e}\n{USAGE}", file=sys.stderr)
        return 2
    if wrong := validate_named(source, o):
        print(json.dumps(wrong) if "json-errors" in o else f"pathloom: {wrong['kind']}: {wrong['message']} at line {wrong['line']}, column {wrong['column']}", file=sys.stderr)
        return 3
    if "validate" in o:
        return 0
    try:
        if "spark" in o:
            return with_spark(source, o, rest)
        return run(source, o, rest, indent)
    except OSError as e:
        print(f"pathloom: {e}", file=sys.stderr)
        return 2


def validate_named(source: str, o: dict) -> dict | None:
    try:
        Filter(source, o["named"], o["positional"])
    except FilterSyntaxError:
        return validate(source) or {"kind": "query_syntax_error", "message": "invalid filter", "offset": 0, "line": 1, "column": 1}
    return None


def run(source: str, o: dict, files: list[str], indent: object) -> int:
    errors: list[str] = []
    values = inputs(o, files, errors)
    if "describe" in o:
        print(json.dumps(describe_values(values, int(o.get("depth", DEPTH)), "sort-keys" in o), ensure_ascii=False, separators=(",", ":")))
        return 5 if errors else 0
    filter_ = Filter(source, o["named"], o["positional"])
    colour = "color-output" in o or sys.stdout.isatty() and "monochrome-output" not in o and not os.environ.get("NO_COLOR")
    raw, end = "raw-output" in o or "join-output" in o, "" if "join-output" in o else "\n"
    status, last = 0, 4
    for v in [None] if "null-input" in o else values:
        try:
            for x in filter_.run(v, values):
                last = 1 if x is None or x is False else 0
                shown = x if raw and isinstance(x, str) else text(x, "sort-keys" in o) if "compact-output" in o and not colour else pretty(x, 0 if "compact-output" in o else indent, "sort-keys" in o, colour)
                sys.stdout.write(shown + end)
                if "unbuffered" in o:
                    sys.stdout.flush()
        except JsonError as e:
            status = 5
            message = {"kind": "runtime", "message": e.message}
            print(json.dumps(message) if "json-errors" in o else f"pathloom: error: {e.message}", file=sys.stderr)
        except Halt as e:
            sys.stdout.flush()
            if not e.silent:
                sys.stderr.write(e.value if isinstance(e.value, str) else text(e.value) + "\n")
            return e.status
    if errors or status:
        return 5
    return last if "exit-status" in o else 0


def with_spark(source: str, o: dict, files: list[str]) -> int:
    """Line-delimited files through Spark, outputs printed in order."""
    from pyspark.sql import SparkSession

    from pathloom.plans.numbering import SEQ
    from pathloom.sources.files import null_input, read_lines, read_raw

    spark = SparkSession.builder.master(f"local[{o.get('threads', os.environ.get('PATHLOOM_THREADS', '*'))}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    source_df = null_input(spark) if "null-input" in o else read_raw(spark, files) if "raw-input" in o else read_lines(spark, files)
    filter_ = Filter(source, o["named"], o["positional"])
    out = filter_.slurp(source_df) if "slurp" in o else filter_.apply(source_df, "evaluator")
    status = 4  # no output yet
    for r in out.orderBy(SEQ, "_out").toLocalIterator():
        if r["error"] is not None:
            print(f"pathloom: error: {r['error']}", file=sys.stderr)
            status = 5
        else:
            v = parse(r["value"])
            print(v if "raw-output" in o and isinstance(v, str) else r["value"])
            status = status if status == 5 else 1 if r["value"] in ("null", "false") else 0
    return status if status == 5 or "exit-status" in o else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
