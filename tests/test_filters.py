"""Filters with their inputs and outputs, and agreement of the two lanes."""

from __future__ import annotations

import json

import pytest

from pathloom.api import Filter, JsonError, validate
from pathloom.functions import scalars

CASES = [
    (".", "[1,2.5,null]", ["[1,2.5,null]"]),
    (".a.b", '{"a":{"b":7}}', ["7"]),
    (".a?", "[1]", []),
    (".[1:3]", "[0,1,2,3]", ["[1,2]"]),
    (".[-2:]", '"abcd"', ['"cd"']),
    (".[]?", "3", []),
    ("..", "[[1]]", ["[[1]]", "[1]", "1"]),
    (".a, .b", '{"a":1,"b":2}', ["1", "2"]),
    ("{a, b: (.b, 9)}", '{"a":1,"b":2}', ['{"a":1,"b":2}', '{"a":1,"b":9}']),
    ("[.[] | . * 2]", "[1,2]", ["[2,4]"]),
    (". + {b: 1}", '{"a":0}', ['{"a":0,"b":1}']),
    (". * {a: {c: 2}}", '{"a":{"b":1}}', ['{"a":{"b":1,"c":2}}']),
    ("[1,2,3,1] - [1]", "null", ["[2,3]"]),
    ('"a,b" / ","', "null", ['["a","b"]']),
    ("5 % 3, -5 % 3", "null", ["2", "-2"]),
    (".a // 4", '{"a":false}', ["4"]),
    ("if . then 1 elif false then 2 else 3 end", "null", ["3"]),
    ("try error(\"x\") catch .", "null", ['"x"']),
    ("[.[] | try tonumber catch 0]", '["1","z"]', ["[1,0]"]),
    ("reduce .[] as $x (0; . + $x)", "[1,2,3]", ["6"]),
    ("[foreach .[] as $x (0; . + $x; [$x, .])]", "[1,2]", ["[[1,1],[2,3]]"]),
    ("[limit(2; .[])], first(.[]), [range(0; 6; 2)]", "[5,6,7]", ["[5,6]", "5", "[0,2,4]"]),
    ("[label $f | .[] | if . > 1 then break $f else . end]", "[0,1,2,0]", ["[0,1]"]),
    (". as [$a, {b: $c}] | $a + $c", '[1,{"b":2}]', ["3"]),
    ("def f(g): [g, g]; f(.a)", '{"a":1}', ["[1,1]"]),
    ("def fib: if . < 2 then . else (. - 1 | fib) + (. - 2 | fib) end; fib", "10", ["55"]),
    ("sort, sort_by(-.), unique, reverse", "[2,1,2]", ["[1,2,2]", "[2,2,1]", "[1,2]", "[2,1,2]"]),
    ("sort", '[{"a":1},[0],"s",2,true,false,null]', ['[null,false,true,2,"s",[0],{"a":1}]']),
    ("group_by(.k) | map(length)", '[{"k":1},{"k":2},{"k":1}]', ["[2,1]"]),
    ("min_by(.a), max_by(.a)", '[{"a":2},{"a":1}]', ['{"a":1}', '{"a":2}']),
    ("add, length, any, all", "[1,2]", ["3", "2", "true", "true"]),
    ("flatten, flatten(1)", "[1,[2,[3]]]", ["[1,2,3]", "[1,2,[3]]"]),
    ("to_entries, (with_entries(.value += 1))", '{"a":1}', ['[{"key":"a","value":1}]', '{"a":2}']),
    ("keys, has(\"a\"), del(.a)", '{"b":1,"a":2}', ['["a","b"]', "true", '{"b":1}']),
    ("[paths]", '{"a":[1]}', ['[["a"],["a",0]]']),
    ('setpath(["a",1]; 5)', "null", ['{"a":[null,5]}']),
    (".a |= . + 1 | .b += 2", '{"a":1,"b":1}', ['{"a":2,"b":3}']),
    ("(.[] | select(. >= 2)) |= empty", "[1,5,3,0,7]", ["[1,0]"]),
    ('(.a | select(. == 1)) = "x"', '{"a":1}', ['{"a":"x"}']),
    ("walk(if type == \"number\" then . + 1 else . end)", "[1,[2]]", ["[2,[3]]"]),
    ('split(", "), join("-")?', '"a, b"', ['["a","b"]']),
    ("ascii_downcase, ascii_upcase, explode", '"aB"', ['"ab"', '"AB"', "[97,66]"]),
    ("ltrimstr(\"a\"), rtrimstr(\"c\"), startswith(\"ab\")", '"abc"', ['"bc"', '"ab"', "true"]),
    ("indices(\", \"), index(\"b\"), rindex(\"b\")", '"a, b, b"', ["[1,4]", "3", "6"]),
    ("contains([\"b\"]), inside([\"abc\", 1])", '["abc"]', ["true", "true"]),
    ('test("B"; "i"), [scan("[a-z]")], sub("a"; "x"), gsub("(?<c>[ab])"; "<" + .c + ">")', '"ab"', ["true", '["a","b"]', '"xb"', '"<a><b>"']),
    ('capture("(?<y>[0-9]+)-(?<m>[0-9]+)")', '"2024-05"', ['{"y":"2024","m":"05"}']),
    ("floor, ceil, sqrt, fabs", "2.25", ["2", "3", "1.5", "2.25"]),
    ("pow(.; 3), log2, exp2", "2", ["8", "1", "4"]),
    ("todate, (gmtime | mktime), strftime(\"%Y\")", "86400", ['"1970-01-02T00:00:00Z"', "86400", '"1970"']),
    ("fromdate", '"2015-03-05T23:51:47Z"', ["1425599507"]),
    ("@csv, @tsv, @json, @html, @sh", '["a,b",1]', ['"\\"a,b\\",1"', '"a,b\\t1"', '"[\\"a,b\\",1]"', '"[&quot;a,b&quot;,1]"', "\"'a,b' 1\""]),
    ("@base64, (@base64 | @base64d), @uri", '"a b"', ['"YSBi"', '"a b"', '"a%20b"']),
    ("tojson, (tojson | fromjson)", '{"a":[1]}', ['"{\\"a\\":[1]}"', '{"a":[1]}']),
    ('"x\\(.a)y"', '{"a":1}', ['"x1y"']),
    ("[.[] | type]", '[0,"",[],{},null,true]', ['["number","string","array","object","null","boolean"]']),
    ("[splits(\"a+\")]", '"xaay"', ['["x","y"]']),
    ("transpose, (.[0] | combinations?)?", "[[1,2],[3]]", ["[[1,3],[2,null]]"]),
    ("bsearch(2), bsearch(9)", "[1,2,3]", ["1", "-4"]),
    ("INDEX(.id)", '[{"id":1}]', ['{"1":{"id":1}}']),
    ("IN(1, 2)", "2", ["true"]),
    ("env | type", "null", ['"object"']),
]


@pytest.mark.parametrize(("source", "value", "want"), CASES)
def test_outputs(source, value, want):
    assert [json.loads(x) for x in Filter(source).eval(value)] == [json.loads(x) for x in want]


@pytest.mark.parametrize(("source", "value"), [(".a", "[1]"), (".[0]", '{"a":1}'), ("1 / 0", "null"), ("{} - 1", "null"), ('error("x")', "null"), ("tonumber", '"x"'), ("keys", "1"), ('implode', '"a"')])
def test_errors(source, value):
    with pytest.raises(JsonError):
        Filter(source).eval(value)


@pytest.mark.parametrize("source", ["(", ".a |", "if 1 then", "{a: }", "$missing", "nosuch(1)", "reduce . as $x", '"abc', "break $x"])
def test_compile_errors(source):
    assert validate(source)


LANES = [
    "{k: .n_nationkey, s: (.n_name | ascii_downcase), n: (.n_name | length)}",
    "select(.n_regionkey == 1) | {k: .n_nationkey}",
    'if .n_regionkey > 2 then {k: .n_nationkey, c: "hi"} else {k: .n_nationkey, c: "lo"} end',
    "{k: .n_nationkey, v: range(0; 2)}",
    "{k: .n_nationkey, m: (.n_nationkey % 3), h: (.n_nationkey * 2 - 1)}",
    '{k: .n_nationkey, w: (.n_name | split("A") | map(length) | add)}',
    '{k: .n_nationkey, t: (.n_name | test("^[A-M]")), g: (.n_name | gsub("[AEIOU]"; "_"))}',
]


@pytest.mark.parametrize("source", LANES)
def test_lanes_agree(spark, sf_dir, source):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    native = Filter(source).apply(nation, "native")
    slow = Filter(source).apply(nation, "evaluator")
    got = sorted(json.dumps(r.asDict(), sort_keys=True) for r in native.collect())
    want = sorted(json.dumps(json.loads(r["value"]), sort_keys=True) for r in slow.where("error is null").collect())
    assert got == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "a long, b string")
    assert Filter("select(.a > 1) | {b}").apply(none, "native").count() == 0
    assert Filter("select(.a > 1) | {b}").apply(none, "evaluator").count() == 0


def test_nulls_follow_the_order_of_types(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "id long, a long")
    assert [r.id for r in Filter("select(.a < 0) | {id}").apply(rows, "native").orderBy("id").collect()] == [1, 3]


def test_plain_dates_need_no_general_parser(monkeypatch):
    class Never(scalars.datetime):
        @classmethod
        def strptime(cls, *_):
            raise AssertionError("the general parser")

    monkeypatch.setattr(scalars, "datetime", Never)
    assert scalars.strptime("2019-07-31T23:59:08Z", "%Y-%m-%dT%H:%M:%SZ") == [2019, 6, 31, 23, 59, 8, 3, 211]
    assert scalars.strptime("31.07.2019", "%d.%m.%Y") == [2019, 6, 31, 0, 0, 0, 3, 211]
    with pytest.raises(AssertionError):
        scalars.strptime("2019-7-31T23:59:09Z", "%Y-%m-%dT%H:%M:%SZ")


def test_dates_that_are_remembered_stay_as_they_were():
    for made in (lambda: scalars.gmtime(86400), lambda: scalars.strptime("2019-07-31", "%Y-%m-%d")):
        made()[0] = 1
        assert made()[0] in (1970, 2019)
    assert scalars.mktime([2019, 6, 31, 23, 59, 8.9]) == scalars.mktime([2019, 6, 31, 23, 59, 8]) == 1564617548
    with pytest.raises(JsonError):
        scalars.mktime([True, 6, 31, 0, 0, 0])
    with pytest.raises(JsonError):
        scalars.strptime("2019-02-29T00:00:00Z", "%Y-%m-%dT%H:%M:%SZ")
