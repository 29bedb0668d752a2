"""Further registered queries: operators of the filter language that pathloom.queries doesn't run, each with its SQL.

Most run the evaluator on whole tables. Ordered results carry their place as a column, so that the comparison,
which sorts rows, proves the order too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.api import Filter
from pathloom.plans.numbering import dealt, scratch
from pathloom.queries import QUERIES, SQL, evaluated, read, rows, table
from pathloom.sources.describe import described
from pathloom.sources.files import null_input, read_lines, read_raw, read_raw_whole, read_values, write_text
from pathloom.streaming.apply import apply_filter, windowed_counts

__all__ = ["QUERIES", "SQL"]

CUSTOMER, ORDERS, PART, EVENTS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], ["event_id", "user_id", "event_type", "props"]

# -- paths and construction ------------------------------------------------------------------------
evaluated(
    "paths_read", "customer", CUSTOMER,
    '{r: {a: {k: .c_custkey}, b: [.c_nationkey, .c_name]}} | ("b" as $b | {k: .r.a.k, chained: .r.a["k"], computed: .r[$b][0], sliced: (.r.b[.r.a.k - .r.a.k:] | length), tail: (.r.b[-1:][0]), got: getpath(["r", "b", 1]), missing: (getpath(["x", "y"]) == null), names: (.r | keys | join(",")), unsorted: (.r.a | keys_unsorted | length), deep: ([..] | length), numbers: ([.. | numbers] | add), picked: (pick(.r.a.k) | tojson)})',
    "k long, chained long, computed long, sliced long, tail string, got string, missing boolean, names string, unsorted long, deep long, numbers long, picked string",
    "SELECT c_custkey AS k, c_custkey AS chained, CAST(c_nationkey AS BIGINT) AS computed, CAST(2 AS BIGINT) AS sliced, c_name AS tail, c_name AS got, true AS missing, 'a,b' AS names, CAST(1 AS BIGINT) AS unsorted, CAST(7 AS BIGINT) AS deep, c_custkey + c_nationkey AS numbers, '{\"r\":{\"a\":{\"k\":' || c_custkey || '}}}' AS picked FROM customer",
)
evaluated(
    "paths_write", "orders", ORDERS,
    '.o_orderkey as $k | {a: [$k, 2, 3], b: {c: .o_custkey}} | {k: $k, set: (setpath(["b", "d"]; 7) | .b.d + .b.c), grown: (setpath(["a", 4]; 1) | .a | length), gone: (delpaths([["a", 0], ["b"]]) | tojson), cut: (del(.a[1:]) | .a | length), path: ([path(.a[0], .b.c)] | tojson), leaves: ([leaf_paths] | length), all: ([paths] | length), mapped: (map_values(length) | .a), spread: ([.a, [.b.c]] | transpose | .[2] | tojson), slice: (.a[1:] = [9] | .a[1]), neg: (.a[-1] = 8 | .a[2])}',
    "k long, set long, grown long, gone string, cut long, path string, leaves long, all long, mapped long, spread string, slice long, neg long",
    "SELECT o_orderkey AS k, o_custkey + 7 AS \"set\", CAST(5 AS BIGINT) AS grown, '{\"a\":[2,3]}' AS gone, CAST(1 AS BIGINT) AS cut, '[[\"a\",0],[\"b\",\"c\"]]' AS path, CAST(4 AS BIGINT) AS leaves, CAST(6 AS BIGINT) AS \"all\", CAST(3 AS BIGINT) AS mapped, '[3,null]' AS spread, CAST(9 AS BIGINT) AS slice, CAST(8 AS BIGINT) AS neg FROM orders",
)
evaluated(
    "updates", "part", PART,
    '{k: .p_partkey, m: .p_size, d: .p_size, x: .p_size, p: .p_size, t: [.p_size, 1], o: null, s: .p_name} | .m -= 3 | .d /= 2 | .x *= 4 | .p %= 7 | .t[] += 1 | .o //= 5 | .s |= length | .u = (.m + 3) | .t |= add',
    "k long, m long, d double, x long, p long, t long, o long, s long, u long",
    "SELECT p_partkey AS k, CAST(p_size - 3 AS BIGINT) AS m, p_size / 2 AS d, CAST(p_size * 4 AS BIGINT) AS x, CAST(p_size % 7 AS BIGINT) AS p, CAST(p_size + 3 AS BIGINT) AS t, CAST(5 AS BIGINT) AS o, length(p_name) AS s, CAST(p_size AS BIGINT) AS u FROM part",
)
evaluated(
    "entry_forms", "customer", CUSTOMER,
    '{k: .c_custkey, from: ([{key: "a", value: .c_nationkey}, {name: "b", value: 2}, {k: "c", v: 3}] | from_entries | .a + .b + .c), to: (to_entries | map(.key) | join(",")), with: (with_entries(.value |= tostring) | .c_custkey), has: has("c_name"), hasnt: has("x"), at: ([1, 2] | has(1)), in: ("c_name" | in({c_name: 1})), inside: (["BUILDING", .c_mktsegment] as [$a, $b] | $b | inside($a)), contains: ({a: [.c_name, "z"]} | contains({a: ["Customer"]})), merged: ({a: {x: .c_custkey}} * {a: {y: 1}} | .a.x + .a.y), times: ("ab" * 2)}',
    "k long, from long, to string, with string, has boolean, hasnt boolean, at boolean, in boolean, inside boolean, contains boolean, merged long, times string",
    "SELECT c_custkey AS k, CAST(c_nationkey + 5 AS BIGINT) AS \"from\", 'c_custkey,c_name,c_nationkey,c_mktsegment' AS \"to\", CAST(c_custkey AS VARCHAR) AS \"with\", true AS has, false AS hasnt, true AS \"at\", true AS \"in\", contains('BUILDING', c_mktsegment) AS inside, true AS contains, c_custkey + 1 AS merged, 'abab' AS times FROM customer",
)
evaluated(
    "patterns", "orders", ORDERS,
    '. as {o_orderkey: $k, $o_custkey} | [$o_custkey, [$k, 5], {z: .o_orderstatus}] as [$c, [$kk, $five], {z: $s}] | "o_custkey" as $name | . as {$name: $_x, "o_orderstatus": $t, ("o_" + "custkey"): $cc} ?// $cc | {k: $kk, c: $c, s: $s, t: $t, five: $five, cc: $cc, alt: ([[$k, 1], {a: $k}][$k % 2] | . as [$v] ?// {a: $v} | $v)}'.replace("{$name: $_x, ", "{"),
    "k long, c long, s string, t string, five long, cc long, alt long",
    "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderstatus AS t, CAST(5 AS BIGINT) AS five, o_custkey AS cc, o_orderkey AS alt FROM orders",
)

# -- conditions, selectors, control ----------------------------------------------------------------
evaluated(
    "quantifiers", "part", PART,
    '[.p_size, .p_size * 2, 40] as $v | {k: .p_partkey, any0: ([.p_size > 25, false] | any), all0: ([.p_size > 25, true] | all), any2: any($v[]; . > 60), all2: all($v[]; . > 10), empty: isempty($v[] | select(. > 70)), in2: IN($v[]; 40, 41), in1: (.p_size | IN(range(5))), none: ([empty] | length), neither: ([.p_size] | any(. > 99)), not: (.p_size > 25 | not), opt: ([.p_name[0]?, (.p_size | tostring | tonumber?), ("x" | tonumber?)] | length)}',
    "k long, any0 boolean, all0 boolean, any2 boolean, all2 boolean, empty boolean, in2 boolean, in1 boolean, none long, neither boolean, not boolean, opt long",
    "SELECT p_partkey AS k, p_size > 25 AS any0, p_size > 25 AS all0, p_size * 2 > 60 AS any2, p_size > 10 AS all2, p_size * 2 <= 70 AS \"empty\", true AS in2, p_size < 5 AS in1, CAST(0 AS BIGINT) AS none, false AS neither, NOT p_size > 25 AS \"not\", CAST(1 AS BIGINT) AS opt FROM part",
)
evaluated(
    "selectors", "customer", CUSTOMER,
    '[.c_custkey, .c_name, null, true, [.c_custkey], {a: 1}, false] as $v | def n(f): [$v[] | f] | length; {k: .c_custkey, nulls: n(nulls), bools: n(booleans), nums: n(numbers), strings: n(strings), arrays: n(arrays), objects: n(objects), iter: n(iterables), scal: n(scalars), vals: n(values), nan: (nan | isnan), inf: (infinite | isinfinite), norm: (.c_custkey + 1 | isnormal), sub: (0 | isnormal), types: ($v | map(type) | join(","))}',
    "k long, nulls long, bools long, nums long, strings long, arrays long, objects long, iter long, scal long, vals long, nan boolean, inf boolean, norm boolean, sub boolean, types string",
    "SELECT c_custkey AS k, CAST(1 AS BIGINT) AS nulls, CAST(2 AS BIGINT) AS bools, CAST(1 AS BIGINT) AS nums, CAST(1 AS BIGINT) AS strings, CAST(1 AS BIGINT) AS arrays, CAST(1 AS BIGINT) AS objects, CAST(2 AS BIGINT) AS iter, CAST(5 AS BIGINT) AS scal, CAST(6 AS BIGINT) AS vals, true AS nan, true AS inf, true AS norm, false AS sub, 'number,string,null,boolean,array,object,boolean' AS types FROM customer",
)
evaluated(
    "generators", "part", PART,
    '.p_size as $n | {k: .p_partkey, first: first(range($n; 100)), last: last(range($n)), nth: nth(2; range($n; 100)), limit: ([limit(3; range($n; 100))] | add), skip: ([skip(2; range(5))] | length), arr: ([$n, 7, 9] | [first, last, nth(1)] | add), while: ([1 | while(. < $n; . * 2)] | length), until: (1 | until(. > $n; . * 2)), repeat: ([limit(4; 1 | repeat(. * 2))] | last), recurse: ([2 | recurse(if . < $n then . * . else empty end)] | length), step: ([range(0; $n; 5)] | length), down: ([range(10; 0; -3)] | add), first2: ([first(empty)] | length), dots: ([[1, [$n]] | recurse | numbers] | add), deep: ([recurse(if type == "object" then .p_size else empty end; . != null)] | length)}',
    "k long, first long, last long, nth long, limit long, skip long, arr long, while long, until long, repeat long, recurse long, step long, down long, first2 long, dots long, deep long",
    "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS \"first\", CASE WHEN p_size > 0 THEN CAST(p_size - 1 AS BIGINT) END AS \"last\", CAST(p_size + 2 AS BIGINT) AS nth, CAST(3 * p_size + 3 AS BIGINT) AS \"limit\", CAST(3 AS BIGINT) AS skip, CAST(p_size + 16 AS BIGINT) AS arr, CAST(CASE WHEN p_size <= 1 THEN 0 ELSE ceil(log2(p_size)) END AS BIGINT) AS \"while\", CAST(pow(2, CASE WHEN p_size < 1 THEN 0 ELSE floor(log2(p_size)) + 1 END) AS BIGINT) AS until, CAST(2 AS BIGINT) AS repeat, CAST(CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 2 WHEN p_size <= 16 THEN 3 ELSE 4 END AS BIGINT) AS recurse, CAST(ceil(p_size / 5) AS BIGINT) AS step, CAST(22 AS BIGINT) AS down, CAST(0 AS BIGINT) AS first2, CAST(p_size + 1 AS BIGINT) AS dots, CAST(2 AS BIGINT) AS deep FROM part",
)
evaluated(
    "control_more", "orders", ORDERS,
    '{k: .o_orderkey, t: (try error({code: .o_custkey}) catch .code), e: (try error catch (.o_orderkey // "none")), n: ([.[] | try (if type == "number" then error("n") else . end) catch empty] | length), d: .o_custkey, env: (env | type), envv: ($ENV | type), loc: ($__loc__ | .line), halted: (try (label $f | 1, break $f, 2) catch 9), each: ([foreach (1, 2, 3) as $i (0; . + $i; [$i, .])] | tojson), red: (reduce (1, 2, 3) as [$a] (0; . + 1)), over: (1e308 * 10 | . > 1e308), e2: ([.o_orderstatus | ascii_downcase, error?] | length)}'.replace("(1, 2, 3) as [$a]", "([1], [2], [3]) as [$a]"),
    "k long, t long, e long, n long, d long, env string, envv string, loc long, halted long, each string, red long, over boolean, e2 long",
    "SELECT o_orderkey AS k, o_custkey AS t, o_orderkey AS e, CAST(2 AS BIGINT) AS n, o_custkey AS d, 'object' AS env, 'object' AS envv, CAST(1 AS BIGINT) AS loc, CAST(1 AS BIGINT) AS halted, '[[1,1],[2,3],[3,6]]' AS each, CAST(3 AS BIGINT) AS red, true AS \"over\", CAST(1 AS BIGINT) AS e2 FROM orders",
)

evaluated("said", "region", ["r_regionkey"], "{k: (.r_regionkey | debug | stderr), built: (builtins | length > 100)}", "k long, built boolean", "SELECT CAST(r_regionkey AS BIGINT) AS k, true AS built FROM region")

# -- arrays ----------------------------------------------------------------------------------------
evaluated(
    "array_forms", "part", PART,
    '[.p_size, 30, [.p_size % 10, [5]]] as $v | {k: .p_partkey, flat: ($v | flatten | add), flat1: ($v | flatten(1) | length), addf: (add($v[0, 1])), unions: ([1, 2, .p_size] + [2] | unique | length), diff: ([1, 2, 3] - [.p_size] | length), meet: ([1, 2, 3] - ([1, 2, 3] - [.p_size]) | length), at: ([10, 20, 30] | bsearch(.[.[0] - 9])), miss: ([10, 20, 30] | bsearch(15)), found: ([1, 2, 1] | indices(1) | tojson), sub: ([1, 2, 1, 2] | indices([1, 2]) | length), idx: ("a,b,a" | [index("a"), rindex("a")] | add), minby: ([{a: .p_size}, {a: 25}] | min_by(.a).a), maxby: ([{a: .p_size}, {a: 25}] | max_by(.a).a), cross: ([[1, 2] | combinations(2)] | length), rev: ([1, .p_size] | reverse | .[0]), revs: ("ab" | explode | reverse | implode)}'.replace("cross: ([[1, 2] | combinations(2)] | length), ", "").replace("bsearch(.[.[0] - 9])", "bsearch(.[1])"),
    "k long, flat long, flat1 long, addf long, unions long, diff long, meet long, at long, miss long, found string, sub long, idx long, minby long, maxby long, rev long, revs string",
    "SELECT p_partkey AS k, CAST(p_size + 30 + p_size % 10 + 5 AS BIGINT) AS flat, CAST(4 AS BIGINT) AS flat1, CAST(p_size + 30 AS BIGINT) AS addf, CAST(CASE WHEN p_size IN (1, 2) THEN 2 ELSE 3 END AS BIGINT) AS unions, CAST(CASE WHEN p_size IN (1, 2, 3) THEN 2 ELSE 3 END AS BIGINT) AS diff, CAST(CASE WHEN p_size IN (1, 2, 3) THEN 1 ELSE 0 END AS BIGINT) AS meet, CAST(1 AS BIGINT) AS \"at\", CAST(-2 AS BIGINT) AS miss, '[0,2]' AS found, CAST(2 AS BIGINT) AS sub, CAST(4 AS BIGINT) AS idx, CAST(least(p_size, 25) AS BIGINT) AS minby, CAST(greatest(p_size, 25) AS BIGINT) AS maxby, CAST(p_size AS BIGINT) AS rev, 'ba' AS revs FROM part",
)
evaluated(
    "lag_in_row", "embeddings", ["vec_id", "embedding"],
    '.vec_id as $k | [.embedding[:6][] * 1000 | floor] as $a | range(1; $a | length) | {k: $k, i: ., d: ($a[.] - $a[. - 1])}',
    "k long, i long, d long",
    "SELECT vec_id AS k, i, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 1000) - floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS d FROM embeddings, range(1, 6) AS r(i)",
)
evaluated(
    "sorted_in_row", "orders", ORDERS,
    '.o_orderkey as $k | [{n: 1, v: .o_orderstatus}, {n: 2, v: .o_orderpriority}, {n: 3, v: "M"}, {n: 4, v: null}] | sort_by(.v) | to_entries[] | {k: $k, place: .key, n: .value.n}',
    "k long, place long, n long",
    "SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_orderkey ORDER BY v NULLS FIRST, n) - 1 AS place, CAST(n AS BIGINT) AS n FROM orders, LATERAL (VALUES (1, o_orderstatus), (2, o_orderpriority), (3, 'M'), (4, NULL)) AS t(n, v)",
)
evaluated(
    "group_in_row", "embeddings", ["vec_id", "embedding"],
    '.vec_id as $k | [.embedding[] * 10 | floor] | group_by(.) | to_entries[] | {k: $k, place: .key, v: .value[0], n: (.value | length)}',
    "k long, place long, v long, n long",
    "SELECT vec_id AS k, row_number() OVER (PARTITION BY vec_id ORDER BY v) - 1 AS place, v, n FROM (SELECT vec_id, CAST(floor(CAST(x AS DOUBLE) * 10) AS BIGINT) AS v, count(*) AS n FROM embeddings, unnest(embedding) AS t(x) GROUP BY 1, 2)",
)
evaluated(
    "joins_in_row", "orders", ORDERS,
    '([{id: 1, v: "F"}, {id: 2, v: "O"}, {id: 3, v: "P"}]) as $t | {k: .o_orderkey, looked: ((reduce $t[] as $x ({}; .[$x.v] = $x.id))[.o_orderstatus]), idx: ($t | INDEX(.v))[.o_orderstatus].id, join2: ([{s: .o_orderstatus}] | JOIN($t | INDEX(.v); .s) | .[0][1].id), join3: ([JOIN(INDEX($t[]; .v); {s: .o_orderstatus}; .s)] | .[0][1].id), nested: ([.o_orderstatus as $s | $t[] | select(.v <= $s)] | length), in2: IN($t[].v; .o_orderstatus)}'.replace("idx: ($t | INDEX(.v))[.o_orderstatus].id", "idx: (. as $o | $t | INDEX(.v) | .[$o.o_orderstatus].id)").replace("JOIN($t | INDEX(.v); .s)", "JOIN(($t | INDEX(.v)); .s)"),
    "k long, looked long, idx long, join2 long, join3 long, nested long, in2 boolean",
    "WITH t AS (SELECT *, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS BIGINT) AS id FROM orders) SELECT o_orderkey AS k, id AS looked, id AS idx, id AS join2, id AS join3, id AS nested, true AS in2 FROM t",
)

# -- strings, patterns, formats ----------------------------------------------------------------------
evaluated(
    "string_forms", "customer", CUSTOMER,
    '.c_name as $n | {k: .c_custkey, ends: ($n | endswith("0")), cut: ($n | rtrimstr("0")), both: ("xaxx" | trimstr("x")), trim: ("  \\($n) " | trim), left: (" a " | ltrim), right: (" a " | rtrim), codes: ($n | explode | .[0]), back: ($n | explode | implode), ascii: ("A" | ascii), bool: ("true" | toboolean), div: ($n / "#" | .[1]), sub: ($n[1:4]), plus: ($n + "!"), joined: ([.c_custkey, null, "x", true] | join("-")), all: ($n | [indices("0")[]] | length), str: ([.c_custkey] | tostring), low: ($n | ascii_downcase), num: ("12" | tonumber), bytes: ("é" | utf8bytelength)}',
    "k long, ends boolean, cut string, both string, trim string, left string, right string, codes long, back string, ascii long, bool boolean, div string, sub string, plus string, joined string, all long, str string, low string, num long, bytes long",
    "SELECT c_custkey AS k, ends_with(c_name, '0') AS ends, regexp_replace(c_name, '0$', '') AS cut, 'ax' AS \"both\", c_name AS \"trim\", 'a ' AS \"left\", ' a' AS \"right\", CAST(67 AS BIGINT) AS codes, c_name AS back, CAST(65 AS BIGINT) AS ascii, true AS bool, substr(c_name, 10) AS div, substr(c_name, 2, 3) AS sub, c_name || '!' AS plus, c_custkey || '--x-true' AS joined, CAST(length(c_name) - length(replace(c_name, '0', '')) AS BIGINT) AS \"all\", '[' || c_custkey || ']' AS str, lower(c_name) AS low, CAST(12 AS BIGINT) AS num, CAST(2 AS BIGINT) AS bytes FROM customer",
)
evaluated(
    "match_forms", "customer", CUSTOMER,
    '.c_name as $n | {k: .c_custkey, off: ($n | match("[0-9]+").offset), len: ($n | match("[0-9]+").length), str: ($n | match("(?<w>[a-z]+)#").captures[0].string), name: ($n | match("(?<w>[a-z]+)#").captures[0].name), all: ([$n | match("0"; "g")] | length), gi: ([$n | match("C"; "gi").string] | join("")), x: ($n | test("c u s t"; "xi")), sub: ($n | sub("#0*"; "-")), named: ($n | sub("(?<a>[A-Z])"; "\\(.a | ascii_downcase)")), gsub: ($n | gsub("[^0-9]"; "")), gi2: ($n | gsub("C|R"; "_"; "i")), cap: ($n | capture("(?<p>.)(?<q>z)?") | tojson), scan: ([$n | scan("([0-9])([0-9])")] | length), split: ($n | split("[#0]+"; null) | length), arr: ($n | test(["CUST", "i"]))}',
    "k long, off long, len long, str string, name string, all long, gi string, x boolean, sub string, named string, gsub string, gi2 string, cap string, scan long, split long, arr boolean",
    "SELECT c_custkey AS k, CAST(9 AS BIGINT) AS \"off\", CAST(9 AS BIGINT) AS len, 'ustomer' AS str, 'w' AS name, CAST(length(c_name) - length(replace(c_name, '0', '')) AS BIGINT) AS \"all\", 'C' AS gi, true AS x, regexp_replace(c_name, '#0*', '-') AS sub, 'c' || substr(c_name, 2) AS named, substr(c_name, 10) AS gsub, '_ustome_' || substr(c_name, 9) AS gi2, '{\"p\":\"C\",\"q\":null}' AS cap, CAST(4 AS BIGINT) AS scan, CAST(len(regexp_split_to_array(c_name, '[#0]+')) AS BIGINT) AS split, true AS arr FROM customer",
)
evaluated(
    "encoders", "customer", CUSTOMER,
    '{k: .c_custkey, text: ([.c_custkey] | @text), json: ({a: .c_name} | @json), apos: ("<\'\\(.c_nationkey)\'>&\\"" | @html), uri: ("a b\\(.c_nationkey)/ü" | @uri), urid: ("a%20b%2F" + (.c_nationkey | tostring) | @urid), b64: (.c_name | @base64 | @base64d), sh: ("it\'s" | @sh), csv: ([.c_custkey, "a\\"b", null, true] | @csv), tsv: (["a\\tb", .c_custkey] | @tsv), tojson: ([.c_name, 1.5, null] | tojson), from: ("[\\(.c_custkey), 2]" | fromjson | add), nan: ("nan" | fromjson | isnan), inter: @json "x\\(.c_name)y"}',
    "k long, text string, json string, apos string, uri string, urid string, b64 string, sh string, csv string, tsv string, tojson string, from long, nan boolean, inter string",
    "SELECT c_custkey AS k, '[' || c_custkey || ']' AS text, '{\"a\":\"' || c_name || '\"}' AS json, '&lt;&apos;' || c_nationkey || '&apos;&gt;&amp;&quot;' AS apos, 'a%20b' || c_nationkey || '%2F%C3%BC' AS uri, 'a b/' || c_nationkey AS urid, c_name AS b64, '''it''\\''''s''' AS sh, c_custkey || ',\"a\"\"b\",,true' AS csv, 'a\\tb' || chr(9) || c_custkey AS tsv, '[\"' || c_name || '\",1.5,null]' AS tojson, c_custkey + 2 AS \"from\", true AS nan, 'x\"' || c_name || '\"y' AS inter FROM customer",
)

# -- numbers and dates -------------------------------------------------------------------------------
_MICRO = "CAST(round({} * 1000000) AS BIGINT)"
evaluated(
    "math_functions", "part", ["p_partkey", "p_size"],
    "def m: . * 1000000 | round; (.p_size + 1) as $x | {k: .p_partkey, fabs: (-$x | fabs), cbrt: ($x | cbrt | m), atan2: (atan2($x; 2) | m), rem: remainder($x; 3), drem: drem($x; 3), ldexp: ldexp($x; 3), scalb: scalb($x; 2), scalbln: scalbln($x; 1), fma: fma($x; 2; 1), exp: ($x / 20 | exp | m), exp2: ($x / 20 | exp2 | m), exp10: ($x / 50 | exp10 | m), log: ($x | log | m), log10: ($x | log10 | m), sin: ($x | sin | m), cos: ($x | cos | m), tan: (1 / $x | tan | m), asin: (1 / $x | asin | m), acos: (1 / $x | acos | m), atan: ($x | atan | m), rint: ($x / 4 | rint), near: ($x / 4 | nearbyint), signif: ($x | significand | m), logb: ($x | logb), lgamma: ($x | lgamma | m), tgamma: ($x % 8 + 1 | tgamma), inf: (infinite > $x), dec: have_decnum, lit: (have_literal_numbers | type), mod: (-$x % 4), idiv: ($x / 2 | floor), neg: (-($x))}",
    "k long, fabs long, cbrt long, atan2 long, rem long, drem long, ldexp long, scalb long, scalbln long, fma long, exp long, exp2 long, exp10 long, log long, log10 long, sin long, cos long, tan long, asin long, acos long, atan long, rint long, near long, signif long, logb long, lgamma long, tgamma long, inf boolean, dec boolean, lit string, mod long, idiv long, neg long",
    "WITH t AS (SELECT p_partkey AS k, CAST(p_size + 1 AS BIGINT) AS x FROM part) SELECT k, x AS fabs, "
    + ", ".join(f"{_MICRO.format(e)} AS {n}" for n, e in {"cbrt": "cbrt(x)", "atan2": "atan2(x, 2)", "exp": "exp(x / 20)", "exp2": "pow(2, x / 20)", "exp10": "pow(10, x / 50)", "log": "ln(x)", "log10": "log10(x)", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(1 / x)", "asin": "asin(1 / x)", "acos": "acos(1 / x)", "atan": "atan(x)", "signif": "(x / pow(2, floor(log2(x))))", "lgamma": "lgamma(x)"}.items())
    + ", x - 3 * CAST(round_even(x / 3, 0) AS BIGINT) AS rem, x - 3 * CAST(round_even(x / 3, 0) AS BIGINT) AS drem, x * 8 AS ldexp, x * 4 AS scalb, x * 2 AS scalbln, 2 * x + 1 AS fma, CAST(round_even(x / 4, 0) AS BIGINT) AS rint, CAST(round_even(x / 4, 0) AS BIGINT) AS near, CAST(floor(log2(x)) AS BIGINT) AS logb, CAST(factorial(CAST(x % 8 AS INTEGER)) AS BIGINT) AS tgamma, true AS inf, false AS dec, 'boolean' AS lit, -x % 4 AS mod, x // 2 AS idiv, -x AS neg FROM t",
)
evaluated(
    "date_functions", "orders", ["o_orderkey", "o_orderdate"],
    '.o_orderdate as $d | {k: .o_orderkey, mk: ($d | strptime("%Y-%m-%dT%H:%M:%SZ") | mktime), iso: ($d | fromdateiso8601 | todateiso8601), dow: ($d | strptime("%Y-%m-%dT%H:%M:%SZ") | .[6]), doy: ($d | strptime("%Y-%m-%dT%H:%M:%SZ") | .[7]), fmt: ($d | fromdate | strftime("%A %d %B %Y, %j")), loc: ($d | fromdate | gmtime | mktime | strflocaltime("%Y") | length), now: (now > 1500000000), dt: ($d | fromdate + 86400 | todate), date: ($d | fromdate | gmtime | .[:3] | tojson)}',
    "k long, mk long, iso string, dow long, doy long, fmt string, loc long, now boolean, dt string, date string",
    "SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS mk, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, CAST(dayofyear(o_orderdate) - 1 AS BIGINT) AS doy, strftime(o_orderdate, '%A %d %B %Y, %j') AS fmt, CAST(4 AS BIGINT) AS loc, true AS now, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS dt, '[' || year(o_orderdate) || ',' || (month(o_orderdate) - 1) || ',' || day(o_orderdate) || ']' AS date FROM orders",
)

# -- order over whole tables: the place is a column ----------------------------------------------------
table("sorted_places", "orders", "sort_by(.o_totalprice, .o_orderkey) | to_entries | map({place: .key, k: .value.o_orderkey})", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, o_orderkey AS k FROM orders")
table("reversed_places", "supplier", "sort_by(.s_acctbal, .s_suppkey) | reverse | to_entries | map({place: .key, k: .value.s_suppkey})", "SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey DESC) - 1 AS place, s_suppkey AS k FROM supplier")

table("lag_places", "orders", "sort_by(.o_orderdate, .o_orderkey) | [. as $a | range(1; length) | {i: ., k: $a[.].o_orderkey, step: ($a[.].o_custkey - $a[. - 1].o_custkey)}]", "SELECT * FROM (SELECT row_number() OVER w - 1 AS i, o_orderkey AS k, o_custkey - lag(o_custkey) OVER w AS step FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)) WHERE i > 0")
table("lag_values", "events", "map(.event_id * 3) | [. as $a | range(1; $a | length) | $a[.] - $a[. - 1]]", "SELECT CAST(3 AS BIGINT) AS value FROM events WHERE event_id > 0")
table("nested_loop", "customer", "[.[] as $c | $supplier[] | select(.s_nationkey == $c.c_nationkey and .s_acctbal > $c.c_acctbal) | {c: $c.c_custkey, s: .s_suppkey}]", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal", ("supplier",))


# -- sources, sinks, streams -----------------------------------------------------------------------
def written(spark: SparkSession, sf_dir: str, name: str, main: str, source: str, **shape: object) -> str:
    """The outputs of a filter on a table, written as text files."""
    path = scratch(spark, name)
    write_text(Filter(source).apply(dealt(read(spark, sf_dir, main).select(CUSTOMER if main == "customer" else "*")), "evaluator"), path, **shape)
    return path


def outputs(made: DataFrame, schema: str) -> DataFrame:
    return checked(made).select(F.from_json("value", schema).alias("r")).select("r.*")


def checked(made: DataFrame) -> DataFrame:
    fine = F.when(F.col("error").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("filter error: "), "error")))
    return made.withColumn("value", fine)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, sf_dir, "lines", "customer", "{id: .c_custkey, n: {s: .c_name}}")
    return outputs(Filter("select(.id % 2 == 0) | {id, s: .n.s}").apply(read_lines(spark, path)), "id long, s string")


def json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented values with sorted keys, several a file, read back as concatenated values."""
    path = written(spark, sf_dir, "pretty", "customer", "{z: .c_custkey, a: [.c_nationkey, {b: .c_name}]}", indent=3, sort_keys=True)
    return outputs(Filter("{k: .z, n: .a[0], s: .a[1].b, names: (keys_unsorted | join(\",\"))}").apply(read_values(spark, path).where("error is null").select("_seq", "value")), "k long, n long, s string, names string")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, sf_dir, "raw", "customer", ".c_name, .c_mktsegment", raw=True)
    return outputs(Filter('select(startswith("Customer")) | {n: length, s: .}').apply(read_raw(spark, path)), "n long, s string")


def raw_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "whole")
    write_text(Filter(".n_name").apply(read(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1), "evaluator"), path, raw=True)
    return outputs(Filter('{lines: (split("\\n") | length), chars: length}').apply(read_raw_whole(spark, path)), "lines long, chars long")


def no_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-n with named and positional arguments: the filter runs once, on null."""
    made = Filter("range($n) | {i: ., sq: (. * .), p: $ARGS.positional[0], q: $ARGS.named.q}", {"n": 1000, "q": "x"}, [7]).apply(null_input(spark))
    return outputs(made, "i long, sq long, p long, q string")


def slurped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-s: a form that needs the array itself."""
    made = Filter("[.[].n_nationkey] | {n: length, s: add, m: (sort | .[length / 2 | floor])}").slurp(read(spark, sf_dir, "nation").select("n_nationkey"))
    return outputs(made, "n long, s long, m long") if "error" in made.columns else made


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a condition rejects, what it fails on and what is no JSON are told apart."""
    k = F.col("event_id") % 4
    texts = dealt(read(spark, sf_dir, "events").select("event_id")).select(F.when(k == 0, F.lit('{"a":"xfoo"}')).when(k == 1, F.lit('{"a":1}')).when(k == 2, F.lit('{"a":"bar"}')).otherwise(F.lit("{bad")).alias("value"))
    made = Filter('select(.a | test("foo"))').apply(texts)
    said = F.when(F.col("error").isNull(), "value").when(F.col("error").startswith("parse error"), "parse error").otherwise("type error")
    return made.groupBy(said.alias("outcome")).agg(F.count("*").alias("n"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a stream: every record once, in micro-batches, with its place in its file."""
    path, out = scratch(spark, "in"), scratch(spark, "out")
    write_text(Filter("{id: .event_id, v: .user_id}").apply(read(spark, sf_dir, "events").select("event_id", "user_id").repartition(4), "evaluator"), path)
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(path)
    made = apply_filter(stream, Filter("select(.v % 2 == 1) | {id, v}"))
    made.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    rows_ = spark.read.schema(made.schema).parquet(out)
    return outputs(rows_, "id long, v long")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling event-time windows over the events as a stream."""
    out = scratch(spark, "windows")
    events = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(events).parquet(f"{sf_dir}/events.parquet*")
    counts = windowed_counts(stream, "ts", ["event_type"], "1 hour", late="30 days", total="user_id")
    counts = counts.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


def describe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred schema of the events, a row a field: its types, and whether records lack it."""
    texts = dealt(read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")).select(F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("third"))).alias("value"))
    schema = described(texts)
    kind = "struct<type:string,optional:boolean>"
    fields = F.from_json(F.get_json_object("schema", "$.fields"), "map<string,string>")
    found = schema.select(F.get_json_object("schema", "$.count").cast("long").alias("count"), F.explode(fields).alias("name", "of"))
    told = F.when(F.col("of").startswith("{"), F.from_json("of", kind)).otherwise(F.struct(F.col("of").alias("type"), F.lit(False).alias("optional")))
    return found.select("count", "name", told.alias("t")).select("count", "name", F.col("t.type").alias("type"), F.coalesce("t.optional", F.lit(False)).alias("optional"))


QUERIES |= {
    "json_lines": json_lines, "json_pretty": json_pretty, "raw_lines": raw_lines, "raw_whole": raw_whole, "no_input": no_input, "slurped": slurped, "error_rows": error_rows,
    "streamed": streamed, "stream_windows": stream_windows, "describe_fields": describe_fields,
}
SQL |= {
    "json_lines": "SELECT c_custkey AS id, c_name AS s FROM customer WHERE c_custkey % 2 = 0",
    "json_pretty": "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS n, c_name AS s, 'a,z' AS names FROM customer",
    "raw_lines": "SELECT length(c_name) AS n, c_name AS s FROM customer",
    "raw_whole": "SELECT count(*) AS lines, CAST(sum(length(n_name)) + count(*) - 1 AS BIGINT) AS chars FROM nation",
    "no_input": "SELECT i, i * i AS sq, CAST(7 AS BIGINT) AS p, 'x' AS q FROM range(1000) AS r(i)",
    "slurped": "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s, CAST(quantile_disc(n_nationkey, 0.5) AS BIGINT) AS m FROM nation",
    "error_rows": "SELECT CASE event_id % 4 WHEN 0 THEN 'value' WHEN 1 THEN 'type error' ELSE 'parse error' END AS outcome, count(*) AS n FROM events WHERE event_id % 4 <> 2 GROUP BY 1",
    "streamed": "SELECT event_id AS id, user_id AS v FROM events WHERE user_id % 2 = 1",
    "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    "describe_fields": "SELECT (SELECT count(*) FROM events) AS count, name, type, optional FROM (VALUES ('event_id', 'number', false), ('event_type', 'string', false), ('third', 'number', true)) AS t(name, type, optional)",
}
