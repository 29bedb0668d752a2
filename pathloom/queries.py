"""Registered queries of the filter language, each with the SQL that gives the same rows.

A query runs a filter over whole tables: row filters on records (``rows``), table filters on a table as
one array (``table``), or the evaluator on JSON texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.api import Filter
from pathloom.plans.numbering import SEQ, dealt
from pathloom.sources.describe import described
from pathloom.sources.files import parsed_values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows(name: str, table: str, source: str, sql: str | None) -> None:
    """A native filter on every record."""
    QUERIES[name] = lambda spark, d: Filter(source).apply(read(spark, d, table), "native")
    if sql:
        SQL[name] = sql


def table(name: str, main: str, source: str, sql: str | None, others: tuple[str, ...] = ()) -> None:
    """A native filter on a table as an array."""
    QUERIES[name] = lambda spark, d: Filter(source, tables=others).slurp(read(spark, d, main), {t: read(spark, d, t) for t in others}, gather=0)
    if sql:
        SQL[name] = sql


def evaluated(name: str, main: str, columns: list[str], source: str, out: str, sql: str | None) -> None:
    """The evaluator on records; its outputs read back by the schema ``out``."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = Filter(source).apply(dealt(read(spark, d, main).select(*columns)), "evaluator")
        # A record that the filter fails on fails the query.
        fine = F.when(F.col("error").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("filter error: "), "error")))
        return made.select(F.from_json(fine, out).alias("r")).select("r.*")

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# -- projections, filters --------------------------------------------------------------------------
rows("filter_project", "lineitem", "select(.l_quantity > 45) | {l_orderkey, l_quantity}", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
rows(
    "filter_logic", "orders", 'select((.o_orderstatus == "F" or .o_orderpriority == "1-URGENT") and (.o_totalprice < 100000 | not)) | {o_orderkey, o_totalprice}',
    "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND NOT o_totalprice < 100000",
)
rows("filter_time", "orders", 'select(.o_orderdate >= "1995-01-01T00:00:00Z" and .o_orderdate < "1996-01-01T00:00:00Z") | {o_orderkey}', "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
rows(
    "arithmetic", "lineitem", "{k: .l_orderkey, n: .l_linenumber, net: (.l_extendedprice * (1 - .l_discount)), m: (.l_orderkey % 7), half: (.l_quantity / 2), neg: (-.l_linenumber)}",
    "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice * (1 - l_discount) AS net, l_orderkey % 7 AS m, l_quantity / 2 AS half, CAST(-l_linenumber AS BIGINT) AS neg FROM lineitem",
)
rows(
    "conditional", "part", 'if .p_size < 10 then {k: .p_partkey, c: "small"} elif .p_size < 30 then {k: .p_partkey, c: "medium"} else {k: .p_partkey, c: "large"} end',
    "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c FROM part",
)
rows(
    "alternative", "customer", '{k: .c_custkey, b: (if .c_acctbal < 0 then null else .c_mktsegment end // "none")}',
    "SELECT c_custkey AS k, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, 'none') AS b FROM customer",
)
rows(
    "bindings", "orders", ". as $o | (.o_totalprice / 1000 | floor) as $t | select($t > 100) | {k: $o.o_orderkey, t: $t, s: ($o.o_orderstatus + \"-\" + $o.o_orderpriority)}",
    "SELECT o_orderkey AS k, CAST(floor(o_totalprice / 1000) AS BIGINT) AS t, o_orderstatus || '-' || o_orderpriority AS s FROM orders WHERE floor(o_totalprice / 1000) > 100",
)
rows("membership", "orders", '{k: .o_orderkey, hot: (.o_orderpriority | IN("1-URGENT", "2-HIGH"))} | select(.hot) | {k}', "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
rows("update", "supplier", ".s_acctbal |= (. * 2) | .s_name += \"!\" | {s_suppkey, s_name, s_acctbal}", "SELECT s_suppkey, s_name || '!' AS s_name, s_acctbal * 2 AS s_acctbal FROM supplier")
rows("fan_out", "nation", '{k: .n_nationkey, v: (range(0; 3))}', "SELECT n_nationkey AS k, CAST(v AS BIGINT) AS v FROM nation, range(0, 3) AS r(v)")
rows("comma", "region", ".r_name, (.r_name | length | tostring)", "SELECT r_name AS value FROM region UNION ALL SELECT CAST(length(r_name) AS VARCHAR) FROM region")

# -- arrays ------------------------------------------------------------------------------------------
rows("explode", "embeddings", ".vec_id as $v | .embedding[] | {v: $v, x: .}", "SELECT vec_id AS v, x FROM embeddings, unnest(embedding) AS t(x)")
rows(
    "array_functions", "embeddings", "{k: .vec_id, n: (.embedding | length), lo: (.embedding | min), hi: (.embedding | max), first: .embedding[0], last: .embedding[-1], part: (.embedding[1:3] | length), pos: ([.embedding[] | select(. > 0)] | length), any: (.embedding | any(. > 0.5)), all: (.embedding | all(. < 100))}",
    "SELECT vec_id AS k, CAST(len(embedding) AS BIGINT) AS n, list_min(embedding) AS lo, list_max(embedding) AS hi, embedding[1] AS \"first\", embedding[-1] AS \"last\", CAST(2 AS BIGINT) AS part, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS pos, len(list_filter(embedding, lambda x: x > 0.5)) > 0 AS \"any\", len(list_filter(embedding, lambda x: x < 100)) = len(embedding) AS \"all\" FROM embeddings",
)
rows("reduce_array", "embeddings", "{k: .vec_id, n: (reduce .embedding[] as $x (0; if $x > 0 then . + 1 else . end))}", "SELECT vec_id AS k, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n FROM embeddings")
rows(
    "transform_array", "part", '{k: .p_partkey, words: (.p_name | split(" ") | map(ascii_upcase) | join("+")), n: (.p_name | split(" ") | map(select(length > 4)) | length)}',
    "SELECT p_partkey AS k, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x)), '+') AS words, CAST(len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4)) AS BIGINT) AS n FROM part",
)

# -- strings, patterns, numbers, dates, encoders ----------------------------------------------------
rows(
    "strings", "customer", '{k: .c_custkey, up: (.c_name | ascii_upcase), low: (.c_mktsegment | ascii_downcase), n: (.c_name | length), b: (.c_name | utf8bytelength), cut: (.c_name | ltrimstr("Customer#")), pre: (.c_name[0:4]), has: (.c_mktsegment | contains("BUILD")), s: (.c_name | startswith("Cust")), at: (.c_mktsegment | index("I")), txt: "\\(.c_custkey):\\(.c_nationkey)"}',
    "SELECT c_custkey AS k, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS n, CAST(strlen(c_name) AS BIGINT) AS b, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS cut, substr(c_name, 1, 4) AS pre, contains(c_mktsegment, 'BUILD') AS has, starts_with(c_name, 'Cust') AS s, CASE WHEN strpos(c_mktsegment, 'I') > 0 THEN CAST(strpos(c_mktsegment, 'I') - 1 AS BIGINT) END AS at, c_custkey || ':' || c_nationkey AS txt FROM customer",
)
rows(
    "regex", "documents", '{k: .doc_id, t: (.text | test("[0-9]{3}")), i: (.text | test("THE"; "i")), g: (.text | gsub("[aeiou]"; "_") | length), s: ([.text | scan("[a-z]+ing")] | length), p: ([.text | splits(", ")] | length)}',
    "SELECT doc_id AS k, regexp_matches(text, '[0-9]{3}') AS t, regexp_matches(text, '(?i)THE') AS i, length(regexp_replace(text, '[aeiou]', '_', 'g')) AS g, CAST(len(regexp_extract_all(text, '[a-z]+ing')) AS BIGINT) AS s, CAST(len(string_split(text, ', ')) AS BIGINT) AS p FROM documents",
)
rows("splits", "documents", '.doc_id as $d | .text | splits("\\n") | {d: $d, n: length}', "SELECT doc_id AS d, length(x) AS n FROM documents, unnest(string_split(text, chr(10))) AS t(x)")
rows(
    "math", "part", "{k: .p_partkey, f: (.p_retailprice | floor), c: (.p_retailprice | ceil), q: (.p_size | sqrt | . * 1000 | round), p: pow(.p_size; 2), l: (.p_size | log2 | . * 1000 | round), a: (-.p_size | abs), h: (hypot(.p_size; 1) * 1000 | floor), t: (.p_retailprice | trunc)}",
    "SELECT p_partkey AS k, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(round(sqrt(p_size) * 1000) AS BIGINT) AS q, pow(p_size, 2) AS p, CAST(round(log2(p_size) * 1000) AS BIGINT) AS l, CAST(p_size AS BIGINT) AS a, CAST(floor(sqrt(p_size * p_size + 1) * 1000) AS BIGINT) AS h, trunc(p_retailprice) AS t FROM part",
)
rows(
    "dates", "orders", '{k: .o_orderkey, e: (.o_orderdate | fromdate), iso: .o_orderdate, day: (.o_orderdate | strftime("%Y-%m-%d")), y: (.o_orderdate | gmtime[0]), w: (.o_orderdate | gmtime[6]), back: (.o_orderdate | fromdate | todate)}',
    "SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS e, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) AS y, CAST(dayofweek(o_orderdate) AS BIGINT) AS w, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS back FROM orders",
)
rows(
    "formats", "customer", '{k: .c_custkey, csv: ([.c_name, .c_mktsegment] | @csv), tsv: ([.c_name, .c_mktsegment] | @tsv), html: @html "<b>\\(.c_name)</b>", uri: (.c_name | @uri), sh: (.c_name | @sh), b64: (.c_name | @base64), json: (.c_name | tojson)}',
    "SELECT c_custkey AS k, '\"' || c_name || '\",\"' || c_mktsegment || '\"' AS csv, c_name || chr(9) || c_mktsegment AS tsv, '<b>' || c_name || '</b>' AS html, replace(c_name, '#', '%23') AS uri, '''' || c_name || '''' AS sh, to_base64(encode(c_name)) AS b64, '\"' || c_name || '\"' AS json FROM customer",
)
rows("types", "events", "{k: .event_id, t: (.value | type), s: (.event_type | type), n: (.value | tostring | tonumber | type), i: (.user_id | tostring)}", "SELECT event_id AS k, CASE WHEN value IS NULL THEN 'null' ELSE 'number' END AS t, 'string' AS s, CASE WHEN value IS NULL THEN 'null' ELSE 'number' END AS n, CAST(user_id AS VARCHAR) AS i FROM events")

# -- aggregation, grouping, distinct -----------------------------------------------------------------
table("group_count", "lineitem", "group_by(.l_returnflag) | map({k: .[0].l_returnflag, n: length})", "SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1")
table(
    "group_stats", "lineitem", "group_by(.l_returnflag, .l_linestatus) | map({f: .[0].l_returnflag, s: .[0].l_linestatus, n: length, q: (map(.l_quantity) | add), avg: ((map(.l_quantity) | add) / length * 1000 | round), lo: (map(.l_extendedprice) | min), hi: (map(.l_extendedprice) | max), big: (map(select(.l_quantity > 30)) | length), parts: (map(.l_partkey) | unique | length)})",
    "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, sum(l_quantity) AS q, CAST(round(sum(l_quantity) / count(*) * 1000) AS BIGINT) AS avg, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) FILTER (l_quantity > 30) AS big, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL",
)
table("group_having", "orders", "group_by(.o_custkey) | map({c: .[0].o_custkey, n: length} | select(.n > 12))", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
table("group_extremes", "orders", "group_by(.o_orderpriority) | map({p: .[0].o_orderpriority, top: max_by(.o_totalprice).o_orderkey, low: (sort_by(.o_totalprice) | .[0].o_orderkey)})", "SELECT o_orderpriority AS p, arg_max(o_orderkey, o_totalprice) AS top, arg_min(o_orderkey, o_totalprice) AS low FROM orders GROUP BY 1")
table("totals", "supplier", "{n: length, s: (map(.s_acctbal) | add | . * 100 | round), hi: (map(.s_acctbal) | max), neg: (map(select(.s_acctbal < 0)) | length), any: any(.s_acctbal < -900), all: all(.s_suppkey > 0)}", "SELECT count(*) AS n, CAST(round(sum(s_acctbal) * 100) AS BIGINT) AS s, max(s_acctbal) AS hi, count(*) FILTER (s_acctbal < 0) AS neg, bool_or(s_acctbal < -900) AS \"any\", bool_and(s_suppkey > 0) AS \"all\" FROM supplier")
table("reduce_sum", "lineitem", "reduce .[] as $x (0; . + $x.l_linenumber)", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem")
table("distinct", "orders", "map(.o_orderpriority) | unique", "SELECT DISTINCT o_orderpriority AS value FROM orders")
table("unique_by", "orders", "unique_by(.o_custkey) | map({c: .o_custkey})", "SELECT DISTINCT o_custkey AS c FROM orders")

# -- joins, sets ---------------------------------------------------------------------------------------
table(
    "join_lookup", "customer", "INDEX($nation[]; .n_nationkey) as $n | [JOIN($n; .[]; .c_nationkey; {c: .[0].c_custkey, n: .[1].n_name})]",
    "SELECT c_custkey AS c, n_name AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", ("nation",),
)
table("join_large", "lineitem", "INDEX($orders[]; .o_orderkey) as $o | [JOIN($o; .[]; .l_orderkey; {k: .[0].l_orderkey, n: .[0].l_linenumber, p: .[1].o_orderpriority})]", "SELECT l_orderkey AS k, l_linenumber AS n, o_orderpriority AS p FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", ("orders",))
table("semi", "customer", "map(select(.c_custkey | IN($orders[] | .o_custkey)) | {k: .c_custkey})", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", ("orders",))
table("anti", "customer", "map(select(.c_custkey | IN($orders[] | select(.o_totalprice > 150000) | .o_custkey) | not) | {k: .c_custkey})", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", ("orders",))
table("set_difference", "customer", "map(.c_custkey) - [$orders[] | select(.o_totalprice > 150000) | .o_custkey]", "SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)", ("orders",))
table("set_union", "customer", "(map(.c_nationkey) + [$supplier[] | .s_nationkey]) | unique", "SELECT c_nationkey AS value FROM customer UNION SELECT s_nationkey FROM supplier", ("supplier",))

# -- order, top-k, running -----------------------------------------------------------------------------
table("topk", "orders", "sort_by(-.o_totalprice, .o_orderkey) | .[:10] | map({o_orderkey, o_totalprice})", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
table("offset_limit", "orders", "sort_by(.o_orderkey) | .[100:120] | map({o_orderkey})", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
table("last_k", "orders", "sort_by(.o_orderkey) | .[-5:] | map({o_orderkey})", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5")
table("sorted", "supplier", "sort_by(.s_acctbal) | reverse | map({s_suppkey, s_acctbal})", "SELECT s_suppkey, s_acctbal FROM supplier")
table("running_sum", "events", "sort_by(.event_id) | [foreach .[] as $e (0; . + $e.user_id; {id: $e.event_id, total: .})]", "SELECT event_id AS id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS total FROM events")
table("first_per_group", "events", "group_by(.user_id) | map({u: .[0].user_id, e: min_by(.event_id).event_type})", "SELECT user_id AS u, arg_min(event_type, event_id) AS e FROM events GROUP BY 1")
table("row_numbers", "region", "to_entries | map({i: .key, n: .value.r_name})", "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, r_name AS n FROM region")

# -- the evaluator -------------------------------------------------------------------------------------
evaluated("json_extract", "events", ["event_id", "props"], "{id: .event_id, k: (.props | fromjson | .k)}", "id long, k long", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
evaluated("walk", "nation", ["n_nationkey", "n_name"], 'walk(if type == "string" then ascii_downcase else . end)', "n_nationkey long, n_name string", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, lower(n_name) AS n_name FROM nation")
evaluated("paths", "region", ["r_regionkey", "r_name"], '. as $r | paths | {k: $r.r_regionkey, p: join("/")}', "k long, p string", "SELECT CAST(r_regionkey AS BIGINT) AS k, unnest(['r_regionkey', 'r_name']) AS p FROM region")
evaluated("entries", "supplier", ["s_suppkey", "s_name"], 'with_entries(.key |= ltrimstr("s_")) | del(.missing) | .tags = [.name[0:8], .suppkey] | {suppkey, name, n: (.tags | length)}', "suppkey long, name string, n long", "SELECT s_suppkey AS suppkey, s_name AS name, CAST(2 AS BIGINT) AS n FROM supplier")
evaluated("functions", "region", ["r_regionkey"], "def fac: if . <= 1 then 1 else . * (. - 1 | fac) end; {k: .r_regionkey, f: (.r_regionkey | fac), s: ([limit(3; repeat(.r_regionkey))] | add)}", "k long, f long, s long", "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(CASE WHEN r_regionkey <= 1 THEN 1 ELSE factorial(r_regionkey) END AS BIGINT) AS f, CAST(3 * r_regionkey AS BIGINT) AS s FROM region")
evaluated("control", "nation", ["n_nationkey"], 'label $out | foreach range(0; 10) as $i (0; . + $i; if . > $__limit then break $out else {k: $i, s: .} end)'.replace("$__limit", "12"), "k long, s long", "SELECT CAST(i AS BIGINT) AS k, CAST(i * (i + 1) / 2 AS BIGINT) AS s FROM nation, range(0, 5) AS r(i)")
evaluated("caught", "nation", ["n_nationkey", "n_name"], 'try (if .n_nationkey % 2 == 0 then error("even") else {k: .n_nationkey, e: "none"} end) catch {k: -1, e: .}', "k long, e string", "SELECT CAST(CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE n_nationkey END AS BIGINT) AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'none' END AS e FROM nation")
evaluated("captures", "customer", ["c_custkey", "c_name"], '{k: .c_custkey} + (.c_name | capture("(?<word>[A-Za-z]+)#(?<num>[0-9]+)"))', "k long, word string, num string", "SELECT c_custkey AS k, regexp_extract(c_name, '([A-Za-z]+)#([0-9]+)', 1) AS word, regexp_extract(c_name, '([A-Za-z]+)#([0-9]+)', 2) AS num FROM customer")


def tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated records are repaired where only closing brackets are missing; others become errors."""
    texts = dealt(read(spark, sf_dir, "events").select("event_id", "props")).select(F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"\}$", "")).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("value"))
    found = parsed_values(texts, repair=True)
    return found.groupBy(F.col("error").isNull().alias("parsed")).agg(F.count("*").alias("n"))


QUERIES["tolerant_parse"] = tolerant_parse
SQL["tolerant_parse"] = "SELECT true AS parsed, count(*) AS n FROM events UNION ALL SELECT false, count(*) FROM events WHERE event_id % 3 = 1"
QUERIES["describe"] = lambda spark, d: described(dealt(read(spark, d, "events").select("event_id", "value", "props")).drop(SEQ))
