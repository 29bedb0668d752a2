"""What plans read, in which order they number, and what a prefilter may pass over."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pathloom import catalog
from pathloom.api import Filter
from pathloom.plans import lanes
from pathloom.sources.describe import described
from pathloom.streaming.apply import apply_filter

TEXTS = [
    '{"a":"xfoo"}', '{"a":1}', "{bad", '{"a":null}', '{"a":"bar"}', '{"a": "bar", "b": 1.5}', '{"a":"f\\u006fo"}', "[1]", '"foo"', "null", "", '{"a":"bar","a":1}', '{"b":"foo"}', '{"a":"foo","b":[1]}',
    '{"a":{"x":"foo"}}', "1", '{"a":"bar",}', '{"a":"bar"} x', ' {"a":"bar"}', '{"a":"bar"}{"a":"foo"}', '{"a":"b\tar"}', '{"a":"bar","n":01}', '{"a":"bar","n":1e5}', "{}", '{"a":"bar","c":{"a":"foo"}}', None,
]


@pytest.mark.parametrize("source", ['select(.a | test("foo"))', 'select(.a | contains("foo"))', 'select(.a == "foo")', 'select((.a | startswith("foo")) and .b > 1)', 'select(.b > 1 and (.a | test("foo")))', 'select(.a.x == "foo")', 'select(.a | test("foo"; "x"))'])
def test_prefilter_loses_nothing(spark, source):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "_seq long, value string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(lanes.interpreted(Filter(source), rows)) == key(lanes.interpreted(Filter(source), rows, prefilter=False))


def test_prefilter_passes_over_plain_records(spark):
    rows = spark.createDataFrame([('{"a":"bar","b":1,"c":true,"d":null}',), ('{"a":"foo"}',)], "value string")
    keep = lanes.harvested(lanes.parse_filter('select(.a | test("foo"))'))
    assert [r.value for r in rows.where(keep).collect()] == ['{"a":"foo"}']


@pytest.mark.parametrize(
    "source, want",
    [("13911860366432393 == 13911860366432392", "true"), ("[1E+1000,-1E+1000 | tojson]", '["1.7976931348623157e+308","-1.7976931348623157e+308"]'), ("[1E+1000,-1E+1000 | abs | tojson] | unique", '["1.7976931348623157e+308"]'), ("[1E+1000,-1E+1000 | length | tojson] | unique", '["1.7976931348623157e+308"]'), ("[9, 8] | to_entries | .[1]", '{"key":1,"value":8}')],
)
def test_numbers_without_decimals(source, want):
    assert Filter(source).eval("null") == [want]


def read_schema(df):
    return [x for x in df._jdf.queryExecution().toString().split("\n") if "ReadSchema" in x]


def test_joins_and_firsts_read_only_what_is_used(spark, sf_dir):
    said = "\n".join(read_schema(catalog.QUERIES["join_large"](spark, sf_dir)))
    assert "o_orderpriority" in said and "o_totalprice" not in said and "l_extendedprice" not in said
    said = "\n".join(read_schema(catalog.QUERIES["unique_by"](spark, sf_dir)))
    assert "o_custkey" in said and "o_totalprice" not in said


@pytest.mark.parametrize("key", ["k", "s", "n"])
def test_running_totals_and_places_in_any_order(spark, key):
    rows = [(i * 7 % 50, f"x{i % 3}", None if i % 4 else i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, s string, n long, v long").repartition(7)
    places = Filter(f"sort_by(.{key}, .k) | to_entries | map({{place: .key, k: .value.k}})").slurp(df, gather=0).collect()
    want = sorted(rows, key=lambda r: ((r["ksn".index(key)] is not None, r["ksn".index(key)] or 0) if key != "s" else r[1], r[0]))
    assert [k for _, k in sorted((r.place, r.k) for r in places)] == [r[0] for r in want]
    totals = Filter(f"sort_by(.{key}, .k) | [foreach .[] as $r (0; . + $r.v; {{k: $r.k, t: .}})]").slurp(df, gather=0).collect()
    total, sums = 0, {}
    for r in want:
        total += r[3]
        sums[r[0]] = total
    assert {r.k: r.t for r in totals} == sums


def test_describe_keeps_the_tasks_of_the_scan(spark):
    df = spark.range(0, 4000, 1, 40).select(F.to_json(F.struct("id")).alias("value"))
    (row,) = described(df).collect()
    assert row.schema == '{"type":"object","fields":{"id":"number"},"count":4000}'


def test_streams_number_their_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("".join(f"{i}\n" for i in range(100)))
    stream = apply_filter(spark.readStream.text(str(tmp_path / "in")), Filter(". * 2"))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("_seq").collect()
    assert [r.value for r in got] == [str(2 * i) for i in range(100)] and len({r._seq for r in got}) == 100


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lag_crosses_partitions(spark, parts):
    df = spark.range(0, 30, 1, parts).select(F.col("id").alias("k"), (F.col("id") * F.col("id")).alias("v")).where("k % 7 <> 3")
    rows = sorted((r.k, r.v) for r in df.collect())
    got = Filter("[. as $a | range(1; length) | {i: ., d: ($a[.].v - $a[. - 1].v)}]").slurp(df, gather=0).collect()
    assert {r.i: r.d for r in got} == {i: rows[i][1] - rows[i - 1][1] for i in range(1, len(rows))}
    back = Filter("sort_by(.k) | reverse | [. as $a | range(1; length) | $a[. - 1].k]").slurp(df, gather=0).collect()
    assert sorted(r.value for r in back) == [k for k, _ in rows][1:]


def test_nested_loops_with_an_equality_are_joins(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "k long, v long")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, n string")
    got = Filter("[.[] as $x | $t[] | select(.k == $x.k and $x.v < 9) | {n, v: $x.v}]", tables=("t",)).slurp(a, {"t": b}, gather=0)
    assert sorted((r.n, r.v) for r in got.collect()) == [("x", 5), ("y", 5), ("z", 7)]


def test_floats_reach_the_evaluator_as_the_doubles_they_are(spark):
    """0.007 as a float is a little more than 0.007, 0.009 a little less: its floor in thousandths is 8."""
    df = spark.createDataFrame([(0.009, [0.007, 0.009], (0.009,), {"a": 0.009})], "x float, l array<float>, s struct<y:float>, m map<string,float>")
    (row,) = Filter("[.x, .l[], .s.y, .m.a] | map(. * 1000 | floor)").apply(df, "evaluator").collect()
    thousandths = df.selectExpr("transform(array(x, l[0], l[1], s.y, m['a']), x -> floor(double(x) * 1000))").first()[0]
    assert row.value == str(thousandths).replace(" ", "") and 8 in thousandths


def in_one_task(spark, path, df):
    """Written as one row group, and read so that the scan has many tasks, of which one gets all rows."""
    df.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    return spark.read.parquet(path)


@pytest.fixture
def small_splits(spark):
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def most_in_a_task(df):
    return max(n for _, n in df.groupBy(F.spark_partition_id()).count().collect())


def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path, small_splits):
    made = spark.range(8000).selectExpr("id o_orderkey", "id % 90 o_custkey", "timestamp_seconds(id * 86399) o_orderdate", "'O' o_orderstatus", "md5(string(id)) o_orderpriority")
    assert most_in_a_task(in_one_task(spark, f"{tmp_path}/orders.parquet", made)) == 8000
    for query in ("date_functions", "paths_write", "control_more", "joins_in_row", "patterns"):
        assert most_in_a_task(catalog.QUERIES[query](spark, str(tmp_path))) < 3000, query
    assert most_in_a_task(catalog.QUERIES["sorted_in_row"](spark, str(tmp_path))) < 4 * 3000


def test_nested_loops_deal_the_rows_of_a_key(spark, tmp_path, small_splits):
    a = in_one_task(spark, f"{tmp_path}/a", spark.range(8000).selectExpr("int(if(id % 9 = 0, null, 1)) k", "id v", "md5(string(id)) s"))
    b = spark.createDataFrame([(1, 5), (1, 7000), (None, 3)], "k int, w long")
    got = Filter("[.[] as $x | $t[] | select(.k == $x.k and .w > $x.v) | {w, v: $x.v}]", tables=("t",)).slurp(a, {"t": b}, gather=0)
    want = {(w, v) for v in range(8000) for k, w in [(1, 5), (1, 7000), (None, 3)] if (None if v % 9 == 0 else 1) == k and w > v}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.w, r.v) for r in rows} == want
    assert most_in_a_task(got) < 3000
