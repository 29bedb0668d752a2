"""Sources, sinks, streams, the command line and SQL functions."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

from pathloom.api import Filter
from pathloom.functions.sql import register
from pathloom.sources.describe import described
from pathloom.sources.files import read_lines, read_values, write_text
from pathloom.streaming.apply import apply_filter, read_json_lines, windowed_counts, write_lines

ROOT = Path(__file__).resolve().parents[1]


def cli(*args: str, stdin: str = "") -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-m", "pathloom", *args], input=stdin, capture_output=True, text=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_command_line_shapes():
    assert cli("-c", ".a", stdin='{"a":[1,2]}').stdout == "[1,2]\n"
    assert cli("-r", ".a", stdin='{"a":"x"}').stdout == "x\n"
    assert cli("-s", "-c", "map(.+1)", stdin="1 2\n3").stdout == "[2,3,4]\n"
    assert cli("-n", "-c", "--arg", "v", "q", "[$v]").stdout == '["q"]\n'
    assert cli("-R", ".", stdin="a\nb").stdout == '"a"\n"b"\n'
    assert cli(".", stdin='{"a":1}').stdout == '{\n  "a": 1\n}\n'


def test_command_line_status():
    assert cli("(", stdin="1").returncode == 3
    assert cli("--nosuch").returncode == 2
    assert cli("-e", ".a", stdin="{}").returncode == 1
    assert cli("-e", "empty", stdin="{}").returncode == 4
    assert cli(".a", stdin="[1]").returncode == 5


def test_files_there_and_back(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id":1}\n{"id":2}\n')
    out = Filter("{id: (.id + 1)}").apply(read_lines(spark, str(tmp_path / "in.jsonl")))
    write_text(out, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    assert sorted(map(json.dumps, map(json.loads, lines))) == ['{"id": 2}', '{"id": 3}']


def test_wrong_records_do_not_stop_the_read(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a":1}\n{"a": }\n{"a":3}\n')
    rows = read_values(spark, str(tmp_path / "in.json")).collect()
    assert sorted(json.loads(r["value"])["a"] for r in rows if r["error"] is None) == [1, 3]
    assert any(r["error"] for r in rows)


def test_describe(spark, sf_dir):
    (row,) = described(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")).collect()
    assert "n_name" in str(row)


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("""SELECT path_query('{"a":[1,2]}', '.a[]') AS x""").first().x == ["1", "2"]
    assert spark.sql("""SELECT value FROM path_rows('[3,4]', '.[]')""").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.jsonl").write_text("".join(json.dumps({"id": i * 10 + k}) + "\n" for k in range(4)))
    made = apply_filter(read_json_lines(spark, str(tmp_path / "in"), 1), Filter("select(.id % 2 == 0) | .id"))
    write_lines(made, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(int(r.value) for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == [0, 2, 10, 12, 20, 22]


def test_stream_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = next(f.name for f in events.schema if f.dataType.typeName().startswith("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, time, ["event_type"], "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg({"n": "sum"}).first()[0] == events.count()
