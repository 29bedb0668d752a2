"""The id store: every kind of damage is found on reading."""

from __future__ import annotations

import glob
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import idstore, packing
from pathloom.llm.common import fresh_path

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def path():
    return packing.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def stored(spark, path):
    store = fresh_path(spark, "damage")
    rows = spark.createDataFrame([(i, " ".join(f"word{i * j % 9973}" for j in range(1, 400))) for i in range(60)], DOC)
    idstore.write_store(rows, store, path)
    return store.removeprefix("file://")


def brute_merkle(leaves):
    level = [idstore.digest(b"\0" + x) for x in leaves] or [idstore.digest(b"")]
    while len(level) > 1:
        pairs = [idstore.digest(b"\1" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def test_tree_equals_the_level_by_level_root():
    for n in range(40):
        leaves = [bytes([i]) * 16 for i in range(n)]
        assert idstore.merkle(leaves) == brute_merkle(leaves)


def rewrite(spark, folder, change):
    """Read a folder's rows, change them, write them back."""
    rows = spark.read.parquet(folder)
    spark.createDataFrame(change(rows.collect()), rows.schema).write.mode("overwrite").parquet(folder + "-new")
    shutil.rmtree(folder)
    os.rename(folder + "-new", folder)


def changed(rows, pick, **values):
    out = [r.asDict() for r in rows]
    for r in out:
        if pick(r):
            r.update(values)
    return out


def test_an_undamaged_store_reads(spark, stored, path):
    got = idstore.read_store(spark, stored, path).collect()
    assert len(got) == 60 and sorted(r.start for r in got) == np.cumsum([0, *[r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)]])[:-1].tolist()


DAMAGE = {
    "a file of chunks is gone": lambda s, d: os.remove(max(glob.glob(f"{d}/objects/part-*"), key=os.path.getsize)),
    "a chunk is gone": lambda s, d: rewrite(s, f"{d}/objects", lambda rows: [r for r in rows if r.name != min(x.name for x in rows if x.kind == "chunk")]),
    "a chunk's bytes differ": lambda s, d: rewrite(s, f"{d}/objects", lambda rows: changed(rows, lambda r: r["name"] == min(x.name for x in rows if x.kind == "chunk"), data=b"\1\0" * 200)),
    "a file of recipes is gone": lambda s, d: os.remove(max(glob.glob(f"{d}/recipes/part-*"), key=os.path.getsize)),
    "all recipes are gone": lambda s, d: [os.remove(f) for f in glob.glob(f"{d}/recipes/part-*")],
    "a recipe is gone": lambda s, d: rewrite(s, f"{d}/recipes", lambda rows: rows[:-1]),
    "a recipe is there twice": lambda s, d: rewrite(s, f"{d}/recipes", lambda rows: [*rows, rows[-1]]),
    "a recipe names other chunks": lambda s, d: rewrite(s, f"{d}/recipes", lambda rows: changed(rows, lambda r: r["doc_id"] == 3, names=rows[-1].names, lengths=rows[-1].lengths)),
    "a recipe's length differs": lambda s, d: rewrite(s, f"{d}/recipes", lambda rows: changed(rows, lambda r: r["doc_id"] == 3, n_tokens=7)),
    "the manifest's roots differ": lambda s, d: rewrite(s, f"{d}/manifest", lambda rows: changed(rows, lambda r: True, root=bytearray(b"bad"))),
    "the manifest has lost rows": lambda s, d: rewrite(s, f"{d}/manifest", lambda rows: rows[:1]),
    "the top row is gone": lambda s, d: rewrite(s, f"{d}/manifest", lambda rows: [r for r in rows if r.part != -1]),
    "a part's tokens differ": lambda s, d: rewrite(s, f"{d}/manifest", lambda rows: changed(rows, lambda r: r["part"] == 0, tokens=1)),
}


@pytest.mark.parametrize("kind", DAMAGE)
def test_damage_is_found(spark, stored, path, tmp_path, kind):
    copy = f"{tmp_path}/store"
    shutil.copytree(stored, copy, ignore=shutil.ignore_patterns("*.crc"))
    DAMAGE[kind](spark, copy)
    with pytest.raises(Exception, match="missing|don't|not as"):
        idstore.read_store(spark, copy, path).collect()


def test_repeated_and_null_ids(spark, path):
    store = fresh_path(spark, "store")
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (0, "")], DOC).withColumn("kind", F.lit(1))
    idstore.write_store(rows, store, path)
    got = idstore.read_store(spark, store, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1), (0, 1, 1), (1, 2, 3), (1, 5, 3)]


def brute_cuts(ids):
    """Each place judged alone, by the gears of its last ids."""
    n, last, out = len(ids), 0, []
    gear = [int(idstore._GEAR[i & 0xFFF]) * (i + 1) % 2**64 for i in ids]
    for at in range(1, n + 1):
        hashed = sum(gear[at - 1 - k] << k for k in range(min(idstore.REACH, at))) % 2**64
        if at - last >= idstore.LEAST and hashed >> 40 & idstore.MASK == 0 or at - last == idstore.MOST or at == n:
            out.append(at)
            last = at
    return out


def test_cuts_equal_each_place_judged_alone(path):
    rng = np.random.default_rng(4)
    import pyarrow as pa

    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, n)) for n in (0, 1, 40, 64, 300, 3000)] + ["a " * 10_000]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    rows = [r for b in idstore.tokenized(path, 1)(iter([batch])) for r in b.to_pylist() if r["kind"] == "recipe"]
    for r in rows:
        ids = np.frombuffer(idstore.Encoder.of(path).encode(texts[r["doc_id"]]), dtype="<u4").tolist() + [1]
        assert np.cumsum(r["lengths"]).tolist() == brute_cuts(ids)
