"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of all 3-word shingles. Equal fingerprints are
merged first, so copies cost one row. Fingerprints within the radius agree wholly on some blocks of bits, so each
goes into one bucket for every choice of blocks, more and longer ones the more fingerprints there are.
Within a bucket 64 rows form a block whose bits are stored as vertical planes; a query compares with
a whole block by one XOR a plane, feeding carry-save bitwise counters, and a (query, block) pair is
abandoned once every lane exceeds the radius. A bucket larger than ``tile`` rows is cut into tiles,
and every pair of tiles is a bucket of its own: no task holds a whole hot bucket and no link is lost.

A bucket emits a spanning star of each of its components, not all pairs. Components over all
bands come from rounds of minimum-neighbour hooking and pointer jumping on DataFrames, each round
written to the shared folder.

Defined cases: null or empty text has fingerprint zero and links like any other; fewer than three
words make one shingle; a null doc_id never becomes a component id unless all its members' ids are
null; long texts count whole, a part of their shingles in memory at a time; repeated rows stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import partitions, ship, staged

UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(UPPER).split() if text else []
    if not words:
        return 0
    width = min(3, len(words))
    line, n = b" ".join(words), len(words) - width + 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[width - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = [hashed(line[a:b], 42) for a, b in zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 rows: planes[b, k] has bit b of rows 64k to 64k+63."""
    n, words = fps.shape
    padded = np.zeros((-(-n // 64) * 64, words), dtype=np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _above(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bitwise counter, or its overflow, is above radius."""
    above, level = over.copy(), ~np.zeros_like(over)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            level &= counter[i]
        else:
            above |= level & counter[i]
            level &= ~counter[i]
    return above


def within(fps: np.ndarray, firsts: np.ndarray, ends: np.ndarray, radius: int, at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows i, j with firsts[i] <= j < ends[i] whose fingerprints differ in at most radius bits, in parts."""
    n, sliced = len(fps), planes(fps)
    row = np.arange(n)
    open_ = ends > firsts
    first, stop = firsts[open_] // 64, (ends[open_] - 1) // 64 + 1
    counts, at = stop - first, 0
    query, whole = row[open_], np.cumsum(counts)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    below = lambda m: np.where(m >= 64, full, (np.uint64(1) << np.minimum(m, np.uint64(63))) - np.uint64(1))
    while at < len(query):
        # as many queries as make at_once (query, block) pairs, one at least
        upto = max(at + 1, int(np.searchsorted(whole, (whole[at - 1] if at else 0) + at_once, "right")))
        c = counts[at:upto]
        q = np.repeat(query[at:upto], c)
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:upto], c)
        at = upto
        low = np.clip(firsts[q] - 64 * k, 0, 64).astype(np.uint64)
        high = np.clip(ends[q] - 64 * k, 0, 64).astype(np.uint64)
        alive = below(high) & ~below(low)
        counter = [np.zeros(len(q), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = np.zeros(len(q), dtype=np.uint64)
        for b in range(len(sliced)):
            bit = np.uint64(0) - (fps[q, b // 64] >> np.uint64(b % 64) & np.uint64(1))
            carry = sliced[b][k] ^ bit
            for i, plane in enumerate(counter):
                counter[i], carry = plane ^ carry, plane & carry
            over |= carry
            if b % 8 == 7:
                alive &= ~_above(counter, over, radius)
                keep = np.flatnonzero(alive)
                if not len(keep):
                    break
                if len(keep) < len(q):
                    q, k, alive, over = (x[keep] for x in (q, k, alive, over))
                    counter = [x[keep] for x in counter]
        else:
            bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(bits)
            yield q[i], 64 * k[i] + lane


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label: for each row its component's smallest row; merged over the links i, j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (jumped := label[label] != label).any():
            label[jumped] = label[label][jumped]


def by_bucket(work, at_once: int = ROWS_AT_ONCE):
    """Sorted rows (band, key, x, y, side, further columns) -> what work gives for whole buckets, many at a time.

    work gets the rows and the range of rows that each one is to be compared with: those after it in its
    bucket, or, where two tiles meet (x < y), those of the other tile.
    """

    def whole(rows: pa.Table) -> pa.RecordBatch:
        keys = np.stack([rows.column(c).to_numpy() for c in ("band", "key", "x", "y")], axis=1)
        side = rows.column("side").to_numpy()
        n = len(keys)
        change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        bounds = np.append(change, n)
        bucket = np.searchsorted(bounds, np.arange(n), "right")
        ends = bounds[bucket]
        firsts = np.arange(n) + 1
        apart = keys[:, 2] != keys[:, 3]
        if apart.any():
            other = np.zeros(len(bounds) + 1, dtype=np.int64)
            np.add.at(other, bucket, side == 0)
            other = np.append(0, bounds)[bucket] + other[bucket]  # where the bucket's second tile begins
            firsts = np.where(apart, np.where(side == 0, other, ends), firsts)
        return work(rows, firsts, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                held.append(part)
                size += part.num_rows
                if size >= at_once:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    same = np.ones(rows.num_rows, dtype=bool)
                    for c in ("band", "key", "x", "y"):
                        column = rows.column(c).to_numpy()
                        same &= column == column[-1]
                    open_ = int(np.argmax(same))  # the last bucket may go on
                    if open_:
                        yield whole(rows.slice(0, open_))
                        rows = rows.slice(open_)
                    held, size = rows.to_batches(), rows.num_rows
        if size:
            yield whole(pa.Table.from_batches(held).combine_chunks())

    return run


def bucket_stars(radius: int):
    """Buckets of (fp) -> links (a, b): each row's component star in its bucket."""

    def links(rows: pa.Table, firsts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        fps = rows.column("fp").to_numpy()
        label = np.arange(len(fps))
        for i, j in within(np.ascontiguousarray(fps).view(np.uint64)[:, None], firsts, ends, radius):
            label = joined(label, i, j)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[label[moved]]), pa.array(fps[moved])], names=["a", "b"])

    return by_bucket(links)


def tiled(banded: DataFrame, own: Column, tile: int, order: list[str]) -> DataFrame:
    """banded (band, key, further columns) dealt out by bucket; a bucket of over ``tile`` rows by pairs of its tiles.

    own: a hash that deals a row to a tile. x and y are the tiles that meet, side whether a row is of the second.
    """
    large = banded.groupBy("band", "key").agg(F.count("*").alias("m")).where(F.col("m") > tile)
    large = large.select(F.col("band").alias("_band"), F.col("key").alias("_key"), F.ceil(F.col("m") * 2 / tile).alias("_tiles"))
    cut = banded.join(large, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")), "left").withColumn("_own", F.pmod(own, "_tiles"))
    zero = F.lit(0).cast("long")
    pairs = F.when(F.col("_tiles").isNull(), F.array(F.struct(zero.alias("x"), zero.alias("y"), zero.alias("side")))).otherwise(
        F.transform(
            F.sequence(zero, F.col("_tiles") - 1),
            lambda t: F.struct(F.least(F.col("_own"), t).alias("x"), F.greatest(F.col("_own"), t).alias("y"), (t < F.col("_own")).cast("long").alias("side")),
        )
    )
    columns = [c for c in banded.columns if c not in ("band", "key")]
    rows = cut.select(F.col("band").cast("long").alias("band"), "key", F.explode(pairs).alias("p"), *columns)
    rows = rows.select("band", "key", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.side").alias("side"), *columns)
    return rows.repartition(partitions(banded.sparkSession), "band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y", "side", *order)


def tables(radius: int, rows: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (first bit, width) of every table's key: fingerprints within the radius agree on the whole key of one at least.

    The 64 bits are cut into blocks; all but ``radius`` of them agree, and every choice of so many blocks is a
    table. More blocks give longer keys: few enough are taken that a random bucket holds about 64 rows.
    """
    blocks = radius + 1
    while blocks < 2 * radius + 1 and rows > 64 << 64 * (blocks - radius) // blocks:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in chosen] for chosen in combinations(range(blocks), blocks - radius)]


def near_links(distinct: DataFrame, radius: int = 3, tile: int = 1024, rows: int | None = None) -> DataFrame:
    """distinct (fp) -> links (a, b) that span the same components as all pairs within the radius."""

    def key(ranges: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for at, width in ranges:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1))
        return out

    keys = F.array(*[key(r) for r in tables(radius, distinct.count() if rows is None else rows)])
    banded = distinct.select("fp", F.posexplode(keys).alias("band", "key"))
    return tiled(banded, F.xxhash64("fp", "band"), tile, ["fp"]).mapInArrow(bucket_stars(radius), "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, root): root is the smallest node of the component. Nodes without links are absent.

    Every round each node takes the smallest root among its neighbours' and its own, hooks the roots it
    joins, and jumps to its root's root; it ends when a round changes nothing.
    """
    edges = staged(links.distinct(), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    for _ in range(rounds):
        of = label.select(F.col("node").alias("b"), F.col("root").alias("other"))
        near = edges.join(of, "b").select("a", "other", "b").join(label.select(F.col("node").alias("a"), F.col("root").alias("mine")), "a")
        apart = near.where("mine != other").select(F.greatest("mine", "other").alias("hi"), F.least("mine", "other").alias("lo"))
        hook = staged(apart.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        if hook.isEmpty():
            return label
        hooked = label.join(hook, label["root"] == hook["hi"], "left").select("node", F.coalesce("lo", "root").alias("root"))
        hooked = staged(hooked, "roots")
        while True:
            up = hooked.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = staged(hooked.join(up, hooked["root"] == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("moved")), "roots")
            hooked = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        label = hooked
    raise RuntimeError("components: more rounds needed")


def near_duplicates(docs: DataFrame, radius: int = 3, tile: int = 1024) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (signed 64 bits), component_id: the smallest doc_id of its component."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = staged(rows.mapInArrow(fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius, tile))
    linked = roots.join(distinct, roots["node"] == distinct["fp"])
    groups = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = linked.join(groups, "root").select(F.col("fp").alias("_fp"), "component_id")
    classes = distinct.join(ids, distinct["fp"] == F.col("_fp"), "left").select(F.col("fp").alias("_of"), F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(classes, prints["fp"] == F.col("_of")).select("doc_id", "fp", "component_id")


def op3(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
