"""Near copies at a shingle similarity of 0.8: wide SimHash fingerprints compared in bit slices, links verified.

A text's shingles are its runs of five words (ASCII letters lowered; fewer words make one shingle). Two
documents are near copies when their shingle sets have a Jaccard similarity of 0.8 or more; groups are what such
links connect, and of each group the row with the smallest id stays. Texts of equal words are merged
first (by 64-bit digests), so copies cost one row.

At that similarity 64 bits differ in ten places, too many for bands of equal bits. So a fingerprint has
256 majority bits here, and buckets are made by 20 keys of 5 least shingle hashes: a pair of similarity 0.8 shares
one with probability 0.9996, one of 0.9 all but surely. Inside buckets, tiled where they are large, the
bit-sliced comparison of the SimHash operator finds the fingerprints within RADIUS bits (a pair of similarity 0.8
differs in 39 on average, with a deviation of 5.8). Only these are compared on their texts.

Not all pairs of a group are compared. First every text names its nearest neighbour and the one with the most
neighbours, the likely original, and what proves alike is joined. Then buckets that still hold several groups are
gone through with the texts' shingles at hand: pairs of different groups, nearest first, each in the first bucket
that it shares, until they are joined or told apart. Only what joins groups leaves a bucket, so no group is
spread out into pairs, and no pair within the radius that shares a bucket is passed over.

Defined cases: null and empty texts have no shingles and are copies of each other; null ids come last, a group
stays as null only if all its ids are null; of repeated rows one stays; long texts are hashed and compared
whole; ties go to the smaller digest; an empty table gives no rows; other columns, whatever their names, stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import ship, staged
from pathloom.llm.simhash import UPPER, by_bucket, components, tiled, within

WIDTH, SIMILAR = 5, 0.8
BITS, RADIUS = 256, 58
BANDS, ROWS = 20, 5
SHINGLES_AT_ONCE = 1 << 10
ROWS_AT_ONCE, PAIRS_AT_ONCE, TILE = 1 << 12, 1 << 13, 2048
#: Where shingles are at hand, a fewer rows at a time.
TILE_OF_SETS = 1024
_RANDOM = np.random.default_rng(11)
_TIMES = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_FLIP = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_PRINT = ["f0", "f1", "f2", "f3"]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(UPPER).split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    import xxhash

    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(WIDTH, len(words))
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64))


def _stirred(v: np.ndarray) -> np.ndarray:
    v = (v ^ v >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ v >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return v ^ v >> np.uint64(31)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """BITS majority bits: four 64-bit words, each from hashes of its own."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE, None] + np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ones += np.unpackbits(_stirred(part).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[None, at : at + SHINGLES_AT_ONCE] ^ _FLIP[:, None]
        part *= _TIMES[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    mixed = np.zeros(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        mixed = _stirred((mixed ^ column) * np.uint64(0x9E3779B97F4A7C15))
    return mixed.view(np.int64)


def node_of(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join(words), 7)


_SIGNED = "doc_id long, row long, node long, f0 long, f1 long, f2 long, f3 long, keys array<long>"


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints, keys = [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            found = shingles(words)
            nodes.append(node_of(words))
            prints.append(wide_print(found))
            keys.append(band_keys(found).tolist() if words else [])
        sides = np.array(prints, dtype=np.uint64).reshape(-1, BITS // 64).view(np.int64)
        node = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
        cols = [batch.column(0), batch.column(1), node, *(pa.array(np.ascontiguousarray(c)) for c in sides.T), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "node", *_PRINT, "keys"])


def pairs_within(rows: pa.Table, firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the rows that are to be compared and differ in at most RADIUS bits."""
    prints = np.ascontiguousarray(np.stack([rows.column(c).to_numpy() for c in _PRINT], axis=1)).view(np.uint64)
    found = [(np.zeros(0, dtype=np.int32),) * 3]
    for i, j in within(prints, firsts, ends, RADIUS, PAIRS_AT_ONCE):
        far = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1)
        found.append((i.astype(np.int32), j.astype(np.int32), far.astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found))


def named(rows: pa.Table, firsts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Buckets of (node, fingerprint) -> (a, b, far, many): a's nearest neighbour b and the one with the most neighbours, many."""
    node = rows.column("node").to_numpy()
    n = len(node)
    i, j, far = pairs_within(rows, firsts, ends)
    many = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    a, b, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])
    near, hub = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, dtype=np.int64)
    np.minimum.at(near, a, far.astype(np.int64) << 32 | b)
    np.maximum.at(hub, a, many[b] << 32 | b)
    own = np.flatnonzero(many)
    near, hub = near[own], hub[own]
    cols = [node[own], node[near & 0xFFFFFFFF], near >> 32, node[hub & 0xFFFFFFFF], hub >> 32]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "near", "far", "hub", "many"])


def jaccard_holds(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    few, more = (a, b) if len(a) < len(b) else (b, a)
    both = 0
    if len(few):
        at = np.searchsorted(more, few)
        at[at == len(more)] = 0
        both = int((more[at] == few).sum())
    return both >= SIMILAR * (len(a) + len(b) - both)


def told_apart(rows: pa.Table, firsts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Buckets of (node, label, fingerprint, keys, grams) -> links (a, b) that join the labels' groups."""
    node, label, band = (rows.column(c).to_numpy() for c in ("node", "label", "band"))
    keys = np.array(rows.column("keys").to_pylist(), dtype=np.int64).reshape(-1, BANDS)
    grams = rows.column("grams")
    i, j, far = pairs_within(rows, firsts, ends)
    apart = label[i] != label[j]
    i, j, far = i[apart], j[apart], far[apart]
    first = np.argmax(keys[i] == keys[j], axis=1) == band[i]  # the first bucket that the two share
    i, j, far = i[first], j[first], far[first]
    order = np.argsort(far, kind="stable")
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    sets: dict[int, np.ndarray] = {}
    a, b = [], []
    for k in order.tolist():
        x, y = int(i[k]), int(j[k])
        of_x, of_y = top(int(label[x])), top(int(label[y]))
        if of_x == of_y:
            continue
        for r in (x, y):
            if r not in sets:
                sets[r] = np.frombuffer(grams[r].as_buffer(), dtype=np.uint64)
        if jaccard_holds(sets[x], sets[y]):
            up[max(of_x, of_y)] = min(of_x, of_y)
            a.append(int(node[x]))
            b.append(int(node[y]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) -> the pairs that are near copies."""
    for batch in batches:
        keep, last, of_last = [], None, None
        for text, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if other != last or of_last is None:
                last, of_last = other, shingles(words_of(other))
            keep.append(jaccard_holds(shingles(words_of(text)), of_last))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shingles(words_of(t)).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "grams"])


def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [node_of(words_of(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), batch.column(0)], names=["node", "text"])


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes (_node), one text each."""
    texts = rows.select("text").mapInArrow(with_node, "node long, text string")
    return staged(texts.join(wanted, F.col("node") == F.col("_node"), "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")


def near_groups(rows: DataFrame, distinct: DataFrame) -> DataFrame | None:
    """rows (text), distinct (node, fingerprint, keys) -> (node, root) of every text that has a near copy; None: none has."""
    banded = distinct.select(F.posexplode("keys").alias("band", "key"), "node", *_PRINT)
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    banded = staged(banded.join(_renamed(shared.drop("m")), _same("band", "key"), "left_semi"), "buckets")
    dealt = tiled(banded, F.xxhash64("node", "band"), TILE, ["node"])
    calls = dealt.mapInArrow(by_bucket(named, ROWS_AT_ONCE), "a long, near long, far long, hub long, many long")
    # Of all buckets the nearest, and the hub with the most neighbours.
    calls = calls.groupBy("a").agg(F.min(F.struct("far", "near")).alias("n"), F.max(F.struct("many", "hub")).alias("h"))
    calls = calls.select("a", F.explode(F.array("n.near", "h.hub")).alias("b"))
    pairs = staged(calls.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return None
    texts = texts_of(rows, pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct())
    one = texts.select(F.col("node").alias("_a"), F.col("text").alias("mine"))
    two = texts.select(F.col("node").alias("_b"), F.col("text").alias("theirs"))
    compared = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("a", "b", "mine", "theirs")
    links = staged(compared.mapInArrow(alike, "a long, b long"), "links")
    roots = components(links)
    # Who has neighbours has named one, so the texts at hand are all that matter now.
    grams = texts.mapInArrow(grams_of, "node long, grams binary").join(_renamed(roots), _same("node"), "left")
    grams = grams.select("node", F.coalesce("_root", "node").alias("label"), "grams")
    grams = staged(grams.join(_renamed(distinct.select("node", "keys")), _same("node")).select("node", "label", "grams", F.col("_keys").alias("keys")), "grams")
    labelled = banded.join(_renamed(grams.select("node", "label")), _same("node")).select(*banded.columns, F.col("_label").alias("label"))
    open_ = labelled.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    labelled = labelled.join(_renamed(open_.select("band", "key")), _same("band", "key"), "left_semi")
    full = labelled.join(_renamed(grams.select("node", "keys", "grams")), _same("node")).select(*labelled.columns, F.col("_keys").alias("keys"), F.col("_grams").alias("grams"))
    dealt = tiled(full, F.xxhash64("node", "band"), TILE_OF_SETS, ["node"])
    more = staged(dealt.mapInArrow(by_bucket(told_apart, TILE_OF_SETS), "a long, b long"), "links")
    return roots if more.isEmpty() else components(links.union(more))


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])


def _same(*columns: str):
    return reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in columns])


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any columns): of every group of near copies one row, with the smallest id."""
    ship(docs.sparkSession)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")
    made = staged(rows.mapInArrow(signatures, _SIGNED), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    distinct = made.groupBy("node").agg(F.min(place).alias("place"), *[F.first(c).alias(c) for c in (*_PRINT, "keys")])
    distinct = staged(distinct, "distinct")
    roots = near_groups(rows, distinct)
    first = distinct.select("node", "place")
    if roots is not None:
        first = first.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        first = first.groupBy(F.coalesce("root", "node").alias("node")).agg(F.min("place").alias("place"))
    first = staged(first.select(F.col("place.id").alias("_id"), F.col("place.row").alias("_row")), "first")
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))) & (row == F.col("_row"))
    # Rows that are equal in every column: all but one go.
    times = made.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_i"), F.col("row").alias("_r"))
    first = first.join(times, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left").select("_id", "_row", F.col("_r").isNotNull().alias("_many"))
    first = staged(first, "first")
    once = docs.join(first.where("not _many"), same, "left_semi")
    return once.unionByName(docs.join(first.where("_many"), same, "left_semi").distinct())
