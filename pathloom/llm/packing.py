"""Mixture-controlled packing into fixed-length sequences.

Each source's tokens, in input order, are one stream, and every window (some whole sequences) takes from
each stream what its target proportion has earned by the window's end less what it was served: deficit
round-robin in closed form, over the whole table and not per task. With weights, a source that runs
out leaves its share to the others by weight; what has weight 0 comes last, by size. So windows don't
depend on how the table is laid out: any window of the stream holds the targets within a token a source.

A first pass writes blocks of token ids to the shared folder and counts each source's tokens per
partition; sums over partitions give a partition's place in each stream. The second pass cuts
documents where their stream enters the next window and deals the pieces out by window; a window's
pieces are spread over it by their place in their source's part, so that its sequences are mixed too.
Tokens get places 0, 1, 2, ... in window order; sequence k holds places 1024k to 1024k+1023, and the
last, partial sequence is split into powers of two, so nothing is padded.

Targets are the corpus proportions unless weights are given. Documents are cut freely.

Defined cases: null or empty text is one end id; a null source is a source, a null doc_id stays null;
repeated rows are packed each; documents longer than a block are cut over blocks; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import partitions, ship, ship_file, staged
from pathloom.llm.tokens import Encoder, crc

BLOCK = 1 << 19
IDS_AT_ONCE, PIECES_AT_ONCE = 1 << 20, 1 << 13
STAGE = "part long, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>, ats array<long>, sources array<string>, ids binary"
CUT = "window long, rank double, source string, at long, doc_id long, start long, doc_tokens long, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenized_blocks(path: str, end_id: int, block: int = BLOCK):
    """Blocks of documents' ids; ats: where a piece stands among its source's tokens in this partition."""
    schema = pa.schema([("part", pa.int64())] + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "starts", "lengths", "doc_tokens", "ats")] + [("sources", pa.list_(pa.string())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        kind, end = f"<u{encoder.width}", np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []
        held, so_far = 0, Counter()

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            ids = np.concatenate([r[6] for r in rows]).astype(kind).tobytes()
            cols = [[part], *([[r[i] for r in rows]] for i in range(6)), [ids]]
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for doc_id, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoder.encode_all(batch.column(2))):
                ids = np.frombuffer(data + end, dtype="<u4")
                at = 0
                while at < len(ids):
                    piece = ids[at : at + block - held]
                    rows.append((doc_id, at, len(piece), len(ids), so_far[source], source, piece))
                    so_far[source] += len(piece)
                    held, at = held + len(piece), at + len(piece)
                    if held == block:
                        yield flush()
        if rows:
            yield flush()

    return run


def tail(total: int, size: int) -> list[tuple[int, int, int]]:
    """(first place, length, sequence) of the last sequences: the rest of total by powers of two."""
    at, sequence, out = total - total % size, total // size, []
    while at < total:
        length = 1 << ((total - at).bit_length() - 1)
        out.append((at, length, sequence))
        at, sequence = at + length, sequence + 1
    return out


class Shares:
    """How many of each source's tokens the first windows hold. sizes: all tokens of each source."""

    def __init__(self, sizes: dict, weights: dict | None, window: int):
        self.sizes, self.window, self.total = sizes, window, sum(sizes.values())
        self.phases: list[tuple[Fraction, dict]] = []  # place from which on: source -> (tokens served by then, rate)
        at, left = Fraction(0), {s: Fraction(n) for s, n in sizes.items() if n}
        served = dict.fromkeys(left, Fraction(0))
        while left:
            weight = {s: Fraction((weights or sizes).get(s if not weights or s is not None else "", 0)) for s in left}
            if not sum(weight.values()):
                weight = {s: Fraction(sizes[s]) for s in left}
            whole = sum(weight.values())
            rate = {s: w / whole for s, w in weight.items()}
            self.phases.append((at, {s: (served[s], rate.get(s, Fraction(0))) for s in served}))
            span = min(left[s] / r for s, r in rate.items() if r)
            for s, r in rate.items():
                left[s], served[s] = left[s] - span * r, served[s] + span * r
            at, left = at + span, {s: n for s, n in left.items() if n}
        self.windows = -(-self.total // window)

    def before(self, source: str | None, k: int) -> int:
        """Tokens of source in the first k windows."""
        place = min(k * self.window, self.total)
        if place == self.total:
            return self.sizes[source]
        start, of = next(p for p in reversed(self.phases) if p[0] <= place)
        served, rate = of[source]
        return int(served + (place - start) * rate)  # rounds down: a window is short by less than a token a source

    def place(self, k: int) -> int:
        return sum(self.before(s, k) for s in self.sizes)

    def window_of(self, source: str | None, at: int) -> int:
        low, high = 0, self.windows - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.before(source, middle + 1) > at else (middle + 1, high)
        return low


def cut_blocks(shares: Shares, width: int):
    """Blocks with their partition's place in each source's stream -> pieces, each in one window."""

    def pieces(row: dict) -> Iterator[tuple]:
        base = {m["source"]: m["before"] for m in row["bases"]}
        open_: dict = {}  # source -> (window, its first and end token of the source)
        here = 0
        for doc_id, start, length, tokens, at, source in zip(*(row[c] for c in ("doc_ids", "starts", "lengths", "doc_tokens", "ats", "sources"))):
            at += base[source]
            while length:
                if source not in open_:
                    k = shares.window_of(source, at)
                    open_[source] = (k, shares.before(source, k), shares.before(source, k + 1))
                k, first, end = open_[source]
                if at >= end:
                    open_[source] = (k + 1, end, shares.before(source, k + 2))
                    continue
                n = min(length, end - at)
                rank = (at - first + n / 2) / (end - first)
                yield k, rank, source, at, doc_id, start, tokens, row["ids"][here * width : (here + n) * width]
                at, start, length, here = at + n, start + n, length - n, here + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("window", "rank", "source", "at", "doc_id", "start", "doc_tokens", "ids")
        types = [pa.int64(), pa.float64(), pa.string()] + [pa.int64()] * 4 + [pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                made = list(pieces(batch.slice(i, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    return run


def packed_windows(shares: Shares, size: int, width: int, with_ids: bool):
    """Pieces sorted by window and rank -> pieces of sequences."""
    last = tail(shares.total, size)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
    types = [pa.int64()] * 7 + [pa.string()]

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        *columns, ids = zip(*made)
        cols = [pa.array(c, t) for c, t in zip(columns, types)]
        if with_ids:
            ends = np.cumsum([0, *columns[2]]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
        return pa.RecordBatch.from_arrays(cols, names=[*names, *(["ids"] * with_ids)])

    def bounds(place: int) -> tuple[int, int, int]:
        if not last or place < last[0][0]:
            return place - place % size, size, place // size
        return next(x for x in reversed(last) if x[0] <= place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, place, made, size = -1, 0, [], 0
        for batch in batches:
            for k, source, doc_id, start, tokens, data in zip(*(batch.column(c).to_pylist() for c in ("window", "source", "doc_id", "start", "doc_tokens", "ids"))):
                if k != window:
                    window, place = k, shares.place(k)
                ids = np.frombuffer(data, dtype=f"<u{width}")
                while len(ids):
                    first, room, sequence = bounds(place)
                    own, ids = ids[: first + room - place], ids[first + room - place :]
                    made.append((doc_id, start, len(own), crc(own), tokens, sequence, place - first, source, own))
                    start, place, size = start + len(own), place + len(own), size + len(own)
                    if size >= IDS_AT_ONCE or len(made) >= PIECES_AT_ONCE:
                        yield batch_of(made)
                        made, size = [], 0
        if made:
            yield batch_of(made)

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = 1024, window_sequences: int = 64, weights: dict | None = None, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, source, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source[, ids].

    weights: target proportions by source (others: 0); without them, the corpus proportions.
    """
    spark = docs.sparkSession
    ship(spark)
    ship_file(spark, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    blocks = staged(rows.mapInArrow(tokenized_blocks(path, end_id, block), STAGE), "pack-blocks")
    by_source = blocks.select("part", F.explode(F.arrays_zip("sources", "lengths")).alias("x"))
    by_source = staged(by_source.groupBy("part", F.col("x.sources").alias("source")).agg(F.sum("x.lengths").alias("n")), "pack-sums")
    sizes = {r.source: r.n for r in by_source.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row a source
    shares = Shares(dict(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or ""))), weights, window_sequences * size)
    up = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = by_source.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    bases = bases.groupBy(F.col("part").alias("_part")).agg(F.collect_list(F.struct("source", "before")).alias("bases"))
    width = Encoder.of(path).width
    # A row a partition: the blocks need not move before they are cut.
    cut = blocks.join(F.broadcast(bases), F.col("part") == F.col("_part")).drop("_part").mapInArrow(cut_blocks(shares, width), CUT)
    dealt = cut.repartition(partitions(spark), "window").sortWithinPartitions("window", "rank", "source", "at")
    return dealt.mapInArrow(packed_windows(shares, size, width, with_ids), PIECE + ", ids array<int>" * with_ids)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), vocabulary("byte_bpe_50k.json"))
