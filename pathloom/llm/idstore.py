"""Content-addressed store of token-id streams.

A document's ids (with its end id) are cut where a rolling hash of the last ids meets a mask, so equal
passages give equal chunks wherever they stand. A chunk is named by the BLAKE2b digest of its bytes
and stored once. A document's recipe lists its chunk names, lengths and their Merkle root; recipe
files hold documents in ascending doc_id order, and the manifest has a Merkle root for every recipe
file and one over all of them.

Layout under the store's path (Parquet, any store that Spark reads and writes):
``objects`` (chunks: name, data, ids as little-endian integers of ``width`` bytes; recipes in no order),
``recipes`` (part, pos, doc_id, n_tokens, offset in the part, root, names, lengths), ``manifest`` (part,
docs, tokens, root; the row of part -1 counts the parts' documents and tokens and has the root of their
roots).

Reading verifies everything and raises StoreError, or fails the Spark job, where a part, recipe or chunk is
missing, altered or twice there: the top root must come from the parts' rows, each part's row from its
recipes in order, each recipe's root from its names, each chunk's name from its bytes, each
document's length from its chunks.

Defined cases: null or empty text is one end id; a null doc_id comes first; repeated rows are
documents of their own, ordered by doc_id and root; long texts are cut whole, at most MOST ids a chunk; an
empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import fresh_path, partitions, ship, ship_file
from pathloom.llm.packing import vocabulary
from pathloom.llm.tokens import Encoder

#: REACH: a power of two, at most LEAST.
REACH, LEAST, MOST, MASK = 16, 128, 4096, (1 << 9) - 1
BYTES_AT_ONCE, SEEN = 4 << 20, 50_000
_GEAR = np.random.default_rng(7).integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_CUT = "deal long, kind string, name binary, data binary, doc_id long, n_tokens long, names array<binary>, lengths array<long>"
_CUT_ARROW = pa.schema([("deal", pa.int64()), ("kind", pa.string()), ("name", pa.binary()), ("data", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64()))])
_OBJECT = _CUT.removeprefix("deal long, ")
_RECIPE = "part long, pos long, doc_id long, n_tokens long, offset long, root binary, names array<binary>, lengths array<long>"
_RECIPE_ARROW = pa.schema([("part", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("root", pa.binary()), ("names", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64()))])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class StoreError(ValueError):
    """What is stored is not what was written."""


class Tree:
    """Merkle root of a stream of leaves: a binary tree where a node without a partner moves up. Holds a node a level."""

    def __init__(self):
        self.open: list[tuple[int, bytes]] = []  # (level, node), levels falling

    def add(self, leaf: bytes) -> None:
        level, node = 0, digest(b"\0" + leaf)
        while self.open and self.open[-1][0] == level:
            node, level = digest(b"\1" + self.open.pop()[1] + node), level + 1
        self.open.append((level, node))

    def root(self) -> bytes:
        nodes = [node for _, node in self.open]
        if not nodes:
            return digest(b"")
        made = nodes.pop()
        while nodes:
            made = digest(b"\1" + nodes.pop() + made)
        return made


def merkle(leaves: list[bytes]) -> bytes:
    tree = Tree()
    for x in leaves:
        tree.add(x)
    return tree.root()


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last REACH ids meets the mask: the sum of their gears, each shifted by its age."""
    rolled = _GEAR[ids & np.uint32(0xFFF)] * (ids.astype(np.uint64) + np.uint64(1))
    reach = 1
    while reach < REACH:  # a sum over 2k ids is that over the last k and, shifted, over the k before
        rolled[reach:] += rolled[:-reach] << np.uint64(reach)
        reach *= 2
    return np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def cuts(found: list[int], n: int) -> list[int]:
    """Ends of a document's chunks of LEAST to MOST ids (the last may be shorter), at marks where it has them."""
    if n <= LEAST:
        return [n]
    out, last = [], 0
    for mark in [*found, n]:
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark - last >= LEAST or (mark == n and mark > last):
            last = mark
            out.append(last)
    return out


def tokenized(path: str, end_id: int):
    """Recipe rows and chunk rows, most of a task's repeated chunks left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.of(path), set()
        width, kind, end = encoder.width, f"<u{encoder.width}", np.array([end_id], dtype="<u4").tobytes()

        def made(doc_ids: list, streams: list[bytes]) -> pa.RecordBatch:
            """Documents are cut together: no cut looks back over a document's first LEAST ids, REACH or more."""
            ids = np.frombuffer(b"".join(streams), dtype="<u4")
            sizes = np.fromiter(map(len, streams), dtype=np.int64, count=len(streams)) // 4
            firsts = np.cumsum(sizes) - sizes
            found = marks(ids)
            bounds = np.searchsorted(found, np.append(firsts, len(ids)), "right").tolist()
            short, rows = ids.astype(kind).tobytes(), []
            for k, (doc_id, first, n) in enumerate(zip(doc_ids, firsts.tolist(), sizes.tolist())):
                names, lengths, at = [], [], 0
                for stop in cuts((found[bounds[k] : bounds[k + 1]] - first).tolist(), n):
                    data = short[(first + at) * width : (first + stop) * width]
                    names.append(name := digest(data))
                    lengths.append(stop - at)
                    at = stop
                    if name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        rows.append((int.from_bytes(name[:8], "little", signed=True), "chunk", name, data, None, None, None, None))
                root = merkle(names)
                deal = int.from_bytes(digest(f"{doc_id}".encode() + root)[:8], "little", signed=True)
                rows.append((deal, "recipe", root, None, doc_id, n, names, lengths))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT_ARROW)], schema=_CUT_ARROW)

        doc_ids, streams, size = [], [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                doc_ids.append(doc_id)
                streams.append(data + end)
                size += len(streams[-1])
                if size >= BYTES_AT_ONCE:
                    yield made(doc_ids, streams)
                    doc_ids, streams, size = [], [], 0
        if streams:
            yield made(doc_ids, streams)

    return run


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted recipes of a part and sum their tokens."""
    part, pos, offset = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = np.asarray(batch.column("n_tokens").to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = offset + np.cumsum(n)
        cols = [pa.array(np.full(len(n), part)), pa.array(np.arange(pos, pos + len(n))), batch.column("doc_id"), batch.column("n_tokens"), pa.array(ends - n), batch.column("name"), batch.column("names"), batch.column("lengths")]
        pos, offset = pos + len(n), int(ends[-1]) if len(n) else offset
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _RECIPE_ARROW)], schema=_RECIPE_ARROW)


_MANIFEST = "part long, docs long, tokens long, root binary"


def manifest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part, from recipes sorted by part and pos."""
    part, docs, tokens, tree = None, 0, 0, Tree()

    def row() -> pa.RecordBatch:
        cols = {"part": part, "docs": docs, "tokens": tokens}
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in cols.items()} | {"root": pa.array([tree.root()], pa.binary())})

    for batch in batches:
        for own, pos, offset, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "pos", "offset", "n_tokens", "root"))):
            if part is not None and own != part:
                yield row()
            if own != part:
                part, docs, tokens, tree = own, 0, 0, Tree()
            if (pos, offset) != (docs, tokens):
                raise StoreError(f"part {part}: the recipe at {docs} is missing or out of place")
            tree.add(root)
            docs, tokens = docs + 1, tokens + n
    if part is not None:
        yield row()


def manifest_of(recipes: DataFrame) -> DataFrame:
    sorted_ = recipes.select("part", "pos", "offset", "n_tokens", "root").repartition(partitions(recipes.sparkSession), "part").sortWithinPartitions("part", "pos")
    return sorted_.mapInArrow(manifest_rows, _MANIFEST)


def top_of(manifest: list) -> tuple[int, int, int, bytes]:
    """The manifest's own row, from its parts' rows: one a recipe file."""
    rows = sorted(manifest, key=lambda r: r.part)
    return -1, sum(r.docs for r in rows), sum(r.tokens for r in rows), merkle([bytes(r.root) for r in rows])


def write_store(docs: DataFrame, store: str, path: str, end_id: int = 1) -> None:
    """docs (doc_id, text) -> objects, recipes and manifest under the folder ``store``."""
    spark = docs.sparkSession
    ship(spark)
    ship_file(spark, path)
    n = partitions(spark)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenized(path, end_id), _CUT)
    # deal is the start of a chunk's name: a number, which Spark compares fast. Tasks have left few copies of a name.
    copy = F.row_number().over(W.partitionBy("deal", "name", "kind").orderBy("doc_id"))
    unique = cut.repartition(n, "deal").withColumn("copy", copy).where("kind = 'recipe' or copy = 1").drop("deal", "copy")
    unique.write.option("compression", "snappy").parquet(f"{store}/objects")
    recipes = spark.read.schema(_OBJECT).parquet(f"{store}/objects").where("kind = 'recipe'").select("doc_id", "n_tokens", "name", "names", "lengths")
    recipes = recipes.repartitionByRange(n, "doc_id", "name").sortWithinPartitions("doc_id", "name")
    recipes.mapInArrow(placed, _RECIPE).write.option("compression", "zstd").parquet(f"{store}/recipes")
    parts = manifest_of(read_recipes(spark, store)).collect()
    rows = [*map(tuple, parts), top_of(parts)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{store}/manifest")


def read_chunks(spark, store: str) -> DataFrame:
    return spark.read.schema(_OBJECT).parquet(f"{store}/objects").where("kind = 'chunk'").select("name", "data")


def read_recipes(spark, store: str) -> DataFrame:
    return spark.read.schema(_RECIPE).parquet(f"{store}/recipes")


def checked_manifest(spark, store: str) -> list:
    """The manifest's rows of the parts, after its own root and the recipes have been held against them."""
    kept = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest").collect()  # a row a recipe file
    top, parts = [r for r in kept if r.part == -1], [r for r in kept if r.part != -1]
    if [(r.part, r.docs, r.tokens, bytes(r.root)) for r in top] != [top_of(parts)]:
        raise StoreError("the manifest's rows don't give its root")
    found = {r.part: (r.docs, r.tokens, bytes(r.root)) for r in manifest_of(read_recipes(spark, store)).collect()}
    if found != {r.part: (r.docs, r.tokens, bytes(r.root)) for r in parts}:
        raise StoreError("the recipes don't give the manifest's roots")
    return parts


def verified(width: int):
    """Chunks read back: name, ids, crc32 of the ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, datas = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(digest(d) != n for n, d in zip(names, datas)):
                raise StoreError("a chunk's bytes don't give its name")
            crcs = [zlib.crc32(np.frombuffer(d, dtype=f"<u{width}").astype("<u4").tobytes()) for d in datas]
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.binary()), "n": pa.array([len(d) // width for d in datas], pa.int64()), "crc": pa.array(crcs, pa.int64())})

    return run


def _zeros_tables() -> list[np.ndarray]:
    """For each k the map of a crc32 over 2**k zero bytes, as four tables of 256."""

    def over(step: np.ndarray, v: np.ndarray) -> np.ndarray:
        return step[0][v & 255] ^ step[1][v >> 8 & 255] ^ step[2][v >> 16 & 255] ^ step[3][v >> 24]

    byte = np.arange(256, dtype=np.uint32)
    shift = np.zeros(256, dtype=np.uint32)
    v = byte.copy()
    for _ in range(8):
        v = np.where(v & 1, v >> 1 ^ np.uint32(0xEDB88320), v >> 1).astype(np.uint32)
    shift = v  # one zero byte after the lowest byte
    one = np.stack([shift, byte, byte << np.uint32(8), byte << np.uint32(16)]).astype(np.uint32)
    out = [one]
    for _ in range(47):
        last = out[-1]
        out.append(np.stack([over(last, last[k]) for k in range(4)]))
    return out


_ZEROS = _zeros_tables()


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc32 adds to that of a longer string when n_bytes more bytes follow."""
    v, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    k = 0
    while (n >> k).any():
        t = _ZEROS[k]
        moved = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
        v = np.where(n >> k & 1, moved, v).astype(np.uint32)
        k += 1
    return v.astype(np.int64)


def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        add = crc_shifted(batch.column("crc").to_numpy(), batch.column("after").to_numpy() * 4)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), batch.column("n"), pa.array(add)], names=["part", "pos", "n", "crc"])


def uses_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes -> a row for each chunk they name: its length and the ids of the document after it."""
    for batch in batches:
        names, lengths = batch.column("names"), batch.column("lengths")
        counts = np.diff(names.offsets.to_numpy())
        size = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if (counts != np.diff(lengths.offsets.to_numpy())).any():
            raise StoreError("a recipe has not as many lengths as names")
        flat, row = names.flatten().to_pylist(), np.repeat(np.arange(len(counts)), counts)
        stops = np.cumsum(counts)
        ends = np.cumsum(size)
        whole = np.concatenate([[0], ends])[stops] if len(counts) else np.zeros(0, dtype=np.int64)
        if (np.diff(whole, prepend=0) != batch.column("n_tokens").to_numpy(zero_copy_only=False)).any():
            raise StoreError("a recipe's lengths don't give its document's")
        for stop, n, root in zip(stops.tolist(), counts.tolist(), batch.column("root").to_pylist()):
            if merkle(flat[stop - n : stop]) != root:
                raise StoreError("a recipe's chunk names don't give its root")
        cols = [batch.column("part").take(pa.array(row)), batch.column("pos").take(pa.array(row)), names.flatten(), pa.array(size), pa.array(whole[row] - ends)]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "pos", "name", "length", "after"])


def read_store(spark, store: str, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, from the stored files, verified.

    Chunks are joined by name to where recipes use them; a document's crc32 is the xor of its chunks'
    crc32, each carried over the ids after it, so no task needs a whole group of copies.
    """
    ship(spark)
    ship_file(spark, path)
    parts = checked_manifest(spark, store)
    recipes = read_recipes(spark, store)
    info = read_chunks(spark, store).mapInArrow(verified(Encoder.of(path).width), "name binary, n long, crc long")
    uses = recipes.select("part", "pos", "n_tokens", "root", "names", "lengths").mapInArrow(uses_of, "part long, pos long, name binary, length long, after long")
    found = uses.join(info.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left")
    whole = F.when(F.col("n").eqNullSafe(F.col("length")), F.col("n")).otherwise(F.raise_error(F.lit("a chunk is missing or not as long as its recipe says")))
    parts_of = found.select("part", "pos", "after", whole.cast("long").alias("n"), "crc").mapInArrow(shifted, "part long, pos long, n long, crc long")
    sums = parts_of.groupBy("part", "pos").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("n_chunks"))
    rows, base = [], 0
    for r in sorted(parts, key=lambda r: r.part):
        rows.append((r.part, base))
        base += r.tokens
    bases = F.broadcast(spark.createDataFrame(rows, "part long, base long"))  # a row a recipe file
    out = recipes.select("part", "pos", "doc_id", "offset", "n_tokens").join(sums, ["part", "pos"], "left").join(bases, "part", "left")
    whole = F.when(F.col("n").eqNullSafe(F.col("n_tokens")), F.col("n")).otherwise(F.raise_error(F.lit("chunks don't add up to a document")))
    return out.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), whole.cast("long").alias("n_tokens"), "ids_crc32", "n_chunks")


def rebuild(spark, store: str, path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents (of repeated ids the first), joined from their verified chunks."""
    checked_manifest(spark, store)
    width = Encoder.of(path).width
    wanted = {r.doc_id: r for r in read_recipes(spark, store).where(F.col("doc_id").isin(doc_ids)).orderBy(F.desc("part"), F.desc("pos")).collect()}
    names = {bytes(x) for r in wanted.values() for x in r.names}
    rows = read_chunks(spark, store).join(F.broadcast(spark.createDataFrame([(x,) for x in names], "_name binary")), F.col("name") == F.col("_name"), "left_semi").collect()
    data = {bytes(r.name): bytes(r.data) for r in rows}
    out = {}
    for k, r in wanted.items():
        own = [data.get(bytes(x)) for x in r.names]
        if merkle([bytes(x) for x in r.names]) != bytes(r.root) or any(d is None or digest(d) != bytes(x) for d, x in zip(own, r.names)):
            raise StoreError(f"document {k} can't be rebuilt from what is stored")
        out[k] = np.frombuffer(b"".join(own), dtype=f"<u{width}").astype(np.uint32)
    return out


def op7(spark, sf_dir: str) -> DataFrame:
    store, path = fresh_path(spark, "id-store"), vocabulary("word_bpe_49k.json")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), store, path)
    return read_store(spark, store, path)
