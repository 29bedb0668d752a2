"""Secret scans: named patterns, and a randomness test battery for what has no pattern.

Patterns (assign, access, hex) are found leftmost and non-overlapping per kind; matches that fail
their length are dropped afterwards. Every other run of 20 or more characters of the Base64 alphabets
is a candidate: its encoding (digits, hex, letters, Base32, letters and digits, Base64) is inferred from the
characters it uses, and a chi-squared test of uniformity over that alphabet, a runs test about the
alphabet's middle and a lag-1 serial-correlation test are combined by Fisher's method. Below ALPHA the run
is no random string of its encoding.

What the battery does not tell from random may still be text by chance, short runs above all. So a
candidate's p-value is the chance that writing looks as random: writing is modelled by letter frequencies
and by how often it changes between small letters, capitals, digits and signs, and as a likelihood ratio
against a model exceeds r with a chance of 1 / r at most, the p-value is the model's likelihood over that of a uniform
string of the encoding. It depends on the run alone, never on the corpus. The Benjamini-Hochberg step
over the candidates of all distinct texts, within each length class, flags at the false-discovery rate
``rate``. Digits alone are as likely in writing as at random, and are never flagged.

Texts are read once: candidates with their levels are written to the shared folder, counted by length class
and level (a table of fixed size; copies count once) and decided from there.

Spans are code points, end exclusive. A candidate that overlaps a pattern's span gives way.

Defined cases: null or empty text has no spans; long texts are scanned whole; a null doc_id stays null;
repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import ship, staged

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "random")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", LOWER + "234567",
    DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_",
)
_SETS = [(frozenset(a), {c: i for i, c in enumerate(a)}) for a in ENCODINGS]
_ANY = {c: i for i, c in enumerate(UPPER + LOWER + DIGITS + "+/-_")}
LENGTHS = (20, 24, 32, 48, 64, 128)
LEVELS = 256
ALPHA = 0.001
#: Letters of English text, in percent.
FREQUENCY = dict(zip(LOWER, (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)))
#: Other languages write often what English hardly does.
RAREST = 0.5
#: How writing goes on after a small letter, capital, digit or sign: to one of these, in this order.
GOES_ON = ((0.85, 0.05, 0.03, 0.07), (0.40, 0.50, 0.04, 0.06), (0.01, 0.01, 0.97, 0.01), (0.50, 0.20, 0.15, 0.15))


def _kind(c: str) -> int:
    return 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3


def _written() -> dict[str, float]:
    """Bits of a character, its kind given."""
    whole = sum(FREQUENCY.values())
    out = {c: -math.log2(max(f, RAREST) / whole) for c, f in FREQUENCY.items()}
    return out | {c.upper(): v for c, v in out.items()} | dict.fromkeys(DIGITS, math.log2(10)) | dict.fromkeys("+/_=-", math.log2(5))


_BITS = _written()
_TURN = [[-math.log2(p) for p in row] for row in GOES_ON]


def tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> dict[str, int]:
    """The smallest alphabet that has all characters of the token; padding signs belong to none."""
    used = set(token)
    return next((i for s, i in _SETS if used <= s), _ANY)


def randomness(token: str) -> float:
    """Combined p-value of the battery: uniform for random strings of the inferred encoding, tiny for text."""
    index = encoding(token)
    k, x = len(index), [index[c] for c in token if c in index]
    n = len(x)
    if n < 2:
        return 0.0
    expected = n / k
    chi = sum(c * c for c in Counter(x).values()) / expected - n
    uniform = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [v * 2 >= k for v in x]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * up * down / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        even = 2 * tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        even = 2.0 ** (1 - n)
    middle = sum(x) / n
    var = sum((v - middle) ** 2 for v in x)
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:])) / var if var else 1.0
    apart = 2 * tail(abs(serial + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, even, apart))
    return math.exp(-half) * (1 + half + half * half / 2)


def level(token: str) -> int:
    """-log2 of the chance that writing looks as random, rounded down; 0 where the battery finds it not random."""
    kinds = [_kind(c) for c in token]
    written = 2.0 + sum(map(_BITS.__getitem__, token)) + sum(_TURN[a][b] for a, b in zip(kinds, kinds[1:]))
    index = encoding(token)
    more = written - len(token) * math.log2(len(index))
    if more < 1 or len(index) == len(DIGITS) or randomness(token) < ALPHA:
        return 0
    return min(LEVELS - 1, int(more))


def length_class(n: int) -> int:
    return sum(n >= b for b in LENGTHS[1:])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, level) of runs that no pattern's span overlaps."""
    out, starts = [], [s for s, _, _ in base]
    reach = list(accumulate((e for _, e, _ in base), max))  # how far the spans up to each one go
    for m in _CANDIDATE.finditer(text):
        token = m[0]
        before = bisect_left(starts, m.end())
        if not (before and reach[before - 1] > m.start()):
            out.append((m.start(), m.end(), length_class(len(token)), level(token)))
    return out


_ROW = "doc_id long, base array<struct<s:long,e:long,k:string>>, open array<struct<s:long,e:long,c:long,v:long>>, text_key binary"
_BASE = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.string())]))
_OPEN = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("c", pa.int64()), ("v", pa.int64())]))


def scanned(text: str | None) -> tuple:
    """Base spans, candidates, and where there are any the text's digest."""
    text = text or ""
    base = base_spans(text)
    found = candidates(text, base)
    key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest() if found else None
    return [dict(zip("sek", x)) for x in base], [dict(zip("secv", x)) for x in found], key


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = list(zip(*map(scanned, batch.column("text").to_pylist()))) or [[]] * 3
        made = [pa.array(c, t) for c, t in zip(cols, (_BASE, _OPEN, pa.binary()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "base", "open", "text_key"])


def thresholds(counted: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """(length class, level, candidates) rows -> the lowest flagged level of each class (LEVELS: none), by Benjamini-Hochberg."""
    out = {}
    for cls in range(len(LENGTHS)):
        own = np.zeros(LEVELS)
        for c, v, n in counted:
            if c == cls:
                own[v] += n
        rank = np.cumsum(own[::-1])[::-1]  # candidates of this level or above
        passed = np.flatnonzero((own > 0) & (2.0 ** -np.arange(LEVELS) <= rate * rank / max(own.sum(), 1)))
        out[cls] = int(passed[0]) if len(passed) else LEVELS
    return out


def decided(found: DataFrame, rate: float) -> DataFrame:
    """found (as scan() gives, staged) with spans: base and flagged, by start and kind."""
    codes = F.transform("open", lambda x: (x["c"] * LEVELS + x["v"]).cast("int")).alias("codes")
    single = found.where("text_key is not null").select("text_key", codes).dropDuplicates(["text_key"])
    rows = single.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()  # at most 6 * 256 rows
    top = thresholds([(*divmod(r.code, LEVELS), r.n) for r in rows], rate)
    lowest = F.array(*[F.lit(top[c]) for c in range(len(LENGTHS))])
    flagged = F.filter("open", lambda x: x["v"] >= F.element_at(lowest, (x["c"] + 1).cast("int")))
    extra = F.transform(flagged, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("random").alias("k")))
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda x: F.struct(x["s"], sum((F.when(x["k"] == k, i).otherwise(0) for k, i in rank.items()), F.lit(0)).alias("r"), x["e"], x["k"])
    spans = F.array_sort(F.transform(F.concat("base", extra), order))
    return found.withColumn("spans", spans)


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """docs (any columns, text among them) with base, open and spans (s, e, k), which replace columns of these names."""
    ship(docs.sparkSession)
    made = T.StructType.fromDDL(_ROW).fields[1:]
    rest = docs.drop("spans", *(f.name for f in made))
    schema = T.StructType([*rest.schema.fields, *made])
    return decided(staged(rest.mapInArrow(scan, schema), "secrets"), rate)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ship(spark)
    light = lambda batches: (b.select(["doc_id", "base", "open", "text_key"]) for b in scan(batches))
    found = decided(staged(docs.mapInArrow(light, _ROW), "secrets"), 0.01)
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their spans replaced by <KIND>; overlapping spans by one mark."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            if text and spans:
                out, at = [], 0
                for s in spans:
                    if s["s"] >= at:
                        out += [text[at : s["s"]], f"<{s['k'].upper()}>"]
                    at = max(at, s["e"])
                text = "".join([*out, text[at:]])
            texts.append(text)
        i = batch.schema.get_field_index("text")
        cols = [pa.array(texts, pa.string()) if k == i else c for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).drop_columns(["spans"])


def masked(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """docs with every secret in text replaced; all documents and columns stay, whatever their names."""
    others = [c for c in docs.columns if c != "text"]
    held = docs.select("text", F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"))
    found = find_secrets(held, rate).select("text", "rest", "spans")
    out = found.mapInArrow(masks, held.schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns])
