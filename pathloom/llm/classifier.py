"""Quality classifier by positive-unlabelled learning.

Features of a text: relative frequencies of byte-class pairs (letters by case, digits, white space,
line ends and each kind of punctuation are classes), and its length, word lengths, repetition and
line statistics. A network of one hidden layer is fitted on the driver to minimise the non-negative
unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), whose second
part must not fall below zero; where it does, a step up its gradient is taken instead.

Trusted positives are labelled rows with quality 1; the unlabelled sample is web text of the training
folds regardless of labels. Both samples are bounded by documented parameters, chosen by smallest hash.
The class prior is estimated from the two samples alone: a first model separates positives from
unlabelled text, and the prior is the least ratio, over thresholds that keep enough held-back
positives, of the unlabelled share above a threshold to the positive share above it (with a margin).

Fold: crc32(doc_id as text) mod 3; the remainder 1 is held out and never learnt from. Labels, lang,
source and doc_id are no features.

Defined cases: null or empty text is scored by its (all zero) features; without positives every score
is 0; a null doc_id is not held out and not learnt from; of a repeated id one text is learnt from, and every row is
scored; long texts are scored whole; repeated rows stay; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import ship

POSITIVES, UNLABELLED = 4000, 12000
HIDDEN, STEPS, BATCH, RATE = 24, 1500, 512, 3e-3


def _classes() -> np.ndarray:
    out = np.full(256, 3, dtype=np.uint8)  # bytes of other scripts count as letters
    out[:32], out[127] = 0, 0
    for c in b" \t\x0b\x0c\r":
        out[c] = 1
    out[10] = 2
    out[97:123], out[65:91], out[48:58] = 3, 4, 5
    for k, group in enumerate((b".", b",", b"!?", b";:", b"\"'`", b"-_", b"()[]{}", b"#", b"$%", b"&", b"*+=", b"|", b"<>", b"/\\", b"@^~")):
        for c in group:
            out[c] = 6 + k
    return out


CLASS = _classes()
KINDS = 21
DENSE = 10
WIDTH = KINDS * KINDS + DENSE


def features(text: str | None) -> np.ndarray:
    out = np.zeros(WIDTH, dtype=np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    kind = CLASS[np.frombuffer(raw, dtype=np.uint8)].astype(np.int64)
    if len(kind) > 1:
        out[: KINDS * KINDS] = np.sqrt(np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS) / (len(kind) - 1))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:])))
    out[KINDS * KINDS :] = (
        np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, sizes.mean() / 10, sizes.std() / 10, sizes.max() ** 0.5 / 10,
        len(set(words)) / n, pairs / max(1, n - 1), len(set(lines)) / max(1, len(lines)), len(raw) / n / 10, (kind == 4).sum() / max(1, ((kind == 3) | (kind == 4)).sum()),
    )
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logits(m: Model, x: np.ndarray) -> np.ndarray:
    return np.tanh((x - m.mean) / m.scale @ m.w1 + m.b1) @ m.w2 + m.b2


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int = 5) -> Model:
    """Without a prior: plain positives against unlabelled, both of half the weight."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (pos - mean) / scale, (unl - mean) / scale
    theta = [rng.normal(0, WIDTH**-0.5, (pos.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ theta[0] + theta[1])
        s = sigmoid(h @ theta[2] + theta[3][0])
        # Sigmoid loss: its risk is bounded and symmetric; slope of the loss of label +1 is -s(1-s).
        slope, sp, su = s * (1 - s), s[:BATCH], s[BATCH:]
        if prior is None:
            g = np.concatenate([-(1 - sp), su]) / (2 * BATCH)  # logistic loss
        else:
            negative = su.mean() - prior * sp.mean()
            if negative >= 0:
                weights = np.concatenate([np.full(BATCH, -2 * prior), np.ones(BATCH)])
            else:  # undo the overfit: climb the part that fell below zero
                weights = np.concatenate([np.full(BATCH, prior), -np.ones(BATCH)])
            g = weights * slope / BATCH
        back = np.outer(g, theta[2]) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * theta[0], back.sum(0), h.T @ g + 1e-4 * theta[2], np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            theta[i] = theta[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior or 0.5)


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in unlabelled text, by the best bin of held-back scores."""
    a, b = pos[::2], unl[::2]
    m = fit(a, b, None)
    sp, su = np.sort(logits(m, pos[1::2])), np.sort(logits(m, unl[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    cut = sp[: max(1, len(sp) * 19 // 20)]  # thresholds that keep a twentieth of the positives or more
    above_p, above_u = 1 - np.searchsorted(sp, cut) / len(sp), 1 - np.searchsorted(su, cut) / len(su)
    margin = np.sqrt(np.log(4 / 0.1) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fold(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "x"])


def collected(docs: DataFrame, ids: list[int]) -> np.ndarray:
    """Features of the documents of these ids, a bounded list, in doc_id order; of a repeated id the text with the smallest hash."""
    if not ids:
        return np.zeros((0, WIDTH))
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "_id long"))
    own = docs.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "text")
    one = own.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = sorted(one.mapInArrow(feature_rows, "doc_id long, x binary").collect())
    return np.array([np.frombuffer(r.x, dtype=np.float32) for r in rows], dtype=np.float64).reshape(-1, WIDTH)


def risk(m: Model, pos: np.ndarray, unl: np.ndarray) -> tuple[float, float]:
    """(risk of the positives as such, risk of the negatives): both parts of the unbiased risk under the sigmoid loss.

    Fitting takes the second as no less than zero.
    """
    p, u = sigmoid(logits(m, pos)), sigmoid(logits(m, unl))
    return float(m.prior * (1 - p).mean()), float(u.mean() - m.prior * p.mean())


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """docs (doc_id, text), labels (doc_id, quality); both samples come from the training folds."""
    ship(docs.sparkSession)
    smallest = lambda df, n: [r[0] for r in df.select(F.col("doc_id").cast("long").alias("doc_id")).where((fold() != 1) & F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    trusted = smallest(labels.where("quality = 1"), positives)
    web = smallest(docs, unlabelled)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    x = collected(own, trusted)
    u = collected(own, web)
    if len(x) < 2 or len(u) < 2:
        return None
    prior = estimated_prior(x, u)
    return fit(x, u, prior)


def scored(m: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], dtype=np.float64).reshape(-1, WIDTH)
            s = sigmoid(logits(m, x)) if m and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored(model), "doc_id long, score double")
    return rows.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, train(docs, labels))
