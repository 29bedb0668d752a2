"""Quality rules as a short-circuit cascade.

Every rule rejects by statistics that a document computes when they are first asked for. On a
bounded sample (the documents with the smallest hashes) each rule's cost in seconds and the share it
rejects of what earlier rules leave are measured, and rules run in the order of rejections per cost; the
first rejection ends a document's cascade. The order changes what is computed, never the verdict: a document is kept if no
rule rejects it.

Defined cases: null or empty text has no words and fails; long texts are judged whole; repeated rows stay; a null doc_id stays
null; an empty table gives no rows (rules then keep their given order); other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import WORD, ship

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SAMPLE = 512


class Document:
    """Statistics of one text, each computed at its first use."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # at the six ASCII white-space characters

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_upper(self) -> int:
        return int(self.letters[65:91].sum())

    @cached_property
    def letters(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)

    @cached_property
    def n_ascii_letters(self) -> int:
        return self.n_upper + int(self.letters[97:123].sum())

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that occur twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        number = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        ids = np.fromiter(map(number.__getitem__, self.words), dtype=np.int64, count=n)
        size = len(number)
        pair = ids[:-1] * size + ids[1:]
        if size >= 1 << 21:  # keep the codes within 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        windows = pair[:-1] * size + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        return int(covered.sum())


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Document], bool]


RULES = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repetition", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    Rule("symbols", lambda d: 100 * d.n_symbols > 25 * d.n_words),
    Rule("repeated_lines", lambda d: d.n_dup_lines > 3 and 100 * d.n_dup_lines > 30 * len(d.lines)),  # a short text may repeat a line
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("shouting", lambda d: 100 * d.n_upper > 50 * d.n_ascii_letters),
)
BASE = ("few_words", "repetition")


def measured(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[list[tuple[str, float, float]], dict[str, set[int]]]:
    """(name, seconds a document, share rejected) of each rule on a sample, and whom it rejects; every rule meets fresh documents."""
    out, whom = [], {}
    for rule in rules:
        fresh = [Document(t) for t in texts]
        began = time.perf_counter()
        said = list(map(rule.rejects, fresh))
        out.append((rule.name, (time.perf_counter() - began) / max(1, len(fresh)), sum(said) / max(1, len(fresh))))
        whom[rule.name] = {i for i, x in enumerate(said) if x}
    return out, whom


def ordered(figures: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES, whom: dict[str, set[int]] | None = None) -> tuple[Rule, ...]:
    """By rejections per cost, highest first. With whom, a rule's rejections are those that the rules before it leave."""
    cost = {name: max(c, 1e-9) for name, c, _ in figures}
    if not whom:
        rank = {name: share / cost[name] for name, _, share in figures}
        return tuple(sorted(rules, key=lambda r: -rank.get(r.name, 0.0)))
    out, left, gone = [], list(rules), set()
    while left:
        best = max(left, key=lambda r: len(whom[r.name] - gone) / cost[r.name])  # the first of equals
        left.remove(best)
        out.append(best)
        gone |= whom[best.name]
    return tuple(out)


def planned(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The order that a sample of texts suggests."""
    figures, whom = measured(texts, rules)
    return ordered(figures, rules, whom)


def sample(docs: DataFrame, size: int = SAMPLE) -> list[str | None]:
    """Texts of at most ``size`` documents: those with the smallest id hashes, found without their texts."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    chosen = [r[0] for r in ids.collect() if r[0] is not None]
    return [r[0] for r in docs.where(F.col("doc_id").isin(chosen)).select("text").limit(size).collect()] if chosen else []


def cascade(order: tuple[Rule, ...], figures: bool):
    """Rows (doc_id, text) -> verdicts; with figures, the statistics of the base rules as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                d = Document(text)
                first = next((r.name for r in order if r.rejects(d)), None)
                base = first in BASE
                if first and not base and figures:
                    base = any(r.rejects(d) for r in order if r.name in BASE)
                rows.append((first is None, base, first) + ((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words) if figures else ()))
            cols = list(zip(*rows)) or [[]] * (8 if figures else 3)
            names = ["kept", "base_failed", "rejected_by", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"][: len(cols)]
            types = [pa.bool_(), pa.bool_(), pa.string()] + [pa.int64()] * 5
            made = [pa.array(c, t) for c, t in zip(cols, types)]
            if figures:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", *names])
            else:
                yield batch.filter(made[0])

    return run


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_size: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, kept, base_failed, rejected_by and the base statistics."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = planned(sample(rows, sample_size), rules)
    schema = "doc_id long, kept boolean, base_failed boolean, rejected_by string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return rows.mapInArrow(cascade(order, True), schema)


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_size: int = SAMPLE) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    ship(docs.sparkSession)
    order = planned(sample(docs.select("doc_id", "text"), sample_size), rules)
    return docs.mapInArrow(cascade(order, False), docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_T = "coalesce(text, '')"
OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, {_T} AS t, regexp_extract_all({_T}, '{WORD}') AS w,
    list_filter(string_split({_T}, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
windows AS (
  SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, unnest(range(1, CAST(greatest(len(w) - 1, 1) AS BIGINT))) AS r(i)),
twice AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, a, b, c) > 1),
covered AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters
  FROM d LEFT JOIN covered USING (k)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 25 * n_words OR n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines
    OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words OR 100 * up > 50 * letters) AS kept
FROM judged
"""
