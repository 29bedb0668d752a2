"""The corpus pipeline: quality rules, near-dedup, secret masking, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Stages call the operators and swallow nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import discard, staged, staged_so_far
from pathloom.llm.mixing import remixed
from pathloom.llm.packing import pack, vocabulary
from pathloom.llm.rules import kept
from pathloom.llm.secrets import masked
from pathloom.llm.similar import without_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return kept(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (SimHash, five-word shingles, similarity 0.8, verified) the document with the smallest id."""
    return without_near_copies(docs.select(COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return masked(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a document."""
    return remixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their token ids."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mask_secrets", mask_secrets),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Stages use 64-bit shingle hashes, corpus-wide false-discovery levels and a byte-level vocabulary, which SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote for its own use goes once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        now = staged_so_far()
        discard(spark, before, now - 1)  # the last is the stage's result, which the next one reads
        before = now - 1
    return STAGES[-1][1](spark, docs, sf_dir)
