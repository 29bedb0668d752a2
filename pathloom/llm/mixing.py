"""Mixing sources to target weights, in DataFrame functions only.

Each source's words form one stream (its documents in hash order), cut into blocks of fixed length.
The mix is a sequence of slots, dealt into output shards. Every shard draws its source counts from
the multinomial of the targets; slots that a source drew beyond its target are dealt again to
sources that drew too few, so the corpus totals hit the targets while shards stay random. The j-th
slot of a source maps to a block through a pseudorandom permutation of the indexes of its full blocks
(swap-or-not rounds, one permutation for each pass over the source; a short last block ends the pass), and
blocks join by index.
No block comes twice in one pass, so no document is taken more often than its source has passes.

Sources rank by code point, null last; targets share all words by weight, stop at ``limit`` times
the source's size, and the excess is shared again by weight until none is above.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source; repeated
rows are separate documents; a long text's words lie in as many blocks as they fill; ties between documents go by
id, then a hash of the text, then size; an empty table gives no rows; other columns are ignored. Window steps
over the table of sources hold one row a source, and over shards or hash buckets one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import partitions, running_before, staged, word_count

ROUNDS = 12
DOCS_A_BUCKET = 4096
SHARDS_A_GROUP = 1024
CELLS = 1024


def targets(sized: DataFrame, weights: tuple = (5, 2, 1), limit: int = 3, block: int = 64) -> DataFrame:
    """sized (source, size) -> for each source its rank, size, weight, target, blocks and slots (lo to hi of all)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumns({"weight": weight, "cap": (F.col("source_size") * limit).cast("double")})
    # In the order of cap / weight the capped sources come first; the level is the largest share a unit of weight can get.
    fill = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", level)
    per = per.withColumn("target", F.least("cap", F.max("level").over(W.partitionBy()) * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    per = per.withColumn("blocks", blocks)
    # Whole passes, then whole blocks, and the source's short last block only after all of them: no sum is off by more
    # than half a block.
    per = per.withColumns({"full": F.floor(F.col("source_size") / block).cast("long"), "passes": F.floor(F.try_divide("target", "source_size"))})
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    more = F.least(F.round(rest / block), F.col("full"))
    last = F.col("source_size") - F.col("full") * block
    short = ((more == F.col("full")) & (last > 0) & (rest - more * block > last / 2)).cast("long")
    slots = F.when(F.col("source_size") > 0, F.least(F.col("passes") * F.col("blocks") + more + short, F.col("blocks") * limit)).otherwise(0)
    per = per.withColumn("slots", slots.cast("long"))
    hi = F.sum("slots").over(W.orderBy("rank"))
    return per.select("source", "rank", "source_size", "weight", "target", "blocks", "full", "slots", (hi - F.col("slots")).alias("lo"), hi.alias("hi"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key: swap-or-not rounds."""
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(r, n, *key) - x, n)
        side = F.xxhash64(F.lit("side"), r, F.greatest(x, other), n, *key).bitwiseAND(1)
        return F.when(side == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def draw(per: DataFrame, shard_slots: int = 4096, seed: int = 17) -> DataFrame:
    """per (as targets() gives, staged) -> (shard, rank, j, block): every slot of the mix and the block it takes."""
    spark = per.sparkSession
    total = per.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0]  # one number
    cell = max(1, -(-total // CELLS))
    slots = spark.range(0, max(total, 0), 1, max(1, min(10_000, total // 500_000))).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("u")
    )
    cells = per.where("slots > 0").select(
        "rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell")
    )
    drawn = slots.withColumn("cell", F.floor(F.col("u") / cell)).join(cells, "cell").where("u >= lo and u < hi")
    counts = drawn.groupBy("shard", "rank").agg(F.count("*").alias("n"))
    counts = staged(counts.withColumn("shards", F.floor(F.col("shard") / SHARDS_A_GROUP)), "mix-counts")
    numbered = running_before(counts, ["rank"], "shards", ["shard"], "n", "before")
    # A few rows make many slots: they are dealt out before, not after.
    numbered = numbered.repartition(partitions(spark), "shard", "rank")
    own = numbered.select("shard", "rank", F.explode(F.sequence("before", F.col("before") + F.col("n") - 1)).alias("j"))
    # Over and under: where the draws of a source passed or missed its slots.
    got = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    gap = per.select("rank", "slots").join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    up = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    over, under = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    gap = gap.select("rank", "slots", "got", F.coalesce(F.sum(over).over(up), F.lit(0)).alias("over"), F.coalesce(F.sum(under).over(up), F.lit(0)).alias("under"))
    own = own.join(gap.select("rank", "slots", "over"), "rank")
    keep = own.where("j < slots").select("shard", "rank", "j")
    again = own.where("j >= slots").select("shard", (F.col("over") + F.col("j") - F.col("slots")).alias("q"))
    free = gap.where("got < slots").select("rank", "got", "under", F.explode(F.sequence("got", F.col("slots") - 1)).alias("j"))
    free = free.select("rank", "j", (F.col("under") + F.col("j") - F.col("got")).alias("q"))
    mixed = keep.unionByName(again.join(free, "q").select("shard", "rank", "j"))
    mixed = mixed.join(per.select("rank", "blocks", "full"), "rank").withColumn("x", F.pmod("j", "blocks"))
    index = permuted(F.least("x", F.col("full") - 1), F.greatest("full", F.lit(1).cast("long")), F.col("rank"), F.floor(F.col("j") / F.col("blocks")), F.lit(seed))
    index = F.when(F.col("x") < F.col("full"), index).otherwise(F.col("full"))  # the short block comes last in a pass
    return mixed.select("shard", "rank", "j", index.alias("block"))


def layout(sized: DataFrame, per: DataFrame) -> DataFrame:
    """sized (row_key, doc_id, source, size) with rank, source_size, target and at, its place in its source's stream."""
    ranked = sized.join(per.select(F.col("source").alias("_s"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    n = sized.count()
    ranked = ranked.withColumn("deal", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(max(1, n // DOCS_A_BUCKET))))
    return running_before(ranked, ["rank"], "deal", ["doc_id", "row_key", "size"], "size", "at")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), limit: int = 3, block: int = 64, shard_slots: int = 4096, seed: int = 17):
    """docs (doc_id, source, text) -> (placed documents with their overlaps, takes of each block).

    placed: doc_id, row_key, source, rank, size, source_size, target, at. takes: rank, block, times.
    """
    sized = staged(docs.select("doc_id", F.xxhash64("text").alias("row_key"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    per = staged(targets(sized, weights, limit, block), "mix-targets")
    takes = draw(per, shard_slots, seed).groupBy("rank", "block").agg(F.count("*").alias("times"))
    return staged(layout(sized, per), "mix-layout"), takes


def overlaps(placed: DataFrame, takes: DataFrame, block: int = 64) -> DataFrame:
    """One row for each document and block it has words in: first word (of the document), words, times."""
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("block") * block, F.col("at"))
    hi = F.least((F.col("block") + 1) * block, F.col("at") + F.col("size"))
    spread = spread.withColumns({"first": lo - F.col("at"), "words": hi - lo})
    return spread.join(takes, ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def op2(spark, sf_dir: str) -> DataFrame:
    placed, takes = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    cols = ["doc_id", "row_key", "source", "size", "source_size", "target"]
    taken = overlaps(placed, takes).groupBy(*cols, "rank", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    none = placed.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken"))
    return taken.select(*cols, "taken").unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "source")


def remixed(docs: DataFrame, weights: tuple = (5, 2, 1), limit: int = 3, block: int = 64, shard_slots: int = 4096, seed: int = 17) -> DataFrame:
    """The mix as documents: for every pass a row with the words that pass takes of the document.

    A pass that takes all its words keeps the text as it was; else the taken words are joined by spaces.
    Columns are those of docs (doc_id, text, lang, source, n_chars).
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    placed, takes = mix(docs, weights, limit, block, shard_slots, seed)
    passes = overlaps(placed, takes, block).where("times > 0").select(
        "doc_id", "row_key", "rank", "at", "size", "first", "words", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass")
    )
    spans = passes.groupBy("doc_id", "row_key", "rank", "at", "size", "pass").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias("spans"), F.sum("words").alias("taken")
    )
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "at", "rank", "size", "pass", "taken", F.when(F.col("taken") < F.col("size"), F.col("spans")).alias("spans"))
    full = docs.select(*cols).withColumn("_k", F.xxhash64("text"))
    # Repeated rows share doc_id and key; each has its own place, so their copies are numbered on both sides.
    full = full.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "_k").orderBy(F.col("source").asc_nulls_last(), "lang")))
    where = placed.where("size > 0").select("doc_id", "row_key", "rank", "at")
    where = where.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "row_key").orderBy("rank", "at")))
    spans = spans.join(where.select(F.col("doc_id").alias("_i"), F.col("row_key").alias("_r"), F.col("rank").alias("_rank"), F.col("at").alias("_at"), "_n"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_r")) & (F.col("rank") == F.col("_rank")) & (F.col("at") == F.col("_at")))
    spans = spans.select("_id", "_key", F.col("_n").alias("_m"), "spans")
    joined = full.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")) & (F.col("_n") == F.col("_m")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    # The words are bound once by an outer transform: inside the inner one they would be split again for every span.
    taken = lambda w: F.flatten(F.transform("spans", lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["words"].cast("int"))))
    cut = F.array_join(F.transform(F.array(words), taken)[0], " ")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut)
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
