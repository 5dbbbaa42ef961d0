"""Mixing sources to target weights.

Tokens of a source are packed, document after document, into fixed-length blocks. The mix is a
list of slots, one block each, dealt over output shards: for every shard the counts of its sources
are a multinomial draw from what each source still has to give, so that over all shards each
source meets its target. The slots of a source run through pseudorandom permutations of its block
indices, one permutation per epoch, so no block is used a (k+1)-th time before all were used k
times. Blocks and slots are joined by index.

Only sizes (not texts) are kept between the steps. Positions come from hashed buckets of a source
with bounded size, whose block counts are summed in two levels, so that no source, however large,
is ordered by one task. What the driver holds grows with sources x shards (at most
MAX_SHARDS shards and MAX_DRAWN counts, or one for each source), not with documents.

Defined results: null text has size 0 and is taken 0 times; null source is a source of its own,
last in order; repeated rows are packed each; equal runs give equal results; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm.common import SPACE_DELIMITERS, broadcast_if_small, discard, materialize, word_count

BLOCK_WORDS = 64
BUCKET_WORDS = 1 << 16
SHARD_SLOTS = 4096
MAX_SHARDS = 10_000
#: Source counts of all shards that the driver draws, at most; with more sources shards get larger.
MAX_DRAWN = 500_000
#: Slots of a shard and source that a task deals at once.
PIECE_SLOTS = 1 << 16
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20_240_229


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, text_hash of every row."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("text_hash")
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_no, source_size, target: weights dealt by code point order, capped and reshared.

    target = min(weight * level, max_repeat * size) with the one level at which all targets sum to
    the total size; that is where resharing the excess again and again ends.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth % len(weights) + 1)
    s = by_source.select("source", "source_size", nth.alias("source_no"), weight.alias("weight"))
    s = s.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum(F.col("source_size")).over(everything) - before) / left)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    s = s.withColumn("level", F.max(F.when(fits, F.col("level"))).over(everything))
    return s.select("source", "source_no", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def pack(sizes: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """Places of documents in blocks, and blocks of sources.

    places: doc_id, text_hash, source_no, size, source_size, target, bucket, start (word offset in
    the bucket), base (first block of the bucket). sources: source_no, blocks, source_size, target.
    """
    t = broadcast_if_small(targets)  # one row per source
    with_source = sizes.join(t, sizes["source"].eqNullSafe(targets["source"])).select("doc_id", "text_hash", "size", *[targets[c] for c in ("source_no", "source_size", "target")])
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_size") / bucket_words)).cast("long")
    placed = with_source.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), buckets))
    stream = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))

    per_bucket = placed.groupBy("source_no", "bucket").agg(F.ceil(F.sum("size") / block_words).cast("long").alias("blocks"))
    per_bucket = per_bucket.withColumn("group", F.floor(F.col("bucket") / 1024))
    inside = Window.partitionBy("source_no", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("inner", F.coalesce(F.sum("blocks").over(inside), F.lit(0)))
    groups = per_bucket.groupBy("source_no", "group").agg(F.sum("blocks").alias("group_blocks"))
    outside = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("outer", F.coalesce(F.sum("group_blocks").over(outside), F.lit(0)))
    bases = per_bucket.join(groups, ["source_no", "group"]).select("source_no", "bucket", (F.col("inner") + F.col("outer")).alias("base"), "blocks")
    places = placed.join(bases.drop("blocks"), ["source_no", "bucket"])
    sources = bases.groupBy("source_no").agg(F.sum("blocks").alias("blocks")).join(targets.drop("source"), "source_no")
    return places, sources


def slot_totals(blocks: np.ndarray, sizes: np.ndarray, target: np.ndarray, max_repeat: int) -> np.ndarray:
    """Slots of each source: its target in blocks of its mean length, never over max_repeat rounds."""
    with np.errstate(divide="ignore", invalid="ignore"):
        wanted = np.where(sizes > 0, target * blocks / sizes, 0.0)
    return np.minimum(np.rint(wanted), max_repeat * blocks).astype(np.int64)


def draw_counts(totals: np.ndarray, shard_slots: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """For each shard, a multinomial draw of source counts from what is left of the totals."""
    rng, left = np.random.default_rng(seed), totals.astype(np.int64).copy()
    while (rest := int(left.sum())) > 0:
        n = min(shard_slots, rest)
        drawn = np.minimum(rng.multinomial(n, left / rest), left)
        while (short := n - int(drawn.sum())) > 0:  # a source ran out: draw the rest from the others
            room = left - drawn
            drawn = np.minimum(drawn + rng.multinomial(short, room / room.sum()), left)
        left -= drawn
        yield drawn


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n), applied to index: a four-round Feistel network on the next
    even power of two, walked on until it falls inside the range."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 62, size=4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def slots(sources: DataFrame, max_repeat: int = MAX_REPEAT, shard_slots: int = SHARD_SLOTS, max_shards: int = MAX_SHARDS, seed: int = SEED) -> DataFrame:
    """shard, slot, source_no, block of the whole mix: one row per output block."""
    spark = sources.sparkSession
    s = sources.select("source_no", "blocks", "source_size", "target").orderBy("source_no").toPandas()  # a row per source
    totals = slot_totals(s["blocks"].to_numpy(float), s["source_size"].to_numpy(float), s["target"].to_numpy(float), max_repeat)
    shards = max(1, min(max_shards, MAX_DRAWN // max(1, len(s))))
    shard_slots = max(shard_slots, math.ceil(int(totals.sum()) / shards))
    rows, given = [], np.zeros(len(totals), dtype=np.int64)
    for shard, counts in enumerate(draw_counts(totals, shard_slots, seed)):
        first = np.cumsum(counts) - counts
        rows += [(shard, int(first[i]), int(s["source_no"][i]), int(given[i]), int(counts[i]), int(s["blocks"][i])) for i in np.flatnonzero(counts)]
        given += counts
    plan = spark.createDataFrame(rows, "shard long, slot long, source_no int, first long, n long, blocks long")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                for begin in range(0, r.n, PIECE_SLOTS):  # however many slots a shard has, a piece of them is held
                    n = min(PIECE_SLOTS, r.n - begin)
                    q = np.arange(r.first + begin, r.first + begin + n, dtype=np.int64)
                    epoch, at = q // r.blocks, q % r.blocks
                    block = np.empty_like(at)
                    for e in np.unique(epoch):
                        m = epoch == e
                        block[m] = permute(at[m], r.blocks, seed + 1_000_003 * (r.source_no + 1) + int(e))
                    yield pd.DataFrame({"shard": r.shard, "slot": r.slot + begin + np.arange(n), "source_no": np.int32(r.source_no), "block": block})

    tasks = max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return plan.repartition(tasks, "shard", "source_no").mapInPandas(deal, "shard long, slot long, source_no int, block long")


def overlaps(places: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """places, a row for every block a document reaches: block, inside (word offset in the block),
    offset (in the document), words. Documents without words keep one row, with a null block."""
    L = F.lit(block_words).cast("long")
    first, last = F.floor(F.col("start") / L), F.floor((F.col("start") + F.col("size") - 1) / L)
    reached = F.when(F.col("size") > 0, F.sequence(first, last))
    rows = places.select("*", F.explode_outer(reached).alias("local"))
    begin = F.greatest(F.col("start"), F.col("local") * L)
    end = F.least(F.col("start") + F.col("size"), (F.col("local") + 1) * L)
    return rows.select(
        "*", (F.col("base") + F.col("local")).alias("block"), (begin - F.col("local") * L).alias("inside"), (begin - F.col("start")).alias("offset"), (end - begin).alias("words")
    )


def mix_taken(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, weights=WEIGHTS, seed: int = SEED, **columns) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: how many words the mix takes of it."""
    sizes = materialize(document_sizes(docs, **columns), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, max_repeat), "mix-targets")
    places, sources = pack(sizes, targets, block_words)
    places, sources = materialize(places, "mix-places"), materialize(sources, "mix-sources")
    discard(sizes, targets)
    takes = slots(sources, max_repeat, seed=seed).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    joined = overlaps(places, block_words).join(takes, ["source_no", "block"], "left")
    doc = ["doc_id", "text_hash", "size", "source_size", "target", "source_no", "bucket", "start"]
    # documents of no words can share all of these, so they are counted and spread out again
    taken = joined.groupBy(*doc).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"), F.when(F.col("size") > 0, F.lit(1)).otherwise(F.count(F.lit(1))).cast("int").alias("rows"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy")).drop("_copy")


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, weights=WEIGHTS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: shard, slot, source, block, text (block_words words; the last block of a bucket may be shorter)."""
    sizes = materialize(document_sizes(docs, doc_id, text, source), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, max_repeat), "mix-targets")
    places, sources = pack(sizes, targets, block_words)
    places, sources = materialize(places, "mix-places"), materialize(sources, "mix-sources")
    discard(sizes)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE_DELIMITERS), "").alias("all")).dropDuplicates(["doc_id", "text_hash"])
    p = overlaps(places, block_words).where("words > 0")
    pieces = p.join(texts, [p["doc_id"].eqNullSafe(texts["doc_id"]), p["text_hash"] == texts["text_hash"]]).select(
        "source_no", "block", F.struct("inside", F.slice("all", (F.col("offset") + 1).cast("int"), F.col("words").cast("int")).alias("w")).alias("piece")
    )
    blocks = pieces.groupBy("source_no", "block").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["w"])), " ").alias("text"))  # at most block_words pieces
    mixed = slots(sources, max_repeat, seed=seed).join(blocks, ["source_no", "block"])
    return mixed.join(broadcast_if_small(targets.select("source_no", "source")), "source_no").select("shard", "slot", "source", "block", "text")
