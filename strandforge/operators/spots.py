"""Spots to reads: parallel arrays are zipped, filtered and exploded without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.functions.sequence import clamped, clamped_array
from strandforge.operators.filters import is_emitted, wholly_unaligned


def emitted_reads(spots: DataFrame, whole_spots_only: bool = False) -> DataFrame:
    """A row for each emitted read: row_id, name, spot_group, read_no, index, n, read, quality, read_type, read_filter.

    index counts the reads that the spot emits and n is how many those are.
    """
    if whole_spots_only:
        spots = wholly_unaligned(spots)
    ids = F.col("primary_alignment_id")

    def described(i):
        got = lambda name, default=0: F.coalesce(F.get(F.col(name), i), F.lit(default))
        return F.struct(i.alias("read_no"), F.get(ids, i).alias("id"), got("read_type").alias("read_type"), got("read_filter").alias("read_filter"), got("read_start").alias("start"), got("read_len").cast("bigint").alias("len"))

    every = F.when(F.size(ids) > 0, F.transform(F.sequence(F.lit(0), F.size(ids) - 1), described))
    kept = F.filter(every, lambda r: is_emitted(r["id"], r["read_type"], r["len"]))
    has_quality = "quality" in spots.columns
    wide = ["read"] + ["quality"] * has_quality
    rows = spots.select("row_id", "name", "spot_group", *wide, kept.alias("kept"))
    rows = rows.select("row_id", "name", "spot_group", *wide, F.size("kept").alias("n"), F.posexplode("kept").alias("index", "r"))
    return rows.select(
        "row_id", "name", "spot_group", F.col("r.read_no").alias("read_no"), "index", "n", F.col("r.read_type").alias("read_type"), F.col("r.read_filter").alias("read_filter"),
        clamped(F.col("read"), F.col("r.start"), F.col("r.len")).alias("read"),
        *([clamped_array(F.col("quality"), F.col("r.start"), F.col("r.len")).alias("quality")] if has_quality else []),
    )
