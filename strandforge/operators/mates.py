"""Mate lookup: what a row-order cache of mates would find, as joins.

A row finds its mate if the mate was kept earlier on the same reference, has a mate itself, and no
row in between took it. So a row waits for a mate that precedes it, and of all that wait for one
mate the first takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_cached_mates(kept: DataFrame, scope: tuple[str, ...] = ("ref_name",)) -> DataFrame:
    """kept (already filtered) with cached_pos: the mate's position, null where it is not found.

    scope: columns in which the cache lives, such as the reference and the region entry.
    """
    mated = F.col("mate_align_id") != 0
    waits = kept.where(mated & (F.col("align_id") > F.col("mate_align_id"))).select(*scope, "align_id", "mate_align_id")
    # of those that wait for a mate the least id comes first; a grouped minimum needs no sort and is
    # summed up before the shuffle, unlike a row number
    first = waits.groupBy(*scope, "mate_align_id").agg(F.min("align_id").alias("taker"))
    mates = kept.where(mated).select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("align_id").alias("_mate"), F.col("ref_pos").alias("_pos"))
    alike = F.lit(True)
    for c in scope:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # joined by id alone, the scope is compared after it: a table in buckets of ids then needs no exchange of its rows
    asked = first.join(mates, F.col("mate_align_id") == F.col("_mate"))
    found = asked.select(*[F.col(c).alias(f"_{c}") for c in scope], "taker", F.when(alike, F.struct(F.col("_pos").alias("pos"))).alias("_found")).where(F.col("_found").isNotNull())
    if scope == ("ref_name",):  # an id stands once
        out = kept.join(found, F.col("align_id") == F.col("taker"), "left")
        return out.select(*kept.columns, F.when(alike, F.col("_found.pos")).alias("cached_pos"))
    return kept.join(found, (F.col("align_id") == F.col("taker")) & alike, "left").select(*kept.columns, F.col("_found.pos").alias("cached_pos"))


def take_order(kept: DataFrame, scope: tuple[str, ...] = ("ref_name",)) -> DataFrame:
    """align_id, mate_align_id and the ordinal at which each waiting row asks for its mate."""
    waits = kept.where((F.col("mate_align_id") != 0) & (F.col("align_id") > F.col("mate_align_id")))
    nth = F.row_number().over(Window.partitionBy(*scope, "mate_align_id").orderBy("align_id"))
    return waits.select("align_id", "mate_align_id", nth.cast("long").alias("take_no"))
