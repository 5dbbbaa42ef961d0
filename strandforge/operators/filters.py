"""Row filters of the alignment and spot scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.functions.flags import BIOLOGICAL


def mapq_threshold(min_mapq: int | None) -> int:
    """The threshold as a signed 32-bit number; unset is 0, so negative qualities go even then."""
    n = (min_mapq or 0) & 0xFFFFFFFF
    return n - (1 << 32) if n >> 31 else n


def by_mapq(df: DataFrame, min_mapq: int | None = None) -> DataFrame:
    return df.where(F.col("mapq") >= mapq_threshold(min_mapq))


def stored_mapq(min_mapq: int | None = None) -> Column:
    """The same on a stored table, whose empty cells count as 0: plain comparisons, which reach the Parquet reader."""
    least = mapq_threshold(min_mapq)
    kept = F.col("mapq") >= least
    return kept | F.col("mapq").isNull() if least <= 0 else kept


def starts_inside(pos: Column, start: Column, end: Column) -> Column:
    """The start position lies in [start, end); an alignment that only reaches in does not count."""
    return (pos >= start) & (pos < end)


def is_emitted(primary_id: Column, read_type: Column, read_len: Column) -> Column:
    """A read that is not aligned, is biological and has bases (short arrays count as 0)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (zero(primary_id) == 0) & (zero(read_type).bitwiseAND(F.lit(BIOLOGICAL)) != 0) & (zero(read_len) > 0)


def wholly_unaligned(df: DataFrame) -> DataFrame:
    """Spots with reads of which none is aligned."""
    ids = F.col("primary_alignment_id")
    return df.where((F.size(ids) > 0) & ~F.exists(ids, lambda x: F.coalesce(x, F.lit(0)) != 0))
