"""CIGAR texts and bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operation letters in code order, and those that consume the reference.
OPS = "MIDNSHP=X"
CONSUMES_REFERENCE = "MDN=X"
# Fixed values: (shift, first bin) of the levels of the binning index, finest first.
BIN_LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))


def _known(cigar: Column) -> Column:
    """Unknown letters vanish, so digits around them join, as a scan that only resets on an operation reads them."""
    return F.regexp_replace(cigar, f"[^0-9{OPS}]", "")


def operations(cigar: Column) -> Column:
    """The operation texts in order, such as ["50M", "2I"]."""
    return F.regexp_extract_all(_known(cigar), F.lit(f"([0-9]*[{OPS}])"), 1)


def _length(op: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(op, F.lit(1), F.length(op) - 1), F.lit("")).cast("long"), F.lit(0).cast("long"))


def packed(cigar: Column) -> Column:
    """array<bigint> of length << 4 | code."""
    return F.transform(operations(cigar), lambda op: F.shiftleft(_length(op), 4).bitwiseOR(_code(op).cast("long")))


def _code(op: Column) -> Column:
    return F.position(F.right(op, F.lit(1)), F.lit(OPS)) - 1


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that the alignment spans."""
    return F.aggregate(operations(cigar), F.lit(0).cast("long"), lambda total, op: total + F.when(F.right(op, F.lit(1)).isin(*CONSUMES_REFERENCE), _length(op)).otherwise(0))


def region_bin(begin: Column, end: Column) -> Column:
    """The smallest bin that holds [begin, end)."""
    last = F.greatest(end - 1, F.lit(0))
    out = F
    for shift, first in BIN_LEVELS:
        value = F.shiftright(begin, shift) + first
        out = out.when(F.shiftright(begin, shift) == F.shiftright(last, shift), value)
    return out.otherwise(0).bitwiseAND(F.lit(0xFFFF)).cast("int")
