"""SAM flag bits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits, read filter and read type codes.
PAIRED, PROPER_PAIR, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
FIRST_IN_PAIR, LAST_IN_PAIR, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
PASS, REJECT, CRITERIA, REDACTED = 0, 1, 2, 3
BIOLOGICAL, REVERSED_READ = 1, 2

PAIR_BITS = PAIRED | PROPER_PAIR | MATE_UNMAPPED | MATE_REVERSE | FIRST_IN_PAIR | LAST_IN_PAIR


def with_read_filter(flags: Column, read_filter: Column) -> Column:
    """Null leaves the flags alone; any other value clears 0x200, and sets 0x200 or 0x400 by its kind."""
    cleared = flags.bitwiseAND(F.lit(~QC_FAIL))
    return (
        F.when(read_filter.isNull(), flags).when(read_filter == REJECT, cleared.bitwiseOR(F.lit(QC_FAIL))).when(read_filter == CRITERIA, cleared.bitwiseOR(F.lit(DUPLICATE))).otherwise(cleared)
    )


def without_lost_mate(flags: Column, mate_align_id: Column) -> Column:
    """Pair bits only mean something where the mate is aligned."""
    return F.when(mate_align_id == 0, flags.bitwiseAND(F.lit(~PAIR_BITS))).otherwise(flags)


def is_reversed(read_type: Column) -> Column:
    return read_type.bitwiseAND(F.lit(REVERSED_READ)) != 0


def unaligned_flags(read_type: Column, read_filter: Column, index: Column, n: Column, reverse: bool) -> Column:
    """Flags of read ``index`` of the ``n`` reads that its spot emits."""
    flags = F.lit(UNMAPPED)
    if reverse:
        flags = flags + F.when(is_reversed(read_type), REVERSE).otherwise(0)
    flags = with_read_filter(flags, read_filter)
    ends = F.when(index == 0, FIRST_IN_PAIR).otherwise(0) + F.when(index == n - 1, LAST_IN_PAIR).otherwise(0)
    return F.when(n > 1, flags.bitwiseOR(F.lit(PAIRED | MATE_UNMAPPED)).bitwiseOR(ends)).otherwise(flags).cast("int")
