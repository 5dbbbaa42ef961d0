"""Bases as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four-bit base alphabet of binary alignment records, in code order.
BASES = "=ACMGRSVTWYHKDBN"
HEX = "0123456789abcdef"


def reverse_complement(bases: Column) -> Column:
    """A-T and C-G swapped in either case and read backwards; any other letter becomes N."""
    return F.translate(F.reverse(F.regexp_replace(bases, "[^ACGTacgt]", "N")), "ACGTacgt", "TGCAtgca")


def base_codes(bases: Column) -> Column:
    """A hexadecimal digit for each base, upper or lower case; unknown letters count as N."""
    return F.translate(F.regexp_replace(F.upper(bases), f"[^{BASES}]", "N"), BASES, HEX)


def packed_hex(bases: Column) -> Column:
    """Two bases a byte, an odd tail filled with zero."""
    codes = base_codes(bases)
    return F.concat(codes, F.when(F.length(bases) % 2 == 1, "0").otherwise(""))


def clamped(value: Column, start: Column, length: Column) -> Column:
    """The part of a text from a zero-based start, as far as it goes; a negative start gives none."""
    return F.when((start < 0) | (length <= 0), "").otherwise(F.substring(value, (start + 1).cast("int"), length.cast("int")))


def clamped_array(value: Column, start: Column, length: Column, kind: str = "array<int>") -> Column:
    none = F.array().cast(kind)
    return F.when((start < 0) | (length <= 0), none).otherwise(F.slice(value, (F.greatest(start, F.lit(0)) + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int")))
