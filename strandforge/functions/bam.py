"""Fields of binary alignment records as hexadecimal text (``encoder`` makes whole records).

Numbers are little-endian; fields that the format makes narrow are cut to their width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNMAPPED_BIN = 4680


def little(value: Column, size: int) -> Column:
    """The low ``size`` bytes of a whole number, least significant first, as hexadecimal text."""
    digits = F.lower(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size)))
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def text_bytes(value: Column) -> Column:
    return F.lower(F.hex(F.encode(value, "UTF-8")))


def _tag(name: str, kind: str) -> str:
    return (name + kind).encode().hex()


def tag_number(name: str, value: Column) -> Column:
    """An unsigned number in the smallest of one, two or four bytes."""
    return (
        F.when(value <= 0xFF, F.concat(F.lit(_tag(name, "C")), little(value, 1)))
        .when(value <= 0xFFFF, F.concat(F.lit(_tag(name, "S")), little(value, 2)))
        .otherwise(F.concat(F.lit(_tag(name, "I")), little(value, 4)))
    )


def tag_long(name: str, value: Column) -> Column:
    """A 64-bit number: unsigned if it fits, else a signed 32-bit one, else decimal text."""
    signed = F.concat(F.lit(_tag(name, "i")), little(value, 4))
    return (
        F.when(value.between(0, 0xFFFFFFFF), tag_number(name, value)).when(value.between(-(1 << 31), -1), signed).otherwise(F.concat(F.lit(_tag(name, "Z")), text_bytes(value.cast("string")), F.lit("00")))
    )


def tag_text(name: str, value: Column) -> Column:
    return F.concat(F.lit(_tag(name, "Z")), text_bytes(value), F.lit("00"))
