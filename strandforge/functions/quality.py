"""Quality scores: quantization tables and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 33
#: Phred values whose text is printable ASCII.
PRINTABLE = 94


def parse_table(spec: str) -> list[int]:
    """256 values from "low:high,...": [low, high) becomes high, later pairs win, the rest stays."""
    out = list(range(256))
    for pair in spec.split(","):
        low, colon, high = pair.strip().partition(":")
        if not colon:
            raise ValueError(f"expected low:high, not {pair!r}")
        a, b = int(low.strip()), int(high.strip())
        if not (0 <= a <= 255 and 0 <= b <= 255):
            raise ValueError(f"{pair!r} is outside 0 to 255")
        out[a:b] = [b] * max(0, b - a)
    return out


def quantized_text(quality: Column, table: list[int]) -> Column:
    """Quantizes Phred+33 text."""
    moved = [(p, table[p]) for p in range(PRINTABLE) if table[p] != p]
    return F.translate(quality, "".join(chr(p + OFFSET) for p, _ in moved), "".join(chr(t + OFFSET) for _, t in moved)) if moved else quality


def quantized(phred: Column, table: list[int]) -> Column:
    """Quantizes an array of raw values."""
    lookup = F.array(*map(F.lit, table))
    return F.transform(phred, lambda x: F.element_at(lookup, x + 1))


def as_text(phred: Column, backwards: bool | Column = False, table: list[int] | None = None) -> Column:
    """Phred+33 text of raw values, read backwards where told."""
    values = quantized(phred, table) if table else phred
    text = F.array_join(F.transform(values, lambda x: F.char(x + OFFSET)), "")
    if isinstance(backwards, Column):
        return F.when(backwards, F.reverse(text)).otherwise(text)
    return F.reverse(text) if backwards else text


def _bytes(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")


def bam_from_text(quality: Column, l_seq: Column, omit: bool = False, table: list[int] | None = None) -> Column:
    """Hexadecimal bytes for a binary record of Phred+33 text; none stored: 0xff for each base."""
    absent = F.repeat(F.lit("ff"), l_seq)
    if omit:
        return absent
    raw = F.transform(F.split(quality, ""), lambda c: F.greatest(F.ascii(c) - OFFSET, F.lit(0)))
    return F.when(quality == "", absent).otherwise(_bytes(quantized(raw, table) if table else raw))


def bam_from_raw(phred: Column, l_seq: Column, backwards: Column | None = None, omit: bool = False, table: list[int] | None = None) -> Column:
    absent = F.repeat(F.lit("ff"), l_seq)
    if omit:
        return absent
    values = quantized(phred, table) if table else phred
    if backwards is not None:
        values = F.when(backwards, F.reverse(values)).otherwise(values)
    return F.when(F.size(phred) == 0, absent).otherwise(_bytes(values))
