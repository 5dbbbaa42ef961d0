"""Small texts: durations, counts, rates; fields of packed error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (shift, mask) of the fields of a packed 32-bit return code.
ERROR_FIELDS = {"state": (0, 0x3F), "object": (6, 0xFF), "context": (14, 0x7F), "target": (21, 0x3F), "module": (27, 0x1F)}
DONE_STATE, NETWORK_MODULE = 1, 18


def duration(seconds: float) -> str:
    s = int(seconds)
    if s < 60:
        return f"{s}s"
    big, small, unit = (s // 60, s % 60, "ms") if s < 3600 else (s // 3600, s % 3600 // 60, "hm")
    return f"{big}{unit[0]}" + (f" {small}{unit[1]}" if small else "")


def count(n: int) -> str:
    return f"{n:,}"


def rate(n: int, seconds: float) -> str:
    if seconds <= 0:
        return "-- records/s"
    per = n / seconds
    return f"{count(int(per))} records/s" if per >= 1 else f"{per * 60:.1f} records/min"


def duration_column(seconds: Column) -> Column:
    s = F.floor(seconds)
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    part = lambda big, unit, small, small_unit: F.when(small == 0, F.concat(big.cast("string"), F.lit(unit))).otherwise(F.concat(big.cast("string"), F.lit(f"{unit} "), small.cast("string"), F.lit(small_unit)))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, part(minutes, "m", s % 60, "s")).otherwise(part(hours, "h", F.floor((s % 3600) / 60), "m"))


def count_column(n: Column) -> Column:
    return F.format_number(n, 0)


def error_field(code: Column, name: str) -> Column:
    shift, mask = ERROR_FIELDS[name]
    return F.shiftright(code.cast("long"), shift).bitwiseAND(F.lit(mask)).cast("int")


def is_done(code: Column) -> Column:
    return error_field(code, "state") == DONE_STATE


def is_network(code: Column) -> Column:
    return error_field(code, "module") == NETWORK_MODULE


class ArchiveError(RuntimeError):
    """An error with a packed return code."""

    def __init__(self, code: int):
        super().__init__(f"archive error 0x{code:08x}")
        self.code = code
        for name, (shift, mask) in ERROR_FIELDS.items():
            setattr(self, name, code >> shift & mask)

    @property
    def done(self) -> bool:
        return self.state == DONE_STATE

    @property
    def network(self) -> bool:
        return self.module == NETWORK_MODULE
