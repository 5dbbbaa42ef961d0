"""Binary alignment records, a batch at a time: every field of all rows is laid out by offsets and scattered into one buffer.

A field knows how many bytes each row takes and writes all rows at once; where fields begin is a
running sum. No loop goes over rows. Numbers are little-endian and cut to the width of their field.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from strandforge.functions.cigar import BIN_LEVELS, CONSUMES_REFERENCE, OPS
from strandforge.functions.quality import OFFSET
from strandforge.functions.sequence import BASES

MISSING_QUALITY = 0xFF


def _table(letters: str, other: int) -> np.ndarray:
    out = np.full(256, other, dtype=np.uint8)
    for code, letter in enumerate(letters):
        out[ord(letter)] = code
        out[ord(letter.lower())] = code
    return out


_BASE_CODE = _table(BASES, BASES.index("N"))
_OP_CODE = np.full(256, 0xFF, dtype=np.uint8)
_OP_CODE[np.frombuffer(OPS.encode(), dtype=np.uint8)] = np.arange(len(OPS), dtype=np.uint8)
_ON_REFERENCE = np.array([op in CONSUMES_REFERENCE for op in OPS])


@dataclass
class Spans:
    """Bytes (or numbers) of all rows one after the other: row i has those from starts[i], lengths[i] of them."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of_text(cls, column: pa.Array) -> Spans:
        a = column.cast(pa.large_binary())
        offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
        data = np.frombuffer(a.buffers()[2] or b"", dtype=np.uint8)
        return cls(data, offsets[:-1], np.diff(offsets))

    @classmethod
    def of_list(cls, column: pa.ListArray) -> Spans:
        offsets = column.offsets.to_numpy().astype(np.int64)
        return cls(column.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets))

    @classmethod
    def from_lengths(cls, data: np.ndarray, lengths: np.ndarray) -> Spans:
        return cls(data, np.cumsum(lengths) - lengths, lengths)

    def rows(self) -> np.ndarray:
        """The row of each element."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def inside(self) -> np.ndarray:
        """The place of each element in its row."""
        return np.arange(int(self.lengths.sum())) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def flat(self, backwards: np.ndarray | None = None) -> np.ndarray:
        """All elements in the order of rows, those of some rows backwards."""
        at = self.inside()
        if backwards is not None:
            at = np.where(np.repeat(backwards, self.lengths), np.repeat(self.lengths, self.lengths) - 1 - at, at)
        return self.data[np.repeat(self.starts, self.lengths) + at]


class Number:
    """The low bytes of whole numbers; rows that lack the field take nothing."""

    def __init__(self, values: np.ndarray, size: int, there: np.ndarray | None = None):
        self.values, self.size, self.there = np.asarray(values).astype(np.int64), size, there
        self.sizes = np.full(len(self.values), size) if there is None else np.where(there, size, 0)

    def put(self, out: np.ndarray, at: np.ndarray) -> None:
        values, at = (self.values, at) if self.there is None else (self.values[self.there], at[self.there])
        for b in range(self.size):
            out[at + b] = values >> (8 * b) & 0xFF


class Bytes:
    """Bytes of any length."""

    def __init__(self, spans: Spans, values: np.ndarray | None = None):
        self.spans, self.values, self.sizes = spans, spans.flat() if values is None else values, spans.lengths

    def put(self, out: np.ndarray, at: np.ndarray) -> None:
        out[np.repeat(at, self.sizes) + self.spans.inside()] = self.values


def constant(data: bytes, n: int, there: np.ndarray | None = None) -> Bytes:
    lengths = np.full(n, len(data)) if there is None else np.where(there, len(data), 0)
    return Bytes(Spans.from_lengths(np.frombuffer(data * int((lengths > 0).sum()), dtype=np.uint8), lengths))


def only(spans: Spans, there: np.ndarray) -> Spans:
    return Spans(spans.data, spans.starts, np.where(there, spans.lengths, 0))


def laid_out(fields: list) -> pa.Array:
    """The records: for each row a size in four bytes, then its fields."""
    sizes = np.sum([f.sizes for f in fields], axis=0)
    ends = np.cumsum(sizes + 4)
    at = ends - sizes - 4
    if len(ends) and ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of records is larger than 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    Number(sizes, 4).put(out, at)
    at = at + 4
    for f in fields:
        f.put(out, at)
        at = at + f.sizes
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out)])


def packed_cigar(text: Spans) -> tuple[Spans, np.ndarray]:
    """Operations of each row (length << 4 | code), and how many bases of the reference they span.

    Unknown letters vanish, so digits around them join; digits without an operation after them are dropped.
    """
    data, rows = text.flat(), text.rows()
    code = _OP_CODE[data]
    digit = (data >= 0x30) & (data <= 0x39)
    kept = digit | (code != 0xFF)
    data, rows, code = data[kept], rows[kept], code[kept]
    ops = np.flatnonzero(code != 0xFF)
    row = rows[ops]
    first = np.searchsorted(rows, np.arange(len(text.lengths)))  # where a row begins
    before = np.maximum(np.r_[-1, ops[:-1]], first[row] - 1) if len(ops) else ops
    digits, length = ops - before - 1, np.zeros(len(ops), dtype=np.int64)
    for d in range(1, min(18, int(digits.max(initial=0))) + 1):
        has = digits >= d
        length[has] += (data[ops[has] - d].astype(np.int64) - 0x30) * 10 ** (d - 1)
    counts = np.bincount(row, minlength=len(text.lengths))
    spanned = np.zeros(len(text.lengths), dtype=np.int64)
    np.add.at(spanned, row, np.where(_ON_REFERENCE[code[ops]], length, 0))
    return Spans.from_lengths(length << 4 | code[ops], counts), spanned


def region_bin(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin of the index that holds [begin, end)."""
    last, out = np.maximum(end - 1, 0), np.zeros(len(begin), dtype=np.int64)
    for shift, first in reversed(BIN_LEVELS):
        out = np.where(begin >> shift == last >> shift, (begin >> shift) + first, out)
    return out & 0xFFFF


def packed_bases(text: Spans) -> Bytes:
    """Two bases a byte, an odd tail filled with zero; letters that are no bases count as N."""
    data, rows = text.flat(), text.rows()
    letters = (data & 0xC0) != 0x80  # a letter of several bytes is one unknown base
    codes, rows = _BASE_CODE[data[letters]], rows[letters]
    n = np.bincount(rows, minlength=len(text.lengths))
    bases, out = Spans.from_lengths(codes, n), Spans.from_lengths(np.zeros(0, dtype=np.uint8), (n + 1) // 2)
    packed = np.zeros(int(out.lengths.sum()), dtype=np.uint8)
    at = bases.inside()
    byte, low = out.starts[rows] + at // 2, at % 2 == 1
    packed[byte[~low]] = codes[~low] << 4
    packed[byte[low]] |= codes[low]
    return Bytes(out, packed)


def qualities(values: Spans, raw: np.ndarray, l_seq: np.ndarray, there: np.ndarray, table: list[int] | None) -> Bytes:
    """Scores (raw: of the rows that have them, in order), quantised where told; none stored: 0xff for each base."""
    scores = np.array(table, dtype=np.int64)[raw] if table else raw
    out = Spans.from_lengths(np.zeros(0, dtype=np.uint8), np.where(there, values.lengths, l_seq))
    data = np.full(int(out.lengths.sum()), MISSING_QUALITY, dtype=np.uint8)
    data[np.repeat(there, out.lengths)] = (scores & 0xFF).astype(np.uint8)
    return Bytes(out, data)


def tag_number(name: str, values: np.ndarray, there: np.ndarray | None = None) -> list:
    """An unsigned number in the smallest of one, two or four bytes."""
    there = np.ones(len(values), dtype=bool) if there is None else there
    out, least = [], np.iinfo(np.int64).min
    for kind, size, most in (("C", 1, 0xFF), ("S", 2, 0xFFFF), ("I", 4, np.iinfo(np.int64).max)):
        own = there & (values > least) & (values <= most) if least != np.iinfo(np.int64).min else there & (values <= most)
        out += [constant(f"{name}{kind}".encode(), len(values), own), Number(values, size, own)]
        least = most
    return out


def tag_text(name: str, text: Spans, there: np.ndarray) -> list:
    n = len(there)
    return [constant(f"{name}Z".encode(), n, there), Bytes(only(text, there)), constant(b"\0", n, there)]


def tag_long(name: str, values: np.ndarray) -> list:
    """A 64-bit number: unsigned if it fits, else a signed 32-bit one, else decimal text."""
    unsigned, signed = (values >= 0) & (values <= 0xFFFFFFFF), (values < 0) & (values >= -(1 << 31))
    as_text = ~unsigned & ~signed
    digits = Spans.of_text(pa.array([str(v) if t else "" for v, t in zip(values.tolist(), as_text.tolist(), strict=True)] if as_text.any() else [""] * len(values), pa.string()))
    return [*tag_number(name, values, unsigned), constant(f"{name}i".encode(), len(values), signed), Number(values, 4, signed), *tag_text(name, digits, as_text)]


def _whole(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _fixed(n: int, ref_id, pos, l_name, mapq, bin_, n_cigar, flags, l_seq, mate_ref, mate_pos, tlen) -> list:
    sizes = (4, 4, 1, 1, 2, 2, 2, 4, 4, 4, 4)
    return [Number(np.broadcast_to(v, n), s) for v, s in zip((ref_id, pos, l_name, mapq, bin_, n_cigar, flags, l_seq, mate_ref, mate_pos, tlen), sizes, strict=True)]


def aligned(b: pa.RecordBatch, table: list[int] | None) -> pa.Array:
    """Records of name, ref_id, pos, mapq, flags, cigar, read, quality, mate_ref, mate_pos, tlen, nm, nh, rg and, where there, xi; a null quality is left out."""
    n = b.num_rows
    name, read, group = (Spans.of_text(b.column(c).fill_null("")) for c in ("name", "read", "rg"))
    text = Spans.of_text(b.column("quality").fill_null(""))
    ops, spanned = packed_cigar(Spans.of_text(b.column("cigar").fill_null("")))
    pos, nh = _whole(b, "pos"), _whole(b, "nh")
    end = np.repeat(0, n) if not n else pos + spanned
    raw = np.maximum(text.flat().astype(np.int64) - OFFSET, 0)
    each_op = Bytes(Spans.from_lengths(np.zeros(0, dtype=np.uint8), 4 * ops.lengths), ops.data.astype("<u4").view(np.uint8))
    mate = [_whole(b, c) for c in ("mate_ref", "mate_pos", "tlen")]
    return laid_out([
        *_fixed(n, _whole(b, "ref_id"), pos, name.lengths + 1, _whole(b, "mapq"), region_bin(pos, end), ops.lengths, _whole(b, "flags"), read.lengths, *mate),
        Bytes(name), constant(b"\0", n), each_op, packed_bases(read), qualities(text, raw, read.lengths, text.lengths > 0, table),
        *tag_number("NM", _whole(b, "nm")), *tag_number("NH", nh, nh > 0), *tag_text("RG", group, group.lengths > 0),
        *(tag_long("XI", _whole(b, "xi")) if "xi" in b.schema.names else []),
    ])


def unaligned(b: pa.RecordBatch, table: list[int] | None, unmapped_bin: int) -> pa.Array:
    """Records of name, flags, read, quality (numbers; null: left out), back (whether they go backwards) and rg."""
    n = b.num_rows
    name, read, group = (Spans.of_text(b.column(c).fill_null("")) for c in ("name", "read", "rg"))
    values = Spans.of_list(b.column("quality"))
    raw = values.flat(b.column("back").fill_null(False).to_numpy(zero_copy_only=False)).astype(np.int64)
    return laid_out([
        *_fixed(n, -1, -1, name.lengths + 1, 0, unmapped_bin, 0, _whole(b, "flags"), read.lengths, -1, -1, 0),
        Bytes(name), constant(b"\0", n), packed_bases(read), qualities(values, raw, read.lengths, values.lengths > 0, table), *tag_text("RG", group, group.lengths > 0),
    ])
