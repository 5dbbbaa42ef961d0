"""Records: SAM lines, FASTA and FASTQ entries as projections, binary records a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from strandforge.functions import bam, encoder, fields, flags, quality, sequence
from strandforge.functions.fields import text


@dataclass(frozen=True)
class Format:
    """How records look."""

    prefix: str | None = None
    group_in_name: bool = False
    omit_quality: bool = False
    quantization: tuple[int, ...] | None = None
    xi: bool = False
    reverse: bool = False
    mode: str = "sam"  # sam, bam, fasta or fastq

    @property
    def table(self) -> list[int] | None:
        return list(self.quantization) if self.quantization else None


c = F.col


def _aligned_name(f: Format) -> Column:
    return fields.qname(c("seq_name"), c("spot_group"), ".", f.prefix, f.group_in_name)


def _unaligned_name(f: Format) -> Column:
    return fields.qname(c("name"), c("spot_group"), "#", f.prefix, f.group_in_name)


def aligned_quality(f: Format) -> Column:
    if f.omit_quality:
        return F.lit("*")
    value = quality.quantized_text(c("quality"), f.table) if f.table else c("quality")
    return F.when(c("quality") == "", "*").otherwise(value)


def _unaligned_quality(f: Format) -> Column:
    if f.omit_quality:
        return F.lit("*")
    return fields.or_star(quality.as_text(c("quality"), flags.is_reversed(c("read_type")) if f.reverse else False, f.table))


def _unaligned_bases(f: Format) -> Column:
    return F.when(flags.is_reversed(c("read_type")), sequence.reverse_complement(c("read"))).otherwise(c("read")) if f.reverse else c("read")


def _aligned_flags() -> Column:
    return flags.with_read_filter(c("sam_flags"), c("read_filter"))


def _unaligned_flags(f: Format) -> Column:
    return flags.unaligned_flags(c("read_type"), c("read_filter"), c("index"), c("n"), f.reverse)


def aligned_sam(f: Format) -> Column:
    """Eleven fields and tags; needs rname and cached_pos beside the scan's columns."""
    head = F.concat_ws(
        "\t", _aligned_name(f), text(_aligned_flags()), c("rname"), text(fields.position(c("ref_pos"))), text(c("mapq")), fields.or_star(c("cigar")),
        fields.rnext(c("cached_pos"), c("mate_ref_name"), c("rname")), text(fields.pnext(c("cached_pos"), c("mate_ref_name"), c("mate_ref_pos"))), text(c("template_len")),
        fields.or_star(c("read")), aligned_quality(f),
    )
    return F.concat(head, fields.sam_tags(c("edit_distance"), c("alignment_count"), c("spot_group"), c("align_id") if f.xi else None))


def unaligned_sam(f: Format) -> Column:
    head = F.concat_ws("\t", _unaligned_name(f), text(_unaligned_flags(f)), F.lit("*\t0\t0\t*\t*\t0\t0"), fields.or_star(_unaligned_bases(f)), _unaligned_quality(f))
    return F.concat(head, fields.group_tag(c("spot_group")))


def _fastx(f: Format, name: Column, bases: Column, qual: Column) -> Column:
    if f.mode == "fasta":
        return F.concat(F.lit(">"), name, F.lit("\n"), bases)
    return F.concat(F.lit("@"), name, F.lit("\n"), bases, F.lit("\n+\n"), qual)


def aligned_fastx(f: Format) -> Column:
    """As stored: reads on the reverse strand are not turned."""
    return _fastx(f, _aligned_name(f), c("read"), aligned_quality(f))


def unaligned_fastx(f: Format) -> Column:
    return _fastx(f, _unaligned_name(f), _unaligned_bases(f), _unaligned_quality(f))


def _encoded(rows: DataFrame, keys: dict[str, Column], columns: dict[str, Column], encode: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """keys and the binary records that encode makes of the columns, a batch at a time."""
    picked = rows.select(*[v.alias(k) for k, v in keys.items()], *[v.alias(k) for k, v in columns.items()])
    head = picked.select(*keys).schema
    schema, names = StructType([*head.fields, StructField("record", BinaryType())]), [*keys, "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 1], encode(b)], names=names)

    return picked.mapInArrow(run, schema)


def aligned_bam(rows: DataFrame, f: Format, keys: dict[str, Column]) -> DataFrame:
    """keys, record: binary records; rows need ref_id, mate_ref_id and cached_pos beside the scan's columns."""
    mate_ref, mate_pos, tlen = fields.bam_mate(c("cached_pos"), c("mate_align_id"), c("mate_ref_name"), c("mate_ref_pos"), c("template_len"), c("ref_id"), c("mate_ref_id"))
    columns = {
        "name": _aligned_name(f), "ref_id": c("ref_id"), "pos": c("ref_pos"), "mapq": c("mapq"), "flags": _aligned_flags(), "cigar": c("cigar"), "read": c("read"),
        "quality": F.lit(None).cast("string") if f.omit_quality else c("quality"), "mate_ref": mate_ref, "mate_pos": mate_pos, "tlen": tlen,
        "nm": c("edit_distance"), "nh": c("alignment_count"), "rg": c("spot_group"),
    }
    return _encoded(rows, keys, columns | ({"xi": c("align_id")} if f.xi else {}), lambda b: encoder.aligned(b, f.table))


def unaligned_bam(reads: DataFrame, f: Format, keys: dict[str, Column]) -> DataFrame:
    """keys, record: binary records of reads that are not aligned."""
    none = F.array().cast("array<int>")
    columns = {
        "name": _unaligned_name(f), "flags": _unaligned_flags(f), "read": _unaligned_bases(f), "quality": none if f.omit_quality else F.coalesce(c("quality"), none),
        "back": flags.is_reversed(c("read_type")) if f.reverse else F.lit(False), "rg": c("spot_group"),
    }
    return _encoded(reads, keys, columns, lambda b: encoder.unaligned(b, f.table, bam.UNMAPPED_BIN))


def aligned_records(rows: DataFrame, f: Format, keys: dict[str, Column]) -> DataFrame:
    """keys, record: text, or bytes of a binary record."""
    if f.mode == "bam":
        return aligned_bam(rows, f, keys)
    return rows.select(*[v.alias(k) for k, v in keys.items()], aligned_record(f).alias("record"))


def unaligned_records(reads: DataFrame, f: Format, keys: dict[str, Column]) -> DataFrame:
    if f.mode == "bam":
        return unaligned_bam(reads, f, keys)
    return reads.select(*[v.alias(k) for k, v in keys.items()], unaligned_record(f).alias("record"))


def aligned_record(f: Format) -> Column:
    return aligned_sam(f) if f.mode == "sam" else aligned_fastx(f)


def unaligned_record(f: Format) -> Column:
    return unaligned_sam(f) if f.mode == "sam" else unaligned_fastx(f)
