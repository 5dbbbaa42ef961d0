"""Conversion plans: options to one DataFrame of ordered records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.functions.flags import without_lost_mate
from strandforge.functions.quality import parse_table
from strandforge.operators import records, references
from strandforge.operators.filters import stored_mapq
from strandforge.operators.mates import with_cached_mates
from strandforge.operators.regions import Region, in_regions, parse_region, require_alignments, resolve, stored_regions
from strandforge.operators.spots import emitted_reads
from strandforge.sources import schemas as S
from strandforge.sources.archive import Archive
from strandforge.sources.writers import PART_ROWS, bucket_of

#: Order of a record: stage (header, primary, secondary, unaligned), region in the order typed or reference, row, read.
ORDER = ["stage", "group_no", "row_id", "read_no"]
HEADER_STAGE = -1


@dataclass(frozen=True)
class Options:
    unaligned: bool = False
    primary_only: bool = False
    regions: tuple[str, ...] = ()
    min_mapq: int | None = None
    no_header: bool = False
    regenerate_header: bool = False
    header_file: str | None = None
    header_comments: tuple[str, ...] = ()
    seqid: bool = False
    unaligned_spots_only: bool = False
    output_format: str = "sam"
    fasta: bool = False
    fastq: bool = False
    gzip: bool = False
    bzip2: bool = False
    omit_quality: bool = False
    cigar_long: bool = False
    spot_group: bool = False
    prefix: str | None = None
    reverse: bool = False
    qual_quant: str | None = None
    xi: bool = False

    @property
    def mode(self) -> str:
        return "bam" if self.output_format == "bam" else "fasta" if self.fasta else "fastq" if self.fastq else "sam"

    @property
    def compression(self) -> str:
        """gzip wins over bzip2; binary output has its own."""
        return "none" if self.mode == "bam" else "gzip" if self.gzip else "bzip2" if self.bzip2 else "none"

    @property
    def writes_header(self) -> bool:
        return self.mode in ("sam", "bam") and not self.no_header

    @property
    def format(self) -> records.Format:
        table = tuple(parse_table(self.qual_quant)) if self.qual_quant is not None else None
        return records.Format(self.prefix, self.spot_group, self.omit_quality, table, self.xi, self.reverse, self.mode)

    def check(self) -> None:
        """Binary output without a header would lack its reference dictionary."""
        if self.mode == "bam" and self.no_header:
            raise ValueError("binary output needs its header")
        _ = self.format


def resolved_regions(archive: Archive, table: str, o: Options) -> list[Region]:
    """The regions asked for, by reference name; each must have alignments in the table."""
    regions = resolve([parse_region(r) for r in o.regions], archive.references(), o.seqid)
    if regions:
        require_alignments(archive.aligned(table), regions)
    return regions


def kept_rows(archive: Archive, table: str, o: Options, regions: list[Region]) -> DataFrame:
    """Rows of an alignment table that the options keep, with ref_idx, rname and group_no.

    Quality and regions are asked of the stored columns, so they reach the Parquet reader.
    """
    keep = stored_mapq(o.min_mapq) & stored_regions(regions) if regions else stored_mapq(o.min_mapq)
    rows = archive.aligned(table, o.cigar_long, keep)
    rows = in_regions(rows, regions) if regions else rows
    named = archive.references().select(F.col("name").alias("_name"), "ref_idx", F.col("seq_id" if o.seqid else "name").alias("rname"))
    # no hint: references are few for most archives, and then Spark broadcasts them by their size
    rows = rows.drop("ref_idx").join(named, F.col("ref_name") == F.col("_name"), "left").drop("_name")
    rows = rows.withColumn("rname", F.coalesce("rname", "ref_name"))
    return rows.withColumn("group_no", F.col("region_no").cast("long") if regions else F.coalesce("ref_idx", F.lit(-1)).cast("long"))


def aligned_rows(archive: Archive, table: str, o: Options, regions: list[Region] | None = None) -> DataFrame:
    """Kept rows of an alignment table with group_no, rname, ref_idx, cached_pos and mended flags."""
    regions = resolved_regions(archive, table, o) if regions is None else regions
    rows = with_cached_mates(kept_rows(archive, table, o, regions), ("ref_name", "region_no") if regions else ("ref_name",))
    return rows.withColumn("sam_flags", without_lost_mate(F.col("sam_flags"), F.col("mate_align_id")))


def with_bam_ids(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """ref_id from the reference list, mate_ref_id from the header's dictionary (ref_id, name)."""
    ids = dictionary.select(F.col("ref_id").alias("mate_ref_id"), F.col("name").alias("_mate_name"))
    rows = rows.withColumn("ref_id", F.coalesce("ref_idx", F.lit(-1)))
    return rows.join(ids, F.col("mate_ref_name") == F.col("_mate_name"), "left").drop("_mate_name")


def dictionary_table(archive: Archive, header: str) -> DataFrame:
    """ref_id, name of the header's reference lines."""
    rows = [(i, n) for i, (n, _) in reversed(list(enumerate(references.dictionary_of(header))))]
    last = {n: i for i, n in sorted(rows)}  # of equal names the last counts
    return archive.spark.createDataFrame([(i, n) for n, i in last.items()], "ref_id int, name string")


def aligned_tables(archive: Archive, o: Options) -> list[str]:
    if o.unaligned_spots_only:
        return []
    return [S.PRIMARY] + [S.SECONDARY] * (not o.primary_only and archive.has_table(S.SECONDARY))


def key_histogram(archive: Archive, o: Options, part_rows: int = PART_ROWS) -> DataFrame:
    """stage, group_no, bucket, n_rows of the records that records_plan gives, from the scans alone: no mates are
    joined and no records made, so Spark reads the key columns only."""
    parts = [kept_rows(archive, t, o, resolved_regions(archive, t, o)).select(F.lit(stage).alias("stage"), "group_no", F.col("align_id").alias("row_id")) for stage, t in enumerate(aligned_tables(archive, o))]
    if o.unaligned or o.unaligned_spots_only:
        reads = emitted_reads(archive.sequence(), o.unaligned_spots_only)
        parts.append(reads.select(F.lit(2).alias("stage"), F.lit(0).cast("long").alias("group_no"), "row_id"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("stage", "group_no", bucket_of(F.col("row_id"), part_rows).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


def header_records(archive: Archive, o: Options, header: str) -> DataFrame:
    """The header as records before all others: a line each, or the bytes of a binary header."""
    if o.mode == "bam":
        lines = [references.bam_header(header)]
    else:
        lines = header.split("\n")[:-1] if header else []
    rows = [(HEADER_STAGE, 0, i, 0, x) for i, x in enumerate(lines)]
    return archive.spark.createDataFrame(rows, f"stage int, group_no long, row_id long, read_no int, record {'binary' if o.mode == 'bam' else 'string'}")


def records_plan(archive: Archive, o: Options, header: str | None = None, with_header: bool = False) -> DataFrame:
    """stage, group_no, row_id, read_no, record (text, or bytes in binary output) of everything the options ask for."""
    o.check()
    parts = []
    if with_header:
        parts.append(header_records(archive, o, header if header is not None else header_of(archive, o)))
    for stage, name in enumerate(aligned_tables(archive, o)):
        rows = aligned_rows(archive, name, o)
        if o.mode == "bam":
            text = header if header is not None else header_of(archive, o)
            rows = with_bam_ids(rows, dictionary_table(archive, text))
        parts.append(records.aligned_records(rows, o.format, {"stage": F.lit(stage), "group_no": F.col("group_no"), "row_id": F.col("align_id"), "read_no": F.lit(0)}))
    if o.unaligned or o.unaligned_spots_only:
        reads = emitted_reads(archive.sequence(), o.unaligned_spots_only)
        parts.append(records.unaligned_records(reads, o.format, {"stage": F.lit(2), "group_no": F.lit(0).cast("long"), "row_id": F.col("row_id"), "read_no": F.col("index")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def header_of(archive: Archive, o: Options) -> str:
    given = None
    if o.header_file:
        with open(o.header_file, encoding="utf-8") as f:
            given = f.read()
    return references.header_text(archive, o.regenerate_header, o.seqid, o.header_comments, given)
