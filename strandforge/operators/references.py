"""Reference dictionary, headers, boundaries, placements and dependencies."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.functions.cigar import reference_length


def header_lines(references: DataFrame, use_seqid: bool = False) -> DataFrame:
    """line_no, line of a rebuilt header: format version, then a line for each reference."""
    lines = references.select(
        (F.col("ref_idx") + 1).cast("long").alias("line_no"),
        F.concat(F.lit("@SQ\tSN:"), F.col("seq_id" if use_seqid else "name"), F.lit("\tLN:"), F.col("seq_length").cast("string")).alias("line"),
    )
    first = references.sparkSession.range(1).select(F.col("id").alias("line_no"), F.lit("@HD\tVN:1.3").alias("line"))
    return first.unionByName(lines)


def sequence_dictionary(lines: DataFrame) -> DataFrame:
    """ref_id, name, length of the reference lines of a header (line_no, line), in order.

    A line without a name is left out and a length that is no number counts as 0.
    """
    name = F.nullif(F.regexp_extract("line", "\tSN:([^\t]*)", 1), F.lit(""))
    length = F.coalesce(F.expr("try_cast(regexp_extract(line, '\\tLN:([^\\t]*)', 1) as bigint)"), F.lit(0).cast("long"))
    named = lines.where(F.col("line").startswith("@SQ\t")).select("line_no", name.alias("name"), length.alias("length")).where(F.col("name").isNotNull())
    order = Window.orderBy("line_no")  # a header: one row a reference
    return named.select((F.row_number().over(order) - 1).cast("int").alias("ref_id"), "name", "length")


def dictionary_of(text: str) -> list[tuple[str, int]]:
    """(name, length) of a header text."""
    out = []
    for line in text.split("\n"):
        if line.startswith("@SQ\t"):
            tags = dict(t.split(":", 1) for t in line.split("\t")[1:] if ":" in t)
            if tags.get("SN"):
                n = tags.get("LN", "")
                out.append((tags["SN"], int(n) if n.isascii() and n.isdecimal() and int(n) <= 0xFFFFFFFF else 0))
    return out


def header_text(archive, regenerate: bool = False, use_seqid: bool = False, comments: tuple[str, ...] = (), from_file: str | None = None) -> str:
    """From a file, else rebuilt where told, else as stored, else rebuilt; then comment lines."""
    text = from_file if from_file is not None else None if regenerate else archive.bam_header()
    if text is None:
        rows = header_lines(archive.references(), use_seqid).orderBy("line_no").collect()  # one row a reference
        text = "".join(r["line"] + "\n" for r in rows)
    if text and not text.endswith("\n"):
        text += "\n"
    return text + "".join(f"@CO\t{x}\n" for x in comments)


def bam_header(text: str) -> bytes:
    """Magic, text, and the reference dictionary."""
    raw, refs = text.encode(), dictionary_of(text)
    out = b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs))
    for name, length in refs:
        out += struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<I", length)
    return out


def boundaries(aligned: DataFrame) -> DataFrame:
    """ref_name, first_row, last_row, n_rows of each reference; rows need not lie together."""
    return aligned.groupBy("ref_name").agg(F.min("align_id").alias("first_row"), F.max("align_id").alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


def boundaries_of(archive, table: str = "PRIMARY_ALIGNMENT") -> DataFrame:
    """The same of an archive's table: from Parquet footers where it is partitioned by reference and has statistics, else by a scan."""
    counts = archive.from_footers(table, "align_id", "ref_name")
    if counts is not None:
        try:
            rows = counts.select("ref_name", "first", "last", "n_rows").collect()  # a row a reference
            return archive.spark.createDataFrame(rows, "ref_name string, first_row long, last_row long, n_rows long")
        except Exception as e:
            if "No min/max found" not in str(e):  # a file without statistics
                raise
    return boundaries(archive.aligned(table))


def total_rows(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.count(F.lit(1)).alias("n_rows"))


def work_items(aligned: DataFrame, rows: int) -> DataFrame:
    """order_idx, ref_name, item, first_row, last_row: row ranges of at most ``rows`` rows, none across
    references, numbered densely in row order (a row for each range, not for each alignment)."""
    b = boundaries(aligned)
    item = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last_row") - F.col("first_row")) / rows).cast("long")))
    b = b.select("ref_name", F.col("first_row").alias("_f"), F.col("last_row").alias("_l"), item.alias("item"))
    nth = (F.row_number().over(Window.orderBy("_f", "item")) - 1).cast("long")
    return b.select(nth.alias("order_idx"), "ref_name", "item", (F.col("_f") + F.col("item") * rows).alias("first_row"), F.least(F.col("_f") + (F.col("item") + 1) * rows - 1, F.col("_l")).alias("last_row"))


def placements(aligned: DataFrame, references: DataFrame, name: str | None = None, start: int = 0, length: int | None = None, min_mapq: int = 0, window: int = 5000) -> DataFrame:
    """ref_idx, window_no, pos, align_id, len, mapq, spot_group of alignments that start in the window of
    one reference (or of all): sort by these columns to walk reference, window, position, record.
    len is how many bases of the reference an alignment spans."""
    refs = references if name is None else references.where((F.col("name") == name) | (F.col("seq_id") == name))
    hit = aligned.where((F.col("mapq") >= min_mapq) & (F.col("ref_pos") >= start))
    if length is not None:
        hit = hit.where(F.col("ref_pos") < start + length)
    hit = hit.drop("ref_idx").join(refs.select("ref_idx", F.col("name").alias("_n")), F.col("ref_name") == F.col("_n"))
    return hit.select("ref_idx", F.floor(F.col("ref_pos") / window).cast("long").alias("window_no"), F.col("ref_pos").alias("pos"), "align_id", reference_length(F.col("cigar")).alias("len"), "mapq", "spot_group")


def placement_set(iterators: list[tuple[str, DataFrame]]) -> DataFrame:
    """Placements of several sources (name of the table, placements) as one, with id_src: sorted by
    ref_idx, window_no, pos, the order of sources and align_id they are walked together. A source
    without placements adds nothing."""
    out = None
    for nth, (source, placed) in enumerate(iterators):
        rows = placed.select("ref_idx", "window_no", "pos", F.lit(nth).alias("source_no"), F.lit(source).alias("id_src"), "align_id", "len", "mapq", "spot_group")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a placement set needs a source")
    return out


#: Ids of a source at one position that one task numbers, at most.
WALK_IDS = 1 << 16


def walk(placed: DataFrame, sources: str | None = "source_no", ids: int = WALK_IDS) -> DataFrame:
    """placed (ref_idx, window_no, pos, source_no, align_id, ...) with ordinal: each record's place, from 1, in the walk over
    references, their windows, positions, sources and records.

    Sources are merged by counting, not by a sort of everything: counts of references, of windows inside them, of runs of
    ids at the positions inside these are summed up one after the other, and a record is numbered in its run.
    No task sees a reference, and none more of a deep position than a run of ids.
    """
    run = F.floor(F.col("align_id") / ids).alias("_run")
    rows = placed.select("*", (F.col(sources) if sources else F.lit(0)).alias("_source"), run)
    levels = [["ref_idx"], ["window_no"], ["pos", "_source", "_run"]]
    keys = [c for level in levels for c in level]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shift = None
    for depth, level in enumerate(levels):
        above = [c for upper in levels[:depth] for c in upper]
        here = counts.groupBy(*above, *level).agg(F.sum("n").alias("n")) if depth < len(levels) - 1 else counts
        order = Window.partitionBy(*above).orderBy(*level) if above else Window.orderBy(*level)  # the first: a row a reference
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = here.withColumn("before", before)
        if shift is not None:
            here = here.join(shift, above).withColumn("before", F.col("before") + F.col("shift"))
        shift = here.select(*above, *level, F.col("before").alias("shift"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("align_id"))
    return rows.join(shift, keys).select((F.col("shift") + nth).cast("long").alias("ordinal"), *placed.columns)


def available_positions(placed: DataFrame) -> DataFrame:
    """ref_idx, window_no, pos, n of each position that has records."""
    return placed.groupBy("ref_idx", "window_no", "pos").agg(F.count(F.lit(1)).alias("n"))


def dependency_summary(dependencies: DataFrame) -> DataFrame:
    """accession, total, local, resolved."""
    n_local = F.count_if(F.col("local"))
    return dependencies.groupBy("accession").agg(F.count(F.lit(1)).alias("total"), n_local.alias("n_local"), (F.count(F.lit(1)) - n_local).alias("n_resolved"))
