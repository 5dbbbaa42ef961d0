"""Command line: ``tosam`` converts archives, ``cache-refs`` reports their dependencies.

python -m strandforge.plans.cli tosam ARCHIVE... [options]
"""

from __future__ import annotations

import argparse
import os
import sys
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from strandforge.operators.references import dependency_summary
from strandforge.plans.convert import ORDER, Options, header_of, key_histogram, records_plan
from strandforge.plans.progress import Progress, Status
from strandforge.sources import schemas as S
from strandforge.sources.archive import Archive, open_archive
from strandforge.sources.storage import discard, materialize
from strandforge.sources.writers import PART_ROWS, stream_parts, write_bam, write_bam_file, write_text, write_text_file


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandforge")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tosam", help="convert archives to SAM, BAM, FASTA or FASTQ")
    t.add_argument("accessions", nargs="+")
    t.add_argument("-u", "--unaligned", action="store_true", help="add unaligned reads")
    t.add_argument("-1", "--primary", action="store_true", dest="primary_only", help="leave out secondary alignments")
    t.add_argument("--aligned-region", action="append", default=[], dest="regions", metavar="NAME[:START-END]")
    t.add_argument("--min-mapq", type=int)
    t.add_argument("-n", "--no-header", action="store_true")
    t.add_argument("-r", "--header", action="store_true", dest="regenerate_header", help="rebuild the header")
    t.add_argument("--header-file")
    t.add_argument("--header-comment", action="append", default=[], dest="header_comments")
    t.add_argument("-s", "--seqid", action="store_true", help="show sequence ids, not names")
    t.add_argument("--unaligned-spots-only", action="store_true")
    t.add_argument("--output-file", help="one file; without it records go to standard output")
    t.add_argument("--output-folder", help="a folder of parts, for large output")
    t.add_argument("--output-format", choices=["sam", "bam"], default="sam")
    for flag in ("gzip", "bzip2", "fasta", "fastq", "reverse"):
        t.add_argument(f"--{flag}", action="store_true")
    t.add_argument("-o", "--omit-quality", action="store_true")
    t.add_argument("-c", "--cigar-long", action="store_true")
    t.add_argument("-g", "--spot-group", action="store_true")
    t.add_argument("-p", "--prefix")
    t.add_argument("-Q", "--qual-quant")
    t.add_argument("--XI", action="store_true", dest="xi")
    t.add_argument("-t", "--threads", type=int, help="parallel tasks")
    t.add_argument("--pool-size", type=int, help="accepted; executors hold what a pool would")
    c = sub.add_parser("cache-refs", help="report reference dependencies")
    c.add_argument("accessions", nargs="+")
    return p


def options_of(args: argparse.Namespace) -> Options:
    known = {k: v for k, v in vars(args).items() if k in Options.__dataclass_fields__}
    return Options(**known | {"regions": tuple(args.regions), "header_comments": tuple(args.header_comments)})


def session(threads: int | None) -> SparkSession:
    b = SparkSession.builder.appName("strandforge")
    if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ and not SparkSession.getActiveSession():
        b = b.master(f"local[{threads or '*'}]")
    return b.getOrCreate()


def convert(archive: Archive, o: Options, output_file: str | None = None, output_folder: str | None = None, part_rows: int = PART_ROWS, out: BinaryIO | None = None, interval: float = 10.0) -> str | None:
    """Converts one archive; everything is checked before an output is opened.

    A folder holds the same as a file, in parts: the first begins with the header. Without either, the bytes of
    the file go to a stream, standard output by default. A line of progress goes to standard error each interval (seconds).
    """
    header = header_of(archive, o) if o.writes_header else ""
    progress = Progress()
    plan = progress.watch(records_plan(archive, o, header, o.writes_header))
    with Status(archive.spark, interval):
        histogram = materialize(key_histogram(archive, o, part_rows), "key-histogram")
        _write(plan, o, output_file, output_folder, histogram, part_rows, out)
    discard(histogram)
    return progress.line() if output_file or output_folder else None


def _write(plan: DataFrame, o: Options, output_file: str | None, output_folder: str | None, histogram: DataFrame, part_rows: int, out: BinaryIO | None) -> None:
    if not (output_file or output_folder):
        stream_parts(plan, out or sys.stdout.buffer, ORDER, histogram, "bam" if o.mode == "bam" else o.compression, part_rows)
    elif o.mode == "bam":
        (write_bam if output_folder else write_bam_file)(plan, output_folder or output_file, ORDER, histogram, part_rows)
    elif output_folder:
        write_text(plan, output_folder, ORDER, histogram, o.compression, part_rows)
    else:
        write_text_file(plan, output_file, ORDER, histogram, o.compression, part_rows)


def tosam(spark: SparkSession, args: argparse.Namespace) -> None:
    o = options_of(args)
    o.check()
    if len(args.accessions) > 1 and (args.output_file or args.output_folder):
        raise ValueError("several archives would overwrite one output: convert them one by one")
    for path in args.accessions:
        line = convert(open_archive(spark, path), o, args.output_file, args.output_folder)
        if line:
            print(line, file=sys.stderr)


def cache_refs(spark: SparkSession, accessions: list[str]) -> tuple[int, int]:
    """(processed, failed): a failing archive does not stop the others."""
    failed = 0
    for path in accessions:
        try:
            archive = open_archive(spark, path)
            rows = dependency_summary(archive.dependencies()).collect() if archive.has_table(S.DEPENDENCIES) else []
            total, local = sum(r["total"] for r in rows), sum(r["n_local"] for r in rows)
            print(f"[cache-refs] {path}: {total} dependenc{'y' if total == 1 else 'ies'} ({local} local, {total - local} resolved)", file=sys.stderr)
        except Exception as e:  # noqa: BLE001  reported, counted, and raised at the end
            print(f"[cache-refs] {path}: ERROR: {e}", file=sys.stderr)
            failed += 1
    print(f"[cache-refs] Done: {len(accessions) - failed} accession(s) processed, {failed} failed", file=sys.stderr)
    return len(accessions) - failed, failed


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session(getattr(args, "threads", None))
    if args.command == "cache-refs":
        return 1 if cache_refs(spark, args.accessions)[1] else 0
    try:
        tosam(spark, args)
        sys.stdout.flush()
    except BrokenPipeError:  # the reader of standard output has had enough
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
