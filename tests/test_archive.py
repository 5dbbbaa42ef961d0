"""Operators on literal rows: the vectors that fix the formats, and cases that the derived tables lack."""

import gzip
import io
import os
import random
import re
import struct
import subprocess
import sys
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandforge.functions import bam, cigar, encoder, fields, flags, quality, sequence, text
from strandforge.operators import filters, records, references, regions
from strandforge.operators.mates import with_cached_mates
from strandforge.operators.records import Format
from strandforge.operators.spots import emitted_reads
from strandforge.plans import cli, convert, progress, retry
from strandforge.sources import archive, fixture, reader, storage, writers
from strandforge.sources import schemas as S
from strandforge.sources.archive import Archive, open_archive
from strandforge.streaming import follow


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if hasattr(v, "isNull") else F.lit(v))
    return df.select(column.alias("x")).first()["x"]


RECORD = {
    "align_id": 42, "sam_flags": 99, "cigar": "50M", "mate_align_id": 2, "mate_ref_name": "chr1", "mate_ref_pos": 500, "template_len": 300, "read": "ACGTACGT", "quality": "IIIIIIII",
    "edit_distance": 1, "spot_group": "RG1", "seq_name": "read1", "alignment_count": 1, "ref_pos": 100, "mapq": 60, "rname": "chr1", "ref_id": 0, "mate_ref_id": 0,
}


def aligned(spark, column, cached=None, read_filter=None, **changed):
    null = lambda v: F.lit(v).cast("int")
    return one(spark, column, **RECORD | {"cached_pos": null(cached), "read_filter": null(read_filter)} | changed)


def sam(spark, f=Format(), **k):  # noqa: B008
    return aligned(spark, records.aligned_sam(f), **k).split("\t")


def test_sam_line(spark):
    assert sam(spark)[:11] == "read1 99 chr1 101 60 50M = 501 300 ACGTACGT IIIIIIII".split()
    assert sam(spark, Format(xi=True))[11:] == ["NM:i:1", "NH:i:1", "RG:Z:RG1", "XI:i:42"]
    assert sam(spark, cached=200)[6:9] == ["=", "201", "300"]
    assert sam(spark, mate_ref_name="*")[6:9] == ["*", "0", "300"]
    assert sam(spark, mate_ref_name="chr2")[6:8] == ["chr2", "501"]
    assert sam(spark, Format(prefix="PRE", group_in_name=True))[0] == "PRE.read1.RG1"
    assert sam(spark, cigar="", read="", quality="")[5:11:4] == ["*", "*"] and sam(spark, quality="")[10] == "*"
    assert sam(spark, Format(omit_quality=True))[10] == "*"
    assert sam(spark, alignment_count=0, spot_group="")[11:] == ["NM:i:1"]
    table = tuple(quality.parse_table("0:10,10:20,20:30,30:40"))
    assert sam(spark, Format(quantization=table), quality="".join(chr(33 + q) for q in (5, 15, 25, 35)))[10] == "".join(chr(33 + q) for q in (10, 20, 30, 40))


def test_names(spark):
    assert one(spark, fields.qname(F.lit("name"), F.lit("grp"), "#", "X", True)) == "X.name#grp"
    assert one(spark, fields.qname(F.lit("name"), F.lit(""), "#", None, True)) == "name"


@pytest.mark.parametrize("flag,kind,want", [(99, None, 99), (99 | 0x200, 0, 99), (99, 1, 99 | 0x200), (99, 2, 99 | 0x400), (99 | 0x200, 3, 99)])
def test_read_filter(spark, flag, kind, want):
    assert one(spark, flags.with_read_filter(F.lit(flag), F.lit(kind).cast("int"))) == want


@pytest.mark.parametrize("flag,want", [(0x49, 0), (0x59, 0x10), (0x249, 0x200), (99, 0)])
def test_lost_mate(spark, flag, want):
    assert one(spark, flags.without_lost_mate(F.lit(flag), F.lit(0))) == want
    assert one(spark, flags.without_lost_mate(F.lit(flag), F.lit(7))) == flag


def spots(spark, rows):
    return spark.createDataFrame([{f: r.get(f) for f in S.SEQUENCE_COLUMNS.names} for r in rows], S.SEQUENCE_COLUMNS)


SPOT = {"row_id": 1, "name": "spot1", "spot_group": "", "read": "ACGT", "quality": [30] * 4, "read_start": [0], "read_len": [4], "read_type": [1], "read_filter": [0], "primary_alignment_id": [0]}


def unaligned(spark, column, *rows, only=False):
    return [r["x"] for r in emitted_reads(spots(spark, rows), only).orderBy("row_id", "index").select(column.alias("x")).collect()]


def test_unaligned_records(spark):
    assert unaligned(spark, records.unaligned_sam(Format()), SPOT) == ["spot1\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t????"]
    assert unaligned(spark, records.unaligned_fastx(Format(mode="fastq")), SPOT) == ["@spot1\nACGT\n+\n????"]
    back = SPOT | {"quality": [10, 20, 30, 40], "read_type": [3]}
    line = unaligned(spark, records.unaligned_sam(Format(reverse=True)), back)[0].split("\t")
    assert (line[1], line[9], line[10]) == (str(0x14), "ACGT", "I?5+")
    pair = SPOT | {"read": "AACC", "quality": [1, 2, 3, 4], "read_start": [0, 2], "read_len": [2, 2], "read_type": [1, 1], "read_filter": [0, 0], "primary_alignment_id": [0, 0]}
    assert [int(x.split("\t")[1]) for x in unaligned(spark, records.unaligned_sam(Format()), pair)] == [0x4D, 0x8D]
    half = pair | {"primary_alignment_id": [9, 0]}
    assert [x.split("\t")[1] for x in unaligned(spark, records.unaligned_sam(Format()), half)] == ["4"]
    assert unaligned(spark, records.unaligned_sam(Format()), half, only=True) == []
    short = pair | {"read_type": [1], "read_len": [2], "read_start": [0], "read_filter": []}
    assert len(unaligned(spark, records.unaligned_sam(Format()), short)) == 1
    assert unaligned(spark, records.unaligned_sam(Format()), SPOT | {"primary_alignment_id": []}, SPOT | {"primary_alignment_id": None}) == []
    assert unaligned(spark, F.col("read"), SPOT | {"read_start": [-2]}, SPOT | {"read_start": [9]}, SPOT | {"read_len": [99]}) == ["", "", "ACGT"]


def test_fastx(spark):
    assert aligned(spark, records.aligned_fastx(Format(mode="fasta"))) == ">read1\nACGTACGT"
    assert aligned(spark, records.aligned_fastx(Format(mode="fastq"))) == "@read1\nACGTACGT\n+\nIIIIIIII"


def test_quality_tables():
    t = quality.parse_table("1:10, 10:20 ,20:30,30:40")
    assert [t[i] for i in (0, 1, 9, 10, 39, 40, 50)] == [0, 10, 10, 20, 40, 40, 50]
    assert quality.parse_table("10:10") == list(range(256))
    for bad in ("not-a-range", "10:abc", "abc:10", "0:300", "", "1:2,"):
        with pytest.raises(ValueError):
            quality.parse_table(bad)


def test_cigar(spark):
    packed = lambda t: one(spark, cigar.packed(F.lit(t)))
    assert packed("50M2I48M") == [800, 33, 768] and [x & 15 for x in packed("1M2I3D4N5S6H7P8=9X")] == list(range(9))
    assert packed("10Z5M") == [105 << 4] and packed("") == [] and packed("M") == [0]
    assert [one(spark, cigar.reference_length(F.lit(t))) for t in ("50M2I48M", "10M5D3N2=4X", "5I3S", "")] == [98, 24, 0, 0]
    bins = [one(spark, cigar.region_bin(F.lit(a), F.lit(b))) for a, b in ((0, 100), (0, 200000), (0, 0), (0, 1 << 26), (1 << 20, (1 << 20) + 5))]
    assert bins == [4681, 73, 4681, 1, 4681 + 64]


def test_bases(spark):
    assert [one(spark, sequence.packed_hex(F.lit(t))) for t in ("ACGT", "ACG", "N", "", "=ry?")] == ["1248", "1240", "f0", "", "05af"]
    assert one(spark, sequence.reverse_complement(F.lit("ACGTacgtRn"))) == "NNacgtACGT"


def test_bam_tags(spark):
    hexed = lambda f, n, v: one(spark, f(n, F.lit(v)))
    assert hexed(bam.tag_number, "NM", 5) == b"NMC\5".hex() and hexed(bam.tag_number, "NM", 300) == (b"NMS" + struct.pack("<H", 300)).hex()
    assert hexed(bam.tag_number, "NM", 100000) == (b"NMI" + struct.pack("<I", 100000)).hex()
    assert hexed(bam.tag_long, "XI", 42) == b"XIC*".hex() and hexed(bam.tag_long, "XI", 5000000000) == b"XIZ5000000000\0".hex()
    assert hexed(bam.tag_long, "XI", -7) == (b"XIi" + struct.pack("<i", -7)).hex() and hexed(bam.tag_text, "RG", "sample1") == b"RGZsample1\0".hex()


def binary(spark, f=Format(mode="bam"), **changed):  # noqa: B008
    """The binary record of one alignment."""
    df = spark.range(1)
    for k, v in (RECORD | {"cached_pos": None, "read_filter": None} | changed).items():
        df = df.withColumn(k, F.lit(v).cast("int") if v is None else F.lit(v))
    return bytes(records.aligned_bam(df, f, {"id": F.col("align_id")}).first()["record"])


def test_bam_record(spark):
    raw = binary(spark)
    size, ref, pos, l_name, mapq, bin_, n_ops, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiiBBHHHiiii", raw)
    assert (size, ref, pos, l_name, mapq, n_ops, flag, l_seq) == (len(raw) - 4, 0, 100, 6, 60, 1, 99, 8) and bin_ == 4681
    assert (mate, mate_pos, tlen) == (0, 500, 300) and raw[36:42] == b"read1\0" and raw[42:46] == struct.pack("<I", 800)
    assert raw[46:50].hex() == "12481248" and raw[50:58] == bytes([40] * 8)
    assert struct.unpack_from("<iii", binary(spark, mate_align_id=0), 24) == (-1, -1, 0)
    bare = binary(spark, quality="", mapq=-1, ref_id=-1)
    assert bare[50:58] == b"\xff" * 8 and bare[13] == 255
    reads = emitted_reads(spots(spark, [SPOT | {"read": "AACG", "read_type": [3], "quality": [1, 2, 3, 4]}]))
    free = bytes(records.unaligned_bam(reads, Format(mode="bam", reverse=True), {"row_id": F.col("row_id")}).first()["record"])
    assert struct.unpack_from("<iiBBHHHiiii", free, 4) == (-1, -1, 6, 0, 4680, 0, 0x14, 4, -1, -1, 0) and free[42:44].hex() == "2488" and free[44:48] == bytes([4, 3, 2, 1])


def one_by_one(r, table=None):
    """A binary record written field by field."""
    ops = re.findall(r"([0-9]*)([MIDNSHP=X])", re.sub("[^0-9MIDNSHP=X]", "", r["cigar"]))
    span = sum(int(n or 0) for n, op in ops if op in "MDN=X")
    last, bin_ = max(r["pos"] + span - 1, 0), 0
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if r["pos"] >> shift == last >> shift:
            bin_ = (first + (r["pos"] >> shift)) & 0xFFFF
            break
    little = lambda v, n: (v & (1 << 8 * n) - 1).to_bytes(n, "little")
    codes = ["=ACMGRSVTWYHKDBN".find(b.upper()) if b.upper() in "=ACMGRSVTWYHKDBN" else 15 for b in r["read"]] + [0] * (len(r["read"]) % 2)
    number = lambda name, v: name + (b"C" + little(v, 1) if v <= 0xFF else b"S" + little(v, 2) if v <= 0xFFFF else b"I" + little(v, 4))
    xi = r["xi"]
    tags = number(b"NM", r["nm"]) + (number(b"NH", r["nh"]) if r["nh"] > 0 else b"") + (b"RGZ" + r["rg"].encode() + b"\0" if r["rg"] else b"")
    tags += number(b"XI", xi) if 0 <= xi <= 0xFFFFFFFF else b"XIi" + little(xi, 4) if -(1 << 31) <= xi < 0 else b"XIZ" + str(xi).encode() + b"\0"
    n_seq = len(r["read"].encode())
    scores = [max(0, b - 33) for b in r["quality"].encode()]
    scores = bytes([table[q] if table else q for q in scores]) or b"\xff" * n_seq
    name = r["name"].encode()
    body = b"".join(little(v, n) for v, n in zip((r["ref_id"], r["pos"], len(name) + 1, r["mapq"], bin_, len(ops), r["flags"], n_seq, r["mate_ref"], r["mate_pos"], r["tlen"]), (4, 4, 1, 1, 2, 2, 2, 4, 4, 4, 4), strict=True))
    body += name + b"\0" + b"".join(little(int(n or 0) << 4 | "MIDNSHP=X".index(op), 4) for n, op in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + scores + tags
    return little(len(body), 4) + body


@pytest.mark.parametrize("table", [None, quality.parse_table("0:10,10:20,20:30,30:40")])
def test_encoder_equals_records_written_one_by_one(table):
    rng = random.Random(4)
    big = lambda: rng.choice([0, 1, -1, 200, 300, 70_000, 1 << 31, 1 << 40, -(1 << 31), -(1 << 33), rng.randrange(1 << 20)])
    rows = []
    for _ in range(500):
        bases = "".join(rng.choice("ACGTNacgt=RYé*") for _ in range(rng.choice([0, 1, 2, 7, 40])))
        cigar = "".join(f"{rng.choice(['', 0, 5, 123, 9999])}{rng.choice('MIDNSHP=XZq')}" for _ in range(rng.choice([0, 1, 3, 9]))) + rng.choice(["", "12"])
        rows.append({
            "name": rng.choice(["", "r1", "spot.é", "x" * 300]), "ref_id": big(), "pos": rng.choice([-1, 0, 5, 16_384, 1 << 29]), "mapq": big(), "flags": big(), "cigar": cigar, "read": bases,
            "quality": rng.choice(["", "".join(chr(33 + rng.randrange(60)) for _ in bases), "\x1f!~"]), "mate_ref": big(), "mate_pos": big(), "tlen": big(), "nm": abs(big()), "nh": big(), "rg": rng.choice(["", "RG1", "ä"]), "xi": big(),
        })
    for part in (rows, rows[:1], []):
        b = pa.RecordBatch.from_pylist(part, pa.schema([(k, pa.int64() if isinstance(v, int) else pa.string()) for k, v in rows[0].items()]))
        assert encoder.aligned(b, table).to_pylist() == [one_by_one(r, table) for r in part]
        assert encoder.aligned(b.slice(3), table).to_pylist() == [one_by_one(r, table) for r in part[3:]]


def test_regions(spark):
    assert regions.parse_region("chr1") == regions.Region("chr1") and regions.parse_region("chr1:1000-2000") == regions.Region("chr1", 999, 2000)
    assert regions.parse_region("chr2:0-500").start == 0
    for bad in ("chr1:1000", "chr1:abc-2000", "chr1:1000-xyz", "chr1:"):
        with pytest.raises(ValueError):
            regions.parse_region(bad)
    refs = spark.createDataFrame([(0, "chr1", "NC_1", 9), (1, "chr2", "NC_2", 9)], S.REFERENCE_COLUMNS)
    assert [r.name for r in regions.resolve([regions.Region("NC_2"), regions.Region("chr1")], refs)] == ["chr2", "chr1"]
    with pytest.raises(ValueError):
        regions.resolve([regions.Region("chr9")], refs)
    rows = spark.createDataFrame([(1, "chr1", 10), (2, "chr1", 20)], "align_id long, ref_name string, ref_pos int")
    with pytest.raises(ValueError):
        regions.require_alignments(rows, [regions.Region("chr2")])
    twice = regions.in_regions(rows, [regions.Region("chr1", 5, 15), regions.Region("chr1", 0, 30)])
    assert sorted((r["region_no"], r["align_id"]) for r in twice.collect()) == [(0, 1), (1, 1), (1, 2)]


def cached_one_by_one(rows):
    """A cache read in row order: take the mate, then put oneself."""
    cache, out = {}, {}
    for align_id, ref, pos, mate in sorted(rows):
        if mate:
            out[align_id] = cache.pop((ref, mate), None)
            cache[ref, align_id] = pos
        else:
            out[align_id] = None
    return out


def test_mate_cache(spark):
    import random

    rng = random.Random(9)
    for _ in range(4):
        rows = [(i, rng.choice("ab"), rng.randrange(1000), rng.choice([0, max(1, i - rng.randrange(4)), rng.randrange(1, 40)])) for i in range(1, 40)]
        df = spark.createDataFrame(rows, "align_id long, ref_name string, ref_pos int, mate_align_id long")
        assert {r["align_id"]: r["cached_pos"] for r in with_cached_mates(df).collect()} == cached_one_by_one(rows)


def test_mapq(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,)], "mapq int")
    assert filters.by_mapq(df).count() == 2 and filters.by_mapq(df, 5).count() == 1 and filters.by_mapq(df, 0xFFFFFFFF).count() == 3


def test_header_and_dictionary(spark):
    lines = "@HD\tVN:1.3\n@SQ\tSN:chr1\tLN:248956422\n@SQ\tSN:chr2\tLN:242193529\n@SQ\tLN:5\n@SQ\tSN:x\tLN:z\n"
    assert references.dictionary_of(lines) == [("chr1", 248956422), ("chr2", 242193529), ("x", 0)]
    df = spark.createDataFrame(list(enumerate(lines.splitlines())), "line_no long, line string")
    assert [tuple(r) for r in references.sequence_dictionary(df).orderBy("ref_id").collect()] == [(0, "chr1", 248956422), (1, "chr2", 242193529), (2, "x", 0)]
    raw = references.bam_header("@SQ\tSN:chr1\tLN:100\n")
    assert raw[:4] == b"BAM\1" and raw[-17:] == struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<I", 100)
    refs = spark.createDataFrame([(0, "chr1", "NC_1", 7)], S.REFERENCE_COLUMNS)
    a = Archive(spark, tables=((S.REFERENCES, refs),), stored_header="@HD\tVN:1.6")
    assert references.header_text(a, comments=("hi",)) == "@HD\tVN:1.6\n@CO\thi\n"
    assert references.header_text(a, True, True) == "@HD\tVN:1.3\n@SQ\tSN:NC_1\tLN:7\n" and references.header_text(a, True, from_file="x") == "x\n"
    assert references.header_text(Archive(spark, tables=((S.REFERENCES, refs),))).endswith("SN:chr1\tLN:7\n")


def test_texts():
    assert [text.duration(s) for s in (0, 45, 60, 135, 3600, 5400)] == ["0s", "45s", "1m", "2m 15s", "1h", "1h 30m"]
    assert text.count(1234567) == "1,234,567" and text.rate(100000, 5) == "20,000 records/s" and text.rate(10, 60) == "10.0 records/min" and text.rate(1, 0) == "-- records/s"
    e = text.ArchiveError(0x900995D8)
    assert e.module == 18 and e.network and not e.done and text.ArchiveError(1).done


def test_retry(spark):
    def failing(times, code=0x90000000):
        calls = []

        def call():
            calls.append(1)
            if len(calls) <= times:
                raise text.ArchiveError(code)
            return "ok"

        return call, calls

    for times, want in ((0, 1), (2, 3), (9, 4)):
        call, calls = failing(times)
        if times == 9:
            with pytest.raises(text.ArchiveError):
                retry.on_network_error("x", call, lambda s: None)
        else:
            assert retry.on_network_error("x", call, lambda s: None) == "ok"
        assert len(calls) == want
    try:
        no_network = spark._jvm.java.net.InetAddress.getByName("no host has this name")
    except Exception as e:  # noqa: BLE001
        assert retry.is_network_error(e)
    else:
        raise AssertionError(no_network)
    call, calls = failing(1, 0x10000000)
    with pytest.raises(text.ArchiveError):
        retry.on_network_error("x", call, lambda s: None)
    assert len(calls) == 1


def test_schema_rules(spark):
    df = spark.createDataFrame([(1, None)], "align_id long, ref_pos int")
    with pytest.raises(S.MissingColumn):
        S.conform(df, S.ALIGNED_COLUMNS)
    got = S.conform(df, S.ALIGNED_COLUMNS, ["align_id", "ref_pos", "read_filter", "alignment_count"]).first()
    assert (got["ref_pos"], got["read_filter"], got["alignment_count"]) == (0, None, 0)


# --- whole conversions


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The derived tables as an archive on disk."""
    root = tmp_path_factory.mktemp("archive")
    fixture.write(spark, sf_dir, str(root))
    return str(root)


def pushed(df):
    """What each file scan of the plan has in PushedFilters."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sorted({tuple(re.split(r", (?=[A-Z])", x)) if x else () for x in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)})


def test_archive_scan(spark, stored):
    a = open_archive(spark, stored)
    assert a.list_tables() == sorted(S.TABLES) and a.has_table(S.SEQUENCE) and a.bam_header() is None
    first, n = a.id_range(S.PRIMARY, "align_id")
    assert first == 1 and n == a.aligned().count()
    with pytest.raises(FileNotFoundError):
        open_archive(spark, stored + "-none")


def test_quality_and_regions_reach_the_reader(spark, stored):
    a = open_archive(spark, stored)
    assert pushed(a.aligned(keep=filters.stored_mapq(30)).select("align_id")) == [("IsNotNull(mapq)", "GreaterThanOrEqual(mapq,30)")]
    assert pushed(a.aligned(keep=filters.stored_mapq()).select("align_id")) == [("Or(GreaterThanOrEqual(mapq,0),IsNull(mapq))",)]
    one = [regions.Region("chr5", 10000, 50000)]
    want = ("IsNotNull(ref_name)", "IsNotNull(ref_pos)", "EqualTo(ref_name,chr5)", "GreaterThanOrEqual(ref_pos,10000)", "LessThan(ref_pos,50000)")
    assert pushed(regions.in_regions(a.aligned(keep=regions.stored_regions(one)), one).select("align_id")) == [want]
    plan = convert.aligned_rows(a, S.PRIMARY, convert.Options(regions=("chr5:10001-50000", "chr7"), min_mapq=30)).select("align_id", "cached_pos")
    found = [" ".join(p) for p in pushed(plan) if any("mapq" in x for x in p)]
    assert found and all("GreaterThanOrEqual(mapq,30)" in p and "EqualTo(ref_name,chr7)" in p and "LessThan(ref_pos,50000)" in p for p in found)


def test_empty_cells_count_as_before(spark):
    rows = [(1, None, None, None), (2, 5, "chr1", None), (3, 40, "chr1", 9), (4, -3, "chr1", 5), (5, 50, "", 7)]
    df = spark.createDataFrame(rows, "align_id long, mapq int, ref_name string, ref_pos int")
    filled = df.select("align_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in (("mapq", 0), ("ref_name", ""), ("ref_pos", 0))])
    ids = lambda d: sorted(r["align_id"] for r in d.select("align_id").distinct().collect())
    for least in (None, 0, 5, 41, 0xFFFFFFFF):
        assert ids(df.where(filters.stored_mapq(least))) == ids(filters.by_mapq(filled, least))
    for some in ([regions.Region("chr1", 0, 6)], [regions.Region("chr1", 3, 10), regions.Region("")], [regions.Region("", 7, 8)], [regions.Region("chr1")]):
        assert ids(df.where(regions.stored_regions(some))) == ids(regions.in_regions(filled, some))


def test_sam_file_is_ordered(spark, stored, tmp_path):
    cli.main(["tosam", stored, "-u", "--output-file", f"{tmp_path}/x.sam"])
    lines = (tmp_path / "x.sam").read_text().splitlines()
    head, body = [x for x in lines if x[0] == "@"], [x.split("\t") for x in lines if x[0] != "@"]
    assert head[0] == "@HD\tVN:1.3" and len(head) == 26
    a = open_archive(spark, stored)
    n, m = a.aligned().count(), a.aligned(S.SECONDARY).count()
    assert len(body) > n + m
    place = [(int(x[2][3:]), int(x[3])) for x in body[:n]]
    assert place == sorted(place) and all(x[2] == "*" for x in body[n + m :])


def test_compressed_and_folder_output(spark, stored, tmp_path):
    cli.main(["tosam", stored, "-1", "--fastq", "--gzip", "--bzip2", "--output-file", f"{tmp_path}/x.fq.gz"])
    cli.main(["tosam", stored, "-1", "--fastq", "--output-folder", f"{tmp_path}/parts"])
    whole = gzip.decompress((tmp_path / "x.fq.gz").read_bytes()).decode()
    assert whole.count("\n") == 4 * open_archive(spark, stored).aligned().count()
    assert whole == "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))


@pytest.mark.parametrize("form", ["sam", "bam"])
def test_folder_holds_what_a_file_holds(spark, stored, tmp_path, form):
    a, o = open_archive(spark, stored), convert.Options(unaligned=True, output_format=form)
    cli.convert(a, o, f"{tmp_path}/x", None, 500)
    cli.convert(a, o, None, f"{tmp_path}/parts", 500)
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert len(parts) > 4 and b"".join(p.read_bytes() for p in parts) == (tmp_path / "x").read_bytes()
    assert {p.name for p in (tmp_path / "parts").iterdir() if not p.name.startswith((".", "_SUCCESS"))} == {p.name for p in parts}
    first = parts[0].read_bytes()
    assert gzip.decompress(first)[:4] == b"BAM\1" and parts[-1].read_bytes() == writers.END_BLOCK if form == "bam" else first.startswith(b"@HD\t")


def test_ordered_parts_are_even_and_in_order(spark):
    rows = [(s, g, 10 * g + i, 0, f"{s}.{g}.{i}") for s in (0, 2) for g in range(40) for i in range(1 + 37 * (g == 7))]
    df = spark.createDataFrame(rows, "stage int, group_no long, row_id long, read_no int, record string")
    histogram = df.groupBy("stage", "group_no", writers.bucket_of(F.col("row_id"), 20).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
    got = writers.ordered(df.repartition(7), convert.ORDER, histogram, 20)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 20 and len(sizes) == -(-len(rows) // 20)
    assert [r["record"] for r in got.select("record").toLocalIterator()] == [r[4] for r in sorted(rows)]
    assert writers.ordered(df.limit(0), convert.ORDER, histogram.limit(0), 20).count() == 0


@pytest.mark.parametrize("fan", [4, writers.FAN])
def test_parts_are_even_where_ids_have_gaps(spark, monkeypatch, fan):
    """Half of the ids in one hundredth of their range, some far away: no part is more than a bucket larger than another."""
    monkeypatch.setattr(writers, "FAN", fan)
    ids = [*range(500_000, 510_000), *range(0, 1_000_000, 100)]
    df = spark.createDataFrame([(0, 3, i, n) for n, i in enumerate(ids)], "stage int, group_no long, row_id long, read_no int").withColumn("record", F.lit("x"))
    histogram = df.groupBy("stage", "group_no", writers.bucket_of(F.col("row_id"), 1000).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
    got = writers.ordered(df, convert.ORDER, histogram, 1000).select(F.spark_partition_id().alias("p"), "row_id").collect()
    sizes = Counter(r["p"] for r in got)
    assert len(sizes) == 20 and max(sizes.values()) <= 1063 and min(sizes[p] for p in list(sizes)[:-1]) >= 937
    assert [r["row_id"] for r in sorted(got, key=lambda r: (r["p"], r["row_id"]))] == sorted(ids)


STREAMED = [["-u", "--output-format", "bam"], ["--fastq", "-1", "--gzip"], ["--fastq", "-1", "--bzip2"], ["-1", "-n"]]


@pytest.mark.parametrize("args", STREAMED)
def test_a_stream_gets_the_bytes_of_a_file(spark, stored, tmp_path, args):
    a, o = open_archive(spark, stored), cli.options_of(cli.parser().parse_args(["tosam", stored, *args]))
    cli.convert(a, o, f"{tmp_path}/x", part_rows=700)
    out = io.BytesIO()
    assert cli.convert(a, o, part_rows=700, out=out) is None
    assert out.getvalue() == (tmp_path / "x").read_bytes() and len(out.getvalue()) > 1000


def test_standard_output_of_the_command(stored, tmp_path):
    """Through a pipe of a process of its own: binary records and nothing else."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-m", "strandforge.plans.cli", "tosam", stored, "-1", "--output-format", "bam", "-t", "2"], env=env, cwd=tmp_path, capture_output=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.endswith(writers.END_BLOCK) and gzip.decompress(done.stdout)[:4] == b"BAM\1"


def test_parts_stream_while_later_ones_are_made(spark, monkeypatch):
    """The first part is with the reader before the last one exists; a reader that goes away ends the job."""
    df = spark.range(40, numPartitions=8).select(F.lit(0).alias("stage"), F.lit(0).cast("long").alias("group_no"), F.col("id").alias("row_id"), F.lit(0).alias("read_no"), F.lit("x").alias("record"))
    histogram = df.groupBy("stage", "group_no", writers.bucket_of(F.col("row_id"), 4).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
    seen = []

    class Reader(io.BytesIO):
        def write(self, data):
            seen.append(data)
            if len(seen) == 3:
                raise BrokenPipeError
            return len(data)

    with pytest.raises(BrokenPipeError):
        writers.stream_parts(df, Reader(), convert.ORDER, histogram, "none", 4)
    assert seen == [b"x\n" * 4] * 3

    out = io.BytesIO()

    def one_by_one_(records, folder, *_):
        """Makes a part only when the one before it has arrived."""
        at = folder.removeprefix("file://")
        os.makedirs(at)
        for i in range(10):
            with open(f"{at}/try", "wb") as f:
                f.write(b"%d\n" % i)
            os.rename(f"{at}/try", f"{at}/part-{i:05d}")
            until = time.monotonic() + 20
            while len(out.getvalue()) < 2 * i + 2:
                assert time.monotonic() < until, "a part waits for later ones"
                time.sleep(0.01)
            assert not os.path.exists(f"{at}/part-{i - 1:05d}")

    monkeypatch.setattr(writers, "write_parts", one_by_one_)
    writers.stream_parts(df, out, convert.ORDER, histogram, "none", 4)
    assert out.getvalue() == b"".join(b"%d\n" % i for i in range(10))


def test_boundaries_come_from_footers(spark, sf_dir, tmp_path):
    """No row group is read where the table lies by reference; a scan gives the same where it does not, or where a file lacks statistics."""
    a = fixture.by_reference(spark, sf_dir)
    plan = a.from_footers(S.PRIMARY, "align_id", "ref_name")._jdf.queryExecution().explainString(archive._FORMATTED(spark))
    assert "PushedAggregation: [MIN(align_id), MAX(align_id), COUNT(*)]" in plan and "PushedGroupBy: [ref_name]" in plan
    want = sorted(map(tuple, references.boundaries(a.aligned()).collect()))
    assert sorted(map(tuple, references.boundaries_of(a).collect())) == want and len(want) == 25
    flat = fixture.archive(spark, sf_dir)
    assert flat.from_footers(S.PRIMARY, "align_id", "ref_name") is None  # the file reader cannot group by a stored column
    assert sorted(map(tuple, references.boundaries_of(flat).collect())) == want
    bare = f"{tmp_path}/bare"
    a.table(S.PRIMARY).write.option("parquet.column.statistics.enabled", "false").partitionBy("ref_name").parquet(f"{bare}/{S.PRIMARY}")
    assert sorted(map(tuple, references.boundaries_of(Archive(spark, bare)).collect())) == want
    held = Archive(spark, tables=((S.PRIMARY, flat.table(S.PRIMARY)),))
    assert held.from_footers(S.PRIMARY, "align_id") is None and sorted(map(tuple, references.boundaries_of(held).collect())) == want


@pytest.mark.parametrize("ids", [1, 7, references.WALK_IDS])
def test_walk_equals_a_sort(spark, ids):
    """Many records at one position, in both sources."""
    rng = random.Random(ids)
    rows = [(rng.randrange(3), p // 10, p, rng.randrange(2), i) for i in range(400) for p in [rng.choice([5, 5, 5, rng.randrange(40)])]]
    got = references.walk(spark.createDataFrame(rows, "ref_idx int, window_no long, pos int, source_no int, align_id long").repartition(5), ids=ids)
    assert [tuple(r)[1:] for r in sorted(got.collect())] == sorted(rows) and sorted(r.ordinal for r in got.collect()) == list(range(1, 401))
    assert references.walk(got.drop("ordinal").limit(0)).count() == 0


def test_status_lines_while_a_job_runs(spark):
    out = io.StringIO()
    with progress.Status(spark, 0.3, out):
        slow = spark.range(0, 400, 1, 40).mapInArrow(lambda batches: (time.sleep(0.3) or b for b in batches), "id long")
        assert slow.repartition(4).count() == 400
    lines = out.getvalue().splitlines()
    assert len(lines) >= 2 and all(re.fullmatch(r"\[progress\] Processed [\d,]+ records across \d+ of \d+ work items in \d+s \(.*\)", x) for x in lines)
    status = progress.Status(spark, 0.01, out)
    seen = iter([(1, 10, 1, 4), (1, 9, 1, 4), None, (1, 20, 2, 4), (2, 0, 0, 2)])
    status.now = lambda: next(seen, None)
    out.truncate(0)
    with status:
        time.sleep(0.5)
    assert re.findall(r"Processed (\d+) records across (\d)", out.getvalue()) == [("10", "1"), ("20", "2"), ("0", "0")]


def test_a_failing_task_fails_the_stream(spark):
    bad = spark.range(8).select(F.lit(0).alias("stage"), F.lit(0).cast("long").alias("group_no"), F.col("id").alias("row_id"), F.lit(0).alias("read_no"), F.expr("if(id = 7, raise_error('no'), 'x')").cast("string").alias("record"))
    histogram = bad.groupBy("stage", "group_no", writers.bucket_of(F.col("row_id"), 4).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
    with pytest.raises(Exception, match="no"):
        writers.stream_parts(bad, io.BytesIO(), convert.ORDER, histogram, "none", 4)


def test_bam_file(spark, stored, tmp_path):
    cli.main(["tosam", stored, "-1", "--output-format", "bam", "--min-mapq", "30", "--output-file", f"{tmp_path}/x.bam"])
    packed = (tmp_path / "x.bam").read_bytes()
    raw = gzip.decompress(packed)
    assert raw[:4] == b"BAM\1" and packed.endswith(writers.END_BLOCK)
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    n_ref = struct.unpack_from("<i", raw, at)[0]
    at += 4
    for _ in range(n_ref):
        at += 8 + struct.unpack_from("<i", raw, at)[0]
    seen = []
    while at < len(raw):
        size, ref, pos = struct.unpack_from("<iii", raw, at)
        seen.append((ref, pos))
        at += 4 + size
    assert at == len(raw) and n_ref == 25 and seen == sorted(seen) and len(seen) == open_archive(spark, stored).aligned().where("mapq >= 30").count()


def test_regions_follow_the_command_line(spark, stored):
    o = convert.Options(regions=("chr9", "chr2:1-50000", "chr9"), primary_only=True)
    plan = convert.records_plan(open_archive(spark, stored), o)
    got = plan.orderBy(*convert.ORDER).select("group_no", "record").collect()
    names = [r["record"].split("\t")[2] for r in got]
    n = names.index("chr2")
    assert set(names[:n]) == {"chr9"} and names[:n] == names[-n:] and [r["record"] for r in got[:n]] == [r["record"] for r in got[-n:]]


def test_options_are_checked(spark, stored, tmp_path):
    for args in (["--output-format", "bam", "-n", "--output-file", "x"], ["-Q", "nonsense", "--output-file", f"{tmp_path}/y"], [stored, "--output-file", f"{tmp_path}/y"]):
        with pytest.raises(ValueError):
            cli.main(["tosam", stored, *args])
    assert not (tmp_path / "y").exists()
    args = cli.parser().parse_args(["tosam", "A", "-u", "-1", "--aligned-region", "chr1", "--aligned-region", "chr2:1-5", "--min-mapq", "3", "-n", "-r", "--header-comment", "c", "-s", "-o", "-c", "-g", "-p", "P", "--reverse", "-Q", "1:2", "--XI", "-t", "4", "--pool-size", "9", "--fasta", "--fastq"])
    o = cli.options_of(args)
    assert o.mode == "fasta" and o.regions == ("chr1", "chr2:1-5") and o.xi and o.seqid and not o.writes_header and o.format.prefix == "P"
    assert convert.Options(output_format="bam", fasta=True, gzip=True).mode == "bam" and convert.Options(output_format="bam", gzip=True).compression == "none"
    assert convert.Options(gzip=True, bzip2=True).compression == "gzip"


def test_cache_refs(spark, stored, capsys):
    assert cli.cache_refs(spark, [stored, "/nowhere/at/all"]) == (1, 1)
    said = capsys.readouterr().err
    assert "25 dependencies (9 local, 16 resolved)" in said and "1 accession(s) processed, 1 failed" in said
    assert cli.main(["cache-refs", stored]) == 0


def test_stream_equals_batch(spark, stored, tmp_path):
    f = Format(mode="fastq")
    q = follow.follow(follow.unaligned_records(follow.spot_stream(spark, f"{stored}/{S.SEQUENCE}"), f), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    got = sorted("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).splitlines())
    want = follow.unaligned_records(open_archive(spark, stored).sequence(), f).collect()
    assert got == sorted("\n".join(r["record"] for r in want).splitlines())


@pytest.mark.parametrize("shares", [1, follow.MATE_SHARES])
def test_mates_in_a_stream_equal_a_lookup_in_the_table(spark, sf_dir, tmp_path, shares):
    """Contested mates, five files one after the other; mates are in other files than those that ask."""
    kept = fixture.archive(spark, sf_dir).table(S.SECONDARY).select("ref_name", "align_id", "mate_align_id", "ref_pos")
    rows = sorted(map(tuple, kept.collect()), key=lambda r: r[1])
    files = [rows[i * len(rows) // 5 : (i + 1) * len(rows) // 5] for i in range(5)]
    for i, part in enumerate(files):
        spark.createDataFrame(part, kept.schema).coalesce(1).write.parquet(f"{tmp_path}/tmp{i}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        name = next(n for n in os.listdir(f"{tmp_path}/tmp{i}") if n.endswith(".parquet"))
        os.rename(f"{tmp_path}/tmp{i}/{name}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    stream = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = follow.mates_in_stream(stream, shares).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted(tuple(r) for r in with_cached_mates(kept).select("align_id", "mate_align_id", "cached_pos").collect())
    assert got == want and 0 < sum(r[2] is not None for r in want) < len(want)


def test_named_source(spark, stored, tmp_path):
    """The scan's rows; options are asked of stored cells, empty ones included; large files are cut between row groups."""
    reader.register(spark)
    load = lambda path=stored, **o: spark.read.format("strandforge_archive").options(**o).load(path)
    want = S.conform(open_archive(spark, stored).table(S.PRIMARY), S.ALIGNED_COLUMNS)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(load()) == rows(want)
    cases = [({"min_mapq": 30, "references": "chr3"}, "mapq >= 30 AND ref_name = 'chr3'"), ({"first_id": 101, "last_id": 140}, "align_id > 100 AND align_id <= 140"), ({"references": "chr1,chr9"}, "ref_name IN ('chr1', 'chr9')")]
    for options, cond in cases:
        assert rows(load(**options)) == rows(want.where(cond)) != [], cond
    for table in (S.SECONDARY, S.SEQUENCE, S.REFERENCES, S.DEPENDENCIES):
        assert rows(load(table=table)) == rows(S.conform(open_archive(spark, stored).table(table), S.TABLES[table], optional=S.OPTIONAL if table == S.SECONDARY else {}))
    odd = want.select(*[F.when(F.col(n) % 3 == 0, F.col(n)).alias(n) if n in ("mapq", "ref_pos") else F.col(n) for n in want.columns if n != "alignment_count"])
    odd.coalesce(1).write.option("parquet.block.size", 20_000).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 10).parquet(f"{tmp_path}/odd/{S.PRIMARY}")
    filled = S.conform(spark.read.parquet(f"{tmp_path}/odd/{S.PRIMARY}"), S.ALIGNED_COLUMNS)
    cut = load(f"{tmp_path}/odd", task_bytes="20000")
    assert cut.rdd.getNumPartitions() > 1
    for cond in ("true", "mapq <= 6", "mapq > 6", "ref_pos = 0 OR mapq = 3", "alignment_count = 0", "alignment_count > 0"):  # one DataFrame, asked again and again
        assert rows(cut.where(cond)) == rows(filled.where(cond)), cond
    for least in (-5, 0, 7):
        assert rows(load(f"{tmp_path}/odd", min_mapq=least)) == rows(filled.where(f"mapq >= {least}"))
    with pytest.raises(Exception, match="no table"):
        load(f"{tmp_path}/odd", table=S.SEQUENCE).count()
    with pytest.raises(Exception, match="no column"):
        load(table=S.SEQUENCE, min_mapq=3).count()


def test_mate_lookup_by_id_moves_no_wide_row(spark, sf_dir):
    a = fixture.by_id(spark, sf_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = with_cached_mates(filters.by_mapq(a.aligned())).select("align_id", "cached_pos", "read", "quality")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    wide = next(i for i, x in enumerate(lines) if "FileScan" in x and "quality" in x)
    above = len(lines[wide]) - len(lines[wide].lstrip(" :+-|"))
    for x in reversed(lines[:wide]):  # the nodes on the way from the wide scan to the top
        depth = len(x) - len(x.lstrip(" :+-|"))
        if depth < above:
            above = depth
            assert "Exchange" not in x, plan
    assert plan.count("Exchange") > 0 and "Bucketed: true" in lines[wide]


def test_plans_have_no_python(spark, sf_dir):
    from strandforge.queries import QUERIES

    for name, q in QUERIES.items():
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        encodes = name in ("bam_record_hex", "bam_unaligned_hex")  # whole records are encoded a batch at a time
        if name.startswith("source_"):
            continue  # read through a data source of this package
        assert plan.count("MapInArrow") == encodes and "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan, name


@pytest.mark.parametrize("master,fine", [("local", True), ("local[8]", True), ("local-cluster[3,2,1000]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    from types import SimpleNamespace

    known = {}
    conf = SimpleNamespace(get=lambda k, d=None: known.get(k, d), set=known.__setitem__)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    if fine:
        assert storage.shared_folder(session).startswith("file://") and known
    else:
        with pytest.raises(RuntimeError):
            storage.shared_folder(session)


def test_files_of_the_archive_have_ranges_of_ids(spark):
    """F8-F10: rows are dealt by id, none sampled, and a file's rows stay about FILE_ROWS however many there are."""
    rows = fixture.in_files(spark.range(1, 1001, numPartitions=7), F.col("id"))
    parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).orderBy("p").collect()
    assert len(parts) == fixture.FILES and all(r["b"] - r["a"] + 1 == r["n"] == 125 for r in parts)


def test_digest_of_a_file_of_members(spark, tmp_path):
    """F2-F5: any number of members is read piece by piece, as is one without content; a cut one is an error."""
    import gzip
    import hashlib
    import random

    from strandforge.sources import writers

    data = [random.Random(i).randbytes(n) for i, n in enumerate((300_000, 0, 1, 65_280, 200_000))]
    path = tmp_path / "x.bam.gz"
    path.write_bytes(b"".join(map(gzip.compress, data)))
    assert [tuple(r) for r in writers.content_digest(spark, str(path)).collect()] == [(sum(map(len, data)), hashlib.sha256(b"".join(data)).hexdigest())]
    with pytest.raises(EOFError):
        list(writers.unpacked(iter([path.read_bytes()[:-3]])))


def test_lines_are_numbered_without_moving(spark, tmp_path):
    """F6, F7, F14, F16: lines get numbers as they are read: no sort, and only a row for each split is exchanged."""
    from types import SimpleNamespace

    from strandforge import queries

    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(1000)))
    (tmp_path / "b.txt").write_text("b0\nb1\n")
    lines = queries._lines(SimpleNamespace(spark=spark), str(tmp_path))
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == [f"a{i}" for i in range(1000)] + ["b0", "b1"]
    assert sorted(r["line_no"] for r in lines.collect()) == list(range(1, 1003))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "row_number" not in plan
