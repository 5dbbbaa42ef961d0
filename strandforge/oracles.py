"""The registered queries as DuckDB SQL, written from the definitions, not from the plans."""

from __future__ import annotations

_FIXTURE = """refs AS (SELECT n_nationkey AS ref_idx, 'chr'||(n_nationkey+1)::string AS name, 'NC_'||lpad((n_nationkey+1)::string,6,'0')||'.1' AS seq_id, (1000000+n_nationkey)::bigint AS seq_length FROM nation),
placed AS (SELECT *, row_number() OVER (ORDER BY ref_idx,ref_pos,spot_id,read_no) AS align_id FROM (
 SELECT spot_id, read_no, (CASE WHEN read_no=2 AND spot_id%3=0 THEN (spot_id+1)%25 ELSE spot_id%25 END)::int AS ref_idx,
  ((spot_id*7919)%100000 + CASE WHEN read_no=2 THEN 150 ELSE 0 END)::int AS ref_pos, ((spot_id*13+read_no*7)%61)::int AS mapq
 FROM (SELECT o_orderkey+1 AS spot_id, 1 AS read_no FROM orders WHERE (o_orderkey+1)%5>=1 UNION ALL SELECT o_orderkey+1, 2 FROM orders WHERE (o_orderkey+1)%5>=2) r) p),
aligned AS (SELECT a.align_id, a.spot_id, a.read_no, a.ref_idx, r.name AS ref_name, a.ref_pos, a.mapq, 'spot'||a.spot_id::string AS seq_name,
 (1 + CASE WHEN a.read_no=1 THEN 64 ELSE 128 END + CASE WHEN m.align_id IS NULL THEN 8 ELSE 2 END + CASE WHEN a.spot_id%2=0 THEN 16 ELSE 0 END)::int AS sam_flags,
 CASE a.spot_id%4 WHEN 0 THEN '32M' WHEN 1 THEN '10M2I20M' WHEN 2 THEN '5S20M3D7M' ELSE '16M100N16M' END AS cigar,
 CASE a.spot_id%4 WHEN 0 THEN '30=1X1=' WHEN 1 THEN '10=2I20=' WHEN 2 THEN '5S20=3D7=' ELSE '16=100N15=1X' END AS cigar_long,
 coalesce(m.align_id,0) AS mate_align_id, coalesce(mr.name,'') AS mate_ref_name, coalesce(m.ref_pos,0)::int AS mate_ref_pos,
 (CASE WHEN m.ref_idx=a.ref_idx THEN m.ref_pos-a.ref_pos ELSE 0 END)::int AS template_len,
 translate(md5('r'||a.spot_id::string||':'||a.read_no::string),'0123456789abcdef','ACGTACGTACGTACGN') AS read,
 CASE WHEN a.spot_id%17=0 THEN '' ELSE translate(md5('q'||a.spot_id::string||':'||a.read_no::string),'0123456789abcdef','#%*-05:?ABCDEFGI') END AS quality,
 (a.spot_id%6)::bigint AS edit_distance, CASE WHEN a.spot_id%3=0 THEN '' ELSE 'RG'||(a.spot_id%3)::string END AS spot_group,
 (a.spot_id%3)::int AS alignment_count, (CASE a.spot_id%5 WHEN 4 THEN NULL ELSE a.spot_id%4 END)::int AS read_filter
 FROM placed a JOIN refs r ON r.ref_idx=a.ref_idx LEFT JOIN placed m ON m.spot_id=a.spot_id AND m.read_no<>a.read_no LEFT JOIN refs mr ON mr.ref_idx=m.ref_idx),
secondary AS (SELECT * EXCLUDE (align_id, mate_align_id, n), n AS align_id, CASE WHEN n%5=0 THEN 0 WHEN n%5=1 THEN n+1 ELSE n-n%5+1 END AS mate_align_id
 FROM (SELECT *, row_number() OVER (ORDER BY align_id) AS n FROM aligned WHERE spot_id%4=0)),
spots AS (SELECT *, list_transform(range(1, length(read)+1), lambda i: ((i+row_id)%41)::int) AS quality FROM (
 SELECT o.o_orderkey+1 AS row_id, 'spot'||(o.o_orderkey+1)::string AS name, CASE WHEN (o.o_orderkey+1)%3=0 THEN '' ELSE 'RG'||((o.o_orderkey+1)%3)::string END AS spot_group,
 translate(md5('r'||(o.o_orderkey+1)::string||':1')||md5('r'||(o.o_orderkey+1)::string||':2'),'0123456789abcdef','ACGTACGTACGTACGN')||'ACGT' AS read,
 [coalesce(p1.align_id,0), coalesce(p2.align_id,0), 0] AS ids, [1, 3, 0] AS types, [0, 32, 64] AS starts,
 [32, CASE WHEN (o.o_orderkey+1)%11=0 THEN 0 ELSE 32 END, 4] AS lens, [((o.o_orderkey+1)%4)::int, 0, 0] AS filters
 FROM orders o LEFT JOIN placed p1 ON p1.spot_id=o.o_orderkey+1 AND p1.read_no=1 LEFT JOIN placed p2 ON p2.spot_id=o.o_orderkey+1 AND p2.read_no=2)),
deps AS (SELECT 'SRR'||(100+n_regionkey)::string AS accession, 'NC_'||lpad((n_nationkey+1)::string,6,'0')||'.1' AS seq_id, n_nationkey%3=0 AS local FROM nation),
unnested AS (SELECT row_id, name, spot_group, unnest([0,1,2]) AS i, read, quality, ids, types, starts, lens, filters FROM spots),
emitted AS (SELECT row_id, name, spot_group, i AS read_no, (row_number() OVER (PARTITION BY row_id ORDER BY i) - 1)::int AS bio_index, (count(*) OVER (PARTITION BY row_id))::int AS n,
 types[i+1]::int AS read_type, filters[i+1]::int AS read_filter, substr(read, starts[i+1]+1, lens[i+1]) AS read, quality[starts[i+1]+1 : starts[i+1]+lens[i+1]] AS quality
 FROM unnested WHERE ids[i+1]=0 AND types[i+1]&1=1 AND lens[i+1]>0)"""


def _with(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((_FIXTURE, *ctes)) + "\n" + select


def _mated(source: str, where: str = "mapq >= 0", scope: str = "ref_name", n: str = "") -> tuple[str, ...]:
    """k: kept rows; m: with cached_pos, from the take order of each mate. n ends these names."""
    cols = scope.split(", ")
    return (
        f"k{n} AS (SELECT * FROM {source} WHERE {where})",
        f"pend{n} AS (SELECT align_id, {scope}, mate_align_id, row_number() OVER (PARTITION BY {scope}, mate_align_id ORDER BY align_id) AS take_no FROM k{n} WHERE mate_align_id<>0 AND align_id>mate_align_id)",
        f"m{n} AS (SELECT k.*, x.ref_pos AS cached_pos FROM k{n} k LEFT JOIN pend{n} p ON p.align_id=k.align_id AND p.take_no=1 AND {' AND '.join(f'p.{c}=k.{c}' for c in cols)} "
        f"LEFT JOIN k{n} x ON x.align_id=p.mate_align_id AND x.mate_align_id<>0 AND {' AND '.join(f'x.{c}=p.{c}' for c in cols)})",
    )


def _filtered(flags: str, read_filter: str = "read_filter") -> str:
    return f"(CASE WHEN {read_filter} IS NULL THEN {flags} WHEN {read_filter}=1 THEN {flags} | 512 WHEN {read_filter}=2 THEN ({flags} & ~512) | 1024 ELSE {flags} & ~512 END)"


_STRIPPED = "(CASE WHEN mate_align_id=0 THEN sam_flags & ~235 ELSE sam_flags END)"


def _rnext(rname: str, cached: str = "cached_pos") -> str:
    return f"CASE WHEN {cached} IS NOT NULL THEN '=' WHEN mate_ref_name IN ('','*') THEN '*' WHEN mate_ref_name={rname} THEN '=' ELSE mate_ref_name END"


def _pnext(cached: str = "cached_pos") -> str:
    return f"(CASE WHEN {cached} IS NOT NULL THEN {cached}+1 WHEN mate_ref_name IN ('','*') THEN 0 ELSE mate_ref_pos+1 END)::int"


_TAGS = "chr(9)||'NM:i:'||edit_distance::string||CASE WHEN alignment_count>0 THEN chr(9)||'NH:i:'||alignment_count::string ELSE '' END||CASE WHEN spot_group<>'' THEN chr(9)||'RG:Z:'||spot_group ELSE '' END"


def _quantized(q: str) -> str:
    """Phred+33 text through 0:10,10:20,20:30,30:40."""
    source = "".join(chr(33 + p) for p in range(40))
    target = "".join(chr(33 + p // 10 * 10 + 10) for p in range(40))
    return "translate({}, '{}', '{}')".format(q, source.replace("'", "''"), target.replace("'", "''"))


def _sam(rname: str = "ref_name", name: str = "seq_name", cigar: str = "cigar", qual: str = "CASE WHEN quality='' THEN '*' ELSE quality END", tags: str = _TAGS) -> str:
    fields = [name, f"{_filtered(_STRIPPED)}::string", rname, "(ref_pos+1)::string", "mapq::string", cigar, _rnext(rname), f"{_pnext()}::string", "template_len::string", "read", qual]
    return "||chr(9)||".join(f"({x})" for x in fields) + "||" + tags


def _le(x: str, n: int) -> str:
    """n bytes of a whole number, least significant first."""
    h = f"lpad(lower(hex(({x})::bigint & {(1 << 8 * n) - 1})), {2 * n}, '0')"
    return "(" + "||".join(f"substr({h}, {2 * i + 1}, 2)" for i in reversed(range(n))) + ")"


def _hex(text: str) -> str:
    return f"lower(hex(encode({text})))"


def _tag_number(name: str, x: str) -> str:
    t = name.encode().hex()
    return f"(CASE WHEN {x}<=255 THEN '{t}43'||{_le(x, 1)} WHEN {x}<=65535 THEN '{t}53'||{_le(x, 2)} ELSE '{t}49'||{_le(x, 4)} END)"


_RG_HEX = f"CASE WHEN spot_group<>'' THEN '52475a'||{_hex('spot_group')}||'00' ELSE '' END"
_OPS = "regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')"
_OP_LEN = "(op[:-2])::bigint"
_REF_LENGTH = f"coalesce(list_sum(list_transform({_OPS}, lambda op: CASE WHEN op[-1] IN ('M','D','N','=','X') THEN {_OP_LEN} ELSE 0 END)), 0)::bigint"


def _bin(begin: str, end: str) -> str:
    last = f"greatest({end}-1, 0)"
    levels = "".join(f" WHEN ({begin})>>{s} = ({last})>>{s} THEN (({begin})>>{s})+{f}" for s, f in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)))
    return f"((CASE{levels} ELSE 0 END) & 65535)::int"


_CODES = "translate(regexp_replace(upper({}), '[^=ACMGRSVTWYHKDBN]', 'N', 'g'), '=ACMGRSVTWYHKDBN', '0123456789abcdef')"


def _packed(read: str) -> str:
    return f"({_CODES.format(read)}||CASE WHEN length({read})%2=1 THEN '0' ELSE '' END)"


def _reversed(read: str) -> str:
    return f"translate(reverse(regexp_replace({read}, '[^ACGTacgt]', 'N', 'g')), 'ACGTacgt', 'TGCAtgca')"


def _qual_hex(q: str, table: bool = False) -> str:
    value = "(CASE WHEN ascii(x)-33<40 THEN (ascii(x)-33)//10*10+10 ELSE ascii(x)-33 END)" if table else "(ascii(x)-33)"
    return f"CASE WHEN {q}='' THEN repeat('ff', length(read)) ELSE array_to_string(list_transform(string_split({q}, ''), lambda x: lpad(lower(hex({value}::bigint)), 2, '0')), '') END"


def _unaligned_flags(reverse: bool) -> str:
    turned = "CASE WHEN read_type & 2 <> 0 THEN 16 ELSE 0 END" if reverse else "0"
    f = _filtered(f"(4 | {turned})")
    return f"(CASE WHEN n>1 THEN {f} | 9 | CASE WHEN bio_index=0 THEN 64 ELSE 0 END | CASE WHEN bio_index=n-1 THEN 128 ELSE 0 END ELSE {f} END)::int"


def _phred_text(q: str) -> str:
    return f"array_to_string(list_transform({q}, lambda x: chr(x+33)), '')"


def _bam_mates(n: str = "", header_id: str = "r.ref_idx") -> tuple[str, ...]:
    """bb: m with mate_id, mpos, mtlen. header_id: a reference's number in the header."""
    mate = f"(CASE WHEN cached_pos IS NOT NULL THEN ref_idx WHEN mate_align_id=0 OR mate_ref_name IN ('','*') THEN -1 ELSE coalesce((SELECT {header_id} FROM refs r WHERE r.name=mate_ref_name), -1) END)::int"
    return (f"b{n} AS (SELECT *, {mate} AS mate_id FROM m{n})", f"bb{n} AS (SELECT *, (CASE WHEN cached_pos IS NOT NULL THEN cached_pos WHEN mate_id=-1 THEN -1 ELSE mate_ref_pos END)::int AS mpos, (CASE WHEN mate_align_id=0 THEN 0 ELSE template_len END)::int AS mtlen FROM b{n})")


def _bam_body() -> str:
    name = _hex("seq_name")
    ops = f"array_to_string(list_transform({_OPS}, lambda op: {_le(f'({_OP_LEN} << 4) | (instr(' + chr(39) + 'MIDNSHP=X' + chr(39) + ', op[-1])-1)', 4)}), '')"
    fixed = [("ref_idx", 4), ("ref_pos", 4), ("length(seq_name)+1", 1), ("mapq", 1), (_bin("ref_pos", f"ref_pos+{_REF_LENGTH}"), 2), (f"len({_OPS})", 2), (_filtered(_STRIPPED), 2), ("length(read)", 4), ("mate_id", 4), ("mpos", 4), ("mtlen", 4)]
    body = "||".join([*[_le(x, n) for x, n in fixed], name, "'00'", ops, _packed("read"), f"({_qual_hex('quality')})", _tag_number("NM", "edit_distance"), f"CASE WHEN alignment_count>0 THEN {_tag_number('NH', 'alignment_count')} ELSE '' END", f"({_RG_HEX})", _tag_number("XI", "align_id")])
    return body


def _bam_record() -> str:
    return _with(f"SELECT align_id, {_le('length(body)//2', 4)}||body AS record FROM (SELECT align_id, {_bam_body()} AS body FROM bb)", *_mated("aligned"), *_bam_mates())


def _unaligned_body(turn: bool = True) -> str:
    """The binary record of turned and turned_q, without its size."""
    fixed = [("-1", 4), ("-1", 4), ("length(name)+1", 1), ("0", 1), ("4680", 2), ("0", 2), (_unaligned_flags(turn), 2), ("length(read)", 4), ("-1", 4), ("-1", 4), ("0", 4)]
    return "||".join([*[_le(x, n) for x, n in fixed], _hex("name"), "'00'", _packed("turned"), "array_to_string(list_transform(turned_q, lambda x: lpad(lower(hex(x::bigint)), 2, '0')), '')", f"({_RG_HEX})"])


def _bam_unaligned() -> str:
    read = f"CASE WHEN read_type & 2 <> 0 THEN {_reversed('read')} ELSE read END"
    qual = "CASE WHEN read_type & 2 <> 0 THEN list_reverse(quality) ELSE quality END"
    return _with(f"SELECT row_id, bio_index, {_le('length(body)//2', 4)}||body AS record FROM (SELECT row_id, bio_index, {_unaligned_body()} AS body FROM (SELECT *, {read} AS turned, {qual} AS turned_q FROM emitted))")


_SAM_UNALIGNED = "name||chr(9)||{flags}::string||chr(9)||'*'||chr(9)||'0'||chr(9)||'0'||chr(9)||'*'||chr(9)||'*'||chr(9)||'0'||chr(9)||'0'||chr(9)||read||chr(9)||{text}||CASE WHEN spot_group<>'' THEN chr(9)||'RG:Z:'||spot_group ELSE '' END"


def _all_sam() -> tuple[str, ...]:
    """every: all records as SAM, primary, secondary and unaligned."""
    line = _SAM_UNALIGNED.format(flags=_unaligned_flags(False), text=_phred_text("quality"))
    return (
        *_mated("aligned"), *_mated("secondary", n="2"),
        f"every AS (SELECT 0 AS stage, ref_idx::bigint AS group_no, align_id AS row_id, 0 AS read_no, {_sam()} AS record FROM m UNION ALL SELECT 1, ref_idx::bigint, align_id, 0, {_sam()} FROM m2 UNION ALL SELECT 2, 0::bigint, row_id, bio_index, {line} FROM emitted)",
    )


_SQ = "'@SQ'||chr(9)||'SN:'||{}||chr(9)||'LN:'||seq_length::string"
_REBUILT = "SELECT 0::bigint AS line_no, '@HD'||chr(9)||'VN:1.3' AS line UNION ALL SELECT ref_idx+1, " + _SQ.format("{name}") + " FROM refs"
_STORED = f"SELECT 0::bigint AS line_no, '@HD'||chr(9)||'VN:1.6'||chr(9)||'SO:coordinate' AS line UNION ALL SELECT 25-ref_idx, {_SQ.format('name')} FROM refs UNION ALL SELECT 26, '@RG'||chr(9)||'ID:RG1'||chr(9)||'SM:sample'"


def _file(records: str, header: str | None = _REBUILT.format(name="name")) -> str:
    """line_no, line of header lines and then the lines of records (a select of stage, group_no, row_id, read_no, record)."""
    head = f"SELECT -1 AS stage, 0::bigint AS group_no, line_no AS row_id, 0 AS read_no, line AS record FROM ({header}) UNION ALL " if header else ""
    return (
        f"SELECT row_number() OVER (ORDER BY stage, group_no, row_id, read_no, i) AS line_no, line FROM (SELECT stage, group_no, row_id, read_no, unnest(string_split(record, chr(10))) AS line, generate_subscripts(string_split(record, chr(10)), 1) AS i FROM ({head}{records}))"
    )


def _bam_file(unaligned: bool, header: str, header_order: str, header_id: str = "r.ref_idx") -> str:
    """n_bytes and sha256 of a whole binary file: header, then records."""
    text = f"(SELECT string_agg(line||chr(10), '' ORDER BY line_no) FROM ({header}))"
    names = f"(SELECT string_agg({_le('length(name)+1', 4)}||{_hex('name')}||'00'||{_le('seq_length', 4)}, '' ORDER BY {header_order}) FROM refs)"
    head = f"'42414d01'||{_le(f'length({text})', 4)}||{_hex(text)}||{_le('(SELECT count(*) FROM refs)', 4)}||{names}"
    parts = [f"SELECT 0 AS stage, ref_idx::bigint AS group_no, align_id AS row_id, 0 AS read_no, {_bam_body()} AS body FROM bb"]
    ctes = [*_mated("aligned"), *_bam_mates(header_id=header_id)]
    if unaligned:
        parts += [f"SELECT 1, ref_idx::bigint, align_id, 0, {_bam_body()} FROM bb2", f"SELECT 2, 0::bigint, row_id, bio_index, {_unaligned_body(False)} FROM (SELECT *, read AS turned, quality AS turned_q FROM emitted)"]
        ctes += [*_mated("secondary", n="2"), *_bam_mates("2", header_id)]
    body = f"SELECT string_agg({_le('length(body)//2', 4)}||body, '' ORDER BY stage, group_no, row_id, read_no) AS t FROM ({' UNION ALL '.join(parts)})"
    return _with(f"SELECT (length(t)//2)::bigint AS n_bytes, sha256(unhex(t)) AS sha256 FROM (SELECT ({head})||t AS t FROM ({body}))", *ctes)


_REGION_ROWS = "regs AS (SELECT * FROM (VALUES (0,'chr3',999,60000),(1,'chr7',NULL,NULL),(2,'chr3',19999,90000)) t(region_no, region, lo, hi))"
_IN_REGIONS = "hit AS (SELECT a.*, region_no FROM aligned a JOIN regs ON ref_name=region AND (lo IS NULL OR ref_pos>=lo AND ref_pos<hi))"
_COLS = "align_id, sam_flags, cigar, mate_align_id, mate_ref_name, mate_ref_pos, template_len, read, quality, edit_distance, spot_group, seq_name, alignment_count, read_filter, ref_pos, mapq, ref_name"
_COLUMNS = {
    "['PRIMARY_ALIGNMENT', 'SECONDARY_ALIGNMENT']": "align_id, sam_flags, cigar_short, cigar_long, mate_align_id, mate_ref_name, mate_ref_pos, template_len, read, quality, edit_distance, spot_group, seq_name, alignment_count, read_filter, ref_pos, mapq, ref_name",
    "['SEQUENCE']": "row_id, name, spot_group, read, quality, read_start, read_len, read_type, read_filter, primary_alignment_id",
    "['REFERENCE']": "ref_idx, name, seq_id, seq_length",
    "['DEPENDENCIES']": "accession, seq_id, local",
}
_ERROR = "(align_id*2654435761 % 4294967296)"
_BIG = "(align_id*40000000-90000000000)"

ORACLES: dict[str, str] = {
    "scan_aligned": _with(f"SELECT {_COLS} FROM aligned"),
    "source_scan": _with(f"SELECT {_COLS} FROM aligned"),
    "source_filters": _with(" UNION ALL ".join(f"SELECT '{t}' AS id_src, align_id, ref_name, ref_pos, mapq FROM {v} WHERE mapq>=30 AND ref_name IN ('chr3','chr5') AND ref_pos<50000" for t, v in (("PRIMARY_ALIGNMENT", "aligned"), ("SECONDARY_ALIGNMENT", "secondary")))),
    "scan_aligned_long_cigar": _with("SELECT align_id, cigar_long AS cigar FROM aligned"),
    "scan_sequence": _with("SELECT row_id, name, spot_group, read, len(ids)::int AS n_reads, list_sum(lens)::bigint AS bases FROM spots"),
    "list_tables": "SELECT unnest(['DEPENDENCIES','PRIMARY_ALIGNMENT','REFERENCE','SECONDARY_ALIGNMENT','SEQUENCE']) AS table_name",
    "list_columns": "SELECT unnest(t) AS table_name, column_name FROM (VALUES " + ", ".join(f"({tables}, '{c}')" for tables, columns in _COLUMNS.items() for c in columns.split(", ")) + ") v(t, column_name)",
    "optional_columns": _with("SELECT align_id, 0 AS alignment_count, -1 AS read_filter_or_none FROM aligned"),
    "id_range": _with("SELECT 'PRIMARY_ALIGNMENT' AS table_name, min(align_id) AS first_id, count(*) AS n_rows FROM aligned UNION ALL SELECT 'SECONDARY_ALIGNMENT', min(align_id), count(*) FROM secondary UNION ALL SELECT 'SEQUENCE', min(row_id), count(*) FROM spots"),
    "find_reference": _with("SELECT * FROM refs WHERE ref_idx IN (3, 8)"),
    "min_mapq": _with("SELECT align_id, mapq FROM aligned WHERE mapq >= 30"),
    "min_mapq_unset_drops_negative": _with("SELECT align_id, mapq-20 AS mapq FROM aligned WHERE mapq-20 >= 0"),
    "region_window": _with("SELECT align_id, ref_name, ref_pos FROM aligned WHERE ref_name='chr5' AND ref_pos>=10000 AND ref_pos<50000"),
    "region_overlap_dupes": _with("SELECT region_no, align_id, ref_name, ref_pos FROM hit", _REGION_ROWS, _IN_REGIONS),
    "region_alias": _with("SELECT align_id, ref_name, ref_pos FROM aligned WHERE ref_name='chr11' AND ref_pos<70000"),
    "ref_boundaries": _with("SELECT ref_name, min(align_id) AS first_row, max(align_id) AS last_row, count(*) AS n_rows FROM aligned GROUP BY 1"),
    "boundaries_metadata": _with("SELECT ref_name, min(align_id) AS first_row, max(align_id) AS last_row, count(*) AS n_rows FROM aligned GROUP BY 1"),
    "id_range_metadata": _with("SELECT 'PRIMARY_ALIGNMENT' AS table_name, min(align_id) AS first_id, count(*) AS n_rows FROM aligned UNION ALL SELECT 'SECONDARY_ALIGNMENT', min(align_id), count(*) FROM secondary UNION ALL SELECT 'SEQUENCE', min(row_id), count(*) FROM spots"),
    "boundary_total": _with("SELECT count(*)::bigint AS n_rows FROM aligned"),
    "work_items": _with("SELECT row_number() OVER (ORDER BY f, item) - 1 AS order_idx, ref_name, item, f+item*500 AS first_row, least(f+(item+1)*500-1, l) AS last_row FROM (SELECT ref_name, f, l, unnest(range((l-f)//500+1)) AS item FROM (SELECT ref_name, min(align_id) AS f, max(align_id) AS l FROM aligned GROUP BY 1))"),
    "mate_lookup": _with("SELECT align_id, mate_align_id, cached_pos FROM m", *_mated("aligned")),
    "mate_lookup_by_id": _with("SELECT align_id, mate_align_id, cached_pos, read, quality FROM m", *_mated("aligned")),
    "mate_lookup_min_mapq": _with("SELECT align_id, mate_align_id, cached_pos FROM m", *_mated("aligned", "mapq >= 10")),
    "mate_lookup_contested": _with("SELECT align_id, mate_align_id, cached_pos FROM m", *_mated("secondary", "true")),
    "mate_take_order": _with("SELECT align_id, mate_align_id, take_no FROM pend", *_mated("secondary", "true")),
    "mate_fields_sam": _with(f"SELECT align_id, {_rnext('ref_name')} AS rnext, {_pnext()} AS pnext, template_len FROM m", *_mated("aligned")),
    "mate_fields_bam": _with("SELECT align_id, mate_id, mpos AS mate_pos, mtlen AS tlen FROM bb", *_mated("aligned"), *_bam_mates()),
    "strip_paired": _with(f"SELECT align_id, {_STRIPPED} AS flags FROM aligned"),
    "read_filter_flags": _with(f"SELECT align_id, {_filtered('(sam_flags | 512)')} AS flags FROM aligned"),
    "qname": _with("SELECT align_id, 'PRE.'||seq_name||CASE WHEN spot_group<>'' THEN '.'||spot_group ELSE '' END AS qname, seq_name AS plain FROM aligned"),
    "rnext_pnext": _with(f"SELECT align_id, {_rnext('ref_name', 'NULL')} AS rnext, {_pnext('NULL::int')} AS pnext, ref_pos+1 AS pos FROM aligned"),
    "sam_tags": _with(f"SELECT align_id, {_TAGS}||chr(9)||'XI:i:'||align_id::string AS tags FROM aligned"),
    "sam_aligned": _with(f"SELECT align_id, {_sam()} AS line FROM m", *_mated("aligned")),
    "sam_aligned_min_mapq": _with(f"SELECT align_id, {_sam()} AS line FROM m", *_mated("aligned", "mapq >= 10")),
    "sam_aligned_all_options": _with(
        "SELECT align_id, " + _sam("seq_id", "'X.'||seq_name||CASE WHEN spot_group<>'' THEN '.'||spot_group ELSE '' END", "cigar_long", f"CASE WHEN quality='' THEN '*' ELSE {_quantized('quality')} END", _TAGS + "||chr(9)||'XI:i:'||align_id::string") + " AS line FROM m JOIN refs ON refs.name=m.ref_name",
        *_mated("aligned"),
    ),
    "sam_omit_quality": _with(f"SELECT align_id, {_sam(qual=chr(39) + '*' + chr(39))} AS line FROM m", *_mated("aligned")),
    "fasta_aligned": _with("SELECT align_id, '>'||seq_name||chr(10)||read AS record FROM aligned"),
    "fastq_aligned": _with("SELECT align_id, '@'||seq_name||chr(10)||read||chr(10)||'+'||chr(10)||CASE WHEN quality='' THEN '*' ELSE quality END AS record FROM aligned"),
    "primary_secondary_union": _with("SELECT 0 AS stage, ref_idx::bigint AS group_no, align_id AS row_id FROM aligned UNION ALL SELECT 1, ref_idx::bigint, align_id FROM secondary"),
    "primary_only": _with("SELECT 0 AS stage, ref_idx::bigint AS group_no, align_id AS row_id FROM aligned"),
    "stages_with_unaligned": _with("SELECT stage, count(*) AS n FROM (SELECT 0 AS stage FROM aligned UNION ALL SELECT 1 FROM secondary UNION ALL SELECT 2 FROM emitted) GROUP BY 1"),
    "spot_explode": _with("SELECT row_id, read_no, bio_index, n AS n_emitted, read_type, read_filter, read FROM emitted"),
    "spot_read_counts": _with("SELECT row_id, count(*)::int AS n_emitted FROM emitted GROUP BY 1"),
    "unaligned_spots_only": _with("SELECT row_id, bio_index, read FROM emitted WHERE row_id NOT IN (SELECT row_id FROM spots WHERE list_sum(ids)<>0)"),
    "clamped_slices": _with("SELECT row_id, substr(read, 61, 20) AS past_end, '' AS outside, '' AS negative, '' AS nothing FROM spots"),
    "unaligned_flags": _with(f"SELECT row_id, bio_index, {_unaligned_flags(True)} AS flags FROM emitted"),
    "sam_unaligned": _with(
        f"SELECT row_id, bio_index, 'P.'||name||CASE WHEN spot_group<>'' THEN '#'||spot_group ELSE '' END||chr(9)||{_unaligned_flags(False)}::string||repeat(chr(9)||'*',1)||chr(9)||'0'||chr(9)||'0'||chr(9)||'*'||chr(9)||'*'||chr(9)||'0'||chr(9)||'0'||chr(9)||read||chr(9)||{_phred_text('quality')}||CASE WHEN spot_group<>'' THEN chr(9)||'RG:Z:'||spot_group ELSE '' END AS line FROM emitted"
    ),
    "fastq_unaligned_reverse": _with(
        f"SELECT row_id, bio_index, '@'||name||chr(10)||CASE WHEN read_type & 2 <> 0 THEN {_reversed('read')} ELSE read END||chr(10)||'+'||chr(10)||CASE WHEN read_type & 2 <> 0 THEN reverse({_phred_text('quality')}) ELSE {_phred_text('quality')} END AS record FROM emitted"
    ),
    "fasta_unaligned": _with("SELECT row_id, bio_index, '>'||name||chr(10)||read AS record FROM emitted"),
    "revcomp": _with("SELECT align_id, " + _reversed("read||'acgtRYn'") + " AS bases FROM aligned"),
    "qual_quant_text": _with(f"SELECT align_id, {_quantized('quality')} AS quality FROM aligned"),
    "qual_quant_raw": _with("SELECT row_id, array_to_string(list_transform(quality, lambda x: CASE WHEN x<40 THEN x//10*10+10 ELSE x END), ',') AS quality FROM spots"),
    "phred_to_text": _with(f"SELECT row_id, {_phred_text('quality')} AS quality, reverse({_phred_text('quality')}) AS backwards FROM spots"),
    "cigar_ops": _with(f"SELECT align_id, array_to_string(list_transform({_OPS}, lambda op: ({_OP_LEN} << 4) | (instr('MIDNSHP=X', op[-1])-1)), ',') AS ops, array_to_string({_OPS}, ',')||',105M' AS with_unknown FROM aligned"),
    "cigar_ref_length": _with(f"SELECT align_id, {_REF_LENGTH} AS ref_length FROM aligned"),
    "reg2bin": _with(f"SELECT align_id, {_bin('ref_pos', f'ref_pos+{_REF_LENGTH}')} AS bin, {_bin('ref_pos', '(ref_pos::bigint*700)')} AS wide_bin FROM aligned"),
    "base_codes": _with("SELECT align_id, " + _CODES.format("read||'=rykmswbdhvnx'") + " AS codes FROM aligned"),
    "packed_sequence_hex": _with(f"SELECT align_id, {_packed('read')} AS packed, {_packed('odd')} AS packed_odd FROM (SELECT align_id, read, read||'N' AS odd FROM aligned)"),
    "bam_quality_hex": _with(f"SELECT align_id, {_qual_hex('quality')} AS quality, {_qual_hex('quality', True)} AS quantized FROM aligned"),
    "bam_tags_hex": _with(
        f"SELECT align_id, {_tag_number('NM', '(align_id*37)')} AS number, CASE WHEN {_BIG} BETWEEN 0 AND 4294967295 THEN {_tag_number('XI', _BIG)} WHEN {_BIG} BETWEEN -2147483648 AND -1 THEN '584969'||{_le(_BIG, 4)} ELSE '58495a'||{_hex(_BIG + '::string')}||'00' END AS big, '52475a'||{_hex('seq_name')}||'00' AS named FROM aligned"
    ),
    "bam_record_hex": _bam_record(),
    "bam_unaligned_hex": _bam_unaligned(),
    "header_lines": _with(
        "SELECT 0::bigint AS line_no, '@HD'||chr(9)||'VN:1.3' AS line UNION ALL SELECT 1000, '@HD'||chr(9)||'VN:1.3' UNION ALL SELECT ref_idx+1, '@SQ'||chr(9)||'SN:'||name||chr(9)||'LN:'||seq_length::string FROM refs UNION ALL SELECT ref_idx+1001, '@SQ'||chr(9)||'SN:'||seq_id||chr(9)||'LN:'||seq_length::string FROM refs"
    ),
    "sq_dictionary": _with("SELECT ref_idx::int AS ref_id, name, seq_length AS length FROM refs"),
    "ref_name_to_id": _with("SELECT align_id, coalesce(r.ref_idx, -1)::int AS mate_ref_id FROM aligned LEFT JOIN refs r ON r.name=mate_ref_name"),
    "placement_positions": _with("SELECT ref_idx, (ref_pos//5000)::bigint AS window_no, ref_pos AS pos, count(*) AS n FROM aligned GROUP BY 1, 2, 3"),
    "placement_walk": _with("SELECT row_number() OVER (ORDER BY ref_idx, window_no, pos, source_no, align_id) AS ordinal, ref_idx, window_no, pos, id_src, align_id, len FROM (" + " UNION ALL ".join(f"SELECT ref_idx, (ref_pos//5000)::bigint AS window_no, ref_pos AS pos, {n} AS source_no, '{t}' AS id_src, align_id, {_REF_LENGTH} AS len FROM {v}" for n, (t, v) in enumerate((("PRIMARY_ALIGNMENT", "aligned"), ("SECONDARY_ALIGNMENT", "secondary")))) + ")"),
    "ordered_gaps": _with("SELECT least((before // 320), (total - 1) // 320)::bigint AS part, count(*) AS n_rows, min(align_id) AS first_id, max(align_id) AS last_id FROM kept JOIN (SELECT bucket, coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM (SELECT bucket, count(*) AS n FROM kept GROUP BY 1)) USING (bucket) GROUP BY 1", "kept AS (SELECT align_id, align_id // 20 AS bucket FROM aligned WHERE align_id % 10 = 0 OR align_id BETWEEN 2001 AND 4000)"),
    "placement_windows": _with("SELECT ref_idx, (ref_pos//5000)::bigint AS window_no, count(*) AS n, min(ref_pos) AS first_pos FROM aligned WHERE ref_name='chr2' AND mapq>=5 AND ref_pos>=1000 AND ref_pos<61000 GROUP BY 1, 2"),
    "placement_records": _with("SELECT ref_idx, (ref_pos//5000)::bigint AS window_no, ref_pos AS pos, align_id, " + _REF_LENGTH + " AS len, mapq, spot_group FROM aligned WHERE ref_name='chr2' AND mapq>=5 AND ref_pos>=1000 AND ref_pos<61000"),
    "placement_sources": _with(" UNION ALL ".join(f"SELECT ref_idx, (ref_pos//5000)::bigint AS window_no, ref_pos AS pos, '{t}' AS id_src, align_id, {_REF_LENGTH} AS len, mapq, spot_group FROM {v} WHERE ref_name IN ('chr2','chr5') AND mapq>=3 AND ref_pos>=500 AND ref_pos<70500" for t, v in (("PRIMARY_ALIGNMENT", "aligned"), ("SECONDARY_ALIGNMENT", "secondary")))),
    "dependency_summary": _with("SELECT accession, count(*) AS total, count(*) FILTER (local) AS n_local, count(*) FILTER (NOT local) AS n_resolved FROM deps GROUP BY 1"),
    "missing_dependencies": _with("SELECT accession, seq_id FROM deps WHERE NOT local"),
    "ordered_output": _with("SELECT row_number() OVER (ORDER BY stage, group_no, row_id, read_no) AS place, stage, group_no, row_id, record FROM every", *_all_sam()),
    "ordered_regions": _with(
        f"SELECT row_number() OVER (ORDER BY region_no, align_id) AS place, 0 AS stage, region_no::bigint AS group_no, align_id AS row_id, {_sam()} AS record FROM m",
        _REGION_ROWS, _IN_REGIONS, *_mated("hit", "mapq >= 0", "ref_name, region_no"),
    ),
    "sam_file_lines": _with(_file("SELECT stage, group_no, row_id, read_no, record FROM every"), *_all_sam()),
    "sam_folder_lines": _with(_file("SELECT stage, group_no, row_id, read_no, record FROM every"), *_all_sam()),
    "sam_gzip_lines": _with(_file(f"SELECT 0, ref_idx::bigint, align_id, 0, {_sam('seq_id')} FROM (SELECT m.*, seq_id FROM m JOIN refs ON refs.name=m.ref_name)", _REBUILT.format(name="seq_id")), *_mated("aligned")),
    "fastq_bzip2_lines": _with(_file("SELECT 0 AS stage, ref_idx::bigint AS group_no, align_id AS row_id, 0 AS read_no, '@'||seq_name||chr(10)||read||chr(10)||'+'||chr(10)||CASE WHEN quality='' THEN '*' ELSE quality END AS record FROM aligned", None)),
    "sam_no_header_lines": _with(_file(f"SELECT 0 AS stage, ref_idx::bigint AS group_no, align_id AS row_id, 0 AS read_no, {_sam()} AS record FROM m", None), *_mated("aligned")),
    "fastq_gzip_stream_lines": _with(_file("SELECT 0 AS stage, ref_idx::bigint AS group_no, align_id AS row_id, 0 AS read_no, '@'||seq_name||chr(10)||read||chr(10)||'+'||chr(10)||CASE WHEN quality='' THEN '*' ELSE quality END AS record FROM aligned", None)),
    "mode_precedence": _with(_file("SELECT 0 AS stage, ref_idx::bigint AS group_no, align_id AS row_id, 0 AS read_no, '>'||seq_name||chr(10)||read AS record FROM aligned", None)),
    "bam_stream_bytes": _bam_file(True, _REBUILT.format(name="name"), "ref_idx"),
    "bam_file_bytes": _bam_file(True, _REBUILT.format(name="name"), "ref_idx"),
    "bam_folder_bytes": _bam_file(True, _REBUILT.format(name="name"), "ref_idx"),
    "bam_stored_header_bytes": _bam_file(False, _STORED, "ref_idx DESC", "24-r.ref_idx"),
    "stored_header": _with(f"SELECT 'stored' AS which, * FROM ({_STORED})"),
    "header_precedence": _with(f"SELECT 'rebuilt' AS which, * FROM ({_REBUILT.format(name='name')}) UNION ALL SELECT 'seqid', * FROM ({_REBUILT.format(name='seq_id')}) UNION ALL SELECT 'comments', * FROM ({_STORED} UNION ALL SELECT 27, '@CO'||chr(9)||'one' UNION ALL SELECT 28, '@CO'||chr(9)||'two words')"),
    "header_without_stored": _with(f"SELECT 'none stored' AS which, * FROM ({_REBUILT.format(name='name')} UNION ALL SELECT 26, '@CO'||chr(9)||'c')"),
    "header_from_file": _with(f"SELECT 'file' AS which, * FROM (SELECT 0::bigint AS line_no, '@HD'||chr(9)||'VN:1.5' AS line UNION ALL SELECT 25-ref_idx, {_SQ.format('seq_id')} FROM refs UNION ALL SELECT 26, '@CO'||chr(9)||'from a file' UNION ALL SELECT 27, '@CO'||chr(9)||'c')"),
    "cache_refs_counts": "SELECT 2 AS processed, 1 AS failed",
    "progress_records": _with("SELECT (SELECT count(*) FROM aligned) + (SELECT count(*) FROM secondary) + (SELECT count(*) FROM emitted) AS n_records"),
    "bam_narrow_fields": _with("SELECT align_id, " + ", ".join(f"{_le('align_id*70001-500000', n)} AS bytes_{n}" for n in (1, 2, 4)) + " FROM aligned"),
    "rnext_without_mate": _with(f"SELECT align_id, {_rnext('ref_name', 'NULL')} AS rnext, {_pnext('NULL::int')} AS pnext FROM (SELECT * REPLACE (CASE align_id%4 WHEN 0 THEN '*' WHEN 1 THEN '' WHEN 2 THEN ref_name ELSE mate_ref_name END AS mate_ref_name) FROM aligned)"),
    "error_fields": _with(f"SELECT align_id, ({_ERROR}&63)::int AS state, (({_ERROR}>>6)&255)::int AS object, (({_ERROR}>>14)&127)::int AS context, (({_ERROR}>>21)&63)::int AS target, (({_ERROR}>>27)&31)::int AS module, {_ERROR}&63=1 AS is_done, ({_ERROR}>>27)&31=18 AS is_network FROM aligned"),
    "progress_texts": _with(
        "SELECT align_id, CASE WHEN s<60 THEN s::string||'s' WHEN s<3600 THEN (s//60)::string||'m'||CASE WHEN s%60=0 THEN '' ELSE ' '||(s%60)::string||'s' END ELSE (s//3600)::string||'h'||CASE WHEN s%3600//60=0 THEN '' ELSE ' '||(s%3600//60)::string||'m' END END AS duration, format('{:,}', align_id*1013) AS n FROM (SELECT align_id, align_id*7 AS s FROM aligned)"
    ),
}
