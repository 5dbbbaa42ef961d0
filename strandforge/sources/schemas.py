"""Schemas, optional columns and defaults of the archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

INT, LONG, TEXT, BOOL = IntegerType(), LongType(), StringType(), BooleanType()
INTS, LONGS = ArrayType(INT), ArrayType(LONG)


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


ALIGNED_COLUMNS = _schema(
    align_id=LONG, sam_flags=INT, cigar_short=TEXT, cigar_long=TEXT, mate_align_id=LONG, mate_ref_name=TEXT, mate_ref_pos=INT, template_len=INT, read=TEXT, quality=TEXT,
    edit_distance=LONG, spot_group=TEXT, seq_name=TEXT, alignment_count=INT, read_filter=INT, ref_pos=INT, mapq=INT, ref_name=TEXT,
)
SEQUENCE_COLUMNS = _schema(
    row_id=LONG, name=TEXT, spot_group=TEXT, read=TEXT, quality=INTS, read_start=INTS, read_len=LONGS, read_type=INTS, read_filter=INTS, primary_alignment_id=LONGS,
)
REFERENCE_COLUMNS = _schema(ref_idx=INT, name=TEXT, seq_id=TEXT, seq_length=LONG)
DEPENDENCY_COLUMNS = _schema(accession=TEXT, seq_id=TEXT, local=BOOL)

#: Columns that a table may lack, with the value that then stands for them.
OPTIONAL = {"alignment_count": 0, "read_filter": None}

#: Row ids: never empty, and read as stored, so that a layout by id reaches joins.
KEYS = ("align_id", "row_id")

PRIMARY, SECONDARY, SEQUENCE, REFERENCES, DEPENDENCIES = "PRIMARY_ALIGNMENT", "SECONDARY_ALIGNMENT", "SEQUENCE", "REFERENCE", "DEPENDENCIES"
TABLES = {PRIMARY: ALIGNED_COLUMNS, SECONDARY: ALIGNED_COLUMNS, SEQUENCE: SEQUENCE_COLUMNS, REFERENCES: REFERENCE_COLUMNS, DEPENDENCIES: DEPENDENCY_COLUMNS}


class MissingColumn(ValueError):
    """A required column is not in the table."""


def default_of(kind: str) -> Column:
    """The value of an empty cell: zero, the empty text, or an empty vector."""
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.lit("").cast(kind) if kind == "string" else F.lit(0).cast(kind)


def conform(df: DataFrame, schema: StructType, wanted: list[str] | None = None, optional: dict = OPTIONAL) -> DataFrame:
    """The wanted columns, typed, with empty cells filled; read_filter stays null where it is absent."""
    out = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        if wanted is not None and f.name not in wanted:
            continue
        if f.name not in df.columns:
            if f.name not in optional:
                raise MissingColumn(f"column {f.name} is missing; the table has {', '.join(df.columns)}")
            out.append(F.lit(optional[f.name]).cast(kind).alias(f.name))
        elif f.name in KEYS or f.name in optional and optional[f.name] is None:
            out.append(F.col(f.name).cast(kind).alias(f.name))
        else:
            out.append(F.coalesce(F.col(f.name).cast(kind), default_of(kind)).alias(f.name))
    return df.select(*out)
