"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandforge.sources.storage import discard, materialize, shared_folder

__all__ = ["discard", "materialize", "shared_folder"]  # and what follows
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Delimiters between the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
WORD_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Delimiters between the words ``[^\x20\x09-\x0D]+``.
SPACE_DELIMITERS = r"[\x20\x09-\x0D]+"

#: bytes.translate() table: A-Z to lower case, every delimiter byte of WORD_DELIMITERS to a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

#: Bytes of texts that an operator works on at once, and that Spark sends to a Python worker at once at most.
#: The latter is a setting of the session; it is the same for all operators, so plans that run later are not changed by others.
PIECE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers what Spark sends at once to BATCH_BYTES, unless it is lower already."""
    known = spark.conf.get(_BATCH_SETTING).removesuffix("b")
    if not known.isdecimal() or int(known) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most limit bytes, or of one row where that is larger."""
    for b in batches:
        rows = max(1, b.num_rows * limit // max(1, b.nbytes))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ascii_words(text: Column) -> Column:
    """Words of the whole text, in order, A-Z lower-cased (null text: none).

    ``lower`` is quicker than ``translate`` and gives the same ASCII words and word counts,
    unless one of the two characters is present that lower-case into ASCII.
    """
    t = F.coalesce(text, F.lit(""))
    odd = F.contains(t, F.lit("K")) | F.contains(t, F.lit("İ"))
    low = F.when(odd, F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, WORD_DELIMITERS), "")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the whole text (null: 0)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_DELIMITERS), "")).cast("long")


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; otherwise df, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def map_rows(df: DataFrame, columns: list[Column], schema: str, fn: Callable[[list[list]], list[list]]) -> DataFrame:
    """mapInArrow over the given columns: fn gets the columns of a batch as lists and returns columns.

    Column names of df play no part, so extra columns cannot clash.
    """
    picked = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cols = fn([c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(cols, arrow, strict=True)], schema=arrow)

    bounded_batches(df.sparkSession)
    return picked.mapInArrow(run, schema)


def change_rows(df: DataFrame, column: str, fn: Callable[[list], tuple[list[bool], dict[str, list]]]) -> DataFrame:
    """df with rows left out and values replaced: fn gets a column of a batch and returns what to
    keep and the new values of columns; all columns of df stay."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keep, new = fn(b.column(b.schema.get_field_index(column)).to_pylist())
            columns = [pa.array(new[f.name], type=f.type) if f.name in new else b.column(i) for i, f in enumerate(b.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(keep, pa.bool_()))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
