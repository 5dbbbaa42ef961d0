"""An archive's table as a named source: ``spark.read.format("strandforge_archive").option("table", ...).load(path)``.

Rows come as the scans of ``Archive`` give them: columns typed, empty cells filled, optional columns there. Options tell
which rows to read: ``min_mapq``, ``references`` (names, comma-separated), ``first_id`` and ``last_id``. They are asked of the
stored columns, so Parquet row groups that cannot hold a row are not read. They are options, not filters taken over from
a query, because Spark 4.1 goes on using what a Python source has taken over when the same DataFrame is filtered otherwise later.
Each file is read by a task of its own, or by several, a run of its row groups each.
Spark's own reader also leaves columns out, so ``Archive.aligned`` stays the way for queries that use few of them.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandforge.sources import schemas as S

#: (option, columns that it may be about, comparison).
_OPTIONS = (("min_mapq", ("mapq",), operator.ge), ("references", ("ref_name", "name"), None), ("first_id", S.KEYS, operator.ge), ("last_id", S.KEYS, operator.le))
#: Bytes of a file that one task reads, about.
TASK_BYTES = 128 << 20
#: Rows made at once, and bytes of a column read at once.
BATCH_ROWS, BUFFER_BYTES = 8_192, 1 << 20


@dataclass
class Groups(InputPartition):
    """Row groups of a file, from the first to before the end."""

    path: str
    first: int
    end: int


def filled(name: str, kind: pa.DataType) -> object:
    """What an empty cell of a column counts as; None where it stays empty."""
    if name in S.OPTIONAL:
        return S.OPTIONAL[name]
    if name in S.KEYS:
        return None
    return [] if pa.types.is_list(kind) else "" if pa.types.is_string(kind) else False if pa.types.is_boolean(kind) else 0


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: pa.Schema, options: dict[str, str]):
        self.path, self.table, self.schema, self.task_bytes = path, table, schema, int(options.get("task_bytes", TASK_BYTES))
        self.filters: list[tuple[str, object, object]] = []
        for option, columns, compare in _OPTIONS:
            if option in options:
                name = next((c for c in columns if c in schema.names), None)
                if name is None:
                    raise ValueError(f"{table} has no column for the option {option}")
                self.filters.append((name, compare, int(options[option]) if compare else options[option].split(",")))

    def _files(self) -> tuple[object, list]:
        from pyarrow import fs

        storage, root = fs.FileSystem.from_uri(self.path)
        top = f"{root}/{self.table}"
        found = storage.get_file_info([top, f"{top}.parquet"])
        if found[0].type == fs.FileType.Directory:
            inside = storage.get_file_info(fs.FileSelector(top))
            return storage, [x for x in inside if x.base_name.endswith(".parquet") and not x.base_name.startswith(("_", "."))]
        return storage, [x for x in found[1:] if x.type == fs.FileType.File]

    def partitions(self) -> list[InputPartition]:
        """A file a task; the footers of large files only are read here, to cut them between row groups."""
        import pyarrow.parquet as pq

        storage, files = self._files()
        if not files:
            raise FileNotFoundError(f"no table {self.table} in {self.path}")
        out: list[InputPartition] = []
        for x in sorted(files, key=lambda x: x.path):
            shares = -(-x.size // self.task_bytes)
            if shares <= 1:
                out.append(Groups(x.path, 0, -1))
                continue
            with storage.open_input_file(x.path) as f:
                n = pq.read_metadata(f).num_row_groups
            step = max(1, n // shares)
            out += [Groups(x.path, i, min(n, i + step)) for i in range(0, n, step)]
        return out

    def expression(self) -> pc.Expression | None:
        """All options, asked of the stored columns: where the value that fills an empty cell passes, empty cells do."""
        out = None
        for name, compare, value in self.filters:
            fill = filled(name, self.schema.field(name).type)
            one = compare(pc.field(name), value) if compare else pc.field(name).isin(value)
            if fill is not None and (compare(fill, value) if compare else fill in value):
                one = one | pc.field(name).is_null()
            out = one if out is None else out & one
        return out

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        storage = fs.FileSystem.from_uri(self.path)[0]
        fragment = ds.ParquetFileFormat().make_fragment(partition.path, storage)
        if partition.end >= 0:
            fragment = fragment.subset(row_group_ids=list(range(partition.first, partition.end)))
        stored = fragment.physical_schema.names
        for name in self.schema.names:
            if name not in stored and name not in S.OPTIONAL:
                raise S.MissingColumn(f"column {name} is missing; the table has {', '.join(stored)}")
        wanted = [n for n in self.schema.names if n in stored]
        # columns through small buffers, one batch after the other: a task holds neither a row group nor batches ahead of it
        scan = ds.ParquetFragmentScanOptions(use_buffered_stream=True, buffer_size=BUFFER_BYTES, pre_buffer=False)
        for b in fragment.to_batches(columns=wanted, filter=self.expression(), batch_size=BATCH_ROWS, batch_readahead=1, fragment_readahead=1, fragment_scan_options=scan, use_threads=False):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([self._column(b, f) for f in self.schema], schema=self.schema)

    @staticmethod
    def _column(b: pa.RecordBatch, f: pa.Field) -> pa.Array:
        fill = filled(f.name, f.type)
        if f.name not in b.schema.names:
            return pa.array([fill] * b.num_rows, f.type)
        column = b.column(f.name).cast(f.type)
        return column if fill is None or not column.null_count else pa.array([fill if v is None else v for v in column.to_pylist()], f.type) if pa.types.is_nested(f.type) else column.fill_null(fill)


class ArchiveSource(DataSource):
    """Options: path, table (PRIMARY_ALIGNMENT by default), task_bytes, and which rows to read."""

    @classmethod
    def name(cls) -> str:
        return "strandforge_archive"

    def schema(self) -> StructType:
        return S.TABLES[self.options.get("table", S.PRIMARY)]

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]
        uri = path if ":" in path.split("/")[0] else f"file://{path}"
        return ArchiveReader(uri, self.options.get("table", S.PRIMARY), to_arrow_schema(schema), dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(ArchiveSource)
