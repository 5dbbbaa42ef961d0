"""An archive: a folder of Parquet tables named as in ``schemas.TABLES``, with a header sidecar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandforge.plans.retry import on_network_error
from strandforge.sources import schemas as S
from strandforge.sources.storage import file_system


_FROM_FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.partitionColumnTypeInference.enabled": "false"}


def _FORMATTED(spark: SparkSession):  # noqa: N802
    return spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")


@dataclass(frozen=True)
class Archive:
    """Named tables, header text and name. Tables given directly win over those in the folder."""

    spark: SparkSession
    path: str | None = None
    tables: tuple[tuple[str, DataFrame], ...] = ()
    stored_header: str | None = None

    def list_tables(self) -> list[str]:
        found = {n for n, _ in self.tables}
        if self.path:
            found |= {n for x in on_network_error("list tables", self._names) if (n := x.removesuffix(".parquet")) in S.TABLES}
        return sorted(found)

    def _names(self) -> list[str]:
        where, fs = file_system(self.spark, self.path)
        if not fs.exists(where):
            raise FileNotFoundError(self.path)
        return [x.getPath().getName() for x in fs.listStatus(where)]

    def has_table(self, name: str) -> bool:
        return name in self.list_tables()

    def table(self, name: str) -> DataFrame:
        """The table as stored."""
        for n, df in self.tables:
            if n == name:
                return df
        if not self.path or not self.has_table(name):
            raise KeyError(f"no table {name}")
        file = name if name in self._names() else f"{name}.parquet"
        return on_network_error(f"open {name}", lambda: self.spark.read.parquet(f"{self.path}/{file}"))

    def list_columns(self, name: str) -> list[str]:
        return self.table(name).columns

    def aligned(self, name: str = S.PRIMARY, long_cigar: bool = False, keep: Column | None = None) -> DataFrame:
        """The alignment scan, with one CIGAR column; Catalyst prunes what a query does not use.

        keep: which stored rows to read. It is asked of the columns as stored, before empty cells
        are filled, since a comparison with a filled column would not reach the Parquet reader.
        """
        stored = self.table(name)
        stored = stored if keep is None else stored.where(keep)
        df = S.conform(stored, S.ALIGNED_COLUMNS, [c for c in S.ALIGNED_COLUMNS.names if c != ("cigar_short" if long_cigar else "cigar_long")])
        return df.withColumnRenamed("cigar_long" if long_cigar else "cigar_short", "cigar")

    def sequence(self) -> DataFrame:
        return S.conform(self.table(S.SEQUENCE), S.SEQUENCE_COLUMNS, optional={})

    def references(self) -> DataFrame:
        return S.conform(self.table(S.REFERENCES), S.REFERENCE_COLUMNS, optional={})

    def find_reference(self, name: str) -> DataFrame:
        """The reference of this name or sequence id."""
        return self.references().where((F.col("name") == name) | (F.col("seq_id") == name))

    def dependencies(self, missing_only: bool = False) -> DataFrame:
        d = S.conform(self.table(S.DEPENDENCIES), S.DEPENDENCY_COLUMNS, optional={})
        return d.where(~F.col("local")) if missing_only else d

    def from_footers(self, name: str, column: str, by: str | None = None) -> DataFrame | None:
        """first (least), last, n_rows of a column, for each value of by where the table is partitioned by it: answered from
        the statistics in Parquet footers, no row group is read. None where the table is no file or has no statistics.

        Spark answers so in its second file reader only, which a session of its own is set to.
        """
        if not self.path or any(n == name for n, _ in self.tables):
            return None
        apart = self.spark.newSession()
        for key, value in _FROM_FOOTERS.items():
            apart.conf.set(key, value)
        file = name if name in self._names() else f"{name}.parquet"
        table = apart.read.parquet(f"{self.path}/{file}")
        grouped = table.groupBy(by) if by else table.groupBy()
        counts = grouped.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("n_rows"))
        return counts if "PushedAggregation: [MIN" in counts._jdf.queryExecution().explainString(_FORMATTED(apart)) else None

    def id_range(self, name: str, column: str) -> tuple[int, int]:
        """(first id, rows)."""
        r = self.table(name).agg(F.min(column), F.count(F.lit(1))).first()
        return r[0] or 0, r[1]

    def bam_header(self) -> str | None:
        """The stored header text; none or empty: None."""
        if self.stored_header is None and self.path:
            where, fs = file_system(self.spark, f"{self.path}/BAM_HEADER")
            if on_network_error("find the header", lambda: fs.exists(where)):
                return self.spark.read.text(f"{self.path}/BAM_HEADER", wholetext=True).first()[0] or None
        return self.stored_header or None


def open_archive(spark: SparkSession, path: str) -> Archive:
    archive = Archive(spark, path.rstrip("/"))
    archive.list_tables()
    return archive
