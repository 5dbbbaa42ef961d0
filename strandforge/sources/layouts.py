"""Layouts in which an archive's alignment tables may be stored, for plans that move less."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandforge.sources import schemas as S
from strandforge.sources.archive import Archive
from strandforge.sources.storage import file_system


def by_reference(archive: Archive, path: str, table: str = S.PRIMARY) -> Archive:
    """The table in a folder for each reference below a path: boundaries and counts then come from Parquet footers."""
    where, fs = file_system(archive.spark, f"{path}/{table}/_SUCCESS")
    if not fs.exists(where):
        archive.table(table).repartition("ref_name").sortWithinPartitions("ref_name", "align_id").write.mode("overwrite").partitionBy("ref_name").parquet(f"{path}/{table}")
    return Archive(archive.spark, path)


def by_id(archive: Archive, path: str, name: str, buckets: int, table: str = S.PRIMARY) -> Archive:
    """The table in buckets of ids below a path, known to the catalog by a name: joins by id then move no wide row.

    buckets: as many as the tasks that one join should have.
    """
    stored: DataFrame = archive.table(table)
    if not archive.spark.catalog.tableExists(name):
        dealt = stored.repartition(buckets, "align_id")  # one file a bucket
        dealt.write.mode("overwrite").option("path", f"{path}/{table}").bucketBy(buckets, "align_id").sortBy("align_id").saveAsTable(name)
    others = tuple((n, archive.table(n)) for n in archive.list_tables() if n != table)
    return Archive(archive.spark, None, ((table, archive.spark.table(name)), *others), archive.bam_header())
