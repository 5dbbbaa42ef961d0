"""Regions: texts, names and aliases, and the rows that start in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.operators.filters import starts_inside


@dataclass(frozen=True)
class Region:
    name: str
    start: int | None = None  # zero-based
    end: int | None = None  # exclusive


def parse_region(text: str) -> Region:
    """"name" or "name:start-end", start counted from 1."""
    name, colon, rest = text.partition(":")
    if not colon:
        return Region(name)
    first, dash, last = rest.partition("-")
    if not dash or not first.isdecimal() or not last.isdecimal():
        raise ValueError(f"expected name:start-end, not {text!r}")
    return Region(name, max(int(first) - 1, 0), int(last))


def region_table(df: DataFrame, regions: list[Region]) -> DataFrame:
    """region_no, region, start, end in the order given: as many rows as the caller typed."""
    rows = [F.struct(F.lit(i).alias("region_no"), F.lit(r.name).alias("region"), F.lit(r.start).cast("int").alias("start"), F.lit(r.end).cast("bigint").alias("end")) for i, r in enumerate(regions)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def resolve(regions: list[Region], references: DataFrame, use_seqid: bool = False) -> list[Region]:
    """Regions by reference name, from a displayed name or else an alias; an unknown one is an error.

    References are collected for the names asked for only.
    """
    wanted = [r.name for r in regions]
    rows = references.where(F.col("name").isin(wanted) | F.col("seq_id").isin(wanted)).select("name", "seq_id").collect()
    shown = {r["seq_id" if use_seqid else "name"]: r["name"] for r in rows}
    other = {r["name" if use_seqid else "seq_id"]: r["name"] for r in rows}
    out = []
    for r in regions:
        name = shown.get(r.name, other.get(r.name))
        if name is None:
            raise ValueError(f"no reference is named {r.name!r}")
        out.append(Region(name, r.start, r.end))
    return out


def require_alignments(aligned: DataFrame, regions: list[Region]) -> None:
    """A known reference that this table has no rows of is an error."""
    wanted = sorted({r.name for r in regions})
    found = {r[0] for r in aligned.where(F.col("ref_name").isin(wanted)).select("ref_name").distinct().collect()}
    if missing := [n for n in wanted if n not in found]:
        raise ValueError(f"no alignments on {', '.join(missing)}")


def stored_regions(regions: list[Region]) -> Column:
    """Rows of a stored table that start in any region; an empty position counts as 0 and an empty name as the
    empty text. Made of plain comparisons, which reach the Parquet reader."""
    any_of = None
    for r in regions:
        one = F.col("ref_name") == r.name if r.name else F.col("ref_name").isNull() | (F.col("ref_name") == "")
        if r.start is not None:
            inside = starts_inside(F.col("ref_pos"), F.lit(r.start), F.lit(r.end))
            one = one & (inside | F.col("ref_pos").isNull() if r.start <= 0 < r.end else inside)
        any_of = one if any_of is None else any_of | one
    return F.lit(False) if any_of is None else any_of


def in_regions(aligned: DataFrame, regions: list[Region]) -> DataFrame:
    """Rows that start in a region, with region_no; overlapping or repeated regions repeat rows.

    One region is a plain filter that reaches the scan; several are a join with a constant table,
    behind a pushed filter on the names.
    """
    if len(regions) == 1:
        r = regions[0]
        rows = aligned.where(F.col("ref_name") == r.name).withColumn("region_no", F.lit(0))
        return rows if r.start is None else rows.where(starts_inside(F.col("ref_pos"), F.lit(r.start), F.lit(r.end)))
    t = F.broadcast(region_table(aligned, regions))
    inside = F.col("start").isNull() | starts_inside(F.col("ref_pos"), F.col("start"), F.col("end"))
    named = aligned.where(F.col("ref_name").isin(sorted({r.name for r in regions})))
    return named.join(t, (F.col("ref_name") == F.col("region")) & inside).drop("region", "start", "end")
