"""Fields of SAM records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(number: Column) -> Column:
    return number.cast("string")


def qname(name: Column, group: Column, separator: str, prefix: str | None = None, with_group: bool = False) -> Column:
    """[prefix.]name[separator group]; the group only where asked for and not empty."""
    parts = ([F.lit(f"{prefix}.")] if prefix is not None else []) + [name]
    if with_group:
        parts.append(F.when(group != "", F.concat(F.lit(separator), group)).otherwise(""))
    return F.concat(*parts)


def position(zero_based: Column) -> Column:
    return zero_based + 1


def or_star(value: Column) -> Column:
    return F.when(value == "", "*").otherwise(value)


def _named(mate_ref: Column) -> Column:
    return (mate_ref != "") & (mate_ref != "*")


def rnext(cached: Column, mate_ref: Column, rname: Column) -> Column:
    """"=" for a found mate; else the mate's reference, "=" if the same, "*" if there is none."""
    return F.when(cached.isNotNull(), "=").when(~_named(mate_ref), "*").when(mate_ref == rname, "=").otherwise(mate_ref)


def pnext(cached: Column, mate_ref: Column, mate_pos: Column) -> Column:
    return F.when(cached.isNotNull(), cached + 1).when(~_named(mate_ref), 0).otherwise(mate_pos + 1).cast("int")


def bam_mate(cached: Column, mate_align_id: Column, mate_ref: Column, mate_pos: Column, tlen: Column, ref_id: Column, mate_ref_id: Column) -> tuple[Column, Column, Column]:
    """(reference id, position, template length) as binary records have them: a record without a
    mate has (-1, -1, 0) whatever its template length is."""
    by_name = F.when(~_named(mate_ref), -1).when(mate_ref == "=", ref_id).otherwise(F.coalesce(mate_ref_id, F.lit(-1)))
    hit, has = cached.isNotNull(), mate_align_id != 0
    ref = F.when(hit, ref_id).when(has, by_name).otherwise(-1)
    pos = F.when(hit, cached).when(has & (by_name != -1), mate_pos).otherwise(-1)
    return ref.cast("int"), pos.cast("int"), F.when(hit | has, tlen).otherwise(0).cast("int")


def sam_tags(edit_distance: Column, alignment_count: Column, group: Column, align_id: Column | None = None) -> Column:
    """Tab-led tags: NM always, NH above zero, RG where named, XI where asked for."""
    parts = [
        F.concat(F.lit("\tNM:i:"), text(edit_distance)),
        F.when(alignment_count > 0, F.concat(F.lit("\tNH:i:"), text(alignment_count))).otherwise(""),
        group_tag(group),
    ]
    if align_id is not None:
        parts.append(F.concat(F.lit("\tXI:i:"), text(align_id)))
    return F.concat(*parts)


def group_tag(group: Column) -> Column:
    return F.when(group != "", F.concat(F.lit("\tRG:Z:"), group)).otherwise("")
