"""Spots that arrive as files become unaligned records as they come, alignments find their mates.

Exploding and formatting a spot needs no state, so the batch operators run unchanged in a stream. The mate lookup
keeps what is still to be asked for as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandforge.operators.records import Format, unaligned_record
from strandforge.operators.spots import emitted_reads
from strandforge.sources import schemas as S


def spot_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    stream = spark.readStream.schema(S.SEQUENCE_COLUMNS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return S.conform(stream, S.SEQUENCE_COLUMNS, optional={})


def unaligned_records(spots: DataFrame, form: Format, whole_spots_only: bool = False) -> DataFrame:
    """row_id, index, record of a stream (or table) of spots."""
    return emitted_reads(spots, whole_spots_only).select("row_id", "index", unaligned_record(form).alias("record"))


def follow(records: DataFrame, out: str, checkpoint: str):
    """Writes records as text files, each input file once, until what is there is read."""
    return records.select("record").writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MATE_SHARES = 256
_LOOKED_UP = "align_id long, mate_align_id long, cached_pos int"


def mates_in_stream(alignments: DataFrame, shares: int = MATE_SHARES, idle_ms: int | None = None) -> DataFrame:
    """align_id, mate_align_id, cached_pos of alignments that arrive in the order of their ids: what ``with_cached_mates``
    finds in the whole table.

    A row offers its position under its own id, and asks under its mate's id if that is smaller. Offers and questions meet
    in a share of the ids of a reference; an offer is kept until the first question takes it. In a stream that goes
    on, idle_ms tells after how many milliseconds without rows a reference has ended: what is left of it is then forgotten. State is one small number for each alignment whose mate is still to come.
    """
    mated = F.col("mate_align_id") != 0
    asks = mated & (F.col("align_id") > F.col("mate_align_id"))
    offer = F.struct(F.col("align_id").alias("key"), F.lit(True).alias("offers"))
    question = F.struct(F.col("mate_align_id").alias("key"), F.lit(False).alias("offers"))
    roles = F.when(asks, F.array(offer, question)).otherwise(F.array(offer))
    rows = alignments.select("ref_name", "align_id", "mate_align_id", "ref_pos", mated.alias("mated"), asks.alias("asks"), F.inline(roles))
    rows = rows.withColumn("share", F.pmod("key", F.lit(shares)))

    def look_up(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        offers = dict(zip(*state.get, strict=True)) if state.exists else {}
        out: list[tuple] = []
        every = pd.concat(batches).sort_values(["align_id", "offers"])  # of one row the question comes before the offer
        for r in every.itertuples(index=False):
            if not r.offers:
                out.append((r.align_id, r.mate_align_id, offers.pop(r.key, None)))
            else:
                if r.mated:
                    offers[r.key] = r.ref_pos
                if not r.asks:
                    out.append((r.align_id, r.mate_align_id, None))
        state.update((list(offers), [int(p) for p in offers.values()]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["align_id", "mate_align_id", "cached_pos"]).astype({"align_id": "int64", "mate_align_id": "int64", "cached_pos": "Int32"})

    return rows.groupBy("ref_name", "share").applyInPandasWithState(look_up, _LOOKED_UP, "ids array<long>, positions array<int>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
