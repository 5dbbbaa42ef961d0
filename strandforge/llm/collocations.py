"""Collocations mined as relations, set by set (SETM).

Texts are cut into pieces and pieces into words. An occurrence relation R_k says which group (a phrase of k
words) begins at which position of which piece, in the order of pieces and positions; it is written out for
every k. R_(k+1) is the merge join of R_k with itself by piece and adjacent position: both sides stand in one
order, so the join reads them side by side. Groups are then counted, and before the next length R_k is
semi-joined with its frequent groups.

* A row of a relation is a block of whole pieces of one language: its different phrases with their counts, and a
  code for every position (-1 where no group begins), four bytes each. Pieces never cross blocks, so joins shuffle nothing;
  what is shuffled is counts, summed in every task before.
* The semi-join asks a bitmap of hashes of the frequent groups, which has BITS bits however many there
  are. A group that passes by chance is counted like any other and fails the exact count after it.
* A block's phrases are hashed, joined and counted as Arrow and NumPy columns, never one by one.

Scores come from joins of the frequent phrases with their parts, in decimals that do not pass over.
The first rows of each language are taken in rounds over ever fewer hashed parts of it, so no task sorts a language.

Defined results: null text is empty, null language is ``und``; repeated rows count each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm.common import bounded_batches, discard, materialize, pieces

MAX_WORDS, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in hundredths.
INSIDE = 50
#: Words of a block, about; a longer piece is a block of its own.
BLOCK_WORDS = 1 << 17
BITS = 1 << 27
#: Hashed parts of a language in the rounds that take its first rows.
ROUNDS = (512, 16, 1)
_GAP = b"."  # no word can be one: it ends a piece
#: bytes.translate() table: A-Z to lower case, ends of pieces to the gap, tabs to spaces.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\v\f\r" else 0x20 if b == 9 else b for b in range(256))
_RELATION = "lang string, n long, phrases array<string>, counts array<int>, groups binary"
#: Row groups of about 8 MiB, also where fewer than the writer's 100 rows fill one; without dictionaries files are larger, but sooner written.
_WRITER = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "4", "parquet.enable.dictionary": "false"}


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text in order, a gap after each piece."""
    low = text.translate(_BYTES).replace(_GAP, b" . ")
    return [*[w for w in low.split(b" ") if w], _GAP]


def blocks_of(tokens: list[bytes], most: int = BLOCK_WORDS) -> Iterator[list[bytes]]:
    """The tokens in runs of whole pieces, of at most so many tokens where pieces allow it."""
    at = 0
    while len(tokens) - at > most:
        try:
            cut = tokens.index(_GAP, at + most - 1) + 1
        except ValueError:
            break
        yield tokens[at:cut]
        at = cut
    if at < len(tokens):
        yield tokens[at:]


def block(tokens: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words, how often each stands, and the code of the word at every position (-1: a gap)."""
    known = pa.array(tokens, pa.binary()).dictionary_encode()
    words, groups = known.dictionary.to_numpy(zero_copy_only=False).tolist(), known.indices.to_numpy()
    if _GAP in words:
        gap = words.index(_GAP)
        del words[gap]
        groups = np.where(groups == gap, -1, groups - (groups > gap)).astype(np.int32)
    counts = np.bincount(groups[groups >= 0], minlength=len(words))
    return words, counts, groups


def _row(lang: str, phrases: pa.Array, counts: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """A row of a relation."""
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    codes = pa.array([groups.astype(np.int32, copy=False).tobytes()], pa.binary())
    columns = [pa.array([lang], pa.string()), pa.array([int(counts.sum())], pa.int64()), listed(phrases), listed(pa.array(counts, pa.int32())), codes]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "n", "phrases", "counts", "groups"])


def words_relation(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """R_1 of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def given(name: str, rest: bool = True) -> Iterator[pa.RecordBatch]:
            for part in blocks_of(held.pop(name)):
                if len(part) < BLOCK_WORDS and not rest:  # the last one, which has room
                    held[name] = part
                    return
                words, counts, groups = block(part)
                yield _row(name, pa.array(words, pa.binary()).cast(pa.string()), counts, groups)

        for b in pieces(batches):
            for name, said in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                tokens, new = held.setdefault(name, []), tokens_of(said)
                tokens += new
                size += len(new)
                if len(tokens) >= BLOCK_WORDS:
                    size -= len(tokens)
                    yield from given(name, rest=False)
                    size += len(held.get(name, ()))
                if size > 8 * BLOCK_WORDS:  # many languages
                    for other in list(held):
                        yield from given(other)
                    size = 0
        for name in list(held):
            yield from given(name)

    bounded_batches(docs.sparkSession)
    picked = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return picked.mapInArrow(run, _RELATION)


def counted(relation: DataFrame) -> DataFrame:
    """lang, phrase, f of all groups of a relation."""
    each = relation.select("lang", "counts", F.posexplode("phrases").alias("at", "phrase"))
    return each.groupBy("lang", "phrase").agg(F.sum(F.get("counts", "at").cast("long")).alias("f"))


def places(lang: str, phrases: pa.Array, bits: int) -> np.ndarray:
    """The bit of each phrase in a bitmap of so many bits, by hash."""
    h = lambda values: pd.util.hash_array(values.cast(pa.binary()).to_numpy(zero_copy_only=False), categorize=False)
    return (h(phrases) ^ h(pa.array([lang]))) % np.uint64(bits)


def bitmap(groups: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bits of hashes of the groups (lang, phrase): bits / 64 rows for the driver at most, however many groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in b.column(0).unique().to_pylist():
                at = places(lang, b.column(1).filter(pc.equal(b.column(0), lang)), bits)
                words = [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))]
                yield pa.RecordBatch.from_arrays(words, names=["at", "bit"])

    words = groups.select("lang", "phrase").mapInArrow(run, "at long, bit long")
    found = words.groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, lang: str, phrases: pa.Array) -> np.ndarray:
    """Which phrases the bitmap knows."""
    at = places(lang, phrases, len(bits) * 64)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def last_words(phrases: pa.Array) -> pa.Array:
    cut = pc.split_pattern(phrases, " ", max_splits=1, reverse=True)
    return cut.values.take(pc.subtract(cut.offsets[1:], 1))


def extended(phrases: pa.Array, groups: np.ndarray, frequent: np.ndarray, last: bool) -> tuple | None:
    """phrases, counts, groups of R_(k+1) from those of R_k: the merge join by adjacent position of what is frequent."""
    there = groups >= 0
    there[there] = frequent[groups[there]]
    both = np.flatnonzero(there[:-1] & there[1:])
    if not len(both):
        return None
    pairs = pa.array(groups[both].astype(np.int64) << 32 | groups[both + 1]).dictionary_encode()
    code, pair = pairs.indices.to_numpy(), pairs.dictionary.to_numpy()
    joined = pc.binary_join_element_wise(phrases.take(pa.array(pair >> 32)), last_words(phrases).take(pa.array(pair & 0xFFFFFFFF)), " ")
    new = np.full(0 if last else len(groups), -1, dtype=np.int32)
    if not last:
        new[both] = code
    return joined, np.bincount(code), new


def next_relation(relation: DataFrame, frequent: np.ndarray, last: bool) -> DataFrame:
    """R_(k+1) from R_k and the bitmap of its frequent groups; the last one needs no positions."""
    shared = relation.sparkSession.sparkContext.broadcast(frequent)  # BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lang, phrases, groups = b.column(0)[i].as_py(), b.column(1)[i].values, np.frombuffer(b.column(2)[i].as_buffer(), dtype=np.int32)
                row = extended(phrases, groups, passes(shared.value, lang, phrases), last)
                if row:
                    yield _row(lang, *row)

    bounded_batches(relation.sparkSession)
    return relation.select("lang", "phrases", "groups").mapInArrow(run, _RELATION)


def scored(frequent: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more, by its worst cut; frequent[k]: phrases of k + 1 words."""
    known = frequent[0]
    for more in frequent[1:-1]:
        known = known.unionByName(more)
    candidates = frequent[1]
    for more in frequent[2:]:
        candidates = candidates.unionByName(more)
    words = candidates.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = words.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    joined = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w")).alias("right"))
    part = lambda on, name: known.select(F.col("lang").alias(f"{on}_lang"), F.col("phrase").alias(f"{on}_phrase"), F.col("f").alias(name))
    for on, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part(on, name), (F.col("lang") == F.col(f"{on}_lang")) & (F.col(on) == F.col(f"{on}_phrase")))
    whole = {c: f"cast({c} as decimal(19,0))" for c in "alr"}
    score = F.expr(f"({whole['a']} * {whole['a']} * cast(1000000 as decimal(7,0))) div ({whole['l']} * {whole['r']})")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return worst.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def held_inside(frequent: list[DataFrame]) -> DataFrame:
    """in_lang, inside, most: phrases of two words or more inside longer ones, with the largest count of these."""
    out = None
    for k, longer in enumerate(frequent[2:], 3):
        w = F.split("phrase", " ")
        parts = [F.array_join(F.slice(w, at + 1, n), " ") for n in range(2, k) for at in range(k - n + 1)]
        rows = longer.select(F.col("lang").alias("in_lang"), "f", F.explode(F.array(*parts)).alias("inside"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("in_lang", "inside").agg(F.max("f").alias("most"))


def first_of_each(rows: DataFrame, top: int, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """The first rows of each language, with their rank: taken from hashed parts of it, then from fewer."""
    for parts in rounds:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        order = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.drop("part")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, inside: int = INSIDE, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases of 2 to max_words words."""
    if max_words < 2:
        raise ValueError("phrases have two words at least")
    relation = materialize(words_relation(docs, text, lang), "occurrences-1", **_WRITER)
    totals = materialize(relation.groupBy(F.col("lang").alias("n_lang")).agg(F.sum("n").alias("n")), "word-totals")
    frequent = []
    for k in range(1, max_words + 1):
        frequent.append(materialize(counted(relation).where(F.col("f") >= least), f"frequent-{k}"))
        if k < max_words:
            longer = materialize(next_relation(relation, bitmap(frequent[-1]), k + 1 == max_words), f"occurrences-{k + 1}", **_WRITER)
            discard(relation)
            relation = longer
    discard(relation)
    found = scored(frequent)
    if max_words > 2:
        longer = held_inside(frequent)
        found = found.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inside")), "left")
        found = found.where(F.coalesce(100 * F.col("most") < inside * F.col("a"), F.lit(True))).drop("in_lang", "inside", "most")
    first = first_of_each(found, top).join(totals, F.col("lang") == F.col("n_lang"))
    out = materialize(first.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(totals, *frequent)
    return out
