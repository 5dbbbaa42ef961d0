"""Hard negatives by a secondary-sort shuffle.

Anchors are rows whose id is divisible by a number; the positives of an anchor are its best rows of the
same label, and each positive opens a window of scores in which the best rows of other labels are its
hard negatives. Components are quantised to whole numbers, so scores are whole numbers and exact.

1. Scores are made block by block: a block of anchors against a block of rows. A block gives back what
   can be in the result only: of each anchor its best rows of the same label, and, once the positives
   are known, the best of each window.
2. A pair's score is packed into a key (anchor, descending score, kind, id): pairs are dealt by anchor
   and sorted within partitions by the whole key. A task reads them as a stream: a positive opens its window, a
   negative goes to the open windows that it lies in, and a window that is full or passed takes no more.
   What is held is the windows of one anchor, never its pairs.

Blocks are cut by hashes of ids, those of the positives within each label, so neither a hot label nor many
anchors make one large task.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part;
equal rows count once; rows that share an id are never paired; rows of another length than
the anchor's are not compared with it; a pair whose score does not fit into 64 bits takes no part; an
anchor without positives, and a positive without negatives, give no rows; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import bounded_batches, discard, materialize

ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score lies between these hundredths of its positive's.
LOWEST, HIGHEST = 50, 95
QUANTUM = 256
#: Rows and anchors of a block, and anchors scored at once.
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE = 8_192, 2_048, 64
POSITIVE, NEGATIVE = 0, 1
_EXACT_FLOAT, _EXACT_LONG = 2.0**52, 2**63
_NONE = np.iinfo(np.int64).min
KEY = "anchor long, anchor_row long, descending long, kind byte, id long"
MINED = "anchor_id long, anchor_row long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_MINED = pa.schema([(c, pa.int32() if c == "rank" else pa.int64()) for c in re.findall(r"(\w+) (?:long|int)", MINED)])


def shifted_label(vec_id: Column, label: Column) -> Column:
    """The label of a row: that of every seventh id is moved on by one, of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, d (length), v (array<double> of whole numbers), row (a hash) of the rows that take part, equal ones once."""
    x = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    x = x.where(F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False)))
    # a double beyond 2^52 is whole as it is, and floor() ends at 64 bits
    whole = F.transform("v", lambda c: F.when(F.abs(c * QUANTUM) < _EXACT_FLOAT, F.floor(c * QUANTUM).cast("double")).otherwise(c * QUANTUM))
    x = x.select("id", shifted_label(F.col("id"), F.col("label")).alias("label"), F.size("v").alias("d"), whole.alias("v")).distinct()
    return x.withColumn("row", F.xxhash64("label", "v"))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors as longs; _NONE where one does not fit."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    most = np.abs(anchors).max(initial=0.0) * np.abs(rows).max(initial=0.0) * anchors.shape[1]
    if most < _EXACT_FLOAT:
        return (anchors @ rows.T).astype(np.int64)
    # 256 times a component may be no double any more: such a number fits with nothing but zero
    whole = lambda m: np.array([[int(c) if np.isfinite(c) else int(np.sign(c)) << 2000 for c in r] for r in m], dtype=object)
    exact = whole(anchors) @ whole(rows).T
    return np.array([[s if -_EXACT_LONG < s < _EXACT_LONG else _NONE for s in r] for r in exact], dtype=np.int64)


def best(s: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best scores that are not _NONE, higher first, ties by position."""
    k = min(n, len(s))
    if not k:
        return np.zeros(0, dtype=np.int64)
    least = np.partition(s, len(s) - k)[len(s) - k]
    where = np.flatnonzero(s > least) if least == _NONE else np.flatnonzero(s >= least)
    return where[np.argsort(-s[where], kind="stable")][:n]


def in_window(negative: int, positive: int) -> bool:
    """Whether a negative's score lies in the window of a positive's, both whole numbers."""
    return (LOWEST * positive <= 100 * negative) & (100 * negative <= HIGHEST * positive)


def window_bounds(positive: int) -> tuple[int, int]:
    """The least and the greatest whole score inside a positive's window."""
    return -(-LOWEST * positive // 100), HIGHEST * positive // 100


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _blocked(rows: DataFrame, anchors: DataFrame, keys: list[str], find, row_block: int, anchor_block: int) -> DataFrame:
    """What find gives back for each block of anchors and block of rows of equal keys, as packed keys.

    The number of blocks of a key comes from counts, a row for each key, joined back by the key.
    """

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    sizes = materialize(blocks(rows, row_block, "row_blocks").join(blocks(anchors, anchor_block, "anchor_blocks"), keys), "blocks")
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from one table
    left = anchors.join(sizes, keys).withColumn("a", of("anchor_blocks")).withColumn("r", every("row_blocks"))
    right = fresh(rows).join(fresh(sizes), keys).withColumn("r", of("row_blocks")).withColumn("a", every("anchor_blocks"))
    by = [*keys, "a", "r"]
    return fresh(left).groupBy(*by).cogroup(fresh(right).groupBy(*by)).applyInArrow(find, KEY)


def _packed(kind: int, left: pa.Table, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Keys from (position of the anchor, ids, scores)."""
    of = np.concatenate([np.full(len(ids), i) for i, ids, _ in found] or [np.zeros(0)]).astype(np.int64)
    ids, s = (np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype(np.int64) for k in (1, 2))
    named = [left.column(c).to_numpy()[of] if left.num_rows else of for c in ("id", "row")]
    return pa.table({"anchor": named[0], "anchor_row": named[1], "descending": -s, "kind": np.full(len(s), kind, dtype=np.int8), "id": ids})


def _scored(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position of an anchor, ids and labels of the rows in the order of ids, scores; _NONE for its own id)."""
    if not left.num_rows or not right.num_rows:
        return
    d = left.column("d")[0].as_py()
    right = right.sort_by([("id", "ascending"), ("row", "ascending")])
    ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()
    own, a, x = left.column("id").to_numpy(), _matrix(left.column("v"), d), _matrix(right.column("v"), d)
    for at in range(0, len(a), AT_ONCE):
        for i, s in enumerate(scores(a[at : at + AT_ONCE], x), at):
            s[ids == own[i]] = _NONE
            yield i, ids, labels, s


def positive_candidates(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Packed keys of each anchor's best rows of its label in every block of rows."""

    def find(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tops = ((i, ids, s, best(s, positives)) for i, ids, _labels, s in _scored(left, right))
        return _packed(POSITIVE, left, [(i, ids[top], s[top]) for i, ids, s, top in tops])

    return _blocked(rows, anchors, ["d", "label"], find, row_block, anchor_block)


def negative_candidates(rows: DataFrame, anchors: DataFrame, negatives: int = NEGATIVES, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Packed keys of the best rows of other labels in each window of an anchor, in every block of rows.

    anchors have a column opened: the scores of their positives."""

    def find(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for i, ids, labels, s in _scored(left, right):
            other = np.where(labels == left.column("label")[i].as_py(), _NONE, s)
            top: set[int] = set()
            for p in left.column("opened")[i].as_py():
                low, high = window_bounds(p)
                if low <= high:
                    top.update(best(np.where((other >= low) & (other <= high), other, _NONE), negatives).tolist())
            chosen = np.array(sorted(top), dtype=np.int64)
            found.append((i, ids[chosen], s[chosen]))
        return _packed(NEGATIVE, left, found)

    return _blocked(rows, anchors, ["d"], find, row_block, anchor_block)


def sorted_stream(keys: DataFrame) -> DataFrame:
    """The secondary sort: packed keys dealt by anchor, and sorted within partitions by the whole key.

    At one score positives come before negatives, as the window of a score of zero holds that score itself.
    """
    dealt = keys.repartition("anchor", "anchor_row")
    return dealt.sortWithinPartitions("anchor", "anchor_row", "descending", "kind", "id").select("anchor", "anchor_row", "descending", "kind", "id")


def windows(batches: Iterator[pa.RecordBatch], positives: int = POSITIVES, negatives: int = NEGATIVES) -> Iterator[pa.RecordBatch]:
    """Of a stream of sorted keys: each positive (rank 0, no negative) and the negatives of its window."""
    at, opened = None, []  # windows of the anchor: [positive, its score, negatives so far]
    for b in batches:
        out: list[tuple] = []
        for anchor, row, down, kind, i in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if at != (anchor, row):
                at, opened = (anchor, row), []
            if kind == NEGATIVE:
                for w in opened:
                    if w[2] < negatives and in_window(-down, w[1]):
                        w[2] += 1
                        out.append((anchor, row, w[0], w[2], i, w[1], -down))
            elif len(opened) < positives:
                opened.append([i, -down, 0])
                out.append((anchor, row, i, 0, None, -down, None))
        columns = list(zip(*out, strict=True)) or [()] * len(_MINED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MINED, strict=True)], schema=_MINED)


def hard_negatives(
    vectors: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    bounded_batches(vectors.sparkSession)
    rows = materialize(usable(vectors, vec_id, embedding, label), "quantised")
    anchors = rows.where(F.col("id") % every == 0)
    mined = lambda keys: sorted_stream(keys).mapInArrow(lambda batches: windows(batches, positives, negatives), MINED)
    known = materialize(mined(positive_candidates(rows, anchors, positives, row_block, anchor_block)), "positives")
    opened = known.groupBy(F.col("anchor_id").alias("i"), F.col("anchor_row").alias("r")).agg(F.collect_list("positive_score").alias("opened"))  # as many as positives at most
    asking = anchors.join(opened, (F.col("id") == F.col("i")) & (F.col("row") == F.col("r"))).drop("i", "r")
    as_keys = known.select(F.col("anchor_id").alias("anchor"), "anchor_row", (-F.col("positive_score")).alias("descending"), F.lit(POSITIVE).cast("byte").alias("kind"), F.col("positive_id").alias("id"))
    found = materialize(mined(as_keys.unionByName(negative_candidates(rows, asking, negatives, row_block, anchor_block))).where("rank > 0").drop("anchor_row"), "hard-negatives")
    discard(rows, known)
    return found
