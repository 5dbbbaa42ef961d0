"""Approximate nearest neighbours by largest inner product.

Partitions come from k-means; what a vector differs from its centroid by is quantised with a
product code of four bits per two dimensions. Codebooks and codes minimise the score-aware loss
``|r|^2 + (eta - 1) (x.r / |x|)^2``: the part of the residual r parallel to the vector x costs eta
times the rest, as it moves the scores of the queries that matter. A query scans the codes of its
partitions with lookup tables and reranks exactly, in double precision, the best and all others whose
code, with the length of what it leaves of the vector, does not rule them out.

The index is fitted on a bounded sample (SAMPLE rows, by hash of the id); every row is indexed. What a
search may leave out follows from the rows and queries themselves, not from the sample: a partition's
largest distance from its centroid, and an entry's from its code, bound the scores that they can give. Equal vectors are one
entry that keeps the k + 1 smallest ids, all that any result can name. Partitions and their queries
are split into blocks, so a task holds CELL_ROWS entries and QUERY_ROWS queries at most. The partitions
nearest to a query are searched first; its k-th best score there is the least that the others must be
able to reach to be searched, and the least that they give back.

Defined results: null, zero, or non-finite vectors, vectors of another length than the most common
one (the shorter on ties) and rows without an id take no part; repeated rows count as one; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm.common import bounded_batches, broadcast_if_small, discard, materialize, pieces

SAMPLE = 20_000
CELL_TARGET = 2_000
MAX_CELLS = 4_096
CELL_ROWS = 4_096
QUERY_ROWS = 2_048
THRESHOLD = 0.2  # of the score-aware loss: scores above this share of |q||x| matter
RERANK = 10  # exact scores a block, per result asked for
SCAN_QUERIES = 128  # queries of a table scan at once


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # cells x d
    books: np.ndarray  # subspaces x 16 x 2
    eta: float


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = assign(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - (centroids**2).sum(axis=1) / 2, axis=1)


def _pairs(x: np.ndarray) -> np.ndarray:
    """n x subspaces x 2, a zero added to an odd length."""
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2))).reshape(len(x), -1, 2)


def encode(x: np.ndarray, centroid: np.ndarray, books: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Four-bit codes (n x subspaces) of x - centroid, by coordinate descent on the score-aware loss."""
    unit = _pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
    r = _pairs(x - centroid)
    m = books.shape[0]
    apart = lambda s: r[:, s, None, :] - books[s]
    codes = np.stack([np.argmin((apart(s) ** 2).sum(axis=2), axis=1) for s in range(m)], axis=1)
    rows = np.arange(len(x))
    along = np.stack([(unit[:, s] * (r[:, s] - books[s][codes[:, s]])).sum(axis=1) for s in range(m)], axis=1)
    total = along.sum(axis=1)
    for _ in range(passes):
        for s in range(m):
            d = apart(s)
            a = (unit[:, s, None, :] * d).sum(axis=2)
            others = total - along[:, s]
            best = np.argmin((d**2).sum(axis=2) + (eta - 1) * (others[:, None] + a) ** 2, axis=1)
            codes[:, s], along[:, s] = best, a[rows, best]
            total = others + along[:, s]
    return codes.astype(np.uint8)


def _books(x: np.ndarray, centroid: np.ndarray, eta: float, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    r, unit = _pairs(x - centroid), _pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
    m = r.shape[1]
    books = np.stack([r[rng.choice(len(x), 16), s] for s in range(m)])
    for _ in range(rounds):
        codes = encode(x, centroid, books, eta, passes=1)
        left = r - np.stack([books[s][codes[:, s]] for s in range(m)], axis=1)
        along = (unit * left).sum(axis=2)
        total = along.sum(axis=1)
        for s in range(m):
            others = total - along[:, s]
            for c in range(16):
                own = codes[:, s] == c
                if own.any():  # the weighted least squares of this entry, the others held
                    u, y, b = unit[own, s], r[own, s], others[own]
                    lhs = own.sum() * np.eye(2) + (eta - 1) * u.T @ u
                    books[s, c] = np.linalg.solve(lhs, y.sum(axis=0) + (eta - 1) * (u * (b + (u * y).sum(axis=1))[:, None]).sum(axis=0))
            along[:, s] = (unit[:, s] * (r[:, s] - books[s][codes[:, s]])).sum(axis=1)
            total = others + along[:, s]
    return books


def fit(x: np.ndarray, rows: int, seed: int = 7) -> Index:
    """An index of ``rows`` vectors, fitted on the sample x."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    cells = int(min(max(1, rows // CELL_TARGET), MAX_CELLS, len(x)))
    centroids = _kmeans(x, cells, rng)
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    return Index(centroids, _books(x, centroids[assign(x, centroids)], eta, rng), eta)


def left_over(x: np.ndarray, centroid: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The length of what centroid and code leave of each vector."""
    coded = np.stack([books[s][codes[:, s]] for s in range(len(books))], axis=1)
    return np.sqrt(((_pairs(x - centroid) - coded) ** 2).sum(axis=(1, 2)))


def search_block(q: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray, centroid: np.ndarray, books: np.ndarray, n: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, positions and exact inner products of its n best entries and those equal to the last,
    as far as they reach the query's least; others may be among them."""
    top, m = min(RERANK * n, len(x)), books.shape[0]
    codes = np.pad(codes, ((0, 0), (0, m % 2)))
    packed = np.ascontiguousarray((codes[:, 0::2].astype(np.intp) << 4 | codes[:, 1::2]).T)  # two codes a lookup
    # what sums in single precision may be off by, for a query of length 1
    off = (m + 8) * 2e-7 * np.sqrt((books**2).sum(axis=2).max(axis=1).sum())
    for at in range(0, len(q), SCAN_QUERIES):
        part, floor = q[at : at + SCAN_QUERIES], least[at : at + SCAN_QUERIES]
        rows = np.arange(len(x))
        if len(x) > top:
            tables = np.einsum("qsd,scd->scq", _pairs(part), books).astype(np.float32)
            tables = np.pad(tables, ((0, m % 2), (0, 0), (0, 0)))
            # a row of a table holds all queries' values for a code, so a lookup copies a row
            joined = (tables[0::2, :, None] + tables[1::2, None, :]).reshape(len(packed), 256, len(part))
            rough, row = np.zeros((len(x), len(part)), dtype=np.float32), np.empty((len(x), len(part)), dtype=np.float32)
            for table, column in zip(joined, packed, strict=True):
                rough += np.take(table, column, axis=0, out=row, mode="clip")
            best = np.argpartition(-rough.T, top - 1, axis=1)[:, :top]
            reached = np.partition(np.einsum("qnd,qd->qn", x[best], part), top - n, axis=1)[:, top - n]
            floor = np.maximum(floor, reached)
            length = np.linalg.norm(part, axis=1)
            base = part @ centroid
            slack = length * off + 1e-9 * (np.abs(base) + np.abs(floor))
            # an entry is ruled out where even an error along the query would not bring it to the floor
            ruled_out = rough + (left[:, None] * length).astype(np.float32) * np.float32(1.000001) < (floor - base - slack).astype(np.float32)
            rows = np.nonzero(~ruled_out.all(axis=1))[0]
        scores = x[rows] @ part.T
        if len(rows) > n:
            floor = np.maximum(floor, np.partition(scores, len(rows) - n, axis=0)[len(rows) - n])
        near = scores >= floor - 1e-9 * np.abs(floor)
        for i, own in enumerate(part):
            where = rows[near[:, i]]
            yield where, np.einsum("nd,d->n", x[where], own)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(fine, F.lit(False)))
    length = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("v") == (length[0]["d"] if length else 0))


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, d)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by every."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    base = materialize(usable(vectors, vec_id, embedding).select("id", "v"), "vectors")
    first = base.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = len(first[0]["v"])
    equal = Window.partitionBy("v").orderBy("id")
    ranked = base.dropDuplicates(["id", "v"]).withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1)
    entries = materialize(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")  # k + 1 ids at most
    rows = entries.count()
    sample = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(SAMPLE).select("v").toArrow()
    index = fit(np.array(sample.column("v").combine_chunks().values.to_numpy(zero_copy_only=False)).reshape(-1, d), rows)
    shared = spark.sparkContext.broadcast(index)  # MAX_CELLS x d at most

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in pieces(batches, 1 << 20):
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype("<f8")
                cell = assign(x, ix.centroids)
                codes = encode(x, ix.centroids[cell], ix.books, ix.eta)
                left, away = left_over(x, ix.centroids[cell], codes, ix.books), np.linalg.norm(x - ix.centroids[cell], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), b.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(left), pa.array(away)],
                    names=["cell", "ids", "x", "code", "left", "away"],
                )

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest partitions of a query; where its least is given, all others that can reach it."""
        ix = shared.value
        for b in pieces(batches, 1 << 20):
            if b.num_rows:
                q = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype("<f8")
                toward = q @ ix.centroids.T
                order = np.argsort(-toward, axis=1, kind="stable")
                # cells that hold k + 1 entries at least, so no query comes back short
                taken = np.cumsum(held[order], axis=1) - held[order] < k + 1
                least = np.full(len(q), -np.inf)
                if b.num_columns > 2:
                    least, length = b.column(2).to_numpy(zero_copy_only=False), np.linalg.norm(q, axis=1)[:, None]
                    reach = toward + length * away * (1 + 1e-9) + 1e-9 * length * np.linalg.norm(ix.centroids, axis=1)
                    taken = ~taken & np.take_along_axis((reach >= least[:, None]) & (held > 0), order, axis=1)
                row, rank = np.nonzero(taken)
                for some in np.array_split(np.arange(len(row)), max(1, -(-len(row) * 8 * d // (4 << 20)))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(order[row[some], rank[some]], pa.int32()), pa.array(b.column(0).to_numpy()[row[some]], pa.int64()), pa.array([q[i].tobytes() for i in row[some]], pa.binary()), pa.array(least[row[some]])],
                        names=["cell", "query_id", "q", "least"],
                    )

    bounded_batches(spark)
    stored = materialize(entries.select("v", "ids").mapInArrow(coded, "cell int, ids array<long>, x binary, code binary, left double, away double"), "codes")
    of_cell = {r["cell"]: r for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()}  # a row for each cell
    held = np.array([of_cell[c]["n"] if c in of_cell else 0 for c in range(len(index.centroids))])
    away = np.array([of_cell[c]["away"] if c in of_cell else 0.0 for c in range(len(index.centroids))])
    asked = materialize(base.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).select("id", "v"), "asked")
    discard(base, entries)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ix, ids, scores, of = shared.value, [], [], []
        if left.num_rows and right.num_rows:
            qs, xs = _matrix(left.column("q"), d), _matrix(right.column("x"), d)
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype=np.uint8).reshape(len(xs), -1)
            names = right.column("ids").to_pylist()
            found = search_block(qs, xs, codes, right.column("left").to_numpy(), ix.centroids[key[0].as_py()], ix.books, k + 1, left.column("least").to_numpy())
            for own, least, (at, s) in zip(left.column("query_id").to_pylist(), left.column("least").to_pylist(), found, strict=True):
                got, floor = [], -np.inf
                for j in np.argsort(-s, kind="stable").tolist():
                    if s[j] < least or len(got) >= k and s[j] < floor:
                        break
                    got += [(-s[j], i) for i in names[at[j]] if i != own]
                    floor = s[j]
                for s_, i in sorted(got)[:k]:
                    of.append(own), ids.append(i), scores.append(-s_)
        return pa.table({"query_id": pa.array(of, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    keys = ["cell", "xb", "qb"]

    def found_in(questions: DataFrame, name: str) -> DataFrame:
        q = materialize(questions.mapInArrow(probed, "cell int, query_id long, q binary, least double"), name)
        counts = {"x": {c: int(n) for c, n in enumerate(held)}, "q": dict(q.groupBy("cell").count().collect())}
        blocks = {
            side: F.element_at(F.array(*[F.lit(max(1, -(-counts[side].get(c, 1) // most))) for c in range(len(index.centroids))]), F.col("cell") + 1)
            for side, most in (("x", CELL_ROWS), ("q", QUERY_ROWS))
        }
        last = lambda b: F.sequence(F.lit(0), b - 1)
        x = stored.drop("away").withColumn("xb", F.pmod(F.xxhash64(F.col("ids")[0]), blocks["x"]).cast("int")).withColumn("qb", F.explode(last(blocks["q"])))
        q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), blocks["q"]).cast("int")).withColumn("xb", F.explode(last(blocks["x"])))
        return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(search, out)

    near = materialize(found_in(asked, "nearest-probes"), "nearest-cells")
    reached = near.groupBy("query_id").agg(F.coalesce(F.expr(f"try_element_at(sort_array(collect_list(score), false), {k})"), F.lit(float("-inf"))).alias("least"))
    # the nearest cells of a query tell a score that its k-th result reaches; cells that cannot give it are not searched
    least = F.coalesce("least", F.lit(float("-inf"))).alias("least")
    far = found_in(asked.join(broadcast_if_small(reached.withColumnRenamed("query_id", "id")), "id", "left").select("id", "v", least), "probes")
    found = near.unionByName(far)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
