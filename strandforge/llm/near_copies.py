"""SimHash near-dedup of a pipeline: five-word shingles, a similarity of 0.8.

The same bit-sliced comparison as in ``simhash``, over fingerprints of 256 bits, as 64 cannot tell
a similarity of 0.8 (some 10 of 64 bits differ) from one of 0.6 (16):

1. The distinct five-word shingles of a whole text give its 256-bit SimHash. Texts of equal sets are
   one class.
2. A class goes to BANDS buckets, each the hash of BAND_ROWS minima of rehashed shingles: a pair of
   similarity 0.8 misses all with a chance of 0.0004, and unlike texts do not meet.
3. In a bucket, bit planes are stored vertically, distances of a member to a block of others are added
   up in carry-save counters, and a block is abandoned once all of it exceeds RADIUS bits. RADIUS lies
   two standard deviations above the mean for 0.8. The bucket gives the edges of spanning trees, never all its pairs.
   A bucket of more than BUCKET classes is cut into parts by their hashes, and every two parts are a bucket: each pair still meets, in tasks of bounded size.
4. An edge counts if the whole shingle sets have a Jaccard similarity of 0.8 or more, so nothing below
   0.8 is joined directly. As a tree may have left out a better edge than one that failed, each member
   of a bucket that is still of another component than most then names the nearest of the others, and these edges are verified too.
   A tree may be a star: the shingle set of its hub is sent once for every HUB edges, not with each.
5. Connected components as in ``simhash``.

Nothing is capped or sampled. What can be lost is a link of a similarity close to 0.8 whose bits
differ more than RADIUS, or whose bands all differ; tests measure it against brute force.

Shingles and classes are told apart by 64-bit hashes. Words are those of ``simhash.fingerprint``; a
text of fewer than five is one shingle, an empty or null one has none and equals only its like.

Defined results: rows with a null doc_id give way to others; of rows with equal id and text the one
with the least other columns stays; an empty table gives no rows; other columns, whatever their
names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import bounded_batches, broadcast_if_small, discard, map_rows, materialize
from strandforge.llm.simhash import SEED, bit_planes, buckets_of, components, within_radius

SHINGLE = 5
SIMILARITY = 0.8
LANES = 4  # 64 bits each
RADIUS = 52
BANDS = 14
BAND_ROWS = 4
#: Members that are compared with one another bit by bit, without planes.
FEW = 24
BLOCK = 4096
#: Classes of a bucket, at most; and edges of a hub that one task verifies.
BUCKET, HUB = 4096, 512
_CHUNK = 1 << 13
_EPS = 1e-9
_random = np.random.default_rng(SEED)
_MIX = _random.integers(1, 1 << 63, size=(LANES, 2), dtype=np.uint64) | np.uint64(1)
_MIN = _random.integers(1, 1 << 63, size=(BANDS * BAND_ROWS, 2), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of the whole text, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    k = min(shingle, len(words))
    a, b = (ends - lengths + 1)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], dtype=np.uint64))


def _rehashed(s: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A new hash of each shingle for each pair of keys."""
    x = (s[None, :] ^ keys[:, :1]) * keys[:, 1:]
    return x ^ (x >> np.uint64(29))


def wide_fingerprint(s: np.ndarray) -> bytes:
    """The SimHash of LANES times 64 bits: bits that more than half of the shingles have."""
    counts = np.zeros(64 * LANES, dtype=np.int64)
    for at in range(0, len(s), _CHUNK):
        h = np.ascontiguousarray(_rehashed(s[at : at + _CHUNK], _MIX).T)
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(s), bitorder="little").tobytes()


def band_keys(s: np.ndarray) -> list[int]:
    """The buckets of a shingle set: hashes of a band number and its minima."""
    if not len(s):
        return []
    least = np.min([_rehashed(s[at : at + _CHUNK], _MIN).min(axis=1) for at in range(0, len(s), _CHUNK)], axis=0).reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def signatures(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, cls, fp (bytes), bands of every row."""

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], []]
        for t in cols[1]:
            s = shingle_set(t, shingle)
            c = xxhash.xxh64_intdigest(s.tobytes(), SEED)
            for column, value in zip(out, (c - (1 << 64) if c >> 63 else c, wide_fingerprint(s), band_keys(s)), strict=True):
                column.append(value)
        return [cols[0], cols[2], *out]

    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return map_rows(docs, [F.col(doc_id).cast("long"), F.col(text), text_hash], "doc_id long, text_hash long, cls long, fp binary, bands array<long>", run)


class Members:
    """Fingerprints of a bucket as bit planes, in blocks; those taken out are compared no more."""

    def __init__(self, prints: list[bytes], radius: int):
        self.words, self.radius = np.frombuffer(b"".join(prints), dtype=np.uint64).reshape(len(prints), -1), radius
        self.numbers = [int.from_bytes(p, "little") for p in prints]
        self.left = np.arange(len(prints))
        self._lay()

    def _lay(self) -> None:
        self.laid = self.left
        self.blocks = []
        if len(self.laid) > FEW:
            for at in range(0, len(self.laid), BLOCK):
                part = self.words[self.laid[at : at + BLOCK]]
                self.blocks.append(([p for lane in range(part.shape[1]) for p in bit_planes(part[:, lane])], (1 << len(part)) - 1))

    def near(self, query: int) -> np.ndarray:
        """Members that are left and within the radius of a member."""
        if not self.blocks:
            q = self.numbers[query]
            return np.array([i for i in self.left.tolist() if (q ^ self.numbers[i]).bit_count() <= self.radius], dtype=np.int64)
        hit = []
        for b, (planes, everyone) in enumerate(self.blocks):
            mask = within_radius(self.numbers[query], planes, everyone, self.radius)
            if mask:
                raw = mask.to_bytes(-(-everyone.bit_length() // 8), "little")
                hit.append(b * BLOCK + np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")))
        found = self.laid[np.concatenate(hit)] if hit else self.laid[:0]
        return np.intersect1d(found, self.left, assume_unique=True)

    def take(self, members: np.ndarray) -> None:
        self.left = np.setdiff1d(self.left, members, assume_unique=True)
        if 2 * len(self.left) <= len(self.laid):
            self._lay()


def tree_edges(prints: list[bytes], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, its parent) of spanning trees of what links within the radius join."""
    m, out = Members(prints, radius), []
    while len(m.left) > 1:
        queue = [int(m.left[0])]
        m.take(np.array(queue))
        while queue and len(m.left):
            q = queue.pop()
            found = m.near(q)
            if len(found):
                m.take(found)
                out += [(i, q) for i in found.tolist()]
                queue += found.tolist()
    return out


def nearest_edges(prints: list[bytes], of: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """For each member outside the largest component, the nearest member of another one within the radius."""
    names, inverse, sizes = np.unique(of, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    m, out = Members(prints, radius), []
    for q in np.flatnonzero(inverse != int(sizes.argmax())).tolist():
        found = m.near(q)
        found = found[inverse[found] != inverse[q]]
        if len(found):
            out.append((q, int(found[np.bitwise_count(m.words[found] ^ m.words[q]).sum(axis=1).argmin()])))
    return out


def bounded_buckets(rows: DataFrame, most: int = BUCKET) -> DataFrame:
    """rows (key, cls, ...) of buckets of two classes or more; larger ones than ``most`` as buckets of every two of their parts."""
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    large = sizes.where(F.col("n") > most).select(F.col("key").alias("large_key"), F.ceil(2 * F.col("n") / most).cast("int").alias("parts"))
    if large.limit(1).count() == 0:
        return rows
    joined = rows.join(broadcast_if_small(large), F.col("key") == F.col("large_key"), "left")
    own, kept = F.pmod(F.xxhash64("cls", "key"), F.col("parts")).cast("int"), [c for c in rows.columns if c != "key"]
    split = joined.where("parts IS NOT NULL").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # parts are of half the size, so any two fit; two parts of one number meet in the buckets with all others
    pair = split.where("own != other").select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *kept)
    return joined.where("parts IS NULL").select("key", *kept).unionByName(pair)


def _edges(rows: DataFrame, find, most: int = BUCKET) -> DataFrame:
    """u, v: the edges that find(columns of a bucket) gives as positions; rows: key, cls, fp, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in buckets_of(batches):
            got: list[tuple[int, int]] = []
            for bucket in group:
                cls = bucket.column(1).to_numpy()
                got += [(int(cls[i]), int(cls[j])) for i, j in find(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return bounded_buckets(rows, most).repartition("key").sortWithinPartitions("key", "cls").mapInArrow(run, "u long, v long").distinct()


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two shingle sets have this Jaccard similarity."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - _EPS:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common) - _EPS


def _verified(edges: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, shingle: int, text: str, hub: int = HUB) -> DataFrame:
    """The edges (member, parent) whose whole shingle sets are similar enough, written out.

    A parent with many members is dealt to several tasks, hub members each. A task gets the parent's set first
    and then streams its members', so it holds two sets, and no set is sent with every edge of its hub.
    """
    edges = materialize(edges, "tree-edges")
    asked = edges.select("u").union(edges.select("v")).distinct().withColumnRenamed("u", "k")
    wanted = materialize(asked.join(classes, F.col("k") == F.col("cls")).select("cls", F.col("text_hash").alias("h")), "asked")
    texts = docs.select(F.col(text).alias("t"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    found = texts.join(broadcast_if_small(wanted), F.col("th") == F.col("h")).select("cls", "t")
    sets = map_rows(found.dropDuplicates(["cls"]), [F.col("cls"), F.col("t")], "cls long, s binary", lambda cols: [cols[0], [shingle_set(t, shingle).tobytes() for t in cols[1]]])
    sets = materialize(sets, "sets")
    degrees = materialize(edges.groupBy(F.col("v").alias("p")).agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("shares")), "hubs")
    dealt = edges.join(degrees, F.col("v") == F.col("p")).select("u", "v", F.pmod(F.xxhash64("u"), F.col("shares")).cast("int").alias("share"))
    own = lambda name: sets.select(F.col("cls").alias(name), "s")
    members = dealt.join(own("m"), F.col("u") == F.col("m")).select("v", "share", F.lit(1).alias("kind"), "u", "s")
    parents = degrees.select("p", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).join(own("m"), F.col("p") == F.col("m"))
    rows = members.unionByName(parents.select(F.col("p").alias("v"), "share", F.lit(0).alias("kind"), F.col("p").alias("u"), "s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parent = None, b""
        for b in batches:
            keep: tuple[list, list] = ([], [])
            for v, share, kind, u, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind == 0:
                    of, parent = (v, share), s
                elif of == (v, share) and similar(s, parent, similarity):
                    keep[0].append(u)
                    keep[1].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in keep], names=["u", "v"])

    bounded_batches(docs.sparkSession)
    streamed = rows.repartition("v", "share").sortWithinPartitions("v", "share", "kind").select("v", "share", "kind", "u", "s")
    out = materialize(streamed.mapInArrow(run, "u long, v long"), "similar")
    discard(edges, wanted, sets, degrees)
    return out


def class_components(classes: DataFrame, docs: DataFrame, similarity: float, shingle: int, text: str) -> DataFrame:
    """v, c: the component of every class that is similar to another. classes: cls, text_hash, fp, bands."""
    rows = classes.select(F.explode("bands").alias("key"), "cls", "fp")
    first = _verified(_edges(rows, lambda b: tree_edges(b.column(2).to_pylist())), classes, docs, similarity, shingle, text)
    labels = components(first)
    known = rows.join(labels, F.col("cls") == F.col("v"), "left").select("key", "cls", "fp", F.coalesce("c", "cls").alias("c"))
    more = _verified(_edges(known, lambda b: nearest_edges(b.column(2).to_pylist(), b.column(3).to_numpy())), classes, docs, similarity, shingle, text)
    out = components(first.union(more))
    discard(labels, first, more)
    return out


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of near copies: that of the smallest doc_id."""
    prints = materialize(signatures(docs, shingle, doc_id, text), "signatures")
    classes = materialize(prints.groupBy("cls").agg(F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    labels = class_components(classes, docs, similarity, shingle, text)
    # the row to keep of each group, chosen by ids and hashes alone; no text moves
    named = prints.groupBy("cls", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    groups = named.join(labels, F.col("cls") == F.col("v"), "left").withColumn("root", F.coalesce("c", "cls"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "rows")).alias("first"))
    first = materialize(first.select("first.doc_id", "first.text_hash", "first.rows"), "kept")
    spread = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = lambda name: F.col("row").getField(name)
    own_hash = F.xxhash64(F.coalesce(at(text), F.lit("")))
    kept = spread.join(broadcast_if_small(first), at(doc_id).cast("long").eqNullSafe(F.col("doc_id")) & (own_hash == F.col("text_hash")))
    # most ids and texts have one row; of those that repeat the least row stays
    alone = kept.where("rows = 1").select("row")
    least = kept.where("rows > 1").groupBy("doc_id", "text_hash").agg(F.min("row").alias("row")).select("row")
    discard(prints, classes, labels)
    return alone.union(least).select("row.*")
