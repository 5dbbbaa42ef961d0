"""SimHash near-dedup with bit-sliced comparison.

1. Fingerprint of a whole text: majority bits of the XXH64 of its word 3-shingles.
2. Equal fingerprints are one class. A class goes to 28 buckets, one for each way to leave out two
   of the eight bytes: two fingerprints within two bits agree on at least six bytes, so they meet
   in a bucket, and no bucket can hold more than 2^16 classes.
3. In a bucket, bit planes are stored vertically (bit i of a plane is that bit of member i). One
   member is compared with a block of others at once by adding planes into carry-save counters;
   a block is abandoned as soon as all of it exceeds the radius. A bucket gives the edges of a
   bounded-degree spanning tree of each linked set, never all its pairs.
4. Connected components by min-label hooking and shortcutting, each round written to the shared
   folder. What a round joins are written tables, so run-time splitting deals a large component out.

Defined results: null text is the empty text (fingerprint zero, linked like any other); null
doc_id keeps its row and counts for no minimum; repeated rows stay; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import discard, map_rows, materialize

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Members compared with one query at a time.
BLOCK = 4096
#: Children of a node in the spanning trees that buckets give.
FANOUT = 16
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the whole text, as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    k = min(shingle, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    h, n, counts = xxhash.xxh64_intdigest, len(a), np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        got = np.array([h(joined[i:j], SEED) for i, j in zip(a[at : at + _CHUNK], b[at : at + _CHUNK], strict=True)], dtype=np.uint64)
        bits = np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(cols: list[list]) -> list[list]:
        return [cols[0], [f - (1 << 64) if f >> 63 else f for f in map(fingerprint, cols[1])]]

    return map_rows(docs, [F.col(doc_id).cast("long"), F.col(text)], "doc_id long, fp long", run)


def within_radius(query: int, planes: list[int], everyone: int, radius: int = RADIUS) -> int:
    """Members, as set bits, at a distance of at most radius from the query.

    planes[b] holds bit b of all members. Differing bits of four planes at a time go through carry-save
    adders into vertical counters, which start so high that one bit more than the radius overflows
    them; what overflowed stays in over, and once that is everyone the block is abandoned.
    """
    size = max(2, (radius + 1).bit_length())
    start = (1 << size) - 1 - radius
    counters = [everyone if start >> k & 1 else 0 for k in range(size)]
    over = 0
    for at in range(0, len(planes), 4):
        a, b, c, d = [(p ^ everyone if query >> at + i & 1 else p) for i, p in enumerate(planes[at : at + 4])] + [0] * (at + 4 - min(len(planes), at + 4))
        ones = counters[0]
        u = a ^ b
        twos_a = a & b | u & ones
        ones ^= u
        u = c ^ d
        twos_b = c & d | u & ones
        counters[0] = ones ^ u
        u = twos_a ^ twos_b
        carry = twos_a & twos_b | u & counters[1]
        counters[1] ^= u
        for k in range(2, size):
            if not carry:
                break
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        if carry:
            over |= carry
            if over == everyone:
                return 0
    return everyone & ~over


def bit_planes(members: np.ndarray) -> list[int]:
    """The 64 vertical planes of the members, each a whole number with a bit for a member."""
    bits = np.unpackbits(members.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, b].tobytes(), "little") for b in range(64)]


def linked_sets(members: np.ndarray, radius: int = RADIUS, block: int = BLOCK) -> list[list[int]]:
    """Positions of members that links join, directly or not, in sets of two or more."""
    n = len(members)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = [int(x) for x in members]
    varying = [b for b in range(64) if len({v >> b & 1 for v in values}) > 1] if n <= 8 else np.flatnonzero(np.unpackbits((np.bitwise_or.reduce(members) & ~np.bitwise_and.reduce(members)).astype("<u8").reshape(1).view(np.uint8), bitorder="little")).tolist()
    thin = [sum((v >> b & 1) << k for k, b in enumerate(varying)) for v in values]
    for at in range(0, n, block):
        part = members[at : at + block]
        planes_all = bit_planes(part)
        planes, everyone = [planes_all[b] for b in varying], (1 << len(part)) - 1
        for i in range(at + len(part) - 1):  # queries: members before or inside the block
            later = everyone if i < at else everyone & ~((1 << (i - at + 1)) - 1)
            near = within_radius(thin[i], planes, everyone, radius) & later
            while near:
                low = near & -near
                j = at + low.bit_length() - 1
                near ^= low
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    sets: dict[int, list[int]] = {}
    for i in range(n):
        sets.setdefault(root(i), []).append(i)
    return [s for s in sets.values() if len(s) > 1]


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """For each batch of rows sorted by their first column, its buckets of two or more rows of one key;
    the last of a batch may go on and is given with the next."""
    held: list[pa.RecordBatch] = []

    def whole() -> list[pa.RecordBatch]:
        return [held[0] if len(held) == 1 else pa.concat_batches(held)] if sum(h.num_rows for h in held) > 1 else []

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        out = []
        if held and held[0].column(0)[0].as_py() == int(key[0]):
            held.append(b.slice(0, int(cut[1])))
            if len(cut) == 2:
                continue
            cut = cut[1:]
        out += whole()
        inner = np.flatnonzero(np.diff(cut[:-1]) > 1)
        out += [b.slice(int(cut[k]), int(cut[k + 1] - cut[k])) for k in inner.tolist()]
        held = [b.slice(int(cut[-2]))]
        yield out
    if last := whole():
        yield [*last]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: trees that join all classes (column fp, distinct) which links of at most two bits join."""
    if radius > 2:
        raise ValueError("six equal bytes are certain only up to radius 2")
    kept = [~(0xFF << 8 * i | 0xFF << 8 * j) & (1 << 64) - 1 for i, j in combinations(range(8), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    keys = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])
    rows = classes.select("fp", F.inline(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            begin, end = np.r_[0, new], np.r_[new, len(t)]
            for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
                members = np.unique(fp[a:b]).view(np.uint64)
                for found in linked_sets(members, radius):
                    for k in range(1, len(found)):
                        yield int(members[found[k]].view(np.int64)), int(members[found[(k - 1) // FANOUT]].view(np.int64))

        def out(got: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["u", "v"])

        rest: list[np.ndarray] | None = None
        for b in batches:
            got = [b.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            got = got if rest is None else [np.concatenate(x) for x in zip(rest, got, strict=True)]
            last = np.flatnonzero((got[0] != got[0][-1]) | (got[1] != got[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the bucket at the end may go on
            rest = [x[cut:] for x in got]
            yield out(list(edges(*[x[:cut] for x in got])) if cut else [])
        if rest is not None:
            yield out(list(edges(*rest)))

    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "key", "fp")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, c: the least vertex that edges (u, v) join to each vertex. Vertices count as signed longs.

    Each round, a vertex sees the labels of its neighbours, its component takes the least label seen
    by any member (hooking), and labels are replaced by their own labels (shortcutting).
    """
    both = materialize(edges.select("u", "v").union(edges.select("v", "u")).where("u != v").distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "v"), "labels")

    def lookup(rows: DataFrame, on: str, known: DataFrame, key: str, value: str, name: str) -> DataFrame:
        """rows with known's value where rows.on == known.key. Both sides are written tables, so the
        join reads two plain exchanges and the large partition of a popular key is split at run time."""
        return rows.join(known.select(F.col(key).alias("_k"), F.col(value).alias(name)), F.col(on) == F.col("_k"), "left").drop("_k")

    while True:
        seen = both.join(labels, "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(seen, labels["v"] == seen["u"], "left").select("v", "c", F.least("c", F.coalesce("m", "c")).alias("t"))
        step = materialize(step, "seen")
        hooked = materialize(step.groupBy("c").agg(F.min("t").alias("h")), "hooks")
        mid = materialize(lookup(step, "c", hooked, "c", "h", "h").select("v", "c", F.least("t", F.coalesce("h", "t")).alias("d")), "hooked")
        jump = lookup(mid, "d", mid, "v", "d", "e").select("v", "c", F.least("d", F.coalesce("e", "d")).alias("n"))
        jump = materialize(jump, "labels-next")
        moved = jump.where("n != c").limit(1).count()
        new = jump.select("v", F.col("n").alias("c"))
        new._written = jump._written
        for old in (step, hooked, mid, labels):
            discard(old)
        labels = new
        if not moved:
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id, root of every row; component_id is the smallest doc_id reachable,
    root a fingerprint that stands for the component."""
    return components_of(materialize(fingerprints(docs, doc_id, text), "fingerprints"), radius)


def components_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, fp and other columns, written out) with component_id and root."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(links(classes.select("fp"), radius))
    named_all = materialize(labels.join(classes, labels["v"] == classes["fp"]).select("v", "c", "least"), "named")
    best = materialize(named_all.groupBy("c").agg(F.min("least").alias("best")).withColumnRenamed("c", "c2"), "best")
    named = named_all.join(best, F.col("c") == F.col("c2")).select(F.col("v").alias("fp2"), "best", "c")
    full = classes.join(named, classes["fp"] == named["fp2"], "left")
    full = full.select(F.col("fp").alias("fp2"), F.coalesce("best", "least").alias("component_id"), F.coalesce("c", "fp").alias("root"))
    full = materialize(full, "class-components")
    discard(classes, labels, named_all, best)
    return prints.join(full, F.col("fp") == F.col("fp2")).drop("fp2")
