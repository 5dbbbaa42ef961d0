"""The pipeline's near-dedup against brute-force Jaccard of 5-word shingles."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest
from test_operators import AZ, ODD, SPACE, frame

from strandforge.llm import near_copies as near


def brute_set(t):
    w = [x.translate(AZ) for x in SPACE.findall(t or "")]
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """The least (doc_id, text) of each group that pairs with a similarity of 0.8 or more join."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        first.setdefault(root(i), rows[i][0])
    return sorted(first.values(), key=lambda d: (d is None, d or 0))


def check(spark, df, sf_dir, spare=0):
    """All that brute force keeps is kept; of the others at most ``spare`` stay, as links close to 0.8 may be lost."""
    got = cp.keep_one_of_near_duplicates(spark, df, sf_dir).collect()
    ids = sorted((r["doc_id"] for r in got), key=lambda d: (d is None, d or 0))
    want = brute_kept([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert len(set(ids)) == len(ids) and set(want) <= set(ids) and len(ids) - len(want) <= spare


@pytest.mark.parametrize("which", ["table", "odd", "none"])
def test_stage_on_tables(spark, sf_dir, which):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet") if which == "table" else frame(spark, ODD if which == "odd" else [])
    check(spark, df, sf_dir)


def test_stage_finds_edited_copies(spark, sf_dir):
    """Copies at all similarities around 0.8, chains of them, and passages that many texts share."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(60)]
    texts = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([5, 8, 30, 120, 400]))] + common * (g % 3)
        texts.append(base)
        for k in range(6):
            new = list(base if k % 2 else texts[-1])
            for _ in range(rng.randrange(1, max(2, len(new) // 30))):
                new[rng.randrange(len(new))] = word()
            texts.append(new)
    group = [word() for _ in range(200)]
    for _ in range(60):  # one large group
        new = list(group)
        new[rng.randrange(200)] = word()
        texts.append(new)
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    df = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    assert len(brute_kept([r[:2] for r in rows])) < len(rows) - 100
    check(spark, df, sf_dir, spare=15)


def test_nearly_all_links_are_found():
    """Of pairs of a similarity of 0.8 and more, how many meet in a bucket and stay within the radius."""
    rng, found, n = random.Random(4), 0, 0
    for _ in range(400):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 120, 400]))]
        b = list(a)
        for _ in range(rng.randrange(1, 1 + len(a) // 40)):
            b[rng.randrange(len(b))] = "new"
        x, y = near.shingle_set(" ".join(a)), near.shingle_set(" ".join(b))
        common = len(set(x.tolist()) & set(y.tolist()))
        if common >= 0.8 * (len(x) + len(y) - common):
            n += 1
            apart = int.from_bytes(near.wide_fingerprint(x), "little") ^ int.from_bytes(near.wide_fingerprint(y), "little")
            found += bool(set(near.band_keys(x)) & set(near.band_keys(y))) and apart.bit_count() <= near.RADIUS
    assert n > 150 and found >= 0.99 * n


@pytest.mark.parametrize("m", [5, 24, 25, 300, 9000])
def test_trees_join_what_the_radius_joins(m):
    rng = random.Random(m)
    seeds = [rng.getrandbits(256) for _ in range(4)]
    prints = []
    for _ in range(m):
        x = seeds[rng.randrange(4)]
        for _ in range(rng.randrange(40)):
            x ^= 1 << rng.randrange(256)
        prints.append(x.to_bytes(32, "little"))
    group = {i: i for i in range(m)}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    edges = near.tree_edges(prints)
    for i, j in edges:
        assert (int.from_bytes(prints[i], "little") ^ int.from_bytes(prints[j], "little")).bit_count() <= near.RADIUS
        assert root(i) != root(j)  # trees: at most m - 1 edges whatever links there are
        group[root(i)] = root(j)
    if m <= 300:
        numbers = [int.from_bytes(p, "little") for p in prints]
        assert all(root(i) == root(j) for i in range(m) for j in range(i) if (numbers[i] ^ numbers[j]).bit_count() <= near.RADIUS)
    of = np.array([root(i) % 2 for i in range(m)])
    assert all(of[i] != of[j] for i, j in near.nearest_edges(prints, of))


def test_columns_of_any_name_stay(spark, sf_dir):
    names = ["doc_id", "text", "_text_hash", "row", "cls", "rows", "root", "key", "fp", "u", "v", "c", "k"]
    rows = [(i, " ".join(f"w{j}" for j in range(30 + i % 2)), *[777 + i] * (len(names) - 2)) for i in range(4)] + [(3, "other text of this id", *[1] * (len(names) - 2))]
    df = spark.createDataFrame(rows + rows[:1], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    got = near.one_of_each(df)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted([rows[0], rows[4]])
