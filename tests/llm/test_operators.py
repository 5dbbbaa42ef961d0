"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandforge.llm import decontaminate as dec
from strandforge.llm import html_text as ht
from strandforge.llm import license_scan as lic
from strandforge.llm import mixing as mix
from strandforge.llm import nearest as nn
from strandforge.llm import personal_data as pii
from strandforge.llm import quality as qual
from strandforge.llm import queries as q
from strandforge.llm import quotes as quo
from strandforge.llm import secrets as sec
from strandforge.llm import simhash as sim

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
ODD = [
    (1, "Released under the MIT License. Released under the MIT license!", "en", "a", 1),
    (2, None, "en", None, 0),
    (3, "", None, "b", 0),
    (4, LONG, "en", "a", 9),
    (None, "CC BY-NC 4.0 and cc by nc", "en", "b", 5),
    (5, "same text here", "en", "c", 1),
    (5, "same text here", "en", "c", 1),
    (6, "Apache License, Version 2.0 İK token=abcdefghijklmnop \U0001f600 é me@x.org", "en", "é", 3),
    (7, "   \n\t ", "en", "", 3),
]
EXTRA = ["doc_id long", "text string", "lang string", "source string", "n_chars long", "words string", "fp string", "size int", "c0 int", "tid int"]
#: Names that operators use on the way.
EXTRA += [f"{n} int" for n in "row rows cls bands key u v c k n root hash text_hash near near_at places diag votes item_id id q bytes h bucket base start block turn own quotes passage source_no target host plan bits part wrapper cell xb qb c1 c2 t th d label score".split()]


def frame(spark, rows=ODD):
    rows = [(*r, "x", "y", *[1] * (len(EXTRA) - 7)) for r in rows]
    return spark.createDataFrame(rows, ", ".join(EXTRA)).repartition(3)


def words(t):
    return WORD.findall((t or "").translate(AZ))


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def docs_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# --- 1


def base_places(t):
    w, out = words(t), []
    for label, phrase in lic.BASE_PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), out


@pytest.mark.parametrize("which", ["odd", "table"])
def test_license_base(spark, sf_dir, which):
    df = frame(spark) if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lic.license_scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    want = []
    for d, t in [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]:
        n, p = base_places(t)
        at = [i for i, _ in p]
        want.append((d, n, len(p), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in p}))))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)
    assert all((r["score"] == 1) >= (r["n_base"] > 0) for r in got)


def test_license_shifted_and_similar(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the Software), to deal in the Software without restriction"
    rows = [
        (1, notice, "en", "a", 1),
        (2, "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", "en", "a", 1),
        (3, "permission to deal in words of any license", "en", "a", 1),
        (4, "This work is licensed under the GNU General Public License, version 3.", "en", "a", 1),
    ]
    got = {r["doc_id"]: r for r in lic.license_scan(frame(spark, rows)).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["mit", "cc-by-nc", "", "gpl-3"]
    assert got[3]["score"] < 0.5 and got[1]["n_base"] == 0


def test_repeated_grams_are_no_license(spark):
    rows = [(1, "the mit license " * 4, "en", "a", 1), (2, "conditions are met " * 22, "en", "a", 1), (3, "the software is the software is provided as is the software is " * 30, "en", "a", 1)]
    got = {r["doc_id"]: r for r in lic.license_scan(frame(spark, rows)).collect()}
    assert all(r["labels"] == "" and r["score"] <= 0.5 for r in got.values())


def test_every_template_with_edited_words(spark):
    """One word replaced, put in or left out in the middle; templates of eight words or more are still found."""
    rows, want = [], {}
    for t, (label, text) in enumerate(lic.TEMPLATES):
        w, m = text.split(), len(text.split()) // 2
        for k, edited in enumerate((w, [*w[:m], "zzz", *w[m + 1 :]], [*w[:m], "zzz", *w[m:]], [*w[:m], *w[m + 1 :]])):
            want[4 * t + k] = label if len(w) >= 8 or not k else None
            rows.append((4 * t + k, "Words before, " + " ".join(edited).upper() + "; words after.", "en", "a", 1))
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in lic.license_scan(frame(spark, rows)).collect()}
    for i, label in want.items():
        others = {x for j, (x, text) in enumerate(lic.TEMPLATES) if j != i // 4 and text in lic.TEMPLATES[i // 4][1]}
        assert (label is None or label in got[i]) and got[i] - {label, ""} <= others | {x for x, _ in lic.BASE_PHRASES}, (i, label, got[i])


def test_real_notices(spark):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \u201cSoftware\u201d), to deal in the Software without restriction", "en", "a", 1),
        (2, "You may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "en", "a", 1),
        (3, "This work is licensed under the Creative Commons Attribution 4.0 International License", "en", "a", 1),
        (4, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "en", "a", 1),
    ]
    got = {r["doc_id"]: r["labels"] for r in lic.license_scan(frame(spark, rows)).collect()}
    assert got == {1: "mit", 2: "apache-2", 3: "cc-by", 4: "cc-by-sa"}


# --- 2


def brute_nearest(ids, x, k, every):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ v
            order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
            out[i] = [b for _, b in order]
    return out


def recall_of(got, want):
    hits = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    return hits / sum(map(len, want.values()))


def test_nearest_table_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    x = np.array([r[1] for r in rows], dtype=float)
    got = defaultdict(list)
    for r in nn.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert recall_of(got, brute_nearest([r[0] for r in rows], x, 20, 20)) >= 0.9


def test_nearest_partitions_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 15)) + rng.normal(size=(12, 15))[rng.integers(12, size=9000)] * 3
    x[100:400] = x[100]  # a group of equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * 15, 0), (9003, [float("nan")] * 15, 0), (9004, [1.0, 2.0], 0), (None, [1.0] * 15, 0), (9005, [None] * 15, 0), (120, x[120].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int")
    got, scores = defaultdict(list), {}
    for r in nn.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
        scores[r["query_id"], r["vec_id"]] = r["score"]
    want = brute_nearest(list(range(9000)), x, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall_of(got, want) >= 0.9
    assert all(abs(s - x[i] @ x[j]) < 1e-9 for (i, j), s in scores.items())
    own = [i for i in got if 100 <= i < 400]
    best = [i for i in own if x[100] @ x[100] >= (x @ x[100]).max()]
    assert all(got[i] == [j for j in range(100, 121) if j != i][:20] for i in best)


def test_nearest_empty(spark):
    assert nn.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_score_aware_code_lowers_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    ix = nn.fit(x, 2000, 10)
    c = ix.centroids[nn.assign(x, ix.centroids)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    error = {}
    for eta in (1.0, ix.eta * 4):
        codes = nn.encode(x, c, ix.books, eta)
        left = (x - c) - np.stack([ix.books[s][codes[:, s]] for s in range(8)], axis=1).reshape(len(x), -1)
        error[eta] = ((unit * left).sum(axis=1) ** 2).mean()
    assert error[ix.eta * 4] < error[1.0]


# --- 3


def test_quote_links_and_order(spark):
    rows = [
        (1, 0, "user", "The first question of all.\nAnother line here"),
        (1, 1, "assistant", "A first answer, at length"),
        (1, 2, "user", "On Monday they wrote:\n> the FIRST question, of all\nBut I ask again"),
        (1, 3, "assistant", "carries on"),
        (1, 4, "user", "> > The first question of all.\n> a first answer at length\nreply to the answer"),
        (1, 5, "user", "> never said before\nnothing linked"),
        (2, 0, "user", "The first question of all."),
        (2, 2000, "user", "> The first question of all.\nfar away"),
        (3, None, "user", None),
        (None, 1, None, "> x"),
        (4, 0, "user", "hello there"), (4, 0, "user", "hello there"), (4, 1, "user", "> hello there\nyes"),
    ]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, path string, own int")
    got = quo.conversations(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 2]["parent_turn"] == 0 and by[1, 2]["text"] == "But I ask again"
    assert by[1, 4]["parent_turn"] == 1 and by[1, 4]["quote_levels"] == 2 and by[1, 4]["n_linked"] == 2
    assert by[1, 5]["parent_turn"] is None and by[1, 5]["text"] == "> never said before\nnothing linked" and by[1, 5]["n_quoted"] == 0
    assert by[2, 2000]["parent_turn"] == 0 and by[2, 2000]["reply_path"] == []
    assert by[4, 1]["parent_turn"] == 0 and by[3, None]["text"] == "" and by[None, 1]["text"] == "> x"
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["reply_path"], r["turn"]))]
    assert order == [0, 1, 4, 5, 2, 3]  # the branch at 1 ends before the one at 0 begins
    assert quo.conversations(df.limit(0)).count() == 0


def test_what_is_no_quote_stays():
    say = lambda text, linked=(): quo.without_quotes(quo.parse(text), set(linked))
    assert say("yes: see\n>>> import os\n>>> os.getcwd()\nprints the folder") == ("", 0)  # nothing goes: the text stays as it is
    assert say("On Monday they\nwrote:\n> gone\n> too\nkept") == ("kept", 2)
    assert say("a\n> x\n> > y\nb", {2}) == ("a\nb", 2)


def brute_links(rows):
    """(conversation, turn) -> (linked passages, parent): every passage looked for in every earlier message."""
    talks = defaultdict(list)
    for c, t, _, text in rows:
        talks[c].append((t, quo.parse(text)))
    out = {}
    for c, said in talks.items():
        own = [(t, [x for v, x in segments if not v]) for t, segments in said]
        for turn, segments in said:
            votes, linked = Counter(), set()
            for k, (level, text) in enumerate(segments):
                words = quo.normal(text)
                if not level or not words or turn is None:
                    continue
                n = min(8, len(words))
                units = [words[i : i + n] for i in sorted({*range(0, len(words) - n + 1, n), len(words) - n})]
                found = Counter()
                for unit in units:
                    have = [t for t, texts in own if t is not None and t < turn and any(has_unit(x, unit) for x in texts)]
                    if have:
                        found[max(have)] += 1
                if found:
                    source = max(found, key=lambda t: (found[t], t))
                    linked.add(k)
                    votes[level, source] += 1
            parent = max(votes, key=lambda x: (-x[0], votes[x], x[1]))[1] if votes else None
            out[c, turn] = (len(linked), parent)
    return out


def has_unit(text, unit):
    if len(unit) == 8:
        words = quo.normal(text)
        return any(words[i : i + 8] == unit for i in range(len(words) - 7))
    parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n"), *[x for p in re.split(r"\n\s*\n", text) for x in re.split(r"(?<=[.!?…。！？])\s*", p)]]
    return any(quo.normal(p) == unit for p in parts)


def test_planted_quotes_against_brute_force(spark):
    """Thousands of messages that quote whole, rewrapped, cut, nested, short and foreign passages."""
    rng = random.Random(6)
    rows = []
    for c in [None, *range(60)]:
        said, n = [], rng.choice([3, 30, 80])
        for t in range(n):
            own = ". ".join(" ".join(f"w{rng.randrange(40 if rng.random() < 0.3 else 4000)}" for _ in range(rng.choice([1, 3, 9, 25]))) for _ in range(rng.randrange(1, 4)))
            own = rng.choice(["Yes.", "No!", "好", own, own, own])
            lines = []
            for _ in range(rng.choice([0, 0, 1, 2])):
                if not said:
                    break
                words = rng.choice([rng.choice(said), rng.choice(said[-3:]), "foreign text that nobody in here has ever said before"]).split()
                if rng.random() < 0.3 and len(words) > 12:
                    words = words[2:-1]
                width, mark = rng.choice([3, 7, 100]), rng.choice(["> ", ">", ">> ", "> > "])
                lines += [mark + " ".join(words[i : i + width]).upper() for i in range(0, len(words), width)]
                lines += rng.choice([[], ["between"]])
            said.append(own)
            rows.append((c, None if t == 0 and rng.random() < 0.1 else t, "user", "\n".join([*lines, own])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quo.conversations(df).collect()
    want = brute_links(rows)
    assert len(rows) > 2000 and len(got) == len(rows)
    assert {(r["conv_id"], r["turn"]): (r["n_linked"], r["parent_turn"]) for r in got} == want
    assert sum(n > 0 for n, _ in want.values()) > 300 and any(len(r["reply_path"]) > 2 for r in got)
    texts = {(c, t): x for c, t, _, x in rows}
    assert all((r["n_quoted"] == 0) == (r["text"] == texts[r["conv_id"], r["turn"]]) and (r["n_linked"] == 0 or r["n_quoted"]) for r in got)


def test_repeated_turns_of_a_large_conversation(spark):
    rows = [(1, t // 3, "user", f"message number {t} has words of its own") for t in range(6000)]
    rows += [(1, 3000 + k, "user", f"> Message number {k * 50} has words\n> of its own\nreply {k}") for k in range(100)] * 2
    got = quo.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).where("turn >= 3000").collect()
    assert len(got) == 200 and all(r["parent_turn"] == (r["turn"] - 3000) * 50 // 3 and r["text"] == f"reply {r['turn'] - 3000}" for r in got)


def test_quotes_keep_plain_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in q.op3_chat_quotes(spark, sf_dir).collect())
    assert got == sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect())


# --- 4


def targets_by_rounds(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if target[s] + weight[s] * share >= 3 * sizes[s]}
        for s in free:
            add = min(weight[s] * share, 3 * sizes[s] - target[s])
            target[s] += add
            left -= add
        free -= full
        if not full:
            break
    return target


@pytest.mark.parametrize("which", ["odd", "table"])
def test_mix(spark, sf_dir, which):
    df = frame(spark) if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = df.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(SPACE.findall(r["text"] or ""))
    want = targets_by_rounds(sizes)
    got = mix.mix_taken(df).collect()
    expected = sorted(((r["doc_id"], len(SPACE.findall(r["text"] or "")), sizes[r["source"]], round(want[r["source"]], 4)) for r in rows), key=key)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4)) for r in got), key=key) == expected
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r["target"], r["source_size"]] += r["taken"]
    for (target, _), n in taken.items():
        same = sum(1 for s in want if abs(want[s] - target) < 1e-6 and sizes[s] == _)
        assert abs(n - target * same) <= max(2 * mix.BLOCK_WORDS * same, 0.02 * target * same)
    again = mix.mix_taken(df).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mixed_blocks_hold_the_texts(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i % 90)), "en", "ab"[i % 2], 1) for i in range(120)]
    df = frame(spark, rows)
    blocks = mix.mixed_blocks(df, block_words=16).collect()
    assert {len(b["text"].split()) for b in blocks} <= set(range(1, 17)) and len({(b["shard"], b["slot"]) for b in blocks}) == len(blocks)
    per_doc = Counter(re.match(r"d(\d+)w", w)[1] for b in blocks for w in b["text"].split())
    taken = {r["doc_id"]: r["taken"] for r in mix.mix_taken(df, block_words=16).collect()}
    assert {int(k): v for k, v in per_doc.items()} == {k: v for k, v in taken.items() if v}


def test_permutations_and_draws():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(mix.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    totals = np.array([1000, 0, 37, 5])
    draws = list(mix.draw_counts(totals, 100))
    assert (sum(draws) == totals).all() and all(d.sum() == 100 for d in draws[:-1])


def test_mix_empty(spark):
    assert mix.mix_taken(frame(spark, [])).count() == 0


# --- 5


def brute_fingerprint(t):
    w = [x.translate(AZ) for x in SPACE.findall(t or "")]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=2):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and root(i) != root(j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_near_duplicates(spark, sf_dir, which):
    df = frame(spark) if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    roots = brute_components([f for _, f in rows])
    least = {}
    for (d, _), c in zip(rows, roots, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = [(d, f, least.get(c)) for (d, f), c in zip(rows, roots, strict=True)]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in sim.near_duplicates(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds[:20]:  # chains and stars of near fingerprints
        at = s
        for _ in range(15):
            at ^= 1 << rng.randrange(64) ^ 0
            at ^= (1 << rng.randrange(64)) if rng.random() < 0.7 else 0
            prints.add(at)
    prints |= {0, (1 << 64) - 1, 1, 3, 7, 1 << 63}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = sim.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    label = {r["v"]: r["c"] for r in sim.components(edges).collect()}
    roots = brute_components(prints)
    groups, found = defaultdict(set), defaultdict(set)
    for p, c in zip(signed, roots, strict=True):
        groups[c].add(p)
        found[label.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


@pytest.mark.parametrize("n,block", [(2, 4096), (7, 4096), (300, 64), (300, 4096)])
def test_bit_sliced_distances(n, block):
    rng = np.random.default_rng(n)
    members = rng.integers(0, 1 << 6, size=n, dtype=np.uint64) << np.uint64(20) | np.uint64(5)
    members = np.unique(members | (rng.integers(0, 1 << 10, size=n, dtype=np.uint64) << np.uint64(50)))
    for radius in (0, 1, 2, 3):
        want = defaultdict(set)
        for i, c in enumerate(brute_components([int(m) for m in members], radius)):
            want[c].add(i)
        got = sim.linked_sets(members, radius, block)
        assert sorted(map(sorted, got)) == sorted(sorted(s) for s in want.values() if len(s) > 1)


# --- 6


def brute_hits(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(10, len(x))
        for a in range(len(x) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == x[a : a + n]:
                    hit.update(range(b, b + n))
                    if item is not None:
                        ids.add(item)
    return len(w), hit, ids


ITEMS = [(1, "Alpha beta gamma"), (2, "one two three four five six seven eight nine ten eleven"), (3, None), (4, "..."), (None, "null item here"), (2, "one two three four five six seven eight nine ten eleven"), (5, "two three four five six seven eight nine ten eleven twelve")]


def test_decontaminate_small(spark):
    texts = ["alpha, BETA; gamma alpha beta gamma", "zero one two three four five six seven eight nine ten eleven twelve x", "alphabeta gamma", None, "", "null-item here alpha", LONG + " alpha beta gamma"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "a", 1), (None, texts[0], "en", "a", 1)]
    bench = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    want = sorted(((r[0], n, len(h), sorted(i)) for r in rows for n, h, i in [brute_hits(r[1], ITEMS)]), key=lambda r: (r[0] is None, r[0]))
    spans = []
    for most in (dec.MAX_BYTES, 40):  # one automaton, and several with a pass each
        found = dec.decontaminate(frame(spark, rows), bench, max_bytes=most).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found), key=lambda r: (r[0] is None, r[0])) == want
        spans.append(sorted((r["doc_id"] or -1, [tuple(s) for s in r["spans"]]) for r in found))
        clean = dec.keep_clean(frame(spark, rows), bench, max_bytes=most)
        assert clean.columns == frame(spark, rows).columns and clean.count() == sum(not w[2] for w in want)
    assert spans[0] == spans[1]
    span = dec.decontaminate(frame(spark, rows[:2]), bench).where("doc_id = 1").first()["spans"]
    assert texts[1][span[0]["start"] : span[0]["end"]] == "one two three four five six seven eight nine ten eleven twelve"
    assert dec.decontaminate(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert dec.decontaminate(frame(spark, []), bench).count() == 0


def test_windows_against_brute_force():
    """Few different words, so that windows repeat, overlap and nearly match everywhere."""
    rng = random.Random(11)
    for _ in range(150):
        say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
        items = [(rng.choice([None, i, i % 5]), say(rng.choice([1, 4, 5, 9, 10, 11, 17, 40]))) for i in range(rng.randrange(1, 7))]
        b = dec.build(items)
        text = " ".join([say(30), rng.choice(items)[1], say(12)])
        found = b.scan(dec.normal_words(text))
        n, hit, ids = brute_hits(text, items)
        assert sum(y - x for x, y in dec.merge(list(found))) == len(hit) and {i for ts in found.values() for t in ts for i in b.ids[t]} == ids


def test_automaton_holds_the_benchmark_once():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(200))) for i in range(300)]
    b = dec.build(items)
    assert len(b.automaton) <= 300 * 200 // 5 and len(b.hashes) == 300 * 191
    assert set(map(tuple, b.scan(dec.normal_words("x " + " ".join(items[7][1].split()[33:45])))))  == {(1, 10), (2, 10), (3, 10)}


# --- 7


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in q.op7_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [(got[d]["predicted"], y) for d, y in labels.items() if got[d]["held_out"]]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) >= 0.93
    assert all(p == 1 for p, y in held if y) or sum(p == 0 for p, y in held if y) / len(held) < 0.03


def area(scores, labels):
    """Under the curve: how often a good text scores above a bad one."""
    good, bad = ([s for s, y in zip(scores, labels, strict=True) if y == q] for q in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_the_difference_carries_the_score(spark):
    """Held-out rows of the larger table, by sizes computed here; without the difference nothing is left."""
    import zstandard

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    model = qual.train(read("documents"), read("labels"))
    rows = read("documents").join(read("labels").where("quality IS NOT NULL"), "doc_id").where(qual.fold(F.col("doc_id")) == 0).select("text", "quality").collect()
    packers = [zstandard.ZstdCompressor(level=qual.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    want = []
    for r in rows:
        t = (r["text"] or "").encode()
        good, bad = (sum(len(p.compress(t[i : i + 256])) for i in range(0, len(t), 256)) for p in packers)
        want.append((bad - good) / (len(t) + 16))
    scores = qual.score_texts(model, [r["text"] for r in rows])
    assert len(rows) > 500
    logit = [model.weights[0] + model.weights[1] * np.clip((d - model.mean) / model.scale, -6, 6) for d in want]
    assert np.allclose(scores, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    labels = [r["quality"] for r in rows]
    assert area(want, labels) >= 0.97 and area(scores, labels) >= 0.97
    assert sum((s >= 0.3) == bool(y) for s, y in zip(scores, labels, strict=True)) / len(labels) >= 0.95


def test_one_long_text_does_not_stop_the_training(spark):
    rows = [(i, "x" * 5000 if i == 1 else f"{'good words of sense' if i % 2 else 'zzz $$ buy'} {i}", "en", "a", 1) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    assert qual.train(frame(spark, rows), labels, max_bytes=4000).weights


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, 0), (5, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark)
    got = qual.score(df, qual.train(df, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    nothing = qual.score(df, qual.train(df, labels.limit(0))).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert qual.score(frame(spark, []), qual.fit([])).count() == 0


def test_quality_learns_from_bounded_rows(spark):
    rows = [(1, f"text {i % 3}", "en", "a", 1) for i in range(300)] + [(4, "b" * 50, "en", "a", 1), (7, None, "en", "a", 1)]
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 0)], "doc_id long, quality int")
    seen = []
    fit, qual.fit = qual.fit, lambda rows: seen.append(sorted(rows)) or fit(rows)
    try:
        qual.train(frame(spark, rows), labels)
        qual.train(frame(spark, rows), labels, max_bytes=20)
        qual.train(frame(spark, rows), labels, max_bytes=-1)
    finally:
        qual.fit = fit
    keep = [r for r in [(1, "text 0", 1), (4, "b" * 50, 0), (7, None, 0)] if zlib.crc32(str(r[0]).encode()) % 5]
    short = [r for r in keep if r[1] is None or len(r[1]) <= 20]
    assert seen[0] == keep and seen[1] == short and seen[2] == []


# --- 8


def test_html_regions(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<aside>side</aside><article><h1>Title &amp; more&nbsp;x</h1><p>One <b>bold\n  word</b><br>next<p>Two &#65;&#x42; &copy 1<div class=ad>buy</div>"
        "<ul><li>a<li>b</ul><form><input>f</form><section id=comments><p>nice!</p></section></article><footer>&copy; us</footer></body></html>"
    )
    assert ht.extract(page) == "Title & more x\nOne bold word next\nTwo AB © 1\na\nb"
    plain = "<html><body><div id=top class=menu><a href=a>x</a></div><div class=content><p>%s</p><p>Second para, with words.</p></div><div class=footer>f</div></body></html>"
    assert ht.extract(plain % ("Long text here. " * 20)) == ("Long text here. " * 20).strip() + "\nSecond para, with words."
    assert ht.extract(None) == ht.extract("") == ht.extract("<script>x") == ""
    assert ht.extract("<article><p>a &lt; b < c</p><p>cut <b") == "a < b < c\ncut"


def test_html_regions_by_class_and_density():
    body = "<p>%s</p><p>Short end.</p>" % ("Long running text. " * 15)
    text = ("Long running text. " * 15).strip() + "\nShort end."
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(20)) + "</ul>"
    assert ht.extract(f"<body><div class='page with-sidebar'><div>{links}</div><div id=c>{body}</div></div></body>") == text
    assert ht.extract(f"<body><div class='page has-sidebar'><main>{body}</main><div class=sidebar><article class=teaser>x</article></div></div></body>") == text
    assert ht.extract(f"<body><main><div class='breadcrumbs'>a b</div><article>{body}</article><div class=comments><article class=comment><p>no</p></article></div></main></body>") == text
    assert ht.extract(f"<body><h1>Title</h1>{body}{links}<div class=related-posts>r</div></body>") == "Title\n" + text
    assert ht.extract(f"<body><div role=main>{body}</div><div role=complementary>{body}</div></body>") == text
    assert ht.extract(f"<body><article><div style='display: none'>h</div><div hidden>h</div>{body}<aside>q</aside><dl><dt>a<dd>b</dl><table><tr><td>1<td>2<tr><td>3</table></article>") == text + "\na\nb\n1\n2\n3"


def test_html_of_any_depth():
    n = 5000
    deep = "<article>" + "<div>a" * n + "<nav><ul><li>menu</ul></nav>t" + "</div>" * n + "<p>end</p></article><p>out"
    assert ht.extract(deep) == "\n".join(["a"] * n + ["t", "end"])
    assert ht.extract("<body>" + "<b>x" * n + "</body>") == "x" * n
    a, b = (ht.shape(x) for x in ("<div>" * n + "x", "<div><p>q</p>" * n + "y"))
    assert ht.extract("<div>" * n + "x", ht.decide(ht.align(a, b))) == "x" and ht.as_regex(ht.align(b, a))


def test_names_do_not_drop_article_text():
    body = "<p>%s</p>" % ("Long running text. " * 15)
    page = f"<body><article><h2 id=legal-basis>Basis</h2>{body}<section id=search-optimization><p>kept</p></section><div class='related-posts'>gone</div></article></body>"
    assert ht.extract(page) == "Basis\n" + ("Long running text. " * 15).strip() + "\nkept"


def wrapper_of(pages):
    w = None
    for p in pages:
        w = ht.shape(p) if w is None else ht.align(w, ht.shape(p))
    return w


def test_template_text_goes_and_copies_stay():
    page = "<body><div><p>Share this page with friends</p><p>%s</p></div></body>"
    texts = [f"text number {i} of its own, long enough to stand for an article" for i in range(3)]
    w = wrapper_of([page % t for t in texts])
    assert ht.extract(page % texts[0], ht.decide(w)) == texts[0] and "#TEXT" in ht.as_regex(w)
    same = wrapper_of([page % texts[0]] * 3)
    assert ht.extract(page % texts[0], ht.decide(same)) == "Share this page with friends\n" + texts[0]


def test_text_of_one_page_is_no_template():
    """What only one page has stands in an optional slot, whose text was never compared."""
    page = "<body><div class=q><p>Share this page with friends</p><p>%s</p>%s</div></body>"
    texts = ["first text of its own, long enough " * 3, "second text of its own, long enough " * 3, "third text, of its own as well, and longer " * 3]
    pages = [page % (t, "<blockquote>only here</blockquote><table><tr><td>cell</table>" if i == 1 else "") for i, t in enumerate(texts)]
    assert ht.extract(pages[1], ht.decide(wrapper_of(pages))) == texts[1].strip() + "\nonly here\ncell"


@pytest.mark.parametrize("seed", range(4))
def test_common_subsequences_are_longest(seed):
    rng = random.Random(seed)
    for _ in range(200):
        a, b = ([rng.choice([None, 1, 2, 3, x]) for _ in range(rng.randrange(40))] for x in (4, 5))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y and x is not None else max(best[i][j + 1], best[i + 1][j])
        got = ht.common_subsequence(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_long_lists_are_aligned_whole():
    page = "<body><ul>" + "".join(f"<li>%s {i}</li>" for i in range(50_000)) + "</ul>"
    a, b = ht.shape(page.replace("%s", "item")), ht.shape(page.replace("%s", "thing"))
    began = time.process_time()
    assert ht.as_regex(ht.align(a, b)) == "(<li>#TEXT)+"
    assert time.process_time() - began < 4  # under a second by itself; other work may share the machine


def test_wrapper_inference(spark):
    page = lambda n, extra="": f"<html><body><div class=x><p>Share this</p>{extra}<p>{'t' + str(n)}</p>" + "".join(f"<li>i{n}{k}</li>" for k in range(n)) + "</div></body></html>"
    text = ht.as_regex(wrapper_of([page(1), page(2), page(3, "<h2>head</h2>"), page(4)]))
    assert text.startswith("<p>#") and "(<h2>#TEXT)?<p>#TEXT(<li>#TEXT)+" in text
    rows = [(i, "http://H.example.com/x", page(1 + i % 4), 1) for i in range(40)] + [(None, None, None, 1), (7, "http://h.example.com/x", page(4), 1), (8, "odd", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = ht.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] is None or r["page_id"] == 8 and r["url"] == "odd"} == {""}
    assert ht.extract_pages(df.limit(0)).count() == 0


def article_blocks(page):
    """The blocks of the article of a page of the test tables, by its tags alone."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inside.replace("<b>", ""))]
    return "\n".join(b for b in blocks if b)


def test_wrappers_find_articles_that_nothing_names(spark):
    """The table's pages with no tag or class that tells: hosts' wrappers give what the tags gave, single pages do not."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    rows = []
    for r in pages:
        page = r["html"].replace('class="ad"', "class=qy")
        for tag, name in (("nav", "qx"), ("article", "qz"), ("footer", "qw")):
            page = page.replace(f"<{tag}>", f"<div class={name}>").replace(f"</{tag}>", "</div>")
        rows.append((r["page_id"], r["url"], page))
    want = {r["page_id"]: article_blocks(r["html"]) for r in pages}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {n: {r["page_id"]: r["text"] for r in ht.extract_pages(df.repartition(n)).collect()} for n in (1, 50)}
    assert got[1] == got[50] == want
    alone = {i: ht.extract(page) for i, _, page in rows}
    assert sum(alone[i] != want[i] for i in want) > 3


def test_pages_give_their_articles(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in q.op8_html_text(spark, sf_dir).collect():
        assert r["text"] == article_blocks(pages[r["page_id"]])


# --- 9


def brute_personal(t):
    t = t or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_against_patterns(spark, sf_dir):
    rng = random.Random(2)
    made = ["".join(rng.choice("ab1@.+- 0()4é9%_") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts = made + [t for _, t in docs_of(spark, sf_dir)] + [r[1] for r in ODD]
    for t in texts:
        assert pii.joined(pii.spans(t), pii.BASE) == brute_personal(t), t
    got = pii.personal_data(frame(spark)).collect()
    assert sorted(r["base"] for r in got) == sorted(brute_personal(r[1]) for r in ODD)
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_account_numbers_behind_cues():
    text = "IBAN number is:" + " " * 500 + "DE89370400440532013000 and iban without one, account GB82WEST12345698765432; IBAN GB82WEST12345698765433"
    assert [text[a:b] for a, b in pii.spans(text)["iban"]] == ["DE89370400440532013000", "GB82WEST12345698765432"]
    began = time.process_time()
    assert pii.spans("iban " * 200_000 + "@" * 200_000 + "+1" * 200_000 + "1." * 200_000)["iban"] == []
    assert time.process_time() - began < 30


def test_personal_extra_kinds():
    f = pii.spans("IBAN: GB82 WEST 1234 5698 7654 32 AND account no: 1234567890, https://bob:pw@host.org/x accountant 1234567")
    text = "IBAN: GB82 WEST 1234 5698 7654 32 AND account no: 1234567890, https://bob:pw@host.org/x accountant 1234567"
    cut = {k: [text[a:b] for a, b in v] for k, v in f.items()}
    assert cut["iban"] == ["GB82 WEST 1234 5698 7654 32"] and cut["account"] == ["1234567890"] and cut["login"] == ["bob:pw@host.org"]


# --- 10


def brute_secrets(t):
    t = t or ""
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.ASCII):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    names = ("assign", "access", "hex")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_against_patterns(spark, sf_dir):
    rng = random.Random(4)
    parts = ["token", "TOKEN", "passWord", "api_key", "apikey", "secret", " = ", ":", "'", '"', "AKIA", "ABCDEF12", "0123456789abcdef", "x", " ", "é", "zzzz", "ſecret"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + [t for _, t in docs_of(spark, sf_dir)] + [r[1] for r in ODD]
    base = [k for k, r in enumerate(sec.RULES) if r.base]
    for at in range(0, len(texts), 256):
        for t, f in zip(texts[at : at + 256], sec.scan_block(texts[at : at + 256]), strict=True):
            assert ",".join(f"{sec.RULES[k].kind}:{a}:{b}" for a, k, b in f if k in base) == brute_secrets(t), t
    got = sec.secrets(frame(spark)).collect()
    assert sorted(r["base"] for r in got) == sorted(brute_secrets(r[1]) for r in ODD)
    assert sec.secrets(frame(spark, [])).count() == 0


def test_long_texts_of_tokens_are_read_once():
    began = time.process_time()
    assert sec.scan_block(["eyJ" * 300_000, "eyJabcdefgh.eyJabcdefgh.abcdefgh-_1 eyJx.eyJabcdefgh.abcdefghij"])[1] == [(0, 7, 35)]
    assert sec.scan_block(["-----BEGIN PRIVATE KEY-----\n" * 20_000, "token" * 100_000])[1] == []
    assert time.process_time() - began < 10


def test_trigram_queries():
    assert sec.trigram_query(r"AKIA[A-Z0-9]+") == ("and", b"aki", b"kia")
    assert sec.trigram_query(r"[0-9a-f]{16,}") is True and sec.trigram_query(r"(abc)?x*") is True
    assert sec.trigram_query(r"abc|xyz\d+") == ("or", b"abc", b"xyz")
    rng = random.Random(1)
    for pattern in (sec.RULES[0].pattern, r"ab?c(de|fg)+h", r"x(yz|zy)?w{2}", r"(a|b)cd[ef]g"):
        query = sec.trigram_query(pattern)
        texts = ["".join(rng.choice("abcdefghwxyz") for _ in range(12)) for _ in range(2000)] + ["token: abcdefghijklmnop"]
        index = sec.TrigramIndex([t.encode() for t in texts], sorted(sec.trigrams(query)))
        held = set(index.candidates(query).tolist())
        assert {i for i, t in enumerate(texts) if re.search(pattern, t)} <= held


def test_redact():
    assert sec.redact("ab token=abcdefghijkl z", [(3, 0, 21), (9, 2, 20)]) == "ab [secret] z"


def test_digest_columns(spark, sf_dir):
    r = q.op9_personal_data(spark, sf_dir).limit(1).first()
    t = dict(docs_of(spark, sf_dir))[r["doc_id"]]
    assert r["base_sha256"] == hashlib.sha256(brute_personal(t).encode()).hexdigest()
    assert q.op5_simhash(spark, sf_dir).where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0


@pytest.mark.parametrize("kind", ["queries apart", "few long", "equal scores"])
def test_nearest_where_the_sample_tells_little(spark, monkeypatch, kind):
    """Queries unlike the rows, rows too rare for the sample, many different vectors of one score."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 16))
    if kind == "queries apart":
        x[:, 0] *= np.where(np.arange(6000) % 20 == 0, 0, 1000)
    elif kind == "few long":
        x[rng.choice(6000, 30, replace=False)] *= 50
    else:
        x = rng.integers(0, 2, (6000, 16)).astype(float)
        x[0, 0] = 1
    monkeypatch.setattr(nn, "SAMPLE", 1000)
    monkeypatch.setattr(nn, "CELL_TARGET", 200)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    used = [i for i in range(6000) if x[i].any()]
    scores = x @ x.T if kind != "equal scores" else np.rint(x @ x.T)
    for i in range(0, 6000, 20):
        if i in used:
            assert got[i] == sorted((j for j in used if j != i), key=lambda j: (-scores[i, j], j))[:20]
