"""Toxicity, collocations and hard negatives: brute force, held-out accuracy, odd rows."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from strandforge.llm import collocations as col
from strandforge.llm import hard_negatives as hard
from strandforge.llm import queries as q
from strandforge.llm import toxicity as tox

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = ", ".join(f"{n} int" for n in "phrase f a l r n score k rank part at bit word most inside left_lang counts groups id v row d label2 anchor kind descending opened entries".split())


def wide(spark, rows, ddl):
    """A frame with further columns of clashing names."""
    n = EXTRA.count(" int")
    return spark.createDataFrame([(*r, *[1] * n) for r in rows], f"{ddl}, {EXTRA}").repartition(3)


# --- 11

PLAIN = "the house was built near a river and people liked to walk there in the evening with their dogs".split()
BAD = "idiot moron stupid worthless loser scum".split()


def labelled(n=600, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = [rng.choice(PLAIN) + rng.choice(["", "", "s", "ing"]) for _ in range(60)]
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(2):
                w[rng.randrange(60)] = rng.choice(BAD)
        rows.append((i, " ".join(w), y))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return docs, labels, tox.train(docs, labels)


def test_entries_are_what_tells(toxic_model):
    assert {e.rstrip("$") for e in toxic_model[2].entries} == set(BAD)


@pytest.mark.parametrize("disguised, word", [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("St-u-pid", "stupid"), ("l0$er", "loser"), ("loooser", "loser"), ("W0RTHLE55", "worthless"),
    ("ïdiöt", "idiot"), ("mоrоn", "moron"), ("ssscccuuummm", "scum"), ("$CUM!!!", "scum"), ("s t u p 1 d", "stupid"), ("(moron)", "moron"),
])
def test_disguises_are_restored(toxic_model, disguised, word):
    model = toxic_model[2]
    assert word in {e.rstrip("$") for e in tox.found_entries(model, f"they walk {disguised} there")}
    assert tox.restore(model, disguised).startswith(word)


@pytest.mark.parametrize("text", ["m or on", "lo se r", "is tupi d", "a m. Oron b", "the 105 er river", "walk i d", "house $$$ people%%% the&&&", "", "x" * 5000, "1 2 3 4 5", "the close rivers"])
def test_clean_texts_stay_clean(toxic_model, text):
    assert not tox.found_entries(toxic_model[2], text)


def test_viterbi_finds_the_best_path(toxic_model):
    logs = toxic_model[2].ready()[1]

    def value(said, p):
        codes, total = [tox.BOUNDARY, tox.BOUNDARY], p
        for c in re.sub(" +", " ", f"{said} ").lstrip(" ") if said.strip() else "":
            codes.append(tox.BOUNDARY if c == " " else tox._CODE.get(c, tox.OTHER))
            total += logs[codes[-3]][codes[-2]][codes[-1]]
        return total

    for token in ["1d10t", "l0$er", "m.0r0n", "t+h3", "r1vér!", "$$tuu", "w-a.l|k", "(a)b"]:
        steps = tox.lattice(token)
        best = max(value("".join(x for x, _ in path), sum(p for _, p in path)) for path in itertools.product(*steps))
        mine = tox.viterbi(steps, logs)
        same = [sum(p for _, p in path) for path in itertools.product(*steps) if "".join(x for x, _ in path) == mine]
        assert math.isclose(value(mine, max(same)), best, abs_tol=1e-4), token


def test_skeletons_leave_no_path_out(toxic_model):
    """All tokens decoded, with or without the skeleton of an entry: the same findings."""
    model, rng = toxic_model[2], random.Random(5)
    automaton, logs, _ = model.ready()
    signs = "abdeilmnoprstuw0134567$@!|.-_ é"
    for _ in range(3000):
        base = rng.choice([*BAD, *PLAIN])
        token = "".join(rng.choice([c, c, c * 2, rng.choice(signs), c + rng.choice(signs)]) for c in base).replace(" ", "")
        words = tox._WORD.findall(tox.viterbi(tox.lattice(token), logs))
        held = {e for e in model.entries for w in words if (w == e[:-1] if e.endswith("$") else w.startswith(e))}
        assert tox.entries_of(model, token) == held, token


def test_long_tokens_are_decoded_around_entries(toxic_model):
    token = "x7" * 40_000 + ".1d10t." + "z9" * 40_000
    assert {e.rstrip("$") for e in tox.found_entries(toxic_model[2], token)} == {"idiot"}


def test_held_out_toxic_texts_are_told(spark, toxic_model):
    docs, labels, model = toxic_model
    got = tox.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 80 and all(r.predicted == r.toxic and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_of_odd_rows(spark, toxic_model):
    model = toxic_model[2]
    rows = [(1, None), (None, "you idiot"), (2, ""), (3, "you 1d10t " * 20_000), (4, "fine"), (4, "fine"), (5, " \n")]
    docs = wide(spark, rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.predicted, r.held_out) for r in tox.score(docs, model).collect()), key=str)
    assert [(d, p) for d, p, _ in got] == sorted([(1, 0), (None, 1), (2, 0), (3, 1), (4, 0), (4, 0), (5, 0)], key=str)
    assert not [h for d, _, h in got if d is None and h]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = tox.train(docs, none)
    assert {r.score for r in tox.score(docs, empty).collect()} == {0.0}
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert {r.score for r in tox.score(docs, tox.train(docs, odd)).collect()} == {0.0}
    assert tox.score(docs.limit(0), model).collect() == [] and tox.train(docs.limit(0), odd).entries == {}


def test_copies_are_one_witness():
    copy = " ".join(f"odd{i} word{i}" for i in range(40))
    rows = [(f"{copy} {i}", 1) for i in range(30)] + [(" ".join(random.Random(i).choices(PLAIN, k=40)), 0) for i in range(100)]
    assert tox.learn(rows, 0.2)[0] == {}


# --- 12


def brute_phrases(rows, least, top, longest=3, inside=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        kept = []
        phrases = [(p, a) for p, a in g.items() if p.count(" ") and a >= least]
        for p, a in phrases:
            w = p.split(" ")
            if any(100 * b >= inside * a and len(x) > len(p) and f" {p} " in f" {x} " for x, b in phrases):
                continue
            score, _, l, r = min((1_000_000 * a * a // (g[" ".join(w[:k])] * g[" ".join(w[k:])]), k, g[" ".join(w[:k])], g[" ".join(w[k:])]) for k in range(1, len(w)))
            kept.append((p, a, l, r, n[lang], score))
        kept.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(kept[:top], 1)]
    return sorted(out)


def prose(rng, n):
    vocabulary = ["Big", "data", "new", "york", "City", "é", "ß", " ", "a", "\x1c", "tb", "x-y", "of", "the"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "?!", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("longest, top", [(3, 2000), (2, 7), (4, 50)])
def test_phrases_equal_brute_force(spark, longest, top):
    rng = random.Random(longest)
    rows = [(prose(rng, rng.randrange(80)), rng.choice(["en", "de", None, "und", ""])) for _ in range(300)] + [(None, "en"), ("", None), ("a a a a a a a a a a a a a a", "fr")]
    docs = wide(spark, rows, "text string, lang string")
    got = sorted(tuple(r) for r in col.collocations(docs, max_words=longest, top=top).collect())
    assert got == brute_phrases(rows, 10, top, longest) and len(got) > 5


def test_blocks_hold_whole_pieces():
    tokens = col.tokens_of(b"One two, three;;four\tfive " * 50)
    parts = list(col.blocks_of(tokens, 16))
    assert sum(parts, []) == tokens and all(p[-1] == b"." for p in parts) and len(parts) > 10
    long = [*[b"w"] * 100, b".", b"x", b"."]
    assert [len(p) for p in col.blocks_of(long, 16)] == [101, 2]
    words, counts, groups = col.block([b"b", b"a", b".", b".", b"b"])
    assert (words, counts.tolist(), groups.tolist()) == ([b"b", b"a"], [2, 1], [0, 1, -1, -1, 0])


def test_small_blocks_and_bitmaps_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(prose(rng, 200), "en") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(col, "blocks_of", lambda tokens, most=32, of=col.blocks_of: of(tokens, most))
    monkeypatch.setattr(col, "bitmap", lambda groups, bits=64, of=col.bitmap: of(groups, bits))  # almost all pass by chance
    assert sorted(tuple(r) for r in col.collocations(docs).collect()) == brute_phrases(rows, 10, 2000)


def test_blocks_are_filled_and_positions_packed(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    docs = spark.createDataFrame([(" ".join(rng.choices(vocabulary, k=20_000)), "en") for _ in range(20)], "text string, lang string").coalesce(1)
    rows = col.words_relation(docs).collect()
    sizes = [len(r.groups) // 4 for r in rows]  # positions, gaps too
    assert sum(sizes) == 20 * 20_001 and sum(r.n for r in rows) == 400_000
    assert len(rows) > 2 and all(x >= col.BLOCK_WORDS for x in sizes[:-1])
    codes = np.frombuffer(rows[0].groups, dtype=np.int32)
    assert np.bincount(codes[codes >= 0]).tolist() == rows[0].counts and codes.min() == -1


def test_bitmap_knows_frequent_phrases_by_language(spark):
    groups = [("en" if i % 2 else "de", f"one {i}é") for i in range(500)]
    bits = col.bitmap(spark.createDataFrame(groups, "lang string, phrase string"))
    phrases = pa.array(["?", *[p for _, p in groups], "!"]).slice(1, 500)
    for name in ("en", "de"):
        assert col.passes(bits, name, phrases).tolist() == [x == name for x, _ in groups]


def test_phrases_of_a_block_are_hashed_together():
    phrases = pa.array([f"some phrase {i}" for i in range(200_000)])
    bits = np.zeros(1 << 10, dtype=np.uint64)

    def least_time(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert least_time(lambda: col.passes(bits, "en", phrases)) < least_time(phrases.to_pylist)


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    frequent = [spark.createDataFrame(rows, "lang string, phrase string, f long") for rows in ([("en", "a", big), ("en", "b", big + 7)], [("en", "a b", big - 1)], [("en", "a b a", 10)])]
    known = {r.phrase: (r.a, r.l, r.r, r.score) for r in col.scored(frequent).collect()}
    assert known["a b"] == (big - 1, big, big + 7, 1_000_000 * (big - 1) ** 2 // (big * (big + 7)))


def test_phrases_of_an_empty_table(spark):
    assert col.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert col.collocations(spark.createDataFrame([(None, None), ("few words here", "en")], "text string, lang string")).collect() == []


# --- 13


def brute_negatives(rows, every=50, positives=5, negatives=3):
    use = {(i, (l + 1) % 10 if i % 7 == 0 else l, tuple(math.floor(256 * Fraction(x)) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, l, v in use:
        if i % every:
            continue
        others = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in use if j != i and len(w) == len(v)]
        others = sorted((o for o in others if abs(o[0]) < 2**63), key=lambda o: (-o[0], o[1]))
        for p, j, _ in [o for o in others if o[2] == l][:positives]:
            inside = [o for o in others if o[2] != l and 50 * p <= 100 * o[0] <= 95 * p][:negatives]
            out += [(i, j, k, o[1], p, o[0]) for k, o in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hard.hard_negatives(df, **options).collect())


def test_hard_negatives_equal_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in q.op13_hard_negatives(spark, sf_dir).collect())
    assert got == brute_negatives(rows) and len(got) > 50


def test_hard_negatives_of_odd_rows_and_small_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 4)) / rng.choice([1, 2, 4]) for _ in range(rng.choice([3, 3, 3, 4]))], rng.randrange(3)) for i in range(1, 200)]  # many ties
    rows += [(200 + i, [1.0, 0.5, 0.25], i % 2) for i in range(150)]  # a third are copies
    rows += [(None, [1.0, 1.0, 1.0], 1), (50, None, 1), (100, [1.0, None, 1.0], 2), (150, [float("nan"), 1.0, 1.0], 2), (400, [math.inf, 1.0, 1.0], 1), (450, [1.0, 1.0, 1.0], None)]
    rows += [(500, [0.0, 0.0, 0.0], 1), (501, [0.0, 0.0, 0.0], 2), (550, [], 1), (551, [], 1), (552, [], 3), (600, [1e300, 1.0, 1.0], 1), (602, [1.5e308, 1.0, 1.0], 1), (601, [1e30, 1.0, 1.0], 1), (650, [3e7, 1.0, 2.0], 1), (651, [3e7, 2.0, 1.0], 1), (652, [2e7, 2.0, 1.0], 2)]
    rows += [rows[0], rows[0]]
    df = wide(spark, rows, "vec_id long, embedding array<double>, label int")
    want = brute_negatives(rows, every=10)
    assert mined(df, every=10, row_block=40, anchor_block=7) == want and len(want) > 100
    assert mined(df, every=10) == want
    assert mined(df.limit(0)) == []


def test_windows_hold_nothing_but_open_windows():
    """One anchor of a million pairs streams through; what comes out is its windows."""
    def batches():
        for down in range(-1_000_000, 0, 50_000):
            n = 50_000
            s = np.arange(down, down + n)
            kind = np.where(s < -999_995, hard.POSITIVE, hard.NEGATIVE).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(s), pa.array(kind), pa.array(-s)], names=["a", "r", "d", "k", "i"])

    out = [r for b in hard.windows(batches()) for r in b.to_pylist()]
    assert [r["rank"] for r in out if r["positive_id"] == 1_000_000] == [0, 1, 2, 3]
    assert [r["negative_score"] for r in out if r["positive_id"] == 1_000_000][1:] == [950_000, 949_999, 949_998]
    assert len(out) == 20


def test_scores_are_exact_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 5.0], [2.0**40, 0.0]])
    assert hard.scores(a, b).tolist() == [[2**40 * (2**20 + 1) + 15, hard._NONE]]
