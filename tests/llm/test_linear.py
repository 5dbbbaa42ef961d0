"""Work on one long text or page grows with its length, and no bucket or hub is one task."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge.llm import decontaminate as dec
from strandforge.llm import html_text as ht
from strandforge.llm import near_copies as near
from strandforge.llm import quotes as quo

SECONDS = 6  # on a machine that may be busy; quadratic work takes minutes


def took(f):
    began = time.process_time()
    out = f()
    assert time.process_time() - began < SECONDS
    return out


def test_a_long_message_of_interleaved_quotes():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    said = [" ".join(word() for _ in range(12)) for _ in range(9500)]
    original = "\n\n".join(said)
    reply = "\n".join(f"> {s}\nmy answer {i} {word()}" for i, s in enumerate(said))
    assert len(reply) > 800_000

    def linked():
        own = quo.own_hashes([t for v, t in quo.parse(original) if not v])
        return [all(h in own for h in quo.passage_hashes(t)) for v, t in quo.parse(reply) if v]

    assert took(linked) == [True] * len(said)


def test_quoting_messages_link_without_joining_texts(spark):
    rng = random.Random(4)
    said = [" ".join(f"w{rng.randrange(900)}" for _ in range(10)) for _ in range(400)]
    rows = [(1, 0, "a", "\n\n".join(said)), (1, 1, "b", "\n".join(f"> {s}\nyes {i}" for i, s in enumerate(said)))]
    rows += [(1, 2 + k, "c", f"> {said[k]}\nno") for k in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quo.conversations(df).collect()}
    assert got[1].n_linked == 400 and got[1].parent_turn == 0 and "w" not in got[1].text
    assert all(got[2 + k].parent_turn == 0 and got[2 + k].text == "no" for k in range(50))


def test_an_item_of_equal_words():
    items = [(1, "a " * 5000), (2, "a " * 5000 + "b"), *[(3 + i, "shared words that stand in each of these many items here and there") for i in range(3000)]]
    b = took(lambda: dec.build(items))
    words = dec.normal_words("a " * 20_000 + "shared words that stand in each of these many items here and there " * 200)
    found = took(lambda: b.scan(words))
    assert sum(y - x for x, y in dec.merge(list(found))) == len(words)
    assert {i for t in found.values() for x in t for i in b.ids[x]} == {i for i, _ in items}
    assert b.windows_at(dec.normal_words("a a a a a a a a a b"), 0) and b.ids[b.windows_at(dec.normal_words("a a a a a a a a a b"), 0)[0]] == [2]


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "<h1>x</h1>" * 100_000, "<p>" + "<b>" * 100_000 + "</table>y" * 100_000, "<div>" * 100_000 + "</i>z" * 100_000, "<li>" + "<i>" * 50_000 + "<li>" * 50_000])
def test_open_tags_and_stray_ends(page):
    root = took(lambda: ht.parse(page))
    assert root.children


def walked(source):
    """The stack of a page's open elements as a walk from its end finds them."""
    return [b.text for b in ht.blocks_of(ht.parse(source))[0]]


def test_mended_pages_as_before():
    assert walked("<p>a<p>b<div>c</p>d</div>e") == ["a", "b", "cd", "e"]
    assert walked("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert walked("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert walked("<div>a</b>b</span></div>c") == ["ab", "c"]
    assert walked("<b>x<div>y</b>z</div>w") == ["x", "yz", "w"]


def test_large_buckets_are_cut_and_every_pair_meets(spark):
    rows = spark.range(300).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("cls")).union(spark.range(20).select(F.lit(8).cast("long"), F.col("id")))
    cut = near.bounded_buckets(rows, 64).collect()
    buckets = {}
    for r in cut:
        buckets.setdefault(r.key, set()).add(r.cls)
    assert max(map(len, buckets.values())) <= 100 and len(buckets) > 40
    pairs = {(a, b) for k, m in buckets.items() for a in m for b in m if a < b and k != 8}
    assert len(pairs) == 300 * 299 // 2 and buckets[8] == set(range(20))


@pytest.mark.parametrize("most, hub", [(16, 4), (near.BUCKET, near.HUB)])
def test_bounds_change_no_component(spark, monkeypatch, most, hub):
    """A large star of copies and many unlike texts that share a beginning."""
    monkeypatch.setattr(near, "_edges", lambda rows, find, most_=most, of=near._edges: of(rows, find, most_))
    monkeypatch.setattr(near, "_verified", lambda *a, hub_=hub, of=near._verified: of(*a, hub=hub_))
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"new{i}"
        texts.append(" ".join(w))
    head = " ".join(f"h{i}" for i in range(60))
    texts += [head + " " + " ".join(f"u{i}x{k}" for k in range(60)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near.one_of_each(docs).collect()) == [0, *range(60, 120)]


def test_similarity_is_exact():
    sets = [np.arange(a, b, dtype=np.uint64).tobytes() for a, b in ((0, 100), (0, 80), (0, 79), (10, 110), (0, 0))]
    assert near.similar(sets[0], sets[1], 0.8) and not near.similar(sets[0], sets[2], 0.8) and near.similar(sets[0], sets[3], 0.8) and near.similar(sets[4], sets[4], 0.8)
