"""The corpus pipeline against a brute-force version of all its stages."""

import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from test_near_copies import brute_kept
from test_operators import ITEMS, ODD, SPACE, brute_hits, brute_secrets, frame, key, targets_by_rounds

from strandforge.llm import mixing as mix
from strandforge.llm import quality as qual

LABELS = [(i, i % 2, 0) for i in range(10, 60)] + [(1, None, 0), (None, 1, 0), (2, 1, 0)]


def redacted(t):
    spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in brute_secrets(t).split(",") if s))
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += t[at:a] + "[secret]"
        at = max(at, b)
    return out + t[at:] if t else t


def brute_pipeline(rows, model, items):
    """(doc_id, text, source) that reach the mix."""
    scores = qual.score_texts(model, [r["text"] for r in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    ids = brute_kept([(r["doc_id"], r["text"]) for r in rows])
    kept = [r for r in {r["doc_id"]: r for r in rows if r["doc_id"] in ids}.values() if not brute_hits(r["text"], items)[1]]
    return [(r["doc_id"], redacted(r["text"]), r["source"]) for r in kept]


def check(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs, items = read("documents"), [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    want = brute_pipeline(docs.select("doc_id", "text", "source").collect(), qual.train(docs, read("labels")), items)
    size = lambda t: len(SPACE.findall(t or ""))
    sources = Counter()
    for _, t, s in want:
        sources[s] += size(t)
    target = targets_by_rounds(sources)
    got = cp.run(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4)) for r in got), key=key) == sorted(((d, size(t), sources[s], round(target[s], 4)) for d, t, s in want), key=key)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(target.values())) <= max(2 * mix.BLOCK_WORDS * len(target), 0.02 * sum(target.values()))
    return len(docs.collect()), len(got)


def test_pipeline_table(spark, sf_dir):
    before, after = check(spark, sf_dir)
    assert 0 < after < before


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_odd_rows(spark, tmp_path, rows):
    more = [(i, f"plain text number {i} " + ("of good words and sense " if i % 2 else "zzz $$ buy now qq ") * (i % 7 + 1), "en", "ab"[i % 3 % 2], 9) for i in range(10, 60)]
    leaks = [(70, "x Alpha beta, gamma y", "en", "a", 2), (71, "a line with token=abcdefghijklmnop inside", "en", "a", 2)]
    df = frame(spark, ODD + more + leaks)
    (df if rows == "odd" else df.limit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before, after = check(spark, f"file://{tmp_path}")
    assert after < before or rows == "none" and after == 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [len(s) for s in cp.STAGES] == [2] * 5
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = cp.materialize(docs, "stage")
    texts = docs.select("text", "n_chars").collect()
    assert all(r["n_chars"] == len(r["text"]) for r in texts) and any("[secret]" in r["text"] for r in texts)
    assert not any(re.search(r"AKIA[A-Z0-9]{14,}", r["text"]) for r in texts)
