"""Pages that need their host's wrapper: nothing in them tells the article from the rest."""

import random

import pytest

from strandforge.llm import html_text as ht
from strandforge.llm import quality as qual

WORDS = "river stone window paper morning garden winter market letter bridge yellow silver quiet early under between their other little after never always people house water light night music story table".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def host_pages(rng, host, n):
    """Pages of one host: two templates, a notice that is longer than most articles, a repeated group of teasers and a
    signature, all in neutral elements."""
    notice = [prose(rng, 90) for _ in range(3)]  # the same on every page
    about, foot = prose(rng, 60), prose(rng, 40)
    pages = []
    for i in range(n):
        article = [prose(rng, rng.randrange(25, 60)) for _ in range(rng.randrange(1, 5))]
        teasers = "".join(f'<div class="k{k % 2}"><a href="/x">{prose(rng, 5)}</a></div>' for k in range(rng.randrange(2, 6)))
        head = "".join(f'<div class="b">{x}</div>' for x in notice)
        text = "".join(f'<div class="t">{x}</div>' for x in article)
        if i % 3:
            body = f'<div class="n">{head}</div><div class="w"><div class="m">{text}</div><div class="r">{teasers}</div></div><div class="z"><div class="q">{about}</div><div class="q2">{foot}</div></div>'
        else:
            body = f'<div class="w"><div class="r">{teasers}</div><div class="m">{text}</div></div><div class="n">{head}</div><div class="z"><div class="q">{about}</div></div>'
        pages.append((f"http://{host}/{i}", f"<html><body>{body}</body></html>", "\n".join(article)))
    return pages


def test_wrappers_find_what_single_pages_do_not(spark):
    rng = random.Random(8)
    pages = [p for h in range(10) for p in host_pages(rng, f"h{h}.example", 100)]
    alone = sum(ht.extract(html) == article for _, html, article in pages)
    assert alone < len(pages) / 2
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ht.extract_pages(df).collect()}
    right = sum(got[i] == article for i, (_, _, article) in enumerate(pages))
    assert right >= 0.98 * len(pages), (right, alone)


def brute_alignment(a, b):
    """A longest common subsequence by the table of all prefixes."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y and x is not None else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("seed", range(20))
def test_alignment_is_as_long_as_brute_force(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice([None, 1, 2, 3, 4, 5, 6]) for _ in range(rng.randrange(60))] for _ in range(2))
    pairs = ht.common_subsequence(a, b)
    assert len(pairs) == brute_alignment(a, b) and all(a[i] == b[j] is not None for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_quality_is_recomputed_from_sizes():
    """Sizes by a compressor of each piece, and the calibration as the minimum of its loss."""
    import numpy as np
    import zstandard

    rng = random.Random(6)
    good = [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(120)]
    bad = ["".join(rng.choice("#$%&*!~^ qxz") for _ in range(400)) + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) for _ in range(120)]
    rows = [(i, t, int(i % 2 == 0)) for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    model = qual.fit(rows)

    def size(text, dictionary):
        c = zstandard.ZstdCompressor(level=qual.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = text.encode()
        return sum(len(c.compress(raw[i : i + qual.PIECE])) for i in range(0, len(raw), qual.PIECE))

    x = {i: (size(t, model.bad) - size(t, model.good)) / (len(t.encode()) + 16) for i, t, _ in rows}
    z = {i: np.clip((v - model.mean) / model.scale, -6, 6) for i, v in x.items()}
    want = [1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * z[i]))) for i, _, _ in rows]
    assert np.allclose(qual.score_texts(model, [t for _, t, _ in rows]), want, atol=1e-9)
    half = [(z[i], y) for i, t, y in rows if qual.zlib.crc32(b"half:%d" % i) % 2]
    zs, ys = np.array([v for v, _ in half]), np.array([y for _, y in half])
    assert abs(zs.mean()) < 0.2

    def loss(w0, w1):
        s = w0 + w1 * zs
        return float(np.logaddexp(0, (1 - 2 * ys) * s).sum() + 1e-2 * (w0 * w0 + w1 * w1) / 2)

    best = loss(*model.weights)
    assert all(best <= loss(model.weights[0] + a, model.weights[1] + b) + 1e-6 for a in (-0.05, 0, 0.05) for b in (-0.05, 0, 0.05))
