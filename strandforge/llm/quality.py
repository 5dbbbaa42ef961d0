"""Quality by compression: zstandard dictionaries of good and bad text.

Labelled texts (a bounded sample, MAX_TRAIN rows at most) are halved by a hash of their id: one half
trains a dictionary from good and one from bad texts, the other calibrates. All of a text is
compressed with either dictionary, in pieces of PIECE bytes, so that what a text shares with a dictionary
counts from its first to its last byte and not only until the text has become its own dictionary. The
difference of the two sizes, divided by the length of the text, is the only input of a logistic
calibration to a score from 0 to 1.

Label, language, source and id are never inputs of a score. Defined results: null text is the empty
text; a null doc_id is not held out and never trained on; null labels are left out and of several
labels of one id the mean counts; repeated rows are scored each; without both classes of labels every score is the share of
good labels (0.5 without any); other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import change_rows, discard, map_rows, materialize

#: Labelled ids to learn from, at most, and the largest total of their texts in bytes; the driver gets no more.
MAX_TRAIN = 4_000
MAX_TRAIN_BYTES = 64 << 20
DICT_BYTES = 110_000
LEVEL = 3
#: Bytes compressed at once.
PIECE = 256
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: float
    scale: float
    weights: tuple[float, ...]  # of a constant and the difference; empty: always prior
    prior: float


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five (null: null)."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their own bytes serve
        return b"\n".join(texts)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)


def compressed_size(text: bytes, compressor: zstandard.ZstdCompressor) -> int:
    """Bytes that all pieces of the text take."""
    return sum([len(compressor.compress(text[i : i + PIECE])) for i in range(0, len(text), PIECE)])


def difference(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """How many bytes a byte of each text takes less with the good dictionary than with the bad one (about 0 for empty texts)."""
    return np.array([(compressed_size(t, bad) - compressed_size(t, good)) / (len(t) + 16) for t in texts])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 100) -> np.ndarray:
    x = np.stack([np.ones(len(x)), x], axis=1)
    w = np.zeros(x.shape[1])
    loss = lambda w: float(np.logaddexp(0, (1 - 2 * y) * (x @ w)).sum() + penalty * (w @ w) / 2)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-9 * max(1.0, now):
            break
        w, now = w - size * step, new
    return w


def fit(rows: list[tuple[int, str | None, int]]) -> Model:
    """From (doc_id, text, label 0 or 1)."""
    labels = [r[2] for r in rows]
    prior = sum(labels) / len(labels) if labels else 0.5
    half = [zlib.crc32(b"half:%d" % r[0]) % 2 for r in rows]
    texts = [(r[1] or "").encode("utf-8", "surrogatepass") for r in rows]
    pick = lambda h, q: [t for t, k, x in zip(texts, half, labels, strict=True) if k == h and x == q and t]
    nothing = Model(b"", b"", 0.0, 1.0, (), prior)
    if not all(pick(h, q) for h in (0, 1) for q in (0, 1)):
        return nothing
    good, bad = (_dictionary(pick(0, q), DICT_BYTES) for q in (1, 0))
    x = difference([t for t, h in zip(texts, half, strict=True) if h], _compressor(good), _compressor(bad))
    y = np.array([q for q, h in zip(labels, half, strict=True) if h], dtype=float)
    mean, scale = float(x.mean()), max(float(x.std()), 1e-6)
    w = _logistic((x - mean) / scale, y)
    return Model(good, bad, mean, scale, tuple(w.tolist()), prior)


def score_texts(model: Model, texts: list[str | None], compressors: tuple | None = None) -> list[float]:
    if not model.weights or not texts:
        return [model.prior] * len(texts)
    good, bad = compressors or (_compressor(model.good), _compressor(model.bad))
    x = difference([(t or "").encode("utf-8", "surrogatepass") for t in texts], good, bad)
    z = np.clip((x - model.mean) / model.scale, -6, 6) * model.weights[1] + model.weights[0]
    return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from at most max_train labelled ids outside the held-out fold, taken in the order of a hash
    of their id, those whose texts fit into what is left of max_bytes; of several texts of an id the smallest counts."""
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).alias("q")).where(F.col("q").isNotNull() & (fold(F.col("id")) != 0))
    known = known.groupBy("id").agg((F.avg("q") >= 0.5).cast("int").alias("q"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_train)  # so few that they can be broadcast
    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    found = materialize(found.groupBy("id", "q").agg(F.min("text").alias("text")), "quality-train")  # one text an id
    sizes = found.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).collect()
    fits, held = [], 0
    for r in sorted(sizes, key=lambda r: (zlib.crc32(b"%d" % r["id"]), r["id"])):
        if held + r["bytes"] <= max_bytes:  # a text that does not fit is left out, and the next one is looked at
            held += r["bytes"]
            fits.append(r["id"])
    rows = found.where(F.col("id").isin(fits)).select("id", "text", "q").collect() if fits else []
    discard(found)
    return fit([tuple(r) for r in sorted(rows, key=lambda r: (zlib.crc32(b"%d" % r["id"]), r["id"]))])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    cache: list = []

    def run(cols: list[list]) -> list[list]:
        if not cache and model.weights:
            cache.append((_compressor(model.good), _compressor(model.bad)))
        s = score_texts(model, cols[1], cache[0] if cache else None)
        return [cols[0], s]

    scored = map_rows(docs, [F.col(doc_id).cast("long"), F.col(text)], "doc_id long, score double", run)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    cache: list = []

    def run(texts: list) -> tuple[list[bool], dict[str, list]]:
        if not cache and model.weights:
            cache.append((_compressor(model.good), _compressor(model.bad)))
        return [s >= threshold for s in score_texts(model, texts, cache[0] if cache else None)], {}

    return change_rows(docs, text, run)
