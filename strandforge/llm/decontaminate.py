"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased, split at ASCII punctuation and space). A window is
ten consecutive words of a benchmark item, or all words of a shorter one. The automaton does not hold
the windows, which would be the benchmark ten times over, but the items cut into blocks of five words,
every word a single character: each window has a whole block of its item in it. One scan over a
document finds the blocks; the six windows around a hit are looked up in a sorted table of window
hashes, and what is found there is compared word by word. Word and character offsets are mapped back
to the original text.

The benchmark is broadcast if its texts have at most MAX_BYTES, which takes some tens of times as much
memory in a worker. A larger one is cut into parts by hashes of its texts, with an automaton and a pass over the
documents for each part: memory keeps its bound, and the result is the same. A Python worker builds an
automaton once.

Defined results: null text has no words; null item texts and items without words have no window;
items without an id still hit words but are not counted; repeated items count once; repeated
documents each have their row; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import WORD_BYTES, change_rows, map_rows, materialize

WINDOW = 10
#: Texts of a benchmark that one automaton may hold, in bytes.
MAX_BYTES = 24 << 20
#: Words of the original text, A-Z still in place.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters that stand for words: of the planes above the first, which have no surrogates.
_FIRST, _CODES = 0x10000, 0x100000
_OTHER = " "
_known: dict[str, Benchmark] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Benchmark:
    """The items of a benchmark, ready to be looked for."""

    window: int
    ids: list[list[int]]  # of each different text
    words: list[list[bytes]]
    codes: dict[bytes, str]
    automaton: ahocorasick.Automaton
    hashes: np.ndarray  # of different windows, ascending
    where: np.ndarray  # a text and a word where each stands, in the same order
    begins: np.ndarray  # where the texts of each begin in holders, and where those of the last end
    holders: np.ndarray  # texts
    known: dict[int, tuple[int, ...]] = field(default_factory=dict)

    def windows_at(self, words: list[bytes], first: int) -> tuple[int, ...]:
        """Texts that have the document's window at this word; one object for each different window."""
        if first < 0 or first + self.window > len(words):
            return ()
        part = words[first : first + self.window]
        h = np.uint64(xxhash.xxh64_intdigest(b" ".join(part)))
        k = int(np.searchsorted(self.hashes, h))
        while k < len(self.hashes) and self.hashes[k] == h:  # different windows of one hash stand in a row
            t, at = self.where[k].tolist()
            if self.words[t][at : at + self.window] == part:
                if k not in self.known:
                    self.known[k] = tuple(self.holders[self.begins[k] : self.begins[k + 1]].tolist())
                return self.known[k]
            k += 1
        return ()

    def scan(self, words: list[bytes]) -> dict[tuple[int, int], tuple[int, ...]]:
        """(first word, words) of every window that stands in the document, with its texts."""
        found: dict[tuple[int, int], tuple[int, ...]] = {}
        if not len(self.automaton):
            return found
        get = self.codes.get
        text = "".join([get(w, _OTHER) for w in words])
        tried: set[int] = set()
        for last, (n, short) in self.automaton.iter(text):
            first = last - n + 1
            if short and (whole := tuple(t for t in short if words[first : last + 1] == self.words[t])):  # items of fewer words than a window
                found[first, n] = whole
            if n == self.window // 2:
                for at in range(last + 1 - self.window, first + 1):
                    if at not in tried:
                        tried.add(at)
                        if texts := self.windows_at(words, at):
                            found[at, self.window] = texts
        return found


def build(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> Benchmark:
    """window: an even number of words."""
    texts: dict[tuple[bytes, ...], set[int]] = {}
    names: dict[bytes, bytes] = {}  # one object a word
    for item, text in items:
        if words := normal_words(text):
            texts.setdefault(tuple(names.setdefault(w, w) for w in words), set()).update(() if item is None else (item,))
    all_words = [list(t) for t in texts]
    codes = {w: chr(_FIRST + i % _CODES) for i, w in enumerate(names)}
    half, blocks = window // 2, {}
    hashes, where = [], []
    for t, words in enumerate(all_words):
        text = "".join([codes[w] for w in words])
        if len(words) < window:
            blocks.setdefault(text, []).append(t)
            continue
        for at in range(0, len(words) - half + 1, half):
            blocks.setdefault(text[at : at + half], [])
        for at in range(len(words) - window + 1):
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words[at : at + window])))
            where.append((t, at))
    automaton = ahocorasick.Automaton()
    for block, short in blocks.items():
        automaton.add_word(block, (len(block), short))
    automaton.make_automaton()
    return Benchmark(window, [sorted(i) for i in texts.values()], all_words, codes, automaton, *_windows(hashes, where, all_words, window))


def _windows(hashes: list[int], where: list[tuple[int, int]], words: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and a place of each different window, and which texts hold it, each text once."""
    h, w = np.array(hashes, dtype=np.uint64), np.array(where, dtype=np.int32).reshape(-1, 2)
    order = np.lexsort((w[:, 1], w[:, 0], h))
    h, w = h[order], w[order]
    same_hash = np.r_[False, h[1:] == h[:-1]][: len(h)]
    first: list[int] = []  # positions of the different windows
    holders: list[list[int]] = []
    run: dict[tuple[bytes, ...], int] = {}
    for k, (again, (t, at)) in enumerate(zip(same_hash.tolist(), w.tolist(), strict=True)):
        if not again:
            run = {}
            if k + 1 == len(h) or not same_hash[k + 1]:  # the usual case: nothing else has its hash
                first.append(k)
                holders.append([t])
                continue
        part = tuple(words[t][at : at + window])
        if part not in run:
            run[part] = len(first)
            first.append(k)
            holders.append([t])
        elif holders[run[part]][-1] != t:
            holders[run[part]].append(t)
    begins = np.cumsum([0, *map(len, holders)])
    at = np.array(first, dtype=np.int64)
    return h[at], w[at], begins, np.array([t for texts in holders for t in texts], dtype=np.int32)


def merge(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Joins touching or overlapping (first word, words) into (first word, end word)."""
    out: list[list[int]] = []
    for first, n in sorted(set(places)):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + n)
        else:
            out.append([first, first + n])
    return [(a, b) for a, b in out]


def shared_parts(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES):
    """For each part of the benchmark, one at a time, a broadcast of its items under a name of its own."""
    if window % 2:
        raise ValueError("a window has an even number of words")
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // max_bytes))
    for part in range(parts):
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64(F.coalesce("t", F.lit(""))), F.lit(parts)) == part)
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, window, [tuple(r) for r in rows.toLocalIterator()]))


def _ready(shared) -> Benchmark:
    """Built once in a Python worker, which keeps the latest one."""
    name, window, items = shared.value
    if name not in _known:
        _known.clear()
        _known[name] = build(items, window)
    return _known[name]


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (array<long>), spans (array of start, end in characters of the original)."""
    schema = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:int,end:int>>, row string, places array<struct<first:int,n:int>>"

    def scanned(shared, places_only: bool) -> DataFrame:
        def run(cols: list[list]) -> list[list]:
            b = _ready(shared)
            out: list[list] = [[] for _ in range(7)]
            for d, t, key in zip(*cols, strict=True):
                words = normal_words(t)
                found = b.scan(words)
                texts = {id(t): t for t in found.values()}.values()  # the same window has the same object
                ids = sorted({i for t in texts for x in t for i in b.ids[x]})
                hit, spans = _spans(t, found)
                places = [{"first": a, "n": n} for a, n in found] if places_only else None
                for column, value in zip(out, (d, len(words), hit, ids, spans, key if places_only else None, places), strict=True):
                    column.append(value)
            return out

        key = F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(F.col(text)).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        return map_rows(docs, [F.col(doc_id).cast("long"), F.col(text), key if places_only else F.lit(None).cast("string")], schema, run)

    parts = list(shared_parts(benchmark, **options))
    if len(parts) == 1:
        return scanned(parts[0], False).drop("row", "places")
    # a pass for each part; hits of one document come together by its id and hash, documents without any hit do not move
    hits = None
    for shared in parts:
        one = materialize(scanned(shared, True).where("n_hit > 0").select("row", "item_ids", "places").distinct(), "benchmark-hits")
        hits = one if hits is None else hits.unionByName(one)
    all_hits = hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("ids"), F.flatten(F.collect_list("places")).alias("all_places"))
    all_hits = materialize(all_hits.withColumnRenamed("row", "row2"), "benchmark-documents")
    key = F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(F.col(text)).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    joined = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), key.alias("k")).join(all_hits, F.col("k") == F.col("row2"), "left")

    def told(cols: list[list]) -> list[list]:
        found = [_spans(t, {(p["first"], p["n"]): () for p in places or []}) for t, places in zip(cols[1], cols[3], strict=True)]
        return [cols[0], [len(normal_words(t)) for t in cols[1]], [h for h, _ in found], [i or [] for i in cols[2]], [s for _, s in found]]

    return map_rows(joined, [F.col("d"), F.col("t"), F.col("ids"), F.col("all_places")], schema.partition(", row")[0], told)


def _spans(text: str | None, found: dict[tuple[int, int], object]) -> tuple[int, list[dict]]:
    """How many words are hit, and where they stand in the original."""
    joined = merge(list(found))
    where = [m.span() for m in _WORD.finditer(text or "")] if joined else []
    return sum(b - a for a, b in joined), [{"start": where[a][0], "end": where[b - 1][1]} for a, b in joined]


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, whose text holds no window of any benchmark item."""
    out = docs
    parts = list(shared_parts(benchmark, **options))
    for nth, shared in enumerate(parts):

        def run(texts: list, shared=shared) -> tuple[list[bool], dict[str, list]]:
            b = _ready(shared)
            return [not b.scan(normal_words(t)) for t in texts], {}

        out = change_rows(out, text, run)
        if nth + 1 < len(parts):  # one automaton a worker: the next pass begins when this one is over
            out = materialize(out, "clean")
    return out
