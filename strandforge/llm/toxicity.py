"""Toxicity by noisy-channel deobfuscation.

What a writer disguises is restored before it is scored:

1. The characters of a token make a lattice. A digit or sign may stand for letters (leetspeak), a letter of
   another alphabet or with an accent for the plain one, a run of one letter for one or two of it, a sign
   between letters for nothing or for the end of a word. Three or more single characters in a row, apart by spaces, are one
   token with spaces as such signs. Each choice has a probability: the channel.
2. A Viterbi search finds the most probable path under the channel and a character language model: trigrams of all
   texts of the corpus, mixed with trigrams of the lexicon.
3. The restored words are looked up in a lexicon of word beginnings and whole words, learned from labelled
   texts: those of enough precision that fewer than CHANCE features as common would reach by chance, copies of a text
   counted once. The score is a noisy-or of the precisions of the entries found and of the share of toxic texts without any.

Only tokens are decoded whose skeleton (one letter for all that may stand for each other, no runs, no signs)
holds the skeleton of an entry. No path through the lattice of another token leads to an entry, so leaving it out changes nothing.
Long tokens are decoded around such places.

Label, language, source and id are never inputs of a score. Defined results: null text is the empty text; a null doc_id is not held out
and never trained on; null labels are left out and of several labels of one id the mean counts; repeated rows are scored each;
without both classes of labels every score is the share of toxic labels (0 without any); signs that stand
for any letter ("id*ot") and words cut by spaces into longer parts are not restored; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import bounded_batches, discard, map_rows, materialize, pieces
from strandforge.llm.quality import fold

#: Labelled ids of each class to learn from, at most, and the largest total of their texts in bytes; the driver gets no more.
MAX_TRAIN = {1: 1_500, 0: 3_000}
MAX_TRAIN_BYTES = 48 << 20
THRESHOLD = 0.5
#: Lengths of word beginnings that may become entries.
PREFIXES = range(4, 10)
#: How many features as telling as an entry are expected by chance, at most.
CHANCE = 0.2
#: Precision of an entry, at least.
PRECISION = 0.75
MAX_ENTRIES = 500
#: Share of the lexicon in the language model.
LEXICON_SHARE = 0.3
#: Characters decoded on both sides of a place, in tokens longer than WHOLE.
AROUND, WHOLE = 24, 96
#: Tokens whose findings a worker keeps.
KEPT = 400_000

# What signs stand for in leetspeak, and letters of other alphabets that look like Latin ones.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "¡": "i", "£": "l"}
ALIKE = dict(zip("аеорсухіѕјαεοιυν", "aeopcyxisjaeoiuv", strict=True))
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
BOUNDARY, OTHER, CODES = 0, 63, 64
_CODE = {c: i for i, c in enumerate(LETTERS, 1)}
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_SPACED = re.compile(r"(?<!\S)(?:\S[^\S\n]+){2,}\S(?!\S)")
_WORD = re.compile(r"[^\W_]+")
_MINIMA = np.random.default_rng(11).integers(1, 1 << 63, size=6, dtype=np.uint64)


def plain_letter(c: str) -> str:
    """The letter a-z that a character is a form of, or nothing."""
    base = ALIKE.get(c) or unicodedata.normalize("NFKD", c)[0].lower()
    return base if "a" <= base <= "z" else ""


def _channel(c: str) -> list[tuple[str, float]]:
    """What a character may stand for, with log probabilities: letters, itself, a boundary (a space), nothing."""
    if "a" <= c <= "z":
        return [(c, 0.0)]
    if c in LEET:
        rest = [(c, math.log(0.5))] if c.isalnum() else [(" ", math.log(0.5))]
        return [*((x, math.log(0.5 / len(LEET[c]))) for x in LEET[c]), *rest]
    if c.isalnum():
        base = plain_letter(c)
        return [(c, math.log(0.9)), (base, math.log(0.1))] if base else [(c, 0.0)]
    return [(" ", math.log(0.9)), ("", math.log(0.1))]


def _again(k: int) -> tuple[tuple[int, float], ...]:
    """How many letters a run of k of them stands for, with log probabilities."""
    return ((1, 0.0),) if k == 1 else ((1, math.log(0.2)), (2, math.log(0.8))) if k == 2 else ((1, math.log(0.5)), (2, math.log(0.5)))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """The choices at each run of one character of a token in lower case."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        k = len(m[0])
        out.append([(x * n if x not in (" ", "") else x, p + q) for x, p in _channel(m[1]) for n, q in (_again(k) if x not in (" ", "") else ((1, 0.0),))])
    return out


def _skeleton_table() -> dict[int, str | None]:
    same: dict[str, str] = {"l": "i"}  # a sign may be either
    table: dict[int, str | None] = {}
    for c in map(chr, range(0x250)):
        if not c.isspace() and not c.isalnum():
            table[ord(c)] = None
    for c in [*map(chr, range(0x80, 0x250)), *map(chr, range(0xFF00, 0xFF5F)), *ALIKE, *LEET, *"abcdefghijklmnopqrstuvwxyz"]:
        base = LEET[c][0] if c in LEET else plain_letter(c)
        if base:
            table[ord(c)] = same.get(base, base)
    return table


_SKELETON = _skeleton_table()


def skeleton(token: str) -> str:
    """A form that all texts along all paths of a lattice share: signs dropped, runs closed."""
    return _RUN.sub(r"\1", "".join(token.translate(_SKELETON).split()))


# --- the language model


def _code_table() -> np.ndarray:
    codes = np.full(0x10000, OTHER, dtype=np.uint8)
    for c in map(chr, range(0x250)):
        if not c.isalnum():
            codes[ord(c)] = BOUNDARY
    codes[0x2000:0x2070] = codes[0x3000:0x3004] = BOUNDARY  # spaces and punctuation
    for c, i in _CODE.items():
        codes[ord(c)] = i
    return codes


_CODES_OF = _code_table()


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of the trigrams of character codes, boundaries in a row taken as one."""
    raw = np.frombuffer(f" {' '.join(texts)} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _CODES_OF[np.minimum(raw, 0xFFFF)]
    kept = codes[np.r_[True, (codes[1:] != BOUNDARY) | (codes[:-1] != BOUNDARY)]].astype(np.int32)
    if len(kept) < 3:
        return np.zeros(CODES**3, dtype=np.int64)
    return np.bincount((kept[:-2] * CODES + kept[1:-1]) * CODES + kept[2:], minlength=CODES**3)


def corpus_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts: summed in each task, then over all; CODES^3 rows for the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, dtype=np.int64)
        for b in pieces(batches):
            total += trigram_counts(b.column(0).to_pylist())
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(total[grams], pa.int64())], names=["gram", "n"])

    bounded_batches(docs.sparkSession)
    found = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CODES**3, dtype=np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


def smoothed(counts: np.ndarray) -> np.ndarray:
    """P(c | a, b) of trigram counts: interpolated with bigrams, single codes and the even distribution by Witten and Bell's weights."""
    c3 = counts.reshape(CODES, CODES, CODES).astype(float)
    p = np.full(CODES, 1 / CODES)
    for c in (c3.sum(axis=(0, 1)), c3.sum(axis=0), c3):
        total, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = (c + np.maximum(kinds, 1) * p) / (total + np.maximum(kinds, 1))
    return p


def language_model(counts: np.ndarray, entries: list[str]) -> np.ndarray:
    """Log probabilities of c after a, b: the corpus mixed with the lexicon."""
    corpus = smoothed(counts)
    lexicon = np.zeros((CODES, CODES, CODES))
    for e in entries:
        codes = [BOUNDARY, *(_CODE.get(c, OTHER) for c in e.rstrip("$")), BOUNDARY]
        for a, b, c in zip([BOUNDARY, *codes], codes, codes[1:], strict=False):
            lexicon[a, b, c] += 1
            if b == BOUNDARY:
                lexicon[:, b, c] += 1  # whatever the word before ends with
    known = lexicon.sum(axis=-1, keepdims=True)
    mixed = np.where(known > 0, (1 - LEXICON_SHARE) * corpus + LEXICON_SHARE * lexicon / np.maximum(known, 1), corpus)
    return np.log(mixed).astype(np.float32)


def viterbi(steps: list[list[tuple[str, float]]], model) -> str:
    """The text of the most probable path; model[a][b][c]: nested lists of log probabilities."""
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(BOUNDARY, BOUNDARY): (0.0, ())}
    code = _CODE.get
    for choices in steps:
        ahead: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, back) in paths.items():
            for said, p in choices:
                x, y, s = a, b, score + p
                if said == " ":
                    if y != BOUNDARY:
                        s += model[x][y][BOUNDARY]
                        x, y = y, BOUNDARY
                else:
                    for c in said:
                        k = code(c, OTHER)
                        s += model[x][y][k]
                        x, y = y, k
                if (x, y) not in ahead or s > ahead[x, y][0]:
                    ahead[x, y] = (s, (back, said))
        paths = ahead
    ends = ((s + (model[a][b][BOUNDARY] if b != BOUNDARY else 0.0), back) for (a, b), (s, back) in paths.items())
    back, out = max(ends, key=lambda e: e[0])[1], []
    while back:
        back, said = back
        out.append(said)
    return "".join(reversed(out))


# --- the lexicon


@dataclass
class Model:
    """entries: word beginnings, or whole words with a $ at the end, with their precisions."""

    entries: dict[str, float]
    rest: float  # the share of toxic texts among those without any entry
    logs: np.ndarray | None = None
    _ready: tuple | None = field(default=None, repr=False)

    def ready(self) -> tuple:
        """Automaton of skeletons, nested lists of the language model, lengths of entries; made once in a process."""
        if self._ready is None:
            automaton = ahocorasick.Automaton()
            for e in self.entries:
                s = skeleton(e.rstrip("$"))
                automaton.add_word(s, len(s))
            automaton.make_automaton()
            self._ready = automaton, self.logs.tolist(), sorted({len(e.rstrip("$")) for e in self.entries})
        return self._ready

    def __getstate__(self) -> tuple:
        return self.entries, self.rest, self.logs

    def __setstate__(self, state: tuple) -> None:
        self.entries, self.rest, self.logs = state
        self._ready = None


def restore(model: Model, token: str) -> str:
    """The most probable text of a token (or of single characters apart by spaces), in lower case."""
    return " ".join(viterbi(lattice(token.lower()), model.ready()[1]).split())


def _places(token: str, automaton: ahocorasick.Automaton) -> list[str]:
    """The parts of a token around what holds the skeleton of an entry; all of it where it is short."""
    closed = skeleton(token)
    if not any(True for _ in automaton.iter(closed)):
        return []
    if len(token) <= WHOLE:
        return [token]
    kept, last = [], ""  # positions of the characters that the skeleton consists of
    for i, c in enumerate(token):
        s = skeleton(c)
        if s and s != last:
            kept.append(i)
            last = s
    cuts: list[list[int]] = []
    for end, n in automaton.iter(closed):
        a, b = max(0, kept[end - n + 1] - AROUND), kept[end] + 1 + AROUND
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(b, cuts[-1][1])
        else:
            cuts.append([a, b])
    return [token[a:b] for a, b in cuts]


def entries_of(model: Model, token: str) -> frozenset[str]:
    """The entries that a token, once restored, holds."""
    automaton, logs, lengths = model.ready()
    found = set()
    for part in _places(token, automaton):
        for w in _WORD.findall(viterbi(lattice(part), logs)):
            found.update(e for n in lengths if (e := w[:n]) in model.entries)
            if f"{w}$" in model.entries:
                found.add(f"{w}$")
    return frozenset(found)


def features(text: str) -> set[str]:
    """Beginnings of the words of a text, and its whole words with a $ at the end."""
    words = set(_WORD.findall(text.lower()))
    return {w[:k] for w in words for k in PREFIXES if k <= len(w)} | {f"{w}$" for w in words}


def groups_of_copies(texts: list[str]) -> list[int]:
    """A number for each text, the same for texts that share one of a few least hashes of their word triples."""
    owner: dict[tuple[int, int], int] = {}
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, t in enumerate(texts):
        w = _WORD.findall(t.lower())
        triples = {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
        h = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in triples], dtype=np.uint64)
        for k, key in enumerate(_MINIMA):
            x = (h ^ key) * np.uint64(0x9E3779B97F4A7C15)
            j = owner.setdefault((k, int((x ^ (x >> np.uint64(29))).min())), i)
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def learn(rows: list[tuple[str | None, int]], share: float) -> tuple[dict[str, float], float]:
    """(entries with their precisions, toxic share of the rest) from texts with labels; share: of toxic ones among all labels.

    Copies of one text are one witness for all of its words."""
    toxic, clean = ([t or "" for t, y in rows if y == q] for q in (1, 0))
    if not toxic or not clean:
        return {}, share
    own, of = [features(t) for t in toxic], groups_of_copies(toxic)
    has: dict[str, set[int]] = {}
    for f, g in zip(own, of, strict=True):
        for x in f:
            has.setdefault(x, set()).add(g)
    has = {x: g for x, g in has.items() if len(g) > 1}
    against: dict[str, set[int]] = {}
    for t, g in zip(clean, clean_of := groups_of_copies(clean), strict=True):
        for x in features(t) & has.keys():
            against.setdefault(x, set()).add(g)
    seen = {x: (len(g), len(against.get(x, ()))) for x, g in has.items()}
    n_toxic, n_clean, alike = len(set(of)), len(set(clean_of)), Counter(a + b for a, b in seen.values())  # features by how many texts have them
    ratio = n_toxic / (n_toxic + n_clean)

    def precision(a: int, b: int) -> float:
        hit, miss = a / n_toxic * share, (b + 0.5) / (n_clean + 1) * (1 - share)
        return hit / (hit + miss)

    def by_chance(a: int, b: int) -> float:
        """Logarithm of how many of the features in as many texts would be in a or more toxic ones."""
        n = a + b
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(ratio) + (n - k) * math.log1p(-ratio)) for k in range(a, n + 1))
        return math.log(max(tail, 1e-300)) + math.log(alike[n])

    rated = {x: r for x, (a, b) in seen.items() if precision(a, b) >= PRECISION and (r := by_chance(a, b)) < math.log(CHANCE)}
    entries: dict[str, float] = {}
    # the most telling first, of equals the longest beginning; what begins like an entry, or is the beginning of one, adds nothing
    for x in sorted(rated, key=lambda x: (rated[x], x.endswith("$"), -len(x), x)):
        bare = x.rstrip("$")
        if len(entries) < MAX_ENTRIES and not any(bare.startswith(e := y.rstrip("$")) or e.startswith(bare) for y in entries):
            entries[x] = precision(*seen[x])
    left = len({g for f, g in zip(own, of, strict=True) if not f & entries.keys()})
    rest = (left + 0.5) / (n_toxic + 1) * share
    return entries, rest / (rest + (1 - share))


def train(docs: DataFrame, labels: DataFrame, max_train: dict[int, int] = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The language model from all texts; the lexicon from at most so many labelled ids of each class outside the
    held-out fold, in the order of a hash of their id, those whose texts fit into what is left of max_bytes."""
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).alias("q")).where(F.col("q").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id")) != 0))
    known = materialize(known.groupBy("id").agg((F.avg("q") >= 0.5).cast("int").alias("q")), "toxic-labels")
    counts = {q: n for q, n in known.groupBy("q").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    sample = None
    for q, most in max_train.items():
        some = known.where(F.col("q") == q).orderBy(F.xxhash64("id"), "id").limit(most)
        sample = some if sample is None else sample.unionByName(some)
    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")  # so few that they can be broadcast
    found = materialize(found.groupBy("id", "q").agg(F.min("text").alias("text")), "toxic-texts")
    sizes = found.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).collect()
    fits, held = [], 0
    for r in sorted(sizes, key=lambda r: (zlib.crc32(b"%d" % r["id"]), r["id"])):
        if held + r["bytes"] <= max_bytes:  # a text that does not fit is left out, and the next one is looked at
            held += r["bytes"]
            fits.append(r["id"])
    rows = found.where(F.col("id").isin(fits)).select("text", "q").collect() if fits else []
    entries, rest = learn([tuple(r) for r in sorted(rows, key=lambda r: (r["q"], r["text"] or ""))], share)
    model = Model(entries, rest)
    if entries:
        model.logs = language_model(corpus_trigrams(docs, text), list(entries))
    discard(known, found)
    return model


_known: dict[str, frozenset[str]] = {}
_known_of: list[Model] = []


def found_entries(model: Model, text: str | None) -> set[str]:
    """The entries that the restored text holds."""
    if not model.entries or not text:
        return set()
    if not _known_of or _known_of[0] is not model:  # tokens of one model are kept in a worker
        _known.clear()
        _known_of[:] = [model]
    low, out = text.lower(), set()
    for token in {*low.split(), *_SPACED.findall(low)}:
        if (e := _known.get(token)) is None:
            if len(_known) >= KEPT:
                _known.clear()
            e = _known[token] = entries_of(model, token)
        if e:
            out |= e
    return out


def score_of(model: Model, found: list[str]) -> float:
    """The noisy-or of what was found."""
    miss = 1 - model.rest
    for e in found:
        miss *= 1 - model.entries[e]
    return 1 - miss


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, entries (what the restored text holds, sorted, comma-joined) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_ENTRIES entries and CODES^3 numbers at most

    def run(cols: list[list]) -> list[list]:
        m = shared.value
        found = [sorted(found_entries(m, t)) for t in cols[1]]
        return [cols[0], [score_of(m, f) for f in found], [",".join(f) for f in found]]

    scored = map_rows(docs, [F.col(doc_id).cast("long"), F.col(text)], "doc_id long, score double, entries string", run)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "entries")
