"""Secret scans over a trigram inverted index.

From the parse tree of each rule's regular expression a Boolean query over trigrams is derived:
any text that matches must hold certain trigrams (sequences give AND, alternatives give OR; what
can be empty or stands for many characters gives none). Texts are indexed in blocks: one pass over
a block's bytes gives, for every trigram of any query, the posting list of the texts that hold it.
Queries intersect and unite postings; only candidates are verified with the expression itself. A
rule without mandatory trigrams scans every text.

Trigrams are of bytes with A-Z lower-cased. The index covers a block of rows and is made where the
rows are, so nothing is shuffled and memory is bounded by the block.

Defined results: null text is empty; null doc_id and repeated rows keep their rows; an empty table
gives no rows; other columns are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import change_rows, map_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    base: bool = False


def _cased(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_cased(w) for w in ("password", "passwd", "secret", "token")) + "|" + _cased("api") + "_?" + _cased("key")

_SEP = r"(?:[\x20\x09-\x0D]|\\[nr])"  # white space, or line ends as JSON writes them
_EDGE = r" (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
#: From BEGIN to the next END line; where that is missing, the header lines, the base64 lines and the shorter one after them.
_KEY = (
    rf"-----BEGIN{_EDGE}(?:(?:[^-]|-{{1,4}}[^-])*-----END{_EDGE}"
    rf"|(?:{_SEP}+[A-Za-z][A-Za-z-]*:\x20[^\x0A\\]*)*(?:{_SEP}*[A-Za-z0-9+/=]{{16,}})*(?:{_SEP}+[A-Za-z0-9+/]+={{0,2}})?(?:{_SEP}+=[A-Za-z0-9+/]{{4}})?)"
)

#: A whole token of three parts.
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
#: Kinds in the order of their names in results; base kinds first.
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18, True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", _KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # what starts like a token is passed over whole, so that no character is read twice; three parts are looked at after
    Rule("jwt", r"eyJ[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*){0,2}", lambda m: re.fullmatch(JWT, m[0]) is not None),
)

# --- Boolean trigram queries: True (any text), a trigram, ("and", ...) or ("or", ...)

_MANY = 8  # exact strings followed at once; beyond it, their trigrams so far are kept


def _all(parts: list) -> object:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def _any(parts: list) -> object:
    kept = list(dict.fromkeys(parts))
    return True if not kept or True in kept else kept[0] if len(kept) == 1 else ("or", *kept)


def _of(strings: set[bytes]) -> object:
    """What a text holds if it holds one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[bytes] | None:
    """The lower-cased characters of a class, None if they are many."""
    chars: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(arg)
        elif op is sre.RANGE and arg[1] - arg[0] < _MANY:
            chars.update(range(arg[0], arg[1] + 1))
        else:
            return None
    out = {chr(c).encode().lower() for c in chars}
    return out if len(out) <= 2 else None


@lru_cache(maxsize=1024)
def trigram_query(pattern: str) -> object:
    """The Boolean query that every text matching the pattern meets."""

    def walk(tree: list) -> tuple[object, set[bytes] | None]:
        """Query of what was read, and the exact strings the whole tree stands for (None: unknown)."""
        query, run, exact = [], {b""}, True

        def close() -> None:
            query.append(_of(run))

        for op, arg in tree:
            strings: set[bytes] | None = None
            inner: object = True
            if op is sre.LITERAL:
                strings = {chr(arg).encode().lower()}
            elif op is sre.IN:
                strings = _class(arg)
            elif op is sre.SUBPATTERN:
                inner, strings = walk(arg[-1])
            elif op is sre.BRANCH:
                got = [walk(b) for b in arg[1]]
                inner = _any([q if s is None else _all([q, _of(s)]) for q, s in got])
                strings = set().union(*[s for _, s in got]) if all(s is not None for _, s in got) else None
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, sub = arg
                got, s = walk(sub)
                if low == 0 and high == 1 and s is not None:
                    strings = s | {b""}
                elif low == high == 1:
                    inner, strings = got, s
                elif low > 0:
                    inner = got if s is None else _all([got, _of(s)])
            elif op is sre.AT:
                strings = {b""}
            if inner is not True:
                query.append(inner)
            if strings is not None and len(run) * len(strings) <= _MANY:
                run = {a + b for a in run for b in strings}
            else:
                close()
                run, exact = (strings if strings is not None and len(strings) <= _MANY else {b""}), False
        if exact:
            return _all(query), run
        close()
        return _all(query), None

    query, whole = walk(list(sre_parse.parse(pattern)))
    return query if whole is None else _all([query, _of(whole)])


def trigrams(query: object) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*[trigrams(q) for q in query[1:]]) if isinstance(query, tuple) else set()


class TrigramIndex:
    """Posting lists, over a block of texts, of the trigrams that queries use."""

    def __init__(self, texts: list[bytes], wanted: list[bytes]):
        self.n, self.ids = len(texts), {t: i for i, t in enumerate(wanted)}
        code = lambda t: t[0] << 16 | t[1] << 8 | t[2]
        order = sorted(wanted, key=code)
        codes = np.array([code(t) for t in order], dtype=np.int32)
        self.lists: dict[bytes, np.ndarray] = {t: np.zeros(0, dtype=np.int64) for t in wanted}
        if not texts or not wanted:
            return
        low = b"\0\0".join(texts).lower()
        at = np.cumsum([0, *[len(t) + 2 for t in texts]])
        first = np.zeros(1 << 16, dtype=bool)
        first[codes >> 8] = True
        b = np.frombuffer(low, dtype=np.uint8)
        if len(b) < 3:
            return
        pairs = b[:-2].astype(np.uint16) << 8 | b[1:-1]
        where = np.flatnonzero(first[pairs])  # few places pass the first two bytes
        full = pairs[where].astype(np.int32) << 8 | b[where + 2]
        slot = np.minimum(np.searchsorted(codes, full), len(codes) - 1)
        hit = codes[slot] == full
        rows = np.searchsorted(at, where[hit], side="right") - 1
        for key in np.unique(slot[hit].astype(np.int64) * self.n + rows).tolist():
            t = order[key // self.n]
            self._add(t, key % self.n)
        self.lists = {t: np.array(v, dtype=np.int64) for t, v in self.lists.items()}

    def _add(self, t: bytes, row: int) -> None:
        if not isinstance(self.lists[t], list):
            self.lists[t] = []
        self.lists[t].append(row)

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.lists[query]
        parts = [self.candidates(q) for q in query[1:]]
        join = np.intersect1d if query[0] == "and" else np.union1d
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return out


def scan_block(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text (start, rule number, end), sorted."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    queries = [trigram_query(r.pattern) for r in rules]
    index = TrigramIndex(raw, sorted(set().union(*[trigrams(q) for q in queries])))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex = re.compile(rule.pattern)
        for i in index.candidates(query).tolist():
            found[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i] or "") if rule.keep(m)]
    return [sorted(f) for f in found]


def redact(text: str | None, found: list[tuple[int, int, int]], mark: str = "[secret]") -> str | None:
    """The text with every found span replaced (overlapping ones once)."""
    if not text or not found:
        return text
    out, at = [], 0
    for start, _, end in found:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_<kind> of base rules, base and spans (strings), found (array of kind, start, end)."""
    base = [k for k, r in enumerate(rules) if r.base]

    def run(cols: list[list]) -> list[list]:
        found = scan_block(cols[1], rules)
        said = lambda f: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in f)
        return [
            cols[0],
            *[[sum(x[1] == k for x in f) for f in found] for k in base],
            [said([x for x in f if rules[x[1]].base]) for f in found],
            [said(f) for f in found],
            [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in f] for f in found],
        ]

    counts = ", ".join(f"n_{rules[k].kind} long" for k in base)
    schema = f"doc_id long, {counts}, base string, spans string, found array<struct<kind:string,start:int,end:int>>"
    return map_rows(docs, [F.col(doc_id).cast("long"), F.col(text)], schema, run)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with every secret in the text replaced and the length kept true."""
    counted = n_chars in docs.columns

    def run(texts: list) -> tuple[list[bool], dict[str, list]]:
        new = [redact(t, f) for t, f in zip(texts, scan_block(texts, rules), strict=True)]
        return [True] * len(texts), {text: new} | ({n_chars: [len(t or "") for t in new]} if counted else {})

    return change_rows(docs, text, run)
