"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a whole text: at-signs, plus signs, URI schemes,
identifier cues and digits. From an anchor a deterministic local parser expands to the boundaries
of the value and validates it. Parsers go left to right and never look back over a span of their
own kind, so base kinds (email, ip, card, phone) come out leftmost and non-overlapping.

Kinds beyond the base: ``iban`` (behind a cue and words such as "number is"; checked modulo 97),
``account`` (a number named by a cue such as "account no"), ``login`` (user:password in a URI).

Defined results: null text is empty; null doc_id and repeated rows keep their rows; an empty table
gives no rows; other columns are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone", "iban", "account", "login")
BASE = KINDS[:4]

# Characters of the base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[^A-Za-z0-9]*(?:(?:no|nr|number|num|is)\b[^A-Za-z0-9]*)*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[\x20:#=.]{0,4}(?:(?:no|nr|number|num)\b)?[\x20:#=.]{0,4}([0-9][0-9-]{4,16}[0-9])(?![A-Za-z0-9-])", re.IGNORECASE)
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+@[A-Za-z0-9.-]+")

CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta")
_ANCHORS: list[ahocorasick.Automaton] = []


def anchors() -> ahocorasick.Automaton:
    """The automaton, built once in a process; its values name the parser."""
    if not _ANCHORS:
        a = ahocorasick.Automaton()
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        a.add_word("://", ("scheme", 3))
        for d in "0123456789":
            a.add_word(d, ("digit", 1))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, ("cue", len(form)))
        a.make_automaton()
        _ANCHORS.append(a)
    return _ANCHORS[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    if start < at and (m := _DOMAIN.match(text, at + 1)):
        return start, m.end()
    return None


def _iban_end(text: str, start: int, end: int) -> int:
    """The farthest end at which the characters from start are a valid account number, 0 if none is."""
    for stop in range(end, start + 14, -1):
        s = text[start:stop].replace(" ", "")
        if text[stop - 1] != " " and not text[stop : stop + 1].isalnum() and len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return stop
    return 0


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in the whole text, by start."""
    text = text or ""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # where the next match of a kind may begin; a match that fails validation is passed over whole
    free = dict.fromkeys(KINDS, 0)

    def take(kind: str, m: re.Match | None, good: bool = True) -> None:
        if m:
            free[kind] = m.end()
            if good:
                out[kind].append(m.span())

    for last, (what, n) in anchors().iter(text):
        at = last - n + 1
        if what == "digit":
            if at and "0" <= text[at - 1] <= "9":
                continue  # inside a run of digits that its first one stands for
            if at >= free["ip"] and (m := _IP.match(text, at)):
                take("ip", m, all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")))
            if at >= free["card"] and (m := _CARD.match(text, at)):
                d = _digits(m[0])
                take("card", m, 12 <= len(d) <= 19 and luhn(d))
        elif what == "at":
            if at >= free["email"] and (e := _email(text, at, free["email"])):
                out["email"].append(e)
                free["email"] = e[1]
        elif what == "plus":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                take("phone", m, 9 <= len(_digits(m[0])) <= 15)
        elif what == "scheme":
            if last + 1 >= free["login"] and (m := _LOGIN.match(text, last + 1)):
                take("login", m)
        elif at == 0 or not text[at - 1].isalnum():
            m = _ACCOUNT.match(text, last + 1)
            if m and m.start(1) >= free["account"] and not text[last + 1 : last + 2].isalnum():
                out["account"].append(m.span(1))
                free["account"] = m.end(1)
            near = _IBAN.match(text, last + 1)
            end = near and near.start(1) >= free["iban"] and _iban_end(text, *near.span(1))
            if end:
                out["iban"].append((near.start(1), end))
                free["iban"] = end
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rows = sorted((a, k, b) for k, kind in enumerate(kinds) for a, b in found[kind])
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in rows)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base and spans (strings), found (array of kind, start, end)."""

    def run(cols: list[list]) -> list[list]:
        found = [spans(t) for t in cols[1]]
        rows = [[{"kind": k, "start": a, "end": b} for k in KINDS for a, b in f[k]] for f in found]
        return [cols[0], *[[len(f[k]) for f in found] for k in BASE], [joined(f, BASE) for f in found], [joined(f, KINDS) for f in found], rows]

    counts = ", ".join(f"n_{k} long" for k in BASE)
    schema = f"doc_id long, {counts}, base string, spans string, found array<struct<kind:string,start:int,end:int>>"
    return map_rows(docs, [F.col(doc_id).cast("long"), F.col(text)], schema, run)
