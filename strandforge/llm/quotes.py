"""Chat formatting by quotation linking.

A message is parsed into its own text and quote blocks (quoted lines in a row). Lines of one nesting
level in a row make a passage. Passages are unwrapped, normalised and hashed, so a passage that a
client has broken into other lines, or a part of a message, has the same hashes as its original:

* a passage of WINDOW words or more gives a hash for every WINDOW words and one for its last ones; a
  message gives one for each run of WINDOW words of its own text;
* a shorter passage gives one hash; a message gives one for each shorter line, sentence, paragraph and
  own text as a whole, however short.

Hashes have 128 bits and stand for the words themselves, so texts are parsed once and not joined, however long they are and
however many messages quote them. A hash is linked to the latest earlier message of the conversation that has it, a passage to the one
that most of its hashes come from (the latest of several). A
message replies to what most of its least nested linked passages come from. A quote block is left out
of the text if one of its passages is linked or a line such as "On Monday they wrote:" stands before it, which
goes with it; other lines that begin with ">" are the message's own. Conversations are returned in reply
order: a branch (a reply to other than the message before it) follows the messages after the one it answers.

The latest earlier message is found with two-level running values over ranges of turns, and order
is a sortable key rather than a rank, so no conversation, however long, is held by one task.

Defined results: null text is empty; null conv_id is a conversation of its own; rows without a
turn come first and are never linked to; repeated rows stay, and several messages of one turn are
linked to and replied to as one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm.common import broadcast_if_small, discard, map_rows, materialize

TURN_RANGE = 1024
WINDOW = 8
_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
#: How a line begins and ends that says whom the quote below is from.
_WROTE = re.compile(r"(?:on|am|le|el|il)\b.*(?:wrote|schrieb|écrit|escribió|scritto)\s*:\s*", re.IGNORECASE | re.DOTALL)
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s*")


def normal(text: str) -> list[str]:
    """Case-folded words of letters and digits."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return "".join(c if c.isalnum() else " " for c in folded).split()


def parse(text: str | None) -> list[tuple[int, str]]:
    """Segments in order: (0, own text) and (level, passage); lines of a passage stay apart."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        level, said = (m[1].count(">"), m[2]) if m else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(said)
        else:
            out.append((level, [said]))
    return [(level, "\n".join(lines)) for level, lines in out]


def _hash(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"), int(len(words) < WINDOW))


def passage_hashes(text: str) -> list[bytes]:
    words = normal(text)
    if len(words) < WINDOW:
        return [_hash(words)] if words else []
    starts = {*range(0, len(words) - WINDOW + 1, WINDOW), len(words) - WINDOW}
    return [_hash(words[i : i + WINDOW]) for i in sorted(starts)]


def own_hashes(own: list[str]) -> set[bytes]:
    """Of a message's own segments, anything that a passage can be linked by."""
    out: set[bytes] = set()
    for text in own:
        words = normal(text)
        out.update(_hash(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1))
        paragraphs = re.split(r"\n\s*\n", text)
        short = [text, *paragraphs, *text.split("\n"), *(x for p in paragraphs for x in _SENTENCE.split(p))]
        out.update(_hash(w) for w in map(normal, short) if 0 < len(w) < WINDOW)
    return out


def without_quotes(segments: list[tuple[int, str]], linked: set[int]) -> tuple[str, int]:
    """The message's text without the quote blocks that go, and how many lines went."""
    kept: list[str] = []
    gone, i = 0, 0
    while i < len(segments):
        level, text = segments[i]
        if not level:
            kept.append(text)
            i += 1
            continue
        j = i
        while j < len(segments) and segments[j][0]:
            j += 1
        lines = kept[-1].rstrip().split("\n") if kept else []
        said = next((n for n in (1, 2) if len(lines) >= n and _WROTE.fullmatch("\n".join(lines[-n:]).strip())), 0)
        if said or any(k in linked for k in range(i, j)):
            gone += sum(t.count("\n") + 1 for _, t in segments[i:j])
            if said:
                kept[-1] = "\n".join(lines[:-said])
        else:
            kept.append("\n".join("> " * v + x if x else ">" * v for v, t in segments[i:j] for x in t.split("\n")))
        i = j
    return (re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n"), gone) if gone else ("", 0)


def parsed_messages(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, row (a hash of these), own (hashes), quotes (array of passage, level, hash), levels."""

    def run(cols: list[list]) -> list[list]:
        own, quotes, levels = [], [], []
        for t in cols[3]:
            segments = parse(t)
            quoted = [(k, v, x) for k, (v, x) in enumerate(segments) if v]
            own.append(sorted(own_hashes([x for v, x in segments if not v])))
            quotes.append([{"passage": k, "level": v, "hash": h} for k, v, x in quoted for h in passage_hashes(x)])
            levels.append(max((v for _, v, _ in quoted), default=0))
        return [*cols[:3], [t or "" for t in cols[3]], cols[4], own, quotes, levels]

    schema = "conv_id long, turn long, role string, text string, row long, own array<binary>, quotes array<struct<passage:int,level:int,hash:binary>>, levels int"
    columns = [F.col(conv_id).cast("long"), F.col(turn).cast("long"), F.col(role), F.col(text)]
    return map_rows(messages, [*columns, F.xxhash64(*columns)], schema, run)


def running_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last non-null value up to each row of its keys, by order (order[0] is a number)."""
    df = df.withColumn("_range", F.floor(F.col(order[0]) / TURN_RANGE)).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    ends = df.groupBy(*keys, "_range").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(across)).where(F.col("_before").isNotNull())
    e = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    on = F.col("_range").eqNullSafe(F.col("_r"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    kept = [c for c in df.columns if c not in ("_range", "_v", "_in")]
    return df.join(e, on, "left").select(*kept, F.coalesce("_in", "_before").alias(name))


def passage_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, row, passage, level, source (turn) of the passages found in earlier messages."""
    quoted = messages.where((F.size("quotes") > 0) & F.col("turn").isNotNull())
    asked = quoted.select("conv_id", "turn", "row", F.inline("quotes")).distinct()
    asked = materialize(asked.select("conv_id", "turn", "row", "passage", "level", "hash", F.lit(0).alias("own")), "asked")
    # only conversations that quote at all, and of these only hashes that are asked for
    talks = asked.select(F.col("conv_id").alias("c2")).distinct()
    have = messages.where("turn IS NOT NULL").join(broadcast_if_small(talks), F.col("conv_id").eqNullSafe(F.col("c2")), "left_semi")
    have = have.select("conv_id", "turn", F.explode("own").alias("hash"))
    wanted = asked.select(F.col("conv_id").alias("c2"), F.col("hash").alias("h2")).distinct()
    have = have.join(wanted, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("hash") == F.col("h2")), "left_semi").distinct()
    rows = asked.unionByName(have.select("conv_id", "turn", "hash", F.lit(1).alias("own")), allowMissingColumns=True)
    # at one turn what is quoted comes before what is said, so a message never answers itself
    linked = running_last(rows, ["conv_id", "hash"], ["turn", "own"], F.when(F.col("own") == 1, F.col("turn")), "source")
    linked = linked.where("own = 0 AND source IS NOT NULL AND source < turn")
    votes = linked.groupBy("conv_id", "turn", "row", "passage", "level", "source").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("conv_id", "turn", "row", "passage", "level").agg(F.max_by("source", F.struct("votes", "source")).alias("source"))
    out = materialize(best, "passage-links")
    discard(asked)
    return out


def reply_links(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn of the turns with a linked passage."""
    votes = links.groupBy("conv_id", "turn", "level", "source").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max_by("source", F.struct(-F.col("level"), F.col("votes"), F.col("source")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("parent_turn"))


def branch_keys(starts: DataFrame) -> DataFrame:
    """conv_id, segment, path: the sortable place of each branch, from its own and its ancestors' keys.

    starts: conv_id, segment (turn at which it begins), up (segment it answers; null: the trunk), at
    (turn it answers). Later answered turns come first, as their branches end first. Paths double
    in each round, so rounds grow with the logarithm of the nesting.
    """
    own = F.array(-F.col("at"), F.col("segment"))
    now = materialize(starts.select("conv_id", "segment", "up", own.alias("path")), "branches")
    while now.where("up IS NOT NULL").limit(1).count():
        above = now.select(F.col("conv_id").alias("c2"), F.col("segment").alias("s2"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        on = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("s2"))
        joined = now.join(above, on, "left")
        now = materialize(joined.select("conv_id", "segment", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.array().cast("array<bigint>")), "path").alias("path")), "branches")
    return now.select("conv_id", "segment", "path")


def conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text (no quotes), n_quoted (lines left out), quote_levels, n_linked (passages), parent_turn, reply_path.

    Sorting by conv_id, reply_path, turn gives the reply order; parent_turn is null where the
    message goes on from the one before it. Only conversations with a line that begins with ">" are
    parsed; in others there is nothing to link or to leave out.
    """
    typed = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    talks = materialize(typed.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select(F.col("conv_id").alias("c2"), F.lit(True).alias("quotes")).distinct(), "quoting")
    split = typed.join(broadcast_if_small(talks), F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    none = F.lit(None).cast("long")
    plain = split.where("quotes IS NULL").select(
        "conv_id", "turn", "role", "text", F.lit(0).alias("n_quoted"), F.lit(0).alias("quote_levels"), F.lit(0).cast("long").alias("n_linked"), none.alias("parent_turn"), F.array().cast("array<bigint>").alias("reply_path")
    )
    return plain.unionByName(linked_conversations(split.where("quotes").select("conv_id", "turn", "role", "text")))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """The same of messages (conv_id, turn, role, text) all of which are parsed."""
    parsed = materialize(parsed_messages(messages), "messages")
    passages = passage_links(parsed)
    links = materialize(reply_links(passages), "links")
    same = lambda c, t: F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col(c) == F.col(t))
    found = passages.groupBy(F.col("conv_id").alias("c2"), F.col("row").alias("row2")).agg(F.sort_array(F.collect_set("passage")).alias("linked"))
    m = parsed.select("conv_id", "turn", "role", "text", "row", "levels").join(found, same("row", "row2"), "left").drop("c2", "row2")
    l = links.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), "parent_turn")
    m = m.join(l, same("turn", "t2"), "left").drop("c2", "t2")
    # a branch answers a message that is not the last one before it
    times = parsed.where("turn IS NOT NULL").select("conv_id", "turn").distinct().select("conv_id", "turn", F.lit(1).alias("own"))
    probe = links.select("conv_id", "turn", F.lit(0).alias("own"))
    before = running_last(times.unionByName(probe), ["conv_id"], ["turn", "own"], F.when(F.col("own") == 1, F.col("turn")), "previous").where("own = 0")
    b = before.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), "previous")
    starts = links.join(b, same("turn", "t2")).where("parent_turn <> previous")
    starts = materialize(starts.select("conv_id", F.col("turn").alias("segment"), F.col("parent_turn").alias("at")), "starts")
    marks = starts.select("conv_id", F.col("segment").alias("turn"), F.lit(0).alias("kind"))
    at = running_last(marks.unionByName(starts.select("conv_id", F.col("at").alias("turn"), F.lit(1).alias("kind")).distinct()), ["conv_id"], ["turn", "kind"], F.when(F.col("kind") == 0, F.col("turn")), "up").where("kind = 1")
    a = at.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), "up")
    placed_starts = starts.join(a, same("at", "t2"), "left").select("conv_id", "segment", "up", "at")
    paths = branch_keys(placed_starts)
    p = paths.select(F.col("conv_id").alias("c2"), F.col("segment").alias("s2"), "path")
    rows = m.select("*", F.lit(1).alias("kind")).unionByName(marks.select("conv_id", "turn", "kind"), allowMissingColumns=True)
    placed = running_last(rows, ["conv_id"], ["turn", "kind"], F.when(F.col("kind") == 0, F.col("turn")), "segment").where("kind = 1")
    placed = placed.join(p, same("segment", "s2"), "left")
    path = F.coalesce("path", F.array().cast("array<bigint>"))

    def run(cols: list[list]) -> list[list]:
        texts, gone = [], []
        for text, linked in zip(cols[3], cols[5], strict=True):
            new, n = without_quotes(parse(text), set(linked or [])) if ">" in text else ("", 0)
            texts.append(new if n else text)
            gone.append(n)
        return [*cols[:3], texts, gone, cols[4], [len(x or []) for x in cols[5]], *cols[6:]]

    schema = "conv_id long, turn long, role string, text string, n_quoted int, quote_levels int, n_linked long, parent_turn long, reply_path array<long>"
    return map_rows(placed, [*map(F.col, ("conv_id", "turn", "role", "text", "levels", "linked", "parent_turn")), path], schema, run)
