"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from strandforge.llm.collocations import INSIDE, LEAST, TOP
from strandforge.llm.decontaminate import WINDOW
from strandforge.llm.hard_negatives import ANCHOR_EVERY, HIGHEST, LOWEST, NEGATIVES, POSITIVES, QUANTUM
from strandforge.llm.license_scan import BASE_PHRASES, EDIT_SHARE, MAX_SHIFT, TEMPLATES
from strandforge.llm.secrets import JWT, RULES

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOW + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_D = f"d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents)"


def _licenses() -> str:
    """From the definition: a label is there where a run of words is close enough to its template."""
    texts = [*BASE_PHRASES, *TEMPLATES]
    rows = ", ".join(f"({i}, '{label}', {i < len(BASE_PHRASES)}, '{text}', '{' '.join(dict.fromkeys(text.split()))}')" for i, (label, text) in enumerate(texts))
    code = "array_to_string(list_transform({}, lambda x: chr((coalesce(list_position(known, x), 0) + 1)::int)), '')"
    return f"""WITH {_D},
t AS (SELECT tid, label, base, string_split(txt, ' ') AS tw, string_split(ks, ' ') AS known, len(string_split(txt, ' ')) AS n, len(string_split(txt, ' ')) // {EDIT_SHARE} AS k FROM (VALUES {rows}) v(tid, label, base, txt, ks)),
ts AS (SELECT *, least(k, {MAX_SHIFT}) AS s, {code.format('tw')} AS code FROM t),
tgram AS (SELECT tid, unnest(range(n - 2)) AS tp, tw FROM t),
tg AS (SELECT tid, tp, tw[tp+1]||' '||tw[tp+2]||' '||tw[tp+3] AS g FROM tgram),
u AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT rid, i - 1 AS p, x||' '||lead(x) OVER o||' '||lead(x, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
hits AS (SELECT DISTINCT rid, tid, p - tp AS diag, tp FROM g JOIN tg USING (g)),
anchors AS (SELECT rid, tid, diag, count(*) AS votes FROM hits GROUP BY ALL),
cover AS (SELECT a.rid, a.tid, a.diag, any_value(a.votes) AS votes, count(DISTINCT h.tp) AS covered FROM anchors a JOIN ts USING (tid) JOIN hits h ON h.rid = a.rid AND h.tid = a.tid AND abs(h.diag - a.diag) <= k + s GROUP BY ALL),
tries AS (SELECT rid, tid, diag, diag + begin AS b, n + longer AS m FROM anchors JOIN ts USING (tid), unnest(range(-s, s + 1)) q(begin), unnest(range(-s, s + 1)) r(longer) WHERE diag + begin >= 0),
dist AS (SELECT rid, tid, diag, min(levenshtein({code.format('w[b+1:b+m]')}, code)) AS dist FROM tries JOIN ts USING (tid) JOIN d USING (rid) GROUP BY ALL),
spans AS (SELECT c.*, label, base, n, votes = n - 2 AS exact, covered / (n - 2) AS coverage, CASE WHEN dist <= k THEN dist END AS dist FROM cover c JOIN ts USING (tid) LEFT JOIN dist USING (rid, tid, diag)),
beaten AS (SELECT DISTINCT a.rid, a.tid, a.diag FROM spans a JOIN spans b ON a.rid = b.rid AND a.label <> b.label AND b.dist < a.dist AND b.diag < a.diag + a.n AND a.diag < b.diag + b.n),
said AS (SELECT spans.*, beaten.tid IS NULL AND dist IS NOT NULL AND NOT base AS added FROM spans LEFT JOIN beaten USING (rid, tid, diag))
SELECT d.doc_id, len(any_value(d.w))::bigint AS n_words, count(*) FILTER (base AND exact) AS n_base, (min(diag) FILTER (base AND exact))::bigint AS first_word, (max(diag) FILTER (base AND exact))::bigint AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND exact), '') AS base_labels,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND exact OR added), '') AS labels,
 coalesce(max(greatest(coverage, CASE WHEN dist IS NOT NULL THEN 1 - dist / n ELSE 0 END)), 0)::double AS score
FROM d LEFT JOIN said ON said.rid = d.rid GROUP BY d.rid, d.doc_id"""


def _leaks() -> str:
    return f"""WITH {_D},
iw AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
ws AS (SELECT item_id, w, least({WINDOW}, len(w))::bigint AS m, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) AS s FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[s+1:s+m], ' ') AS g FROM ws),
places AS (SELECT rid, m, unnest(list_transform(range(greatest(len(w) - m + 1, 0)), lambda i: array_to_string(w[i+1:i+m], ' '))) AS g, unnest(range(greatest(len(w) - m + 1, 0))) AS p FROM d, (SELECT DISTINCT m FROM win)),
hits AS (SELECT DISTINCT rid, m, p, item_id FROM places JOIN win USING (m, g)),
words AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(p, p + m)) AS k FROM hits) GROUP BY 1),
items AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::string, ',' ORDER BY item_id::string) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(words.n, 0)::bigint AS n_hit, coalesce(items.n, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


def _secrets() -> str:
    keep = {"assign": "length(regexp_extract(m, '{0}', 2)) >= 12", "access": "length(m) >= 18", "jwt": f"regexp_full_match(m, '{JWT}')"}
    parts = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {k} AS k, '{r.kind}' AS kind, {r.base} AS base, a[i] AS m, length(array_to_string(b[1:i], '')) + length(array_to_string(a[1:i-1], '')) AS s FROM (SELECT rid, a, b, unnest(range(1, len(a) + 1)) AS i FROM "
            f"(SELECT rid, regexp_extract_all(text, '{pattern}') AS a, string_split_regex(text, '{pattern}') AS b FROM d)) WHERE {keep.get(r.kind, 'true').replace('{0}', pattern).replace('(m,', '(a[i],').replace('(m)', '(a[i])')}"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    said = "string_agg(kind||':'||s::string||':'||(s + length(m))::string, ',' ORDER BY s, k)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts}, sha256(coalesce({said} FILTER (base), '')) AS base_sha256, coalesce({said}, '') AS spans
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""


def _collocations() -> str:
    low = _LOW.format("text")
    return rf"""WITH p AS (SELECT row_number() OVER () AS pid, lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda v: v <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({low}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
o AS (SELECT lang, pid, unnest(w) AS w1, unnest(range(len(w))) AS i FROM p),
g AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM o WINDOW s AS (PARTITION BY pid ORDER BY i)),
f1 AS (SELECT lang, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1||' '||w2 AS phrase, count(*) AS f, any_value(w1) AS w1, any_value(w2) AS w2 FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, w1||' '||w2||' '||w3 AS phrase, count(*) AS f, any_value(w1) AS w1, any_value(w1||' '||w2) AS left2, any_value(w2||' '||w3) AS right2, any_value(w3) AS w3 FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
cuts AS (SELECT f2.lang, f2.phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.phrase = w1 JOIN f1 y ON y.lang = f2.lang AND y.phrase = w2
 UNION ALL SELECT f3.lang, f3.phrase, f3.f, 1, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.phrase = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.phrase = right2
 UNION ALL SELECT f3.lang, f3.phrase, f3.f, 2, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.phrase = left2 JOIN f1 y ON y.lang = f3.lang AND y.phrase = f3.w3),
said AS (SELECT *, (1000000::hugeint * a * a) // (l::hugeint * r) AS score FROM cuts),
worst AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner2 AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, left2 AS phrase, f FROM f3 UNION ALL SELECT lang, right2, f FROM f3) GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN inner2 USING (lang, phrase) WHERE coalesce(100 * most < {INSIDE} * a, true)),
totals AS (SELECT lang, sum(f)::bigint AS n FROM f1 GROUP BY 1)
SELECT lang, rank, phrase, a, l, r, n, score::bigint AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= {TOP}"""


def _negatives() -> str:
    return f"""WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({QUANTUM} * x::double)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::bigint AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::int AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOWEST} * p.score <= 100 * s.score AND 100 * s.score <= {HIGHEST} * p.score)
SELECT * FROM n WHERE rank <= {NEGATIVES}"""


ORACLES: dict[str, str] = {"op1_license_scan": _licenses(), "op6_decontamination": _leaks(), "op10_secrets": _secrets(), "op12_collocations": _collocations(), "op13_hard_negatives": _negatives()}
