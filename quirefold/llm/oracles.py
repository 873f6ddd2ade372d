"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from quirefold.llm.crc import STEP
from quirefold.llm.divergence import MIN_DOCS, SHARE, TOP
from quirefold.llm.langid import PROFILE
from quirefold.llm.lm import K
from quirefold.llm.neighbours import K as NEAREST
from quirefold.llm.quality import RULES, STOP_WORDS
from quirefold.llm.resampling import BUCKETS, MIN_WORDS, PERCENT, SEED
from quirefold.llm.suffixes import SPAN

_STOP = ", ".join("'" + w + "'" for w in STOP_WORDS)
_METRIC = {
    "n_words": "n_words",
    "mean_word_chars": "(word_chars / greatest(n_words, 1))",
    "symbols_per_word": "(n_symbols / greatest(n_words, 1))",
    "stop_words_per_word": "(n_stop / greatest(n_words, 1))",
    "dup_line_ratio": "(n_dup_lines / greatest(n_lines, 1))",
    "repeat_word_ratio": "(n_repeat_words / greatest(n_words, 1))",
    "alpha_ratio": "(n_alpha / greatest(word_chars, 1))",
}
QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + j) AS c FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g'))::BIGINT AS n_alpha,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop, coalesce(c, 0)::BIGINT AS n_repeat_words
    FROM t LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({" OR ".join(f"{_METRIC[m]} {op} {t}" for m, op, t in RULES)}) AS kept FROM b
"""

#: Word lists of a text: A-Z lowered, digits, letters and non-ASCII.
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAM = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
h AS (SELECT doc_id, item_id, dw.k AS k, i FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
c AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(x, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

#: crc32 of doc_id as text, bit by bit: a digit enters with the first of its eight steps.
_CRC = """xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT))"""

#: Of equal counts the shorter n-gram comes first, then that of lower code points; a blank is below all letters.
LANGID = f"""
WITH t AS (SELECT doc_id, lang, {_CRC} % 4 = 2 AS held_out, regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '[^\\p{{L}}]+', ' ', 'g') AS a FROM documents),
c AS (SELECT doc_id, lang, held_out, string_split(a, '') AS c FROM t),
z AS (SELECT doc_id, lang, held_out, unnest(list_concat(c, list_transform(list_zip(c[:-2], c[2:]), lambda x: x[1] || x[2]),
    list_transform(list_zip(c[:-3], c[2:-2], c[3:]), lambda x: x[1] || x[2] || x[3]))) AS g FROM c),
g AS (SELECT doc_id, lang, held_out, g, count(*) AS n FROM z WHERE g <> ' ' GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, len(g), g) - 1 AS r FROM
    (SELECT lang, g, sum(n) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY r < {PROFILE}),
q AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, len(g), g) - 1 AS r FROM g QUALIFY r < {PROFILE}),
away AS (SELECT doc_id, l.lang AS lang, count(*) AS n, sum(coalesce(abs(p.r - q.r), {PROFILE})) AS d
    FROM q CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = q.g GROUP BY ALL),
best AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - d::DOUBLE / ({PROFILE} * n), 0) AS score FROM t LEFT JOIN best USING (doc_id)
"""

#: The empty word stands for the end token, which a text's first word follows.
LM = f"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') AS t FROM documents),
k AS (SELECT doc_id, held_out, t[i] AS v, coalesce(t[i - 1], '') AS u FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM d)),
one AS (SELECT v, count(*) AS c FROM k WHERE NOT held_out GROUP BY v),
two AS (SELECT u, v, count(*) AS c FROM k WHERE NOT held_out GROUP BY u, v),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS types FROM one),
w AS (SELECT doc_id, held_out, n, coalesce(one.c, 0) AS c, coalesce(before.c, 0) AS state, coalesce(two.c, 0) AS arc, (coalesce(one.c, 0) + 1) / (n + types + 1) AS root
    FROM k CROSS JOIN s LEFT JOIN one ON k.v = one.v LEFT JOIN one AS before ON k.u = before.v LEFT JOIN two ON k.u = two.u AND k.v = two.v)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count_if(c > 0)::BIGINT AS n_known, n AS train_tokens, sum(log10(root)) AS base_score,
    sum(CASE WHEN arc > 0 THEN log10((arc + {K} * root) / (state + {K})) ELSE log10({K} / (state + {K})) + log10(root) END) AS score
FROM w GROUP BY doc_id, held_out, n
"""

#: Bytes are pairs of hexadecimal digits; i, a and z count bytes from 1. Strings are taken from
#: pieces (b) of twice their length, as a long text is slow to index.
SUFFIXES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, b, h[2 * {SPAN} * b + 1 : 2 * {SPAN} * (b + 2)] AS x FROM (SELECT *, unnest(range(len(h) // {2 * SPAN} + 1)) AS b FROM d)),
p AS (SELECT doc_id, {SPAN} * b + j AS i, x[2 * j - 1 : 2 * j + {2 * SPAN - 2}] AS g
    FROM (SELECT *, unnest(range(1, least({SPAN}, len(x) // 2 - {SPAN - 1}) + 1)) AS j FROM b)),
r AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
o AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {SPAN}, true)::INT AS opens FROM r),
k AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + {SPAN - 1} AS z FROM k GROUP BY doc_id, k),
e AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM s),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS y, string_agg(h[2 * y + 1 : 2 * a - 2], '' ORDER BY a) AS kept
    FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept || h[2 * y + 1 :], h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""

#: crc32 of a feature by the table of bytes, which are pairs of hexadecimal digits.
_BUCKET = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT)),
    lambda a, x: xor(a >> 8, {STEP.tolist()}[(xor(a, x) & 255) + 1]))) % {BUCKETS}"""
RESAMPLE = f"""
WITH w AS (SELECT doc_id, false AS target, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
    UNION ALL SELECT item_id, true, {_WORDS.format("coalesce(text, '')")} FROM benchmark),
g AS (SELECT doc_id, target, array_to_string(w[i : i + k], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 1)) AS i FROM (SELECT *, unnest([0, 1, 2]) AS k FROM w))),
c AS (SELECT doc_id, target, g, count(*) AS n FROM g GROUP BY ALL),
u AS (SELECT g, {_BUCKET} AS b FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM c)),
t AS (SELECT b, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM c JOIN u USING (g) GROUP BY b),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM t),
v AS (SELECT b, floor(1000 * ln((t::DOUBLE + 1) * (big_s + {BUCKETS}) / ((s::DOUBLE + 1) * (big_t + {BUCKETS}))))::BIGINT AS gain FROM t, z),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN u USING (g) JOIN v USING (b) WHERE NOT target GROUP BY doc_id),
x AS (SELECT w.doc_id, len(w) >= {MIN_WORDS} AS enough, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || sha256('{SEED}:' || w.doc_id)[1:8])::BIGINT AS h FROM w LEFT JOIN d USING (doc_id) WHERE NOT w.target),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS r, {PERCENT} * count(*) OVER (PARTITION BY enough) // 100 AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= n THEN r END::BIGINT AS rank FROM r
"""

NEIGHBOURS = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= {NEAREST}
"""

_SHARE = f"1 + {SHARE}::HUGEINT * ({{}} + 1) // ({{}} + v)"
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {_WORDS.format("coalesce(text, '')").replace("[^\\x00-\\x2F\\x3A-\\x60", "[^\\x00-\\x40\\x5B-\\x60")} AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
l AS (SELECT lang, sum(c) AS n, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format("coalesce(c.c, 0)", "s.n")} AS p, {_SHARE.format("k.c", "l.n")} AS q
    FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM o QUALIFY part = 'pair' OR rank <= {TOP}
"""

ORACLES = {
    "op3_langid": LANGID, "op4_decontam": DECONTAM, "op5_quality": QUALITY, "op8_lm": LM, "op9_suffix_dedup": SUFFIXES,
    "op11_resampling": RESAMPLE, "op12_neighbours": NEIGHBOURS, "op13_divergence": DIVERGENCE,
}
