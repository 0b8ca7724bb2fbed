"""DuckDB SQL of line dedup, language ID and source mixing, each by a plainer way than its
operator's: the rows of a query and of its twin must be the same."""

from __future__ import annotations

from quarry.llm.language import OWN, PROFILE
from quarry.llm.mixing import BLOCK_ROWS

#: Lines as multisets of words; links by a join on prefixes of rare tokens, then all tokens.
OP6_SQL = r"""
WITH d0 AS (SELECT *, doc_id IS NULL OR count(*) OVER (PARTITION BY doc_id) > 1 AS shared FROM documents),
d1 AS (SELECT doc_id, text, row_number() OVER (ORDER BY shared, doc_id NULLS LAST, text NULLS FIRST) AS doc FROM d0),
l AS (SELECT doc, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM d1),
w AS (SELECT doc, line, list_sort(list_filter(string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '')) AS s FROM l),
c AS (SELECT s, min((doc, line)) AS first, row_number() OVER () AS id FROM w WHERE len(s) > 0 GROUP BY s),
e AS (SELECT id, first, len(s) AS n, unnest(list_transform(range(1, len(s) + 1), lambda i: s[i] || ' ' || (i - list_position(s, s[i])))) AS t FROM c),
f AS (SELECT t, count(*) AS many FROM e GROUP BY t),
r AS (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY many, t) AS place FROM e JOIN f USING (t)),
p AS (SELECT id, first, n, t FROM r WHERE place <= n - (4 * n + 4) // 5 + 1),
near AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.t = b.t AND a.first < b.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
sets AS (SELECT id, n, list(t) AS s FROM e GROUP BY id, n),
later AS (SELECT DISTINCT near.b AS id FROM near JOIN sets x ON x.id = near.a JOIN sets y ON y.id = near.b
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
gone AS (SELECT w.doc, w.line FROM w JOIN c USING (s) LEFT JOIN later USING (id) WHERE (w.doc, w.line) > c.first OR later.id IS NOT NULL),
g AS (SELECT doc, list(CAST(line AS INT) ORDER BY line) AS lines FROM gone GROUP BY doc)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INT) AS n_lines, CAST(coalesce(len(lines), 0) AS INT) AS n_removed, coalesce(lines, CAST([] AS INT[])) AS removed_lines
FROM d1 d LEFT JOIN g ON g.doc = d.doc"""

#: A row for each letter, its neighbours by windows; CRC-32 by its table.
OP7_SQL = rf"""
WITH tab AS (SELECT list(v ORDER BY n) AS tb FROM (SELECT n, list_reduce(list_prepend(n, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(n))),
d AS (SELECT doc_id, lang, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1]))) % 4 = 2 AS held_out,
    ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS s FROM documents, tab),
u AS (SELECT doc_id, unnest(string_split(s, '')) AS a, unnest(range(len(string_split(s, '')))) AS i FROM d WHERE s <> '  '),
n AS (SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT doc_id, a AS g FROM n WHERE a <> ' ' UNION ALL SELECT doc_id, a || b FROM n WHERE b IS NOT NULL UNION ALL SELECT doc_id, a || b || c FROM n WHERE c IS NOT NULL AND b <> ' '),
k AS (SELECT doc_id, g, count(*) AS many FROM x GROUP BY doc_id, g),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY many DESC, length(g), g) AS rank FROM k QUALIFY rank <= {OWN}),
prof AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(many) DESC, length(g), g) AS rank FROM k JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY rank <= {PROFILE}),
dist AS (SELECT own.doc_id, p.lang, sum(coalesce(least(abs(own.rank - prof.rank), {PROFILE}), {PROFILE})) AS apart, count(*) AS mine
    FROM own CROSS JOIN (SELECT DISTINCT lang FROM prof) p LEFT JOIN prof ON prof.lang = p.lang AND prof.g = own.g GROUP BY own.doc_id, p.lang),
best AS (SELECT doc_id, lang, 1.0 - CAST(apart AS DOUBLE) / CAST({PROFILE} * mine AS DOUBLE) AS score FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY apart, lang) = 1)
SELECT d.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM d LEFT JOIN best USING (doc_id)"""

# 64-bit arithmetic in 128 bits, by the published constants of xxHash (fixed values)
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_TOP = "18446744073709551616::UHUGEINT"


def _times(a: str, b: int) -> str:
    return f"(({a}) * {b}::UHUGEINT % {_TOP})"


def _turned(a: str, bits: int) -> str:
    return f"(({a}) * {1 << bits}::UHUGEINT % {_TOP} + ({a}) // {1 << (64 - bits)}::UHUGEINT)"


#: Earliest deadline first, slot after slot; rows in the order of xxhash64 (seed 42) of their ids.
OP9_SQL = f"""
WITH RECURSIVE h1 AS (SELECT doc_id, source, CASE WHEN doc_id < 0 THEN (doc_id::HUGEINT + 18446744073709551616)::UHUGEINT ELSE doc_id::UHUGEINT END AS v FROM documents),
h2 AS (SELECT doc_id, source, {_times("v", _P2)} AS v FROM h1),
h3 AS (SELECT doc_id, source, xor({(42 + _P5 + 8) % (1 << 64)}::UHUGEINT, {_times(_turned("v", 31), _P1)}) AS v FROM h2),
h4 AS (SELECT doc_id, source, ({_times(_turned("v", 27), _P1)} + {_P4}::UHUGEINT) % {_TOP} AS v FROM h3),
h5 AS (SELECT doc_id, source, {_times(f"xor(v, v // {1 << 33}::UHUGEINT)", _P2)} AS v FROM h4),
h6 AS (SELECT doc_id, source, {_times(f"xor(v, v // {1 << 29}::UHUGEINT)", _P3)} AS v FROM h5),
h7 AS (SELECT doc_id, source, xor(v, v // {1 << 32}::UHUGEINT) // {1 << 32}::UHUGEINT AS v FROM h6),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY v, doc_id) - 1 AS n FROM h7),
per AS (SELECT source, CASE WHEN regexp_full_match(source, 'src1?[0-9]') THEN CAST(substr(source, 4) AS BIGINT) % 5 + 1 ELSE 1 END AS w, max(n) // {BLOCK_ROWS} + 1 AS blocks FROM ranked GROUP BY source),
names AS (SELECT list({{'source': source, 'w': w, 'blocks': blocks}} ORDER BY coalesce(source, chr(0) || 'null')) AS every FROM per),
run(slot, i, r, k, d, share) AS (
    SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
    UNION ALL
    SELECT slot + 1, pick, r, k, list_transform(d, lambda v, n: v + CASE WHEN n = pick THEN 1 ELSE 0 END), share
    FROM (SELECT *, list_sort(list_filter(list_transform(range(1, len(share) + 1), lambda n: CASE WHEN d[n] < share[n] AND d[n] * total // share[n] <= k
            THEN [((d[n] + 1) * total + share[n] - 1) // share[n], n] END), lambda v: v IS NOT NULL))[1][2] AS pick
        FROM (SELECT slot, r, k, d, share, CAST(list_sum(share) AS BIGINT) AS total
            FROM (SELECT slot, CASE WHEN fresh THEN r + 1 ELSE r END AS r, CASE WHEN fresh THEN 0 ELSE k + 1 END AS k,
                    CASE WHEN fresh THEN list_transform(every, lambda s: CAST(0 AS BIGINT)) ELSE d END AS d,
                    CASE WHEN fresh THEN list_transform(every, lambda s: CAST(greatest(0, least(s.w, s.blocks - (r + 1) * s.w)) AS BIGINT)) ELSE share END AS share
                FROM (SELECT *, k + 1 >= coalesce(list_sum(share), 0) AS fresh FROM run, names)))
        WHERE total > 0)),
slots AS (SELECT slot, every[i].source AS source, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS block FROM run, names WHERE slot >= 0)
SELECT doc_id, ranked.source, slot AS mix_slot, CAST(n % {BLOCK_ROWS} AS INT) AS mix_row, block AS mix_block
FROM ranked JOIN slots ON slots.source IS NOT DISTINCT FROM ranked.source AND slots.block = ranked.n // {BLOCK_ROWS}"""
