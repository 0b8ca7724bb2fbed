"""The chunker as a recursive DuckDB query, for the oracles."""

from __future__ import annotations

from quarry.operators.chunking import BLANK_BACK, LOOK_BACK

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12)"


def _reach(text: str, low: str, high: str, pattern: str) -> str:
    """Where the last match of the pattern in [low, high) ends, null for none."""
    return f"({low}) + nullif(length(regexp_extract(substr({text}, CAST({low} AS BIGINT) + 1, CAST(({high}) - ({low}) AS BIGINT)), '(?s)^(.*{pattern})', 1)), 0)"


def _end(a: str) -> str:
    high, low = f"({a} + size)", f"greatest({a} + 1, {a} + size - {LOOK_BACK})"
    patterns = ("\\n\\s*\\n", "\\n", "[.!?。！？][\"''”’）)]*\\s*", "\\s+")
    return f"CASE WHEN {a} + size >= length(s) THEN length(s) ELSE coalesce({', '.join(_reach('s', low, high, p) for p in patterns)}, {high}) END"


def chunks(texts: str) -> str:
    """CTEs that end in ``pieces`` (key, part, a, content): the chunks of ``texts`` (key, part,
    text, size, overlap), a query."""
    back = "greatest(a + 1, b - overlap)"
    start = f"CASE WHEN overlap = 0 THEN b ELSE coalesce({_reach('s', f'greatest(a + 1, {back} - {BLANK_BACK})', back, chr(92) + 's')}, {back}) END"
    return f"""WITH RECURSIVE given AS ({texts}),
plain AS (SELECT key, part, trim(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), {_WHITE}) AS s, CAST(size AS BIGINT) AS size, CAST(overlap AS BIGINT) AS overlap FROM given),
walk AS (SELECT key, part, s, size, overlap, CAST(0 AS BIGINT) AS a, CAST({_end('0')} AS BIGINT) AS b FROM plain WHERE s <> ''
  UNION ALL SELECT key, part, s, size, overlap, a, CAST({_end('a')} AS BIGINT) FROM (SELECT key, part, s, size, overlap, CAST({start} AS BIGINT) AS a FROM walk WHERE b < length(s)) q),
cut AS (SELECT key, part, a, trim(substr(s, a + 1, b - a), {_WHITE}) AS content FROM walk),
pieces AS (SELECT key, part, a, content, row_number() OVER (PARTITION BY key ORDER BY part, a) - 1 AS n FROM cut WHERE content <> '')"""
