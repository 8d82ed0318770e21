"""Chunks (inventory C)."""

from __future__ import annotations

from tessera.registry import sql

SIZE, OVERLAP, LEAST = 128, 16, 16


@sql
def chunk_fixed(d):
    """Windows of 128 words, 112 apart, none shorter than 16, a lone one neither; the last reaches the end."""
    step = SIZE - OVERLAP
    starts = d.sequence("0", f"greatest(n - 1 - {OVERLAP}, 0)", str(step))
    return f"""WITH w AS (SELECT doc_id, {d.words('text')} AS t FROM {d.table('documents')}), s AS (SELECT doc_id, t, {d.size('t')} AS n FROM w),
c AS (SELECT doc_id, t, n, {d.each(starts, 'pos0')} FROM s WHERE n > 0)
SELECT doc_id, CAST(pos0 AS BIGINT) AS start, CAST(least({SIZE}, n - pos0) AS BIGINT) AS n_words, md5({d.join(d.slice('t', 'CAST(pos0 AS INT) + 1', SIZE), ' ')}) AS chunk_md5
FROM c WHERE least({SIZE}, n - pos0) >= {LEAST}"""


@sql
def chunk_sanity(d):
    return f"SELECT doc_id, {d.size(d.words('text'))} / 112.0 < n_chars / (3.0 * {SIZE}) / 2 AS suspicious FROM {d.table('documents')}"


@sql
def chunk_prefix(d):
    return f"SELECT doc_id, concat('[', CASE WHEN length(source) + length(lang) > 8 THEN concat(substring(source, 1, 3), '…', lang) ELSE concat(source, ' > ', lang) END, ']') AS prefix FROM {d.table('documents')}"
