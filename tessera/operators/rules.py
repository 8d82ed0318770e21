"""Small rules over ranked lists, pages, people, vectors and files (inventory C11, C13, E6, F2, F5, F11, F16, F22, I3, M7, M8, R13, S27, V7, V10, V12)."""

from __future__ import annotations

from tessera.functions.metadata import people
from tessera.registry import sql
from tessera.sources.files import EXTENSIONS, files


@sql
def sentences(d):
    """Every sentence of every document: cut after . ! ? and the ideographic full stop where white space follows."""
    cut = d.rx_sub("text", "([.!?。])" + chr(92) + "s+", chr(92) + "1" + "<cut>")
    parts = f"split({cut}, '<cut>')" if d.name == "spark" else f"string_split({cut}, '<cut>')"
    return f"""WITH s AS (SELECT doc_id, {d.each_at(parts, 'pos', 'sentence')} FROM {d.table('documents')})
SELECT doc_id, CAST(pos AS BIGINT) AS pos, md5(sentence) AS sentence_md5, CAST(length(sentence) AS BIGINT) AS n_chars FROM s"""


@sql
def token_length(d):
    return f"SELECT doc_id, CAST({d.size(d.words('text'))} AS BIGINT) AS n_tokens FROM {d.table('documents')}"


@sql
def unscored_order(d):
    """A hit without a score stands after all scored ones, in its place in the list: score -100 - i. Short documents of a source have none."""
    return f"""WITH h AS (SELECT source, doc_id, CASE WHEN n_chars >= 200 THEN CAST(n_chars AS DOUBLE) / 1000 END AS score, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM {d.table('documents')}),
s AS (SELECT source, doc_id, coalesce(score, -100.0 - i) AS score FROM h)
SELECT source, doc_id, round(CAST(score AS DOUBLE), 6) AS score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS BIGINT) AS place FROM s"""


@sql
def meta_without_text(d):
    """Files known by their metadata alone (no parser reads .exe) whose name holds a word of an item: most words first, then by path, five of each item."""
    return f"""WITH {files(d)}, m AS (SELECT doc_id, path, {d.each(d.distinct(d.rx_all('lower(path)', '[a-z0-9]+')), 'w')} FROM f WHERE {d.rx_get('path', '[.]([^.]+)$', 1)} = 'exe'),
q AS (SELECT item_id, {d.each(d.distinct(d.rx_all("concat(lower(text), ' src', CAST(item_id % 20 AS STRING), ' exe')", '[a-z0-9]+')), 'w')} FROM {d.table('benchmark')}),
h AS (SELECT q.item_id, m.doc_id, m.path, count(*) AS hits FROM q JOIN m ON m.w = q.w GROUP BY q.item_id, m.doc_id, m.path),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, path) AS k FROM h)
SELECT item_id, doc_id, hits, CAST(k AS BIGINT) AS place FROM r WHERE k <= 5"""


@sql
def chunk_page(d):
    """A chunk's page: its own, or that of a span of one page, else the first page of its span, which is not exact. Spans are made of a document's number."""
    return f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 + 1 END AS page, CASE WHEN doc_id % 3 > 0 THEN doc_id % 40 + 1 END AS page_from, CASE WHEN doc_id % 3 = 1 THEN doc_id % 40 + 1 WHEN doc_id % 3 = 2 AND doc_id % 7 > 0 THEN doc_id % 40 + 3 END AS page_to FROM {d.table('documents')})
SELECT doc_id, CAST(coalesce(page, page_from) AS BIGINT) AS page, (page IS NOT NULL OR coalesce(page_from = page_to, FALSE)) AS exact FROM c"""


@sql
def source_resolution(d):
    """Where an asked file comes from: an indexed path, else an indexed text of the same hash (the smallest document), else it is read anew."""
    t = d.table("documents")
    return f"""WITH x AS (SELECT doc_id, concat('/a/', CAST(doc_id AS STRING)) AS path, md5(text) AS h FROM {t}),
asked AS (SELECT doc_id AS ask, CASE WHEN doc_id % 3 = 0 THEN concat('/a/', CAST(doc_id AS STRING)) ELSE concat('/b/', CAST(doc_id AS STRING)) END AS path, CASE WHEN doc_id % 3 = 2 THEN md5(concat(text, '!')) ELSE md5(text) END AS h FROM {t}),
hashed AS (SELECT h, min(doc_id) AS doc_id FROM x GROUP BY h)
SELECT a.ask, coalesce(p.doc_id, s.doc_id) AS doc_id, CASE WHEN p.doc_id IS NOT NULL THEN 'path' WHEN s.doc_id IS NOT NULL THEN 'hash' ELSE 'parse' END AS found_by
FROM asked a LEFT JOIN x p ON p.path = a.path LEFT JOIN hashed s ON s.h = a.h"""


@sql
def line_people(d):
    """Up to three different names of a document by the rank of their role, then by name."""
    return f"""WITH {people(d)}, b AS (SELECT doc, name, min(CASE role WHEN 'author' THEN 1 WHEN 'editor' THEN 2 ELSE 3 END) AS role FROM ppl GROUP BY doc, name),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY role, name) AS k FROM b)
SELECT doc, {d.ordered('name', 'k', ', ')} AS names FROM r WHERE k <= 3 GROUP BY doc"""


@sql
def find_dropped(d):
    """Indexed files whose extension is indexed no longer."""
    names = ", ".join(f"'{x}'" for x in EXTENSIONS)
    return f"WITH {files(d)} SELECT doc_id, path FROM f WHERE lower({d.rx_get('path', '[.]([^.]+)$', 1)}) NOT IN ({names})"


@sql
def people_or_text(d):
    """Documents that a person is named for in any role, and documents whose text holds the name; by which of the two."""
    own = "SELECT DISTINCT doc AS doc_id, 'role' AS how FROM ppl WHERE name IN ('p7', 'p11')"
    text = f"SELECT doc_id, 'text' AS how FROM {d.table('documents')} WHERE {d.rx_has('lower(text)', '(^|[^a-z0-9])(p7|p11|article)($|[^a-z0-9])')}"
    return f"WITH {people(d)}, u AS ({own} UNION ALL {text}) SELECT doc_id, count(*) AS ways, min(how) AS first_way FROM u GROUP BY doc_id"


@sql
def widened_dates(d):
    """Orders of 1996 with the condition as asked, widened by 1, 2 and 10 years on both sides, and switched off."""
    o = d.table("orders")
    years = f"SELECT o_orderkey AS doc, extract(year FROM o_orderdate) AS y FROM {o}"
    options = " UNION ALL ".join(f"SELECT {n} AS widen" for n in (0, 1, 2, 10, -1))
    return f"""WITH x AS ({years}), w AS ({options}) SELECT CAST(widen AS BIGINT) AS widen, count(*) AS docs, CAST(min(y) AS BIGINT) AS first_year, CAST(max(y) AS BIGINT) AS last_year
FROM w JOIN x ON widen = -1 OR y BETWEEN 1996 - widen AND 1996 + widen GROUP BY widen"""


@sql
def empty_scope(d):
    """Each folder asked for with its number of documents; a scope without any is told as such, not searched."""
    scopes = " UNION ALL ".join(f"SELECT '{s}' AS scope" for s in ("src1", "src19", "src99", ""))
    return f"""WITH s AS ({scopes}) SELECT s.scope, count(x.doc_id) AS docs, count(x.doc_id) = 0 AS empty_scope FROM s LEFT JOIN {d.table('documents')} x ON x.source = s.scope GROUP BY s.scope"""


@sql
def scroll_pages(d):
    """A scan of all rows in pages of 100 of each source: first and last id, rows, text."""
    return f"""WITH r AS (SELECT source, doc_id, length(text) AS n, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 100) AS page FROM {d.table('documents')})
SELECT source, CAST(page AS BIGINT) AS page, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY source, page"""


@sql
def matrix_upkeep(d):
    """Dead rows of each label's matrix (removed or replaced vectors); over a fifth of them asks for a rebuild."""
    return f"""WITH m AS (SELECT label, count(*) AS total, {d.at_least_count('vec_id % 7 = 0 OR vec_id % (label + 4) = 0')} AS dead FROM {d.table('embeddings')} GROUP BY label)
SELECT label, total, dead, dead > 0.2 * total AS rebuild FROM m"""


@sql
def pending_batches(d):
    """Chunks without a vector, document by document, in batches of 64."""
    return f"""WITH p AS (SELECT x.source, x.doc_id FROM {d.table('documents')} x WHERE NOT EXISTS (SELECT 1 FROM {d.table('embeddings')} e WHERE e.vec_id = x.doc_id AND e.vec_id % 3 > 0)),
n AS (SELECT *, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 64) AS batch FROM p)
SELECT source, CAST(batch AS BIGINT) AS batch, count(*) AS chunks, min(doc_id) AS first_id, max(doc_id) AS last_id FROM n GROUP BY source, batch"""


@sql
def pool_check(d):
    """Old vectors may be reused if about five evenly spaced ones of a label agree with new ones at cosine 0.95 or more; odd labels' new vectors are their successors'."""
    e = d.table("embeddings")
    return f"""WITH r AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM {e}),
s AS (SELECT * FROM r WHERE (5 * i) % n < 5), p AS (SELECT s.label, round({d.dot('s.embedding', 'o.embedding')}, 6) AS c FROM s JOIN {e} o ON o.vec_id = CASE WHEN s.label % 2 = 1 THEN s.vec_id + 1 ELSE s.vec_id END)
SELECT label, count(*) AS sampled, min(c) AS least, min(c) >= 0.95 AS reuse FROM p GROUP BY label"""


@sql
def excerpt_coverage(d):
    """How much of an item's excerpt the text at hand (the document of its number) holds: all if it holds it whole, else its share of 8-character groups."""
    grams = d.distinct(d.map(d.sequence("1", "greatest(length(x) - 7, 1)"), "k", "substring(x, CAST(k AS INT), 8)"))
    hit = d.filter("g", "y", "contains(body, y)")
    bare = lambda c: d.rx_sub(c, chr(92) + "s+", "")
    return f"""WITH p AS (SELECT i.item_id, {bare('i.text')} AS x, {bare('t.text')} AS body FROM {d.table('benchmark')} i JOIN {d.table('documents')} t ON t.doc_id = i.item_id),
g AS (SELECT item_id, x, body, {grams} AS g FROM p)
SELECT item_id, CASE WHEN contains(body, x) THEN 1.0 ELSE round(CAST({d.size(hit)} AS DOUBLE) / {d.size('g')}, 6) END AS coverage FROM g"""


@sql
def index_staleness(d):
    """Sources whose index is older than their last change: built at the latest of two thirds of the events, changed at the latest of all."""
    e = d.table("events")
    return f"""WITH s AS (SELECT event_type, max(CASE WHEN event_id % 3 > 0 THEN ts END) AS built_at, max(ts) AS changed_at FROM {e} GROUP BY event_type)
SELECT event_type, coalesce(built_at < changed_at, TRUE) AS stale FROM s"""
