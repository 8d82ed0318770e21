"""Metadata of documents (inventory M), on orders as documents and customers and suppliers as their people."""

from __future__ import annotations

from tessera.registry import sql

NAME = "substring(o_orderpriority, 3)"


def people(d):
    """(doc, name, role): author, editor and template of each order."""
    o, li = d.table("orders"), d.table("lineitem")
    return f"""ppl AS (SELECT o_orderkey AS doc, concat('p', CAST(o_custkey % 200 AS STRING)) AS name, 'author' AS role FROM {o}
UNION ALL SELECT DISTINCT l_orderkey, concat('p', CAST(l_suppkey % 200 AS STRING)), 'editor' FROM {li} WHERE l_linenumber = 1
UNION ALL SELECT DISTINCT l_orderkey, concat('p', CAST(l_partkey % 200 AS STRING)), 'template' FROM {li} WHERE l_linenumber = 2)"""


@sql
def people_sets(d):
    """Documents of both asked people; boost: the best role of each, added up."""
    return f"""WITH {people(d)}, b AS (SELECT doc, name, max(CASE role WHEN 'author' THEN 1.5 WHEN 'editor' THEN 0.8 ELSE 0.3 END) AS boost FROM ppl WHERE name IN ('p7', 'p11') GROUP BY doc, name)
SELECT doc, round(CAST(sum(boost) AS DOUBLE), 6) AS boost FROM b GROUP BY doc HAVING count(*) = 2"""


@sql
def people_of(d):
    return f"""WITH {people(d)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY CASE role WHEN 'author' THEN 1 WHEN 'editor' THEN 2 ELSE 3 END) AS k FROM ppl)
SELECT doc, name, role FROM r WHERE k = 1"""


@sql
def date_sets(d):
    """Created if it is trusted, else modified; an unknown date passes."""
    o, li = d.table("orders"), d.table("lineitem")
    return f"""WITH c AS (SELECT l_orderkey AS doc, min(l_shipdate) AS created, max(l_tax) AS conf FROM {li} GROUP BY l_orderkey),
x AS (SELECT o_orderkey AS doc, CASE WHEN conf >= 0.07 THEN created ELSE o_orderdate END AS moment, o_orderdate, created FROM {o} LEFT JOIN c ON c.doc = o_orderkey)
SELECT doc, CASE WHEN created >= TIMESTAMP '1995-01-01 00:00:00' AND created < TIMESTAMP '1996-01-01 00:00:00' THEN 1.0 ELSE 0.5 END AS boost
FROM x WHERE moment IS NULL OR (moment >= TIMESTAMP '1995-01-01 00:00:00' AND moment < TIMESTAMP '1996-01-01 00:00:00')"""


@sql
def dates_of(d):
    o, li = d.table("orders"), d.table("lineitem")
    return f"""WITH c AS (SELECT l_orderkey AS doc, min(l_shipdate) AS created FROM {li} GROUP BY l_orderkey)
SELECT o_orderkey AS doc, CASE WHEN {d.epoch('created')} > {d.epoch('o_orderdate')} + 3600 THEN NULL ELSE CAST(created AS DATE) END AS created,
 CASE WHEN {d.epoch('created')} > {d.epoch('o_orderdate')} + 3600 THEN 0.3 ELSE 0.9 END AS conf FROM {o} JOIN c ON c.doc = o_orderkey"""


CONDITIONS = "o_orderpriority LIKE '1%' AS is_format, o_orderstatus = 'F' AS is_type, o_custkey % 10 = 3 AS is_people, o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-03-01 00:00:00' AS is_date, o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-02-29 00:00:00' AS is_wide"


@sql
def meta_plan(d):
    return f"""WITH c AS (SELECT o_orderkey, {CONDITIONS} FROM {d.table('orders')})
SELECT o_orderkey AS doc, CAST(CASE WHEN is_people THEN 1.5 ELSE 0.0 END + CASE WHEN is_date THEN 1.0 ELSE 0.0 END + CASE WHEN is_type THEN 1.0 ELSE 0.0 END AS DOUBLE) AS boost FROM c WHERE is_format AND (is_date OR is_type)"""


@sql
def meta_relax(d):
    """The first rung of the ladder that leaves documents: all, without people, with a wider date, without type."""
    return f"""WITH c AS (SELECT o_orderkey % 40 AS query_id, o_orderkey, {CONDITIONS} FROM {d.table('orders')}),
l AS (SELECT query_id, {d.at_least_count('is_format AND is_type AND is_people AND is_date')} AS n0, {d.at_least_count('is_format AND is_type AND is_date')} AS n1,
 {d.at_least_count('is_format AND is_type AND is_wide')} AS n2, {d.at_least_count('is_format AND is_wide')} AS n3 FROM c GROUP BY query_id)
SELECT query_id, n0, n1, n2, n3, CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 1 WHEN n2 > 0 THEN 2 WHEN n3 > 0 THEN 3 ELSE 4 END AS relaxed FROM l"""


@sql
def meta_only(d):
    """Without residual text: boost, then newest, then path; the twenty first."""
    return f"""WITH c AS (SELECT o_orderkey, o_orderdate, concat('/o/', CAST(o_orderkey AS STRING)) AS path, {CONDITIONS} FROM {d.table('orders')}),
r AS (SELECT o_orderkey AS doc, path, row_number() OVER (ORDER BY CASE WHEN is_people THEN 1.5 ELSE 0.0 END DESC, o_orderdate DESC, path) AS place FROM c WHERE is_format AND is_type)
SELECT doc, path, CAST(place AS BIGINT) AS place FROM r WHERE place <= 20"""


@sql
def norm_person(d):
    name = d.rx_sub(d.rx_sub("lower(concat(' ', c_name, ' (team)'))", "@.*$", ""), "\\s*[(\\[][^)\\]]*[)\\]]\\s*", " ")
    return f"SELECT c_custkey, trim({name}) AS person FROM {d.table('customer')}"


@sql
def parse_date(d):
    """PDF dates to UTC; out of range: null."""
    raw = "concat('D:', CAST(1970 + doc_id % 60 AS STRING), '0823131638')"
    y = d.rx_get(raw, "^D:([0-9]{4})", 1)
    return f"SELECT doc_id, CASE WHEN CAST({y} AS INT) BETWEEN 1980 AND 2026 THEN concat({y}, '-08-23') END AS day FROM {d.table('documents')}"


@sql
def version_key(d):
    raw = "lower(concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' (1)' WHEN 1 THEN '_v2.1' WHEN 2 THEN '_final' ELSE ' 20240105' END))"
    key = d.rx_sub(d.rx_sub(d.rx_sub(raw, "\\s*\\([0-9]+\\)$", ""), "[ _-]*(v[0-9.]+|final|copy)$", ""), "[ _-]*(19|20)[0-9]{6}$", "")
    return f"SELECT p_partkey, trim({key}) AS version_key FROM {d.table('part')}"


@sql
def jaccard3(d):
    """Resemblance of two names by their groups of three characters."""
    grams = lambda c: d.distinct(d.map(d.sequence("1", f"greatest(length({c}) - 2, 1)"), "k", f"substring({c}, CAST(k AS INT), 3)"))
    return f"""WITH p AS (SELECT a.p_partkey, {grams('a.p_name')} AS x, {grams('b.p_name')} AS y FROM {d.table('part')} a JOIN {d.table('part')} b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round(CAST({d.size(d.both('x', 'y'))} AS DOUBLE) / ({d.size('x')} + {d.size('y')} - {d.size(d.both('x', 'y'))}), 6) AS jaccard FROM p"""


@sql
def pick_title(d):
    return f"""WITH p AS (SELECT p_partkey, p_name AS body, concat(p_name, ' ', p_brand) AS prop FROM {d.table('part')})
SELECT p_partkey, CASE WHEN contains(prop, body) OR contains(body, prop) THEN CASE WHEN length(prop) > length(body) THEN prop ELSE body END ELSE body END AS title,
 CASE WHEN contains(prop, body) THEN 'high' ELSE 'mid' END AS trust FROM p"""


@sql
def url_host(d):
    return f"SELECT page_id, {d.rx_get('url', '^[a-z]+://([^/:?#]+)', 1)} AS host FROM {d.table('pages')}"


@sql
def recv_kind(d):
    host = d.rx_get("url", "^[a-z]+://([^/:?#]+)", 1)
    return f"""WITH h AS (SELECT page_id, {host} AS host FROM {d.table('pages')})
SELECT page_id, CASE WHEN {d.rx_has('host', '^(10|192[.]168|127)[.]')} THEN 'intranet' WHEN host LIKE '%.org' THEN 'org' WHEN host LIKE '%.com' THEN 'web' ELSE 'other' END AS kind FROM h"""


@sql
def type_scores(d):
    """Title 3, folder 2, template 2; the best type from 3 on."""
    return f"""WITH rules AS (SELECT DISTINCT p_brand AS word FROM {d.table('part')}), s AS (
SELECT p_partkey, word, CASE WHEN contains(p_type, substring(word, 1, 3)) THEN 2 ELSE 0 END + CASE WHEN p_brand = word THEN 3 ELSE 0 END AS score FROM {d.table('part')} JOIN rules ON substring(word, 1, 5) = substring(p_brand, 1, 5)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, word) AS k FROM s WHERE score >= 3)
SELECT p_partkey, word AS type, CAST(score AS BIGINT) AS score FROM r WHERE k = 1"""


@sql
def inherited_docs(d):
    return f"""WITH g AS (SELECT source, lang FROM {d.table('documents')} GROUP BY source, lang HAVING count(DISTINCT md5(text)) >= 3)
SELECT doc_id FROM {d.table('documents')} x WHERE EXISTS (SELECT 1 FROM g WHERE g.source = x.source AND g.lang = x.lang)"""


@sql
def meta_scan_diff(d):
    """Two scans of a folder: what to read, what is gone; equal size and time are skipped."""
    t = d.table("documents")
    return f"""WITH old AS (SELECT doc_id, n_chars FROM {t} WHERE doc_id % 9 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM {t} WHERE doc_id % 11 <> 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'gone' WHEN o.doc_id IS NULL THEN 'new' ELSE 'changed' END AS op
FROM new n FULL OUTER JOIN old o ON o.doc_id = n.doc_id WHERE n.doc_id IS NULL OR o.doc_id IS NULL OR n.n_chars <> o.n_chars"""


@sql
def meta_stats(d):
    return f"SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS people, round(avg(o_totalprice), 4) AS mean FROM {d.table('orders')} GROUP BY o_orderpriority, o_orderstatus"


@sql
def top_people(d):
    return f"""WITH {people(d)}, c AS (SELECT name, count(DISTINCT doc) AS docs FROM ppl GROUP BY name), r AS (SELECT *, row_number() OVER (ORDER BY docs DESC, name) AS place FROM c)
SELECT name, docs, CAST(place AS BIGINT) AS place FROM r WHERE place <= 15"""


@sql
def dup_groups(d):
    return f"SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_doc FROM {d.table('documents')} GROUP BY md5(text) HAVING count(*) > 1"


@sql
def version_groups(d):
    return f"SELECT p_brand, substring(p_type, 1, 5) AS family, count(*) AS n, max(p_partkey) AS newest FROM {d.table('part')} GROUP BY p_brand, substring(p_type, 1, 5) HAVING count(DISTINCT p_name) > 1"


@sql
def alias_suggest(d):
    """Pairs of names that share documents: two points a shared document, one if either is frequent."""
    return f"""WITH {people(d)}, n AS (SELECT name, count(DISTINCT doc) AS docs FROM ppl GROUP BY name),
co AS (SELECT a.name AS a, b.name AS b, count(DISTINCT a.doc) AS shared FROM ppl a JOIN ppl b ON a.doc = b.doc AND a.name < b.name GROUP BY a.name, b.name)
SELECT co.a, co.b, 2 * shared + CASE WHEN x.docs >= 10 THEN 1 ELSE 0 END AS score FROM co JOIN n x ON x.name = co.a WHERE shared >= 3"""


@sql
def alias_dict(d):
    """Each name under its words in order, so that the order of names does not matter."""
    return f"SELECT c_custkey, {d.join(d.sorted(d.words('lower(c_name)')), ' ')} AS alias FROM {d.table('customer')}"


@sql
def show_one(d):
    return f"SELECT o_orderkey, o_totalprice FROM {d.table('orders')} WHERE concat('/o/', CAST(o_orderkey AS STRING)) LIKE '%/7' ORDER BY o_orderkey LIMIT 1"
