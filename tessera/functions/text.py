"""Text normal forms (inventory P, A)."""

from __future__ import annotations

from tessera.registry import sql

WS = r"\s+"


@sql
def sanitize_text(d):
    """Non-characters and private-use characters become spaces; each document is read as it is and with one of each put in (UTF-8 holds no lone surrogates)."""
    bad = "[\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}\\x{F000}-\\x{F8FF}]"
    t = "concat(text, CASE WHEN doc_id % 2 = 1 THEN '\uf0b7x\ufdd0' ELSE '' END)"
    return f"SELECT doc_id, md5({d.rx_sub(t, bad, ' ')}) AS clean_md5, CAST({d.size(d.rx_all(t, bad))} AS BIGINT) AS dropped FROM {d.table('documents')}"


@sql
def clean_body(d):
    """The body below a leading [title > section] line."""
    t = "concat('[', source, ' > ', lang, ']', chr(10), text)"
    return f"SELECT doc_id, md5({d.rx_sub(t, '^' + chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']' + chr(92) + 'n', '')}) AS body_md5 FROM {d.table('documents')}"


@sql
def body_key(d):
    """The same under every prefix line [title > section], which is cut before the hash; every third document has one."""
    t = "concat(CASE WHEN doc_id % 3 = 0 THEN concat('[', source, ' > ', lang, ']', chr(10)) ELSE '' END, text)"
    bare = d.rx_sub(d.rx_sub(t, "^" + chr(92) + "[[^" + chr(92) + "]]*" + chr(92) + "]" + chr(92) + "n", ""), WS, "")
    return f"SELECT doc_id, CASE WHEN length({bare}) >= 40 THEN md5({bare}) END AS body_key FROM {d.table('documents')}"


@sql
def dedup_key(d):
    bare = d.rx_sub("text", WS, "")
    return f"SELECT doc_id, CASE WHEN {bare} <> '' THEN md5({bare}) END AS dedup_key FROM {d.table('documents')}"


@sql
def clean_cell(d):
    cell = d.rx_sub("trim(text)", WS, " ")
    return f"SELECT doc_id, md5(replace({cell}, '|', '｜')) AS cell_md5 FROM {d.table('documents')}"


@sql
def render_table(d):
    return f"SELECT source, {d.ordered('CAST(doc_id AS STRING)', 'doc_id', ' | ')} AS line FROM {d.table('documents')} GROUP BY source"


@sql
def table_header(d):
    """A row of cells is a header if at least two are named and none is a number."""
    split = "split(line, r'\\|')" if d.name == "spark" else "string_split(line, '|')"
    named = d.filter("cells", "c", d.rx_has("c", "[^0-9.,% -]"))
    number = d.some_of("cells", "c", d.rx_has("c", "^[0-9.,% -]+$"))
    return f"""WITH l AS (SELECT doc_id, {d.each_at(d.lines('text'), 'pos', 'line')} FROM {d.table('documents')}),
c AS (SELECT doc_id, pos, {d.filter(d.map(split, 'c', 'trim(c)'), 'c', "c <> ''")} AS cells FROM l WHERE contains(line, '|'))
SELECT doc_id, CAST(pos AS BIGINT) AS pos, ({d.size(named)} >= 2 AND NOT {number}) AS header FROM c"""


@sql
def toc_runs(d):
    """Runs of at least three lines that end in a short word and a period stand for leader lines with page numbers."""
    return f"""WITH l AS (SELECT doc_id, {d.each_at(d.lines('text'), 'pos', 'line')} FROM {d.table('documents')}),
m AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l WHERE length(line) < 60)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS first_line, count(*) AS n FROM m GROUP BY doc_id, island HAVING count(*) >= 3"""


@sql
def heading_fallback(d):
    """Documents with fewer than three headings promote short lines without an end mark."""
    return f"""WITH l AS (SELECT doc_id, {d.each_at(d.lines('text'), 'pos', 'line')} FROM {d.table('documents')}),
h AS (SELECT doc_id, count(*) AS n_lines, {d.at_least_count(d.rx_has('line', '^#{1,6} '))} AS headings, {d.at_least_count('length(line) BETWEEN 1 AND 40')} AS short FROM l GROUP BY doc_id)
SELECT doc_id, n_lines, headings, CASE WHEN headings < 3 THEN short ELSE 0 END AS promoted FROM h"""


@sql
def lossless_check(d):
    """More than 30 % of the characters in excluded lines: the plain text is used."""
    return f"""WITH l AS (SELECT doc_id, {d.each(d.lines('text'), 'line')} FROM {d.table('documents')})
SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS body, CAST(sum(CASE WHEN contains(line, '|') THEN length(line) ELSE 0 END) AS BIGINT) AS excluded,
 sum(CASE WHEN contains(line, '|') THEN length(line) ELSE 0 END) > 0.3 * sum(length(line)) AS fallback FROM l GROUP BY doc_id"""


@sql
def serial_to_date(d):
    """Spreadsheet serials of the 1900 system; 60 is the day that never was."""
    date = f"{d.days('DATE ' + chr(39) + '1899-12-30' + chr(39), 'n')}"
    early = f"{d.days('DATE ' + chr(39) + '1899-12-31' + chr(39), 'n')}"
    return f"""WITH s AS (SELECT p_partkey, CAST(p_partkey % 50000 AS INT) AS n FROM {d.table('part')})
SELECT p_partkey, CASE WHEN n = 60 THEN '1900-02-29' WHEN n < 60 THEN CAST({early} AS STRING) ELSE CAST({date} AS STRING) END AS day FROM s"""


@sql
def sentence_split(d):
    # As many sentences as runs of end marks. A pattern that also takes the words is tried from every character of a tail without a mark where the engine goes back.
    sentence = "[.!?]+" if d.name == "spark" else "[^.!?]*[.!?]+"
    return f"SELECT doc_id, CAST({d.size(d.rx_all('text', sentence))} AS BIGINT) AS sentences FROM {d.table('documents')}"


@sql
def normal_form(d):
    return f"SELECT item_id, {d.rx_sub('lower(text)', '[^a-z0-9]', '')} AS norm FROM {d.table('benchmark')}"


@sql
def number_facts(d):
    """Numbers of two digits or more, or with a unit."""
    found = d.rx_all("text", "[0-9][0-9,.]*(?:%|km|kg)?")
    kept = d.filter(found, "n", "length(n) >= 2")
    return f"SELECT doc_id, {d.join(kept, ' ')} AS facts FROM {d.table('documents')}"


@sql
def cited(d):
    t = "concat('see [', CAST(doc_id % 5 AS STRING), '] and [', CAST(doc_id % 3 AS STRING), '] and [2]')"
    numbers = d.map(d.rx_all(t, "[0-9]+"), "n", "CAST(n AS INT)")
    return f"SELECT doc_id, {d.join(d.map(d.sorted(d.distinct(d.filter(numbers, 'n', 'n BETWEEN 1 AND 3'))), 'n', 'CAST(n AS STRING)'), ',')} AS cited FROM {d.table('documents')}"


@sql
def chat_template(d):
    return f"SELECT conv_id, turn, concat('<|', role, '|>', chr(10), text, chr(10), '<|end|>') AS prompt FROM {d.table('conversations')}"
