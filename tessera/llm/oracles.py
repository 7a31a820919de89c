"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from tessera.llm import licenses, urls

OP5 = r"""
WITH d AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(w.weight, 1.0) AS weight
  FROM documents d LEFT JOIN (
    SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END) AS weight FROM labels GROUP BY doc_id
  ) w ON w.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY most / weight, source IS NULL, source) AS place FROM w
), t AS (
  SELECT source, source_size, CASE WHEN most <= level * weight THEN most
    ELSE weight * arg_min(level, place) FILTER (most > level * weight) OVER () END AS target FROM l
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken FROM p
"""

_HOST = r"translate(regexp_extract(coalesce({0}, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce({0}, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_QUERY = r"array_to_string(list_sort(list_filter(string_split(regexp_extract({0}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|\z)'))), '&')"


def _key(url: str) -> str:
    host, path, query = (x.format(url) for x in (_HOST, _PATH, _QUERY))
    return rf"CASE WHEN {host} <> '' THEN regexp_replace({host}, '^(www|m)\.', '') || regexp_replace({path}, '/+\z', '') || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def _rules() -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)


OP7 = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_key('url')} AS alias,
    list_concat(regexp_extract_all(coalesce(html, ''), '{urls.CANONICAL.replace("'", "''")}'), regexp_extract_all(coalesce(html, ''), '{urls.REFRESH.replace("'", "''")}')) AS tags
  FROM pages
), e AS (
  SELECT DISTINCT alias AS a, {_key("target")} AS b FROM (SELECT alias, regexp_extract(unnest(tags), '{urls.TARGET.replace("'", "''")}', 1) AS target FROM p)
), both_ways AS (
  SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL
), reach(a, b) AS (
  SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a
), part AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
), rules AS (
  SELECT * FROM (VALUES {_rules()}) AS r(verdict, host, path)
), fit AS (
  SELECT p.page_id, p.alias, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS own
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL
), blocked AS (
  SELECT DISTINCT coalesce(part.component, fit.alias) AS component FROM fit LEFT JOIN part ON part.a = fit.alias WHERE own = 'block' AND fit.alias IS NOT NULL
)
SELECT p.page_id, p.host, p.path, fit.rule,
  coalesce(fit.own, CASE WHEN coalesce(part.component, p.alias) IN (SELECT component FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN part ON part.a = p.alias
"""

_KNOWN = ", ".join(f"({k}, '{v}')" for k, v in licenses.SENTENCES.items())
_FITS = "[" + ", ".join(
    f"CASE WHEN contains(',' || sequence || ',', ',{','.join(map(str, r))},') THEN {{{{'rule': '{name}', 'licence': '{licence}'}}}} END" for name, licence, r in licenses.RULES
).replace("{{", "{").replace("}}", "}") + "]"

OP10 = rf"""
WITH s AS (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(translate(
    regexp_replace(coalesce(text, ''), '[.!?;:]+([ \t\r\f]|\z)', chr(10), 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), chr(10))) AS raw,
    generate_subscripts(string_split(regexp_replace(regexp_replace(translate(
    regexp_replace(coalesce(text, ''), '[.!?;:]+([ \t\r\f]|\z)', chr(10), 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), chr(10)), 1) AS at
  FROM documents
), known AS (
  SELECT * FROM (VALUES {_KNOWN}) AS k(number, sentence)
), f AS (
  SELECT s.doc_id, count(*) AS n_sentences, coalesce(string_agg(k.number::VARCHAR, ',' ORDER BY s.at) FILTER (k.number IS NOT NULL), '') AS sequence
  FROM s LEFT JOIN known k ON trim(s.raw) = k.sentence WHERE trim(s.raw) <> '' GROUP BY s.doc_id
), g AS (
  SELECT d.doc_id, coalesce(f.n_sentences, 0) AS n_sentences, coalesce(f.sequence, '') AS sequence
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN f USING (doc_id)
), h AS (
  SELECT *, list_filter({_FITS}, lambda x: x IS NOT NULL) AS hits FROM g
)
SELECT doc_id, n_sentences, sequence,
  array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.rule))), ',') AS rules,
  array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.licence))), ',') AS licenses
FROM h
"""

_TERMS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH t AS (
  SELECT doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE doc_id IS NOT NULL
), d AS (
  SELECT doc_id, terms, len(terms)::BIGINT AS n, row_number() OVER () AS row FROM t WHERE len(terms) > 0
), c AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d
), i AS (
  SELECT DISTINCT item_id, unnest(list_distinct({_TERMS.format("text")})) AS term FROM benchmark WHERE item_id IS NOT NULL
), o AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY row, term
), w AS (
  SELECT term, floor(1000 * ln((2 * c.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM o, c GROUP BY term, c.docs
), s AS (
  SELECT i.item_id, d.doc_id, d.row, sum(w.weight * ((1000000000 * o.tf) // (1000 * o.tf + 8 * (10 + (90 * d.n * c.docs) // c.total))))::BIGINT AS score
  FROM i JOIN o USING (term) JOIN w USING (term) JOIN d ON d.row = o.row, c GROUP BY i.item_id, d.doc_id, d.row
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""

ORACLES = {"op5_mix": OP5, "op7_urls": OP7, "op10_licenses": OP10, "op11_ranked": OP11}
