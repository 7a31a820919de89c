"""DuckDB twins of the registered queries, over the same Parquet tables."""

from __future__ import annotations

SID = "source || '-' || doc_id"
# Letters beyond ASCII become an ASCII word sign, so that an ASCII word boundary is exact.
WORDY = "regexp_replace({0}, '[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]', '_', 'g')"
PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z&''\-]+){0,3}\b"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_\-]*"


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda t: lower(t))"


def named_values(x: str) -> str:
    """Values of `path: value` lines with a name-like path."""
    rows = f"list_filter(string_split({x}, chr(10)), lambda l: contains(l, ':'))"
    path = "lower(split_part(l, ':', 1))"
    mark = " OR ".join(
        f"contains({path}, '{m}')" for m in ("name", "title", "course", "question", "hall", "sport")
    )
    kept = f"list_filter({rows}, lambda l: ({mark}) AND trim(substr(l, strpos(l, ':') + 1)) <> '')"
    return f"list_transform({kept}, lambda l: trim(substr(l, strpos(l, ':') + 1)))"


def all_phrases(x: str) -> str:
    return f"list_concat({named_values(x)}, regexp_extract_all({WORDY.format(x)}, '{PHRASE}'))"


def entity_cte(name: str, source: str, key: str, text: str, limit: int = 12) -> str:
    """CTE (key, tags): de-duplicated entities in order, [] when there are none."""
    return f"""{name}_all AS (
  SELECT {key}, u.tag, u.pos FROM {source}, unnest({all_phrases(text)}) WITH ORDINALITY AS u(tag, pos)),
{name}_first AS (
  SELECT {key}, tag, pos FROM {name}_all
  QUALIFY row_number() OVER (PARTITION BY {key}, lower(tag) ORDER BY pos) = 1),
{name}_few AS (
  SELECT {key}, tag, pos FROM {name}_first
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY pos) <= {limit}),
{name} AS (
  SELECT s.{key}, coalesce(list(f.tag ORDER BY f.pos) FILTER (WHERE f.tag IS NOT NULL), []) AS tags
  FROM {source} s LEFT JOIN {name}_few f USING ({key}) GROUP BY s.{key})"""


def domain(sid: str, text: str) -> str:
    return f"""CASE WHEN contains(lower({sid}), 'src1-') OR contains(lower({sid}), 'src2-') THEN 'accommodation'
    WHEN contains(lower({sid}), 'src3-') THEN 'sports'
    WHEN contains(lower({text}), ' und ') OR contains(lower({text}), ' der ') THEN 'courses'
    WHEN contains(lower({text}), ' que ') THEN 'finance'
    WHEN contains(lower({text}), ' with ') OR contains(lower({text}), ' from ') THEN 'admissions' END"""


def windows(sources: str, size: int, name: str = "chunks", section: str = "text") -> str:
    """CTEs turning (source_id, text) rows into chunks with ids."""
    return f"""{name}_lines AS (
  SELECT source_id, u.line, u.pos
  FROM ({sources}), unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)),
{name}_full AS (
  SELECT source_id, line, row_number() OVER (PARTITION BY source_id ORDER BY pos) - 1 AS n
  FROM {name}_lines WHERE regexp_matches(line, '\\S')),
{name}_text AS (
  SELECT source_id, CAST(floor(n / {size}) AS INTEGER) AS "order", string_agg(line, chr(10) ORDER BY n) AS text
  FROM {name}_full GROUP BY 1, 2),
{name} AS (
  SELECT sha1(source_id || ':' || "order" || ':' || substring(text, 1, 120)) AS chunk_id, source_id, "order",
    text, '{section}' AS section FROM {name}_text)"""


DOCS = f"SELECT {SID} AS source_id, text FROM documents"
LABELLED = f"{DOCS} WHERE doc_id IN (SELECT doc_id FROM labels)"
CHUNKS = windows(DOCS, 40)


def hash_vector(x: str, dim: int = 64) -> str:
    digest = f"[sha256({clean(x)} || '|0') || sha256({clean(x)} || '|1')]"
    byte = "CAST(('0x' || substr(d, i * 2 + 1, 2)) AS INTEGER)"
    scaled = f"{byte}::DOUBLE / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE"
    return f"list_transform({digest}, lambda d: list_transform(range({dim}), lambda i: {scaled}))[1]"


# The chunk table with domain and tags, and the same with vectors.
TAGGED = f"""{CHUNKS},
{entity_cte("ent", "chunks", "chunk_id", "text")},
kb AS (SELECT c.*, coalesce({domain("source_id", "text")}, 'unknown') AS domain, e.tags
  FROM chunks c JOIN ent e USING (chunk_id))"""

PLAIN_Q = f"""q AS (SELECT item_id AS query_id, {clean("text")} AS query_text, NULL::VARCHAR AS domain,
  NULL::VARCHAR AS source, []::VARCHAR[] AS tags, 32 AS k FROM benchmark)"""

PLANNED_Q = f"""{entity_cte("qent", "benchmark", "item_id", "text")},
planned AS (SELECT item_id AS query_id, {clean("text")} AS query_text, {domain("''", "text")} AS domain,
  NULL::VARCHAR AS source, qe.tags, 32 AS k, substr({clean("text")}, 1, 1) AS c
  FROM benchmark JOIN qent qe USING (item_id))"""


def vector_cte(name: str, queries: str, size: int = 32) -> str:
    return f"""{name}_s AS (
  SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(qv.v, cv.v), 6) AS score
  FROM {queries} q JOIN qvec qv ON qv.query_text = q.query_text
  JOIN kb c ON (q.domain IS NULL OR c.domain = q.domain) AND (q.source IS NULL OR c.source_id = q.source)
  JOIN cvec cv ON cv.chunk_id = c.chunk_id),
{name} AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM {name}_s QUALIFY rank <= {size})"""


VECTORS = f"""qvec AS (SELECT DISTINCT {clean("text")} AS query_text, {hash_vector("text")} AS v FROM benchmark),
cvec AS (SELECT chunk_id, {hash_vector("text")} AS v FROM kb)"""

WORDS = f"""kbw AS (SELECT chunk_id, domain, source_id, {tokens("text || ' ' || array_to_string(tags, ' ')")} AS words FROM kb),
total AS (SELECT count(*)::DOUBLE AS n, sum(len(words)) / count(*)::DOUBLE AS mean FROM kbw),
tf AS (SELECT chunk_id, domain, source_id, len, term, count(*) AS tf FROM (
  SELECT chunk_id, domain, source_id, len(words) AS len, unnest(words) AS term FROM kbw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def bm25_cte(name: str, queries: str, size: str = "32") -> str:
    return f"""{name}_q AS (
  SELECT query_id, domain, source, k, unnest(list_distinct({tokens("query_text")})) AS term FROM {queries}),
{name}_s AS (
  SELECT q.query_id, tf.chunk_id, any_value(q.k) AS k,
    round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
      / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM {name}_q q JOIN tf USING (term) JOIN df USING (term), total
  WHERE (q.domain IS NULL OR tf.domain = q.domain) AND (q.source IS NULL OR tf.source_id = q.source)
  GROUP BY 1, 2),
{name} AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM {name}_s WHERE score > 0 QUALIFY rank <= {size})"""


def scan_cte(name: str, queries: str, size: str = "32") -> str:
    return f"""{name}_t AS (
  SELECT chunk_id, domain, source_id, lower({clean("text")}) AS t, list_transform(tags, lambda x: lower(trim(x))) AS g FROM kb),
{name}_q AS (
  SELECT query_id, domain, source, lower(query_text) AS qt, {tokens("query_text")} AS toks FROM {queries}),
{name}_s AS (
  SELECT query_id, chunk_id, (3 * contains(t, qt)::INTEGER + len(list_filter(toks, lambda x: contains(t, x)))
    + 2 * list_contains(g, qt)::INTEGER)::DOUBLE AS score
  FROM {name}_q q JOIN {name}_t c ON (q.domain IS NULL OR c.domain = q.domain) AND (q.source IS NULL OR c.source_id = q.source)
  WHERE t <> ''),
{name} AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM {name}_s WHERE score > 0 QUALIFY rank <= {size})"""


def channel(c: str, weight: str) -> str:
    u = f"(CASE WHEN {c}_n <= 1 THEN 1.0::DOUBLE ELSE 1 - ({c}_rank - 1)::DOUBLE / ({c}_n - 1) END)"
    m = f"(CASE WHEN {c}_hi <= {c}_lo THEN 1.0::DOUBLE ELSE ({c}_score - {c}_lo) / ({c}_hi - {c}_lo) END)"
    return f"(CASE WHEN {c}_rank IS NULL THEN 0.0::DOUBLE ELSE {weight}::DOUBLE * (0.7::DOUBLE * {u} + 0.3::DOUBLE * {m}) END)"


FINAL = f"""round({channel("v", "0.55")} + {channel("t", "0.45")}
    + (CASE WHEN v_rank IS NOT NULL AND t_rank IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END)
    + (CASE WHEN coalesce(section, '') <> '' AND list_contains(boost_sections, lower(section)) THEN 0.15::DOUBLE ELSE 0 END)
    + least(0.1::DOUBLE * shared, 0.2::DOUBLE), 6)"""
ORDER = "score DESC, v_rank ASC NULLS LAST, t_rank ASC NULLS LAST, chunk_id"


def fuse_cte(name: str, vec: str, txt: str, queries: str, boosts: bool = True, top_k: str = "8") -> str:
    shared = "len(list_intersect(list_transform(c.tags, lambda x: lower(x)), list_transform(q.tags, lambda x: lower(x))))"
    sections = "['text']" if boosts else "[]::VARCHAR[]"
    return f"""{name}_v AS (SELECT *, count(*) OVER w AS n, min(score) OVER w AS lo, max(score) OVER w AS hi
  FROM {vec} WINDOW w AS (PARTITION BY query_id)),
{name}_t AS (SELECT *, count(*) OVER w AS n, min(score) OVER w AS lo, max(score) OVER w AS hi
  FROM {txt} WINDOW w AS (PARTITION BY query_id)),
{name}_m AS (
  SELECT query_id, chunk_id, v.rank AS v_rank, v.score AS v_score, v.n AS v_n, v.lo AS v_lo, v.hi AS v_hi,
    t.rank AS t_rank, t.score AS t_score, t.n AS t_n, t.lo AS t_lo, t.hi AS t_hi
  FROM {name}_v v FULL JOIN {name}_t t USING (query_id, chunk_id)),
{name}_b AS (
  SELECT m.*, c.section, c.source_id, c.domain, c.text, {sections} AS boost_sections, {shared if boosts else "0"} AS shared
  FROM {name}_m m JOIN kb c USING (chunk_id) JOIN {queries} q USING (query_id)),
{name}_f AS (SELECT *, {FINAL} AS score FROM {name}_b),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM {name}_f QUALIFY rank <= {top_k})"""


CHANNELS = "CASE WHEN v_rank IS NULL THEN 'text' WHEN t_rank IS NULL THEN 'vector' ELSE 'vector|text' END"


def search_cte(name: str, queries: str, boosts: bool = True) -> str:
    """Hybrid search of one query set: BM25, and the scan for queries without BM25 hits."""
    return f"""{vector_cte(name + "_near", queries)},
{bm25_cte(name + "_bm", queries)},
{name}_silent AS (SELECT * FROM {queries} WHERE query_id NOT IN (SELECT query_id FROM {name}_bm)),
{scan_cte(name + "_sc", name + "_silent")},
{name}_said AS (SELECT * FROM {name}_bm UNION ALL SELECT * FROM {name}_sc),
{fuse_cte(name, name + "_near", name + "_said", queries, boosts)}"""


KB = f"WITH {TAGGED},\n{VECTORS},\n{WORDS},\n{PLANNED_Q}"
HYBRID = f"{KB},\n{search_cte('h', 'planned')}"
RELAXED = f"""{KB},
q1 AS (SELECT query_id, query_text, tags, k,
  CASE WHEN c BETWEEN 'A' AND 'I' THEN 'nowhere' ELSE domain END AS domain,
  CASE WHEN c BETWEEN 'E' AND 'O' THEN 'missing' END AS source FROM planned),
{search_cte("a1", "q1")},
q2 AS (SELECT query_id, query_text, tags, k, NULL::VARCHAR AS domain, source FROM q1
  WHERE query_id NOT IN (SELECT query_id FROM a1)),
{search_cte("a2", "q2")},
q3 AS (SELECT query_id, query_text, tags, k, NULL::VARCHAR AS domain, NULL::VARCHAR AS source FROM q2
  WHERE query_id NOT IN (SELECT query_id FROM a2)),
{search_cte("a3", "q3", boosts=False)},
answers AS (
  SELECT query_id, 1 AS attempt, rank, chunk_id, score FROM a1 UNION ALL
  SELECT query_id, 2, rank, chunk_id, score FROM a2 UNION ALL
  SELECT query_id, 3, rank, chunk_id, score FROM a3)"""

SECOND = "lower(split_part(text, ' ', 2))"

TURNS = """asked AS (
  SELECT 'conv-' || u.conv_id AS source_id, u.turn AS pos, trim(u.text) AS q, trim(coalesce(a.text, '')) AS a
  FROM turns u LEFT JOIN turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user' AND trim(u.text) <> ''),
blocks AS (SELECT source_id, pos, 'Q: ' || q || chr(10) || 'A: ' || a AS block FROM asked)"""

ORDER_LINES = """lines AS (
  SELECT concat_ws('-', 'line', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE) AS source_id, [
    'order: ' || l_orderkey,
    'keys.part: ' || l_partkey,
    'keys.supplier: ' || l_suppkey,
    'numbers[0]: ' || l_quantity,
    'numbers[1]: ' || l_discount,
    'state[0].flag: ' || l_returnflag,
    'state[0].taxed: ' || CASE WHEN l_tax > 0.04 THEN 'True' ELSE 'False' END,
    'state[1].flag: ' || l_linestatus,
    'state[1].taxed: None'] AS ls FROM lineitem)"""

BATCHES = f"""{windows(DOCS, 40, "old")},
{windows(LABELLED, 40, "again")},
edited AS (SELECT chunk_id, source_id, "order", text, CASE WHEN length(text) > 400 THEN 'v2' ELSE 'v1' END AS version, 1 AS seq FROM again),
added AS (SELECT sha1(chunk_id) AS chunk_id, source_id, "order", text, 'v1' AS version, 1 AS seq FROM again),
batch AS (SELECT * FROM edited UNION ALL SELECT * FROM added
  UNION ALL SELECT chunk_id, source_id, "order", text, 'v3', 2 FROM again WHERE length(text) > 400),
fresh AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1)"""

FUSE_HITS = f"""WITH {entity_cte("ent", "documents", "doc_id", "text", 3)},
base AS (
  SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS query_id, doc_id, text, lang AS section, tags,
    CASE WHEN length(text) < 60 THEN '' ELSE 'c' || (length(text) // 16) END AS chunk_id,
    (length(text) // 16)::DOUBLE AS vs, len(string_split(text, ' '))::DOUBLE AS ts
  FROM documents JOIN ent USING (doc_id)),
hits AS (
  SELECT 'v' AS ch, query_id, chunk_id, vs AS score, text, section, tags,
    row_number() OVER (PARTITION BY query_id ORDER BY vs DESC, doc_id) AS rank FROM base QUALIFY rank <= 60
  UNION ALL
  SELECT 't', query_id, chunk_id, ts, text, section, tags,
    row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, doc_id) AS rank FROM base QUALIFY rank <= 60),
sized AS (
  SELECT *, count(*) OVER w AS n, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits
  WINDOW w AS (PARTITION BY query_id, ch)),
m AS (
  SELECT query_id, chunk_id,
    min(rank) FILTER (WHERE ch = 'v') AS v_rank, arg_max(score, rank) FILTER (WHERE ch = 'v') AS v_score,
    max(n) FILTER (WHERE ch = 'v') AS v_n, max(lo) FILTER (WHERE ch = 'v') AS v_lo, max(hi) FILTER (WHERE ch = 'v') AS v_hi,
    min(rank) FILTER (WHERE ch = 't') AS t_rank, arg_max(score, rank) FILTER (WHERE ch = 't') AS t_score,
    max(n) FILTER (WHERE ch = 't') AS t_n, max(lo) FILTER (WHERE ch = 't') AS t_lo, max(hi) FILTER (WHERE ch = 't') AS t_hi,
    arg_max(struct_pack(section := section, tags := tags),
      length(text) * 1000000 - (CASE WHEN ch = 't' THEN 1000 ELSE 0 END) - rank) AS p
  FROM sized WHERE chunk_id <> '' GROUP BY 1, 2),
q AS (SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS query_id, max(lang) AS lang FROM documents GROUP BY 1),
b AS (
  SELECT m.*, p.section AS section, list_distinct(['en', q.lang]) AS boost_sections,
    len(list_intersect(list_transform(p.tags, lambda x: lower(x)), ['the', 'in', 'de'])) AS shared
  FROM m JOIN q USING (query_id)),
f AS (SELECT *, {FINAL} AS score FROM b)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank, chunk_id, score,
  v_score AS vector_score, t_score AS text_score, {CHANNELS} AS channels, section
FROM f QUALIFY rank <= 12"""

def stored(chunks: str) -> str:
    """Rows of a stored chunk table."""
    return f"""SELECT chunk_id, source_id, "order", section, text, coalesce({domain("source_id", "text")}, 'unknown') AS domain, 'v1' AS version FROM {chunks}"""


EDITED = f"SELECT {SID} AS source_id, CASE WHEN length(text) > 200 THEN text || ' edited' ELSE text END AS text FROM documents"
CUSTOMERS = """SELECT 'customer-' || c_custkey AS source_id, c_acctbal < 0 AS changed, 'name: ' || CASE WHEN c_acctbal < 0 THEN 'new ' ELSE '' END || c_name
  || chr(10) || 'segment: ' || c_mktsegment AS text FROM customer"""


def inner(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt({inner(v, v)}))"


ORACLES = {
    "normalize_text": f"""SELECT doc_id, {clean("text")} AS clean_text,
      CASE WHEN length({clean("text")}) > 40 THEN substring({clean("text")}, 1, 40) || '...' ELSE {clean("text")} END AS preview
      FROM documents""",
    "tokenize_counts": f"""SELECT token, count(*) AS n FROM (SELECT unnest({tokens("text")}) AS token FROM documents)
      GROUP BY token""",
    "line_chunks": f'WITH {CHUNKS} SELECT source_id, "order", section, text FROM chunks',
    "chunk_ids": f'WITH {CHUNKS} SELECT chunk_id, source_id, "order" FROM chunks',
    "doc_profile": f"""WITH l AS (SELECT {SID} AS source_id, text, string_split(text, chr(10)) AS ls FROM documents),
      c AS (SELECT source_id, text, len(ls) - (ls[-1] = '')::INTEGER AS n_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '\\S'))) AS n_full_lines FROM l)
      SELECT source_id, length(text) AS n_chars, n_lines, n_full_lines, CAST(ceil(n_full_lines / 40) AS INTEGER) AS n_chunks FROM c""",
    "qna_blocks": f"WITH turns AS (SELECT * FROM conversations), {TURNS} SELECT source_id, pos, block FROM blocks",
    "qna_chunks": f"""WITH turns AS (SELECT conv_id, turn, role, replace(text, chr(10), '---') AS text FROM conversations), {TURNS},
      pieces AS (SELECT source_id, pos, trim(u.piece) AS text, u.i FROM blocks, unnest(string_split(block, '---')) WITH ORDINALITY AS u(piece, i)
        WHERE trim(u.piece) <> ''),
      n AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY pos, i) - 1 AS INTEGER) AS "order", text FROM pieces)
      SELECT source_id, "order", 'qna' AS section, text, sha1(source_id || ':' || "order" || ':' || substring(text, 1, 120)) AS chunk_id FROM n""",
    "json_flatten_props": """SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY id) - 1 AS INTEGER) AS pos, line FROM (
      SELECT event_id, j.id, substr(j.fullkey, 3) || ': ' || j.atom::VARCHAR AS line FROM events, json_tree(events.props) j
      WHERE j.type NOT IN ('OBJECT', 'ARRAY'))""",
    "json_flatten_nested": f"""WITH {ORDER_LINES}
      SELECT source_id, CAST(u.i - 1 AS INTEGER) AS pos, u.line AS line FROM lines, unnest(ls) WITH ORDINALITY AS u(line, i)""",
    "json_chunks": f"""WITH {ORDER_LINES},
      {windows("SELECT source_id, array_to_string(ls, chr(10)) AS text FROM lines", 4, section="json_fields")}
      SELECT source_id, "order", section, text, chunk_id FROM chunks""",
    "record_description": """SELECT p_partkey, concat_ws(chr(10), 'Hall name: ' || nullif(p_name, ''), 'Type: ' || nullif(p_type, ''),
      CASE WHEN p_size > 10 THEN 'Description: ' || p_brand END, 'Catering: self catered',
      'Services: ' || replace(p_name, ' ', '; '), CASE WHEN p_size > 20 THEN 'Facilities: ' || replace(p_type, ' ', '; ') END,
      'Room type: ' || p_brand || ', ' || CASE WHEN p_size > 25 THEN 'en-suite' ELSE 'shared bathroom' END || ', single occupancy, '
      || p_size || ' weeks tenancy, £' || p_retailprice || ' per week (£' || p_size || ' total)') AS text FROM part""",
    "rule_domain": f"""WITH {CHUNKS} SELECT chunk_id, coalesce({domain("source_id", "text")}, 'unknown') AS domain FROM chunks""",
    "domain_distribution": f"""WITH {CHUNKS} SELECT coalesce({domain("source_id", "text")}, 'unknown') AS domain, count(*) AS n_chunks
      FROM chunks GROUP BY 1""",
    "entities": f"""WITH {CHUNKS}, {entity_cte("ent", "chunks", "chunk_id", "text")}
      SELECT chunk_id, array_to_string(tags, '|') AS tags FROM ent""",
    "key_fields": f"""WITH {ORDER_LINES.replace("'keys.part", "'keys.name").replace("'numbers[", "'per_week_gbp[")},
      t AS (SELECT source_id, ls, list_filter(ls, lambda l: contains(l, 'per_week_gbp') OR contains(l, 'fees'))[1:3] AS prices FROM lines)
      SELECT source_id, true AS contains_price, false AS contains_entry_requirements, false AS contains_location,
        false AS contains_question_answer, array_to_string(prices, '|') AS sample_price_lines,
        split_part(list_filter(ls, lambda l: contains(l, '.name:'))[1], ': ', 2) AS sample_name FROM t""",
    "hash_embed": f"""SELECT source_id, CAST(u.i - 1 AS INTEGER) AS dim, round(u.x, 6) AS value
      FROM (SELECT {SID} AS source_id, {hash_vector("text")} AS v FROM documents WHERE {clean("text")} <> ''),
        unnest(v) WITH ORDINALITY AS u(x, i)""",
    "embedding_dims": """SELECT len(embedding) AS dim, count(*) AS n, len(embedding) = 64 AS matches_query FROM embeddings GROUP BY 1""",
    "cosine_pairs": f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {hash_vector("text")}), 6) AS similarity
      FROM embeddings JOIN documents ON doc_id = vec_id""",
    "model_tags": f"""WITH t AS (SELECT *, 'User From ' || user_id || ' with' AS text FROM events),
      b AS (SELECT *, coalesce({domain("event_type", "text")}, 'unknown') AS hint, CAST('0.' || json_extract_string(props, '$.k') AS DOUBLE) AS conf FROM t),
      a AS (SELECT *, event_type IN ('click', 'purchase', 'view') AS good FROM b)
      SELECT event_id, CASE WHEN good AND value < 5 THEN 'sports' ELSE hint END AS domain,
        CASE WHEN good THEN event_type || '|7|None' ELSE 'User From' END AS entity_tags,
        CASE WHEN good THEN json_extract_string(props, '$.k') END AS extra_k, 'false' AS flag,
        round(CASE WHEN good THEN greatest(0.35, conf) WHEN event_type = 'signup' THEN 0.6 ELSE 0.35 END::DOUBLE, 6) AS confidence
      FROM a""",
    "build_chunks": f"""WITH {TAGGED} SELECT chunk_id, source_id, 'txt' AS source_type, text, domain, array_to_string(tags, '|') AS tags,
      section, "order", 0.35::DOUBLE AS confidence, round({hash_vector("text")}[1], 6) AS first_value, 64 AS dim, 'v1' AS version FROM kb""",
    "cosine_topk": f"""WITH qv AS (SELECT item_id AS query_id, {hash_vector("text")} AS v FROM benchmark),
      s AS (SELECT query_id, vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM qv, embeddings)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""",
    "scan_search": f"""WITH {TAGGED}, {PLAIN_Q}, {scan_cte("s", "q")} SELECT query_id, chunk_id, score, rank FROM s""",
    "bm25_search": f"""WITH {TAGGED}, {PLAIN_Q}, {WORDS}, {bm25_cte("s", "q")} SELECT query_id, chunk_id, score, rank FROM s""",
    "word_postings": f"""WITH {TAGGED}, {WORDS} SELECT term, count(*) AS df, sum(len)::BIGINT AS tokens, sum(tf)::BIGINT AS tf, true AS dealt FROM tf GROUP BY term""",
    "refreshed_postings": f"""WITH {TAGGED}, {WORDS},
      r AS (SELECT chunk_id, CASE WHEN regexp_matches(source_id, '[27]$') THEN list_append(words, 'renewed') ELSE words END AS words
        FROM kbw WHERE NOT regexp_matches(source_id, '[05]$'))
      SELECT '' AS term, count(*) AS df, sum(len(words))::BIGINT AS tokens FROM r UNION ALL
      SELECT term, count(*), sum(n)::BIGINT FROM (SELECT unnest(list_distinct(words)) AS term, len(words) AS n FROM r) GROUP BY term""",
    "text_mode_ladder": f"""WITH {TAGGED}, {WORDS},
      q AS (SELECT item_id AS query_id, regexp_replace({SECOND}, '^.|[^a-z]', '', 'g') AS query_text, NULL::VARCHAR AS domain,
        NULL::VARCHAR AS source, 20 AS k FROM benchmark WHERE regexp_replace({SECOND}, '^.|[^a-z]', '', 'g') <> ''),
      {bm25_cte("b", "q", "20")},
      silent AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM b)),
      {scan_cte("s", "silent", "20")}
      SELECT query_id, chunk_id, score, rank, 'bm25' AS mode FROM b UNION ALL SELECT query_id, chunk_id, score, rank, 'scan' FROM s""",
    "metadata_filter": f"WITH {TAGGED} SELECT chunk_id, source_id, domain FROM kb WHERE domain IN ('courses', 'sports')",
    "candidate_sizes": """WITH n AS (SELECT item_id AS query_id, length(text) AS n FROM benchmark),
      t AS (SELECT query_id, n, greatest(1, least(50, n - 180)) AS top_k FROM n),
      s AS (SELECT query_id, top_k, CASE WHEN n > 200 THEN least(250, n) ELSE greatest(20, 4 * top_k) END AS vector_k,
        greatest(20, 4 * top_k) AS text_k FROM t)
      SELECT *, greatest(5 * vector_k, vector_k + 10) AS vector_pool FROM s""",
    "fuse_rank": FUSE_HITS,
    "hybrid_search": f"""{HYBRID}
      SELECT query_id, rank, chunk_id, source_id, domain, score, v_score AS vector_score, t_score AS text_score, {CHANNELS} AS channels FROM h""",
    "query_diagnostics": f"""{HYBRID}
      SELECT p.query_id, 8 AS top_k, CASE WHEN EXISTS (SELECT 1 FROM h_bm b WHERE b.query_id = p.query_id) THEN 'bm25' ELSE 'scan' END AS text_mode,
        (SELECT count(*) FROM h_near v WHERE v.query_id = p.query_id) AS vector_hits,
        (SELECT count(*) FROM h_said t WHERE t.query_id = p.query_id) AS text_hits,
        (SELECT count(*) FROM h e WHERE e.query_id = p.query_id) AS final_hits,
        'text' AS boost_sections,
        array_to_string(list_sort(list_distinct(list_transform(p.tags, lambda x: lower(x)))), '|') AS boost_entity_tags
      FROM planned p""",
    "relaxed_search": f"{RELAXED} SELECT * FROM answers",
    "relaxed_outcome": f"""{RELAXED} SELECT p.query_id, min(a.attempt) AS attempt_used, count(a.chunk_id) AS result_count
      FROM planned p LEFT JOIN answers a USING (query_id) GROUP BY 1""",
    "tag_overlap_boost": f"""WITH {entity_cte("d", "documents", "doc_id", "text")}, {entity_cte("b", "benchmark", "item_id", "text")},
      s AS (SELECT doc_id, len(list_intersect(list_transform(d.tags, lambda x: lower(x)), list_transform(b.tags, lambda x: lower(x)))) AS shared
        FROM d JOIN b ON doc_id = item_id)
      SELECT doc_id, shared, round(least(0.1::DOUBLE * shared, 0.2::DOUBLE), 6) AS boost FROM s""",
    "context_build": f"""{HYBRID} SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS context, count(*) AS n_chunks, true AS asks
      FROM h WHERE rank <= 3 GROUP BY 1""",
    "evidence_report": f"""{HYBRID}
      SELECT query_id, p.domain, (SELECT count(*) FROM h_near v WHERE v.query_id = p.query_id) AS vector_hits,
        count(h.chunk_id) AS result_count, string_agg(h.chunk_id, '|' ORDER BY h.rank) AS chunk_ids
      FROM planned p LEFT JOIN h USING (query_id) GROUP BY query_id, p.domain""",
    "tag_prompts": f"""WITH {CHUNKS} SELECT chunk_id, 'Source ID: ' || source_id || chr(10) || 'Source type: txt' || chr(10) || 'Hint domain: '
      || coalesce({domain("source_id", "text")}, 'unknown') || chr(10) || chr(10) || 'Chunk:' || chr(10) || text AS prompt FROM chunks""",
    "plan_clean": f"""WITH t AS (SELECT item_id AS query_id, text, {clean("text")} AS whole, length(text) AS n, {SECOND} AS w FROM benchmark),
      v AS (SELECT *, NOT (n > 260 OR (n > 200 AND n <= 220)) AND (n // 6) BETWEEN 1 AND 50 AND n <= 250 AS ok FROM t),
      w AS (SELECT *, strpos(lower(text), w) AS found, strpos(lower(text), 'zz') AS z FROM v)
      SELECT query_id, CASE WHEN ok THEN {clean("'  ' || w || '  x '")} ELSE whole END AS query_text, CASE WHEN ok THEN n // 6 ELSE 8 END AS top_k,
        CASE WHEN ok THEN 'sports' END AS domain, CASE WHEN ok THEN 'sports|finance' ELSE '' END AS domains,
        CASE WHEN ok THEN 'Fees' END AS section, CASE WHEN ok THEN 'Fees' ELSE '' END AS sections,
        CASE WHEN ok THEN (CASE WHEN w = '' THEN '' ELSE CASE WHEN found > 0 THEN substr(text, found, length(w)) ELSE w END || '|' END)
          || CASE WHEN z > 0 THEN substr(text, z, 2) ELSE 'Zz' END ELSE '' END AS entity_tags,
        CASE WHEN ok THEN 'a|b' ELSE '' END AS source_ids, CASE WHEN ok THEN n END AS vector_k,
        ok OR (n > 200 AND n <= 220) AS plan_valid FROM w""",
    "query_batch": """SELECT item_id AS query_id, text AS query_text, 5 AS top_k, CASE WHEN length(text) > 200 THEN 'v1' END AS version,
      CASE WHEN length(text) > 200 THEN '{"domains":["sports"],"version":"v1"}' ELSE '{"domains":["sports"]}' END AS filters FROM benchmark""",
    "shared_filter_batch": """SELECT item_id AS query_id, text AS query_text, 6 AS top_k,
      '{"domains":["sports"],"sections":["fees"]}' AS filters FROM benchmark""",
    "new_chunks_only": f"""WITH {windows(DOCS, 40, "a")}, {windows(LABELLED, 40, "s")}
      SELECT chunk_id, source_id, "order" FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.chunk_id = a.chunk_id)""",
    "upsert_chunks": f"""WITH {BATCHES} SELECT chunk_id, source_id, "order", 'v1' AS version FROM old
      WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh) UNION ALL SELECT chunk_id, source_id, "order", version FROM fresh""",
    "upsert_counts": f"""WITH {BATCHES} SELECT count(*) FILTER (WHERE o.chunk_id IS NULL) AS upserted_count,
      count(*) FILTER (WHERE o.chunk_id IS NOT NULL) AS matched_count,
      count(*) FILTER (WHERE o.chunk_id IS NOT NULL AND f.version <> 'v1') AS modified_count
      FROM fresh f LEFT JOIN old o ON o.chunk_id = f.chunk_id""",
    "upsert_by_business_key": """WITH n AS (SELECT o_custkey AS c_custkey, 'active-' || o_custkey AS c_name, max(o_totalprice) AS c_acctbal FROM orders GROUP BY 1)
      SELECT * FROM n UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""",
    "delete_source": f"""WITH {CHUNKS} SELECT chunk_id, source_id FROM chunks WHERE source_id NOT IN (
      SELECT {SID} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    "incremental_status": f"""WITH m AS (SELECT doc_id, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(text || '!') END AS h,
        CASE WHEN lang = 'en' THEN 'p1' ELSE 'p0' END AS p FROM documents JOIN labels USING (doc_id)),
      j AS (SELECT {SID} AS source_id, sha256(text) = h AS same, p = 'p1' AS pipe, h IS NULL AS fresh,
        (length(text) > 100)::BIGINT AS records_in_db FROM documents LEFT JOIN m USING (doc_id))
      SELECT source_id, records_in_db, coalesce(same AND pipe, false) AND records_in_db > 0 AS unchanged,
        CASE WHEN fresh THEN 'new' WHEN same AND pipe AND records_in_db > 0 THEN 'unchanged' WHEN NOT same THEN 'source_changed'
          WHEN NOT pipe THEN 'pipeline_changed' ELSE 'missing_records' END AS status FROM j""",
    "incremental_ingest": """SELECT 'customer-' || c_custkey AS source_id, CASE WHEN c_acctbal < 0 THEN 'source_changed' ELSE 'unchanged' END AS status,
      CASE WHEN c_acctbal < 0 THEN 'ingested' ELSE 'skipped' END AS action, (c_acctbal < 0)::BIGINT AS new_records, 1::BIGINT AS records_in_db
      FROM customer""",
    "payload_hash": """SELECT event_id::VARCHAR AS source_id, 'payload' AS source_path, sha256(replace(props, ' ', '')) AS source_hash FROM events""",
    "ingest_report": f"""WITH {CHUNKS} SELECT regexp_extract(source_id, '^src[0-9]+') AS collection, count(*) AS n_chunks,
      grouping(regexp_extract(source_id, '^src[0-9]+'))::INTEGER AS is_total FROM chunks GROUP BY ROLLUP (regexp_extract(source_id, '^src[0-9]+'))""",
    "compare_counts": f"""WITH {windows(DOCS, 40, "a")}, {windows(LABELLED, 40, "s")},
      x AS (SELECT source_id, count(*) AS n FROM a GROUP BY 1), y AS (SELECT source_id, count(*) AS n FROM s GROUP BY 1)
      SELECT source_id, coalesce(x.n, 0) AS local_records, coalesce(y.n, 0) AS stored_records FROM x FULL JOIN y USING (source_id)""",
    "table_health": f"""WITH {CHUNKS} SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS n_ids, count(*) - count(DISTINCT chunk_id) AS n_duplicates,
      0::BIGINT AS n_blank_ids, 0::BIGINT AS n_no_embedding, 64 AS min_dim, 64 AS max_dim, '' AS problems, true AS healthy FROM chunks""",
    "incremental_rows": f"""WITH {windows(CUSTOMERS.replace(", c_acctbal < 0 AS changed", ""), 30, section="json_fields")} {stored("chunks")}""",
    "ingest_summary": f"""WITH c AS ({CUSTOMERS}) SELECT count(*) AS total_sources_seen, count(*) FILTER (changed) AS ingested_sources,
      count(*) FILTER (NOT changed) AS skipped_sources, count(*) FILTER (changed) AS total_new_records, count(*) AS records_in_db FROM c""",
    "text_ingest": f"WITH {windows(EDITED, 40)} {stored('chunks')}",
    "keep_existing_ingest": f"""WITH {windows(DOCS, 40, "a")}, {windows(EDITED, 40, "b")},
      u AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM b)) {stored("u")}""",
    "qna_ingest": f"""WITH turns AS (SELECT * FROM conversations), {TURNS},
      pieces AS (SELECT source_id, pos, trim(u.piece) AS text, u.i FROM blocks, unnest(string_split(block, '---')) WITH ORDINALITY AS u(piece, i)
        WHERE trim(u.piece) <> ''),
      n AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY pos, i) - 1 AS INTEGER) AS "order", text FROM pieces),
      chunks AS (SELECT *, 'qna' AS section, sha1(source_id || ':' || "order" || ':' || substring(text, 1, 120)) AS chunk_id FROM n) {stored("chunks")}""",
    "json_file_sources": """WITH f AS (SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' || chr(10) AS json FROM supplier)
      SELECT sha256(json) AS source_hash, json FROM f""",
    "json_file_records": "SELECT s_suppkey, s_name AS name FROM supplier",
    "query_file": """SELECT text AS query_text, 5 AS top_k, NULL::VARCHAR AS domains FROM benchmark
      UNION ALL SELECT text, NULL, 'sports' FROM benchmark""",
    "write_previews": """SELECT sha1('nation-' || s_nationkey || ':0:' || substring(s_name, 1, 120)) AS chunk_id, 'nation-' || s_nationkey AS source_id,
      s_name AS text, 'nation-' || s_nationkey AS source FROM supplier""",
    "embedder_hook": f"""WITH d AS (SELECT {SID} AS source_id, {clean("text")} AS t FROM documents)
      SELECT source_id, length(t)::DOUBLE AS n_chars, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS n_e FROM d WHERE t <> ''""",
    "chunker_hook": f"""WITH s AS (SELECT source_id, u.s AS text, u.i FROM ({DOCS}), unnest(string_split(text, '. ')) WITH ORDINALITY AS u(s, i) WHERE u.s <> ''),
      n AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS INTEGER) AS "order", text FROM s)
      SELECT sha1(source_id || ':' || "order" || ':' || substring(text, 1, 120)) AS chunk_id, source_id, "order", 'sentence' AS section, text FROM n""",
    "ivf_label_cells": f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
      u AS (SELECT vec_id, label, {unit("v")} AS v FROM e),
      m AS (SELECT label, i, avg(v[i]) AS m FROM u, range(1, 65) t(i) GROUP BY ALL),
      c AS (SELECT label AS cell, list(m ORDER BY i) AS c FROM m GROUP BY label),
      qv AS (SELECT item_id AS query_id, {hash_vector("text")} AS v FROM benchmark),
      qu AS (SELECT query_id, {unit("v")} AS v FROM qv),
      placed AS (SELECT vec_id, arg_max(cell, {inner("v", "c")} - {inner("c", "c")} / 2) AS cell FROM u, c GROUP BY vec_id),
      probed AS (SELECT query_id, cell FROM qu, c
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {inner("v", "c")} - {inner("c", "c")} / 2 DESC) <= 2),
      s AS (SELECT query_id, vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(qv.v, e.v), 6) AS score
        FROM probed JOIN placed USING (cell) JOIN e USING (vec_id) JOIN qv USING (query_id))
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""",
}
ORACLES["ivf_all_cells"] = ORACLES["cosine_topk"]
ORACLES["answer_hook"] = f"""WITH p AS ({ORACLES["tag_prompts"]})
  SELECT chunk_id, CASE WHEN NOT contains(prompt, chr(10) || 'Hint domain: unknown' || chr(10)) THEN length(prompt) || ' characters' END AS answer FROM p"""
