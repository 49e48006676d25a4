"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from ..functions.vocabulary import ALL_PREDICATES, CANONICAL, EXTENSIONS, LINK_EXTENSIONS, STOPWORDS, TECH_KEYWORDS, TWO_LETTER_TERMS, WHITELIST

DATA = "http://tessera.local/data/"
TERM = "http://tessera.local/terms#"
CATALOGUE = "http://www.wikidata.org/entity/"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}\\x0b\\x85]+|[\\s\\p{{Z}}\\x0b\\x85]+$', '', 'g')"


FACTS = f"""facts AS (
  SELECT *, substring(md5(subj_name || '|' || predicate || '|' || obj_name || '|{DATA}message/' || message_id), 1, 12) AS triple_id
  FROM (SELECT DISTINCT s_name AS subj_name, 'provides' AS predicate, p_name AS obj_name, {slug("s_name")} AS subj, {slug("p_name")} AS obj,
               l_orderkey AS message_id, o_custkey AS session, o_orderpriority || ' ' || o_orderstatus AS content
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey))"""
SESSIONS = """sessions AS (
  SELECT c_custkey AS session, c_mktsegment AS platform, min(o_orderdate) AS created, max(o_orderdate) AS modified, n_name AS project, 'customer/' || c_custkey AS source_file
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey, c_mktsegment, n_name)"""
MESSAGES = "messages AS (SELECT conv_id || '-' || turn AS message_id, conv_id AS session, turn AS seq, role, text AS content FROM conversations)"
CANDIDATES = """candidates AS (
  SELECT p_name AS query_label, rank, 'Q' || (p_partkey % 97) AS qid, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS label,
         p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' software framework' ELSE ' thing' END AS description,
         CASE WHEN p_partkey % 5 = 0 THEN [p_type, p_name] ELSE [p_type] END AS aliases
  FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rank FROM part) WHERE rank <= 5)"""
LINKS = f"""links AS (
  SELECT query_label AS label, '{CATALOGUE}' || qid AS same_as FROM candidates WHERE rank = 1
  UNION ALL SELECT DISTINCT p_name, 'entity/' || {slug("p_name")} FROM part)"""
STATIC = """static_facts AS (
  SELECT n_name AS subj_name, 'isPartOf' AS predicate, r_name AS obj_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT p_name, 'isTypeOf', p_type FROM part UNION SELECT p_name, 'builtWith', p_brand FROM part
  UNION SELECT s_name, 'deployedOn', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
LABELS = "labels AS (SELECT label, count(DISTINCT session) AS sources FROM (SELECT session, subj_name AS label FROM facts UNION ALL SELECT session, obj_name FROM facts) GROUP BY label)"
TECH = " OR ".join(f"contains(lower(description), '{w}')" for w in TECH_KEYWORDS)
SCORED = f"""scored AS (
  SELECT *, CASE WHEN lower(label) = lower(query_label) THEN 1 WHEN list_contains(list_transform(aliases, lambda a: lower(a)), lower(query_label)) THEN 2 WHEN {TECH} THEN 3 ELSE 4 END AS tier,
         CASE WHEN lower(label) = lower(query_label) THEN 1.0::DOUBLE WHEN {TECH} THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence, ({TECH}) AS tech FROM candidates)"""
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY tier, rank) AS place FROM scored) WHERE place = 1)"
CACHE = """cache AS (
  SELECT lower(query_label) AS label, CASE WHEN substring(qid, 2)::INT % 5 != 0 THEN qid END AS qid, CASE WHEN substring(qid, 2)::INT % 5 = 0 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence
  FROM candidates WHERE rank = 1 AND substring(qid, 2)::INT % 2 = 0)"""
SPLIT = "split AS (SELECT p.label, c.qid, c.confidence, c.label IS NOT NULL AS cached FROM (SELECT DISTINCT p_name AS label FROM part) p LEFT JOIN cache c ON lower(p.label) = c.label)"
MAP = "MAP {" + ", ".join(f"{text(a)}: {text(n)}" for a, n in CANONICAL.items()) + "}"
FACT_ROWS = f"""rows AS (
  SELECT '{DATA}triple/' || triple_id AS s, u.p, u.o, u.k AS o_kind FROM facts, LATERAL (SELECT unnest([
      {{'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'o': '{TERM}KnowledgeTriple', 'k': 'iri'}}, {{'p': '{TERM}tripleSubject', 'o': '{DATA}entity/' || subj, 'k': 'iri'}},
      {{'p': '{TERM}tripleObject', 'o': '{DATA}entity/' || obj, 'k': 'iri'}}, {{'p': '{TERM}triplePredicateLabel', 'o': predicate, 'k': 'literal'}},
      {{'p': '{TERM}extractedFrom', 'o': '{DATA}message/' || message_id, 'k': 'iri'}}, {{'p': '{TERM}extractedInSession', 'o': '{DATA}session/' || session, 'k': 'iri'}}], recursive := true)) u
  UNION SELECT '{DATA}entity/' || subj, '{TERM}' || predicate, '{DATA}entity/' || obj, 'iri' FROM facts
  UNION SELECT '{DATA}message/' || message_id, '{TERM}mentionsTopic', '{DATA}entity/' || subj, 'iri' FROM facts
  UNION SELECT '{DATA}message/' || message_id, '{TERM}mentionsTopic', '{DATA}entity/' || obj, 'iri' FROM facts
  UNION SELECT '{DATA}entity/' || e, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{TERM}Entity', 'iri' FROM names
  UNION SELECT '{DATA}entity/' || e, 'http://www.w3.org/2000/01/rdf-schema#label', name, 'literal' FROM names)"""
NAMES = "names AS (SELECT e, min(name) AS name FROM (SELECT subj AS e, subj_name AS name FROM facts UNION ALL SELECT obj, obj_name FROM facts) GROUP BY e)"
ITEMS = """listed AS (
  SELECT message_id, '[' || string_agg(item, ', ' ORDER BY item) || ']' AS arr, count(*) AS n FROM (
    SELECT message_id, '{"subject":"' || lower(subj_name) || '","predicate":"depends on","object":"' || obj_name || '"}' AS item FROM facts) GROUP BY message_id),
responses AS (
  SELECT message_id, n, CASE message_id % 4 WHEN 0 THEN arr WHEN 1 THEN '{"note": "x", "triples": ' || arr || '}' WHEN 2 THEN 'Here are the facts: ' || arr || ' Done.' ELSE substring(arr, 1, length(arr) - 8) END AS raw FROM listed)"""

# Unicode classes spelt out, since RE2's short classes are ASCII.
W, D = r"\p{L}\p{M}\p{N}_", r"\p{Nd}"


def rx(subject: str, pattern: str) -> str:
    return f"regexp_matches({subject}, {text(pattern)})"


def valid(n: str) -> str:
    ext = "|".join(e.replace(".", r"\.") for e in EXTENSIONS)
    rejects = [
        f"substring({n}, 1, 1) IN ('#', '@', '$', '*', '!', '~', '.', ':', '-')", f"starts_with({n}, '/') OR contains({n}, '\\')",
        rx(n, rf"(?i)^[{W}@./-][{W}./-]*\.({ext})$"), rx(n, rf"(?i)^[a-z]{D}{{2,}}(\.{D}+)?$"), rx(n, rf"(?i)^[a-z]+_{D}{{3}}_{D}{{3}}$"), rx(n, rf"(?i)^[a-z]+_{D}+$"),
        rx(n, r"^[a-z][a-z0-9]*(_[a-z0-9]+){2,}$"), rx(n, rf"^{D}+[\s\p{{Z}}]"), rx(n, rf"^{D}+\.{D}+"), rx(n, rf"^{D}+px"), rx(n, rf"^{D}+$"),
        rx(n, rf"^{D}{{1,3}}\.{D}{{1,3}}\.{D}{{1,3}}\.{D}{{1,3}}$"), rx(n, rf"(?i)^{D}+\s*(seconds?|minutes?|hours?|days?|ms|s|m|h|kb|mb|gb|tb)(?:[^{W}]|$)"),
        rx(n, r"(?i)^[0-9a-f]{6,}$"), rx(n, rf"^{D}+\s+[{W}]+s$"), rx(n, rf"(?i)^{D}+(st|nd|rd|th)(?:[^{W}]|$)"), rx(n, rf"^{D}+/{D}+"),
        rx(n, rf"(?i){D}+(px|vh|vw|em|rem|pt)(?:[^{W}]|$)"), f"contains({n}, '%')", rx(n, r"[\[\]]"), rx(n, "[()]"), f"length({n}) = 2",
        f"len(list_filter(regexp_split_to_array({n}, '\\s+'), lambda w: w != '')) > 3",
    ]
    return f"CASE WHEN length({n}) <= 1 OR {n} IN {among(STOPWORDS)} THEN false WHEN {n} IN {among(WHITELIST)} THEN true " + " ".join(f"WHEN {r} THEN false" for r in rejects) + " ELSE true END"


def linkable(n: str) -> str:
    ext = "|".join(e.replace(".", r"\.") for e in LINK_EXTENSIONS)
    path, letters = r"[a-zA-Z0-9_./-]+", rx(n, r"^\p{L}+$")
    rejects = [
        rx(n, rf"(?i)^[{W}./-]+\.(?:{ext})$"), rx(n, r"^[#@$*!~.:]+") + f" OR starts_with({n}, '--')", rx(n, rf"^{D}+\s"), rx(n, rf"^{D}+\.{D}"),
        f"length({n}) = 2 AND {letters} AND {n} NOT IN {among(TWO_LETTER_TERMS)}", f"length({n}) = 1", rx(n, r"[\[\]]"), rx(n, "[()]"), rx(n, "^@.+/"),
        rx(n, rf"(?i){D}+(?:(?:px|vh|vw|em|rem|pt)(?:[^{W}]|$)|%[{W}])"), rx(n, rf"{D}+%"), rx(n, rf"(?:^|[^a-zA-Z]){path}/{path}/{path}") + " OR " + rx(n, rf"^{path}/{path}$"),
        f"length({n}) <= 6 AND " + rx(n, rf"^[a-z]{D}{{2,}}") + f" AND NOT {letters}", rx(n, rf"^[a-z]+_{D}{{3}}_{D}{{3}}$"), rx(n, r"^[a-z][a-z0-9]*(_[a-z0-9]+){2,}$"), rx(n, rf"^[a-z]+_{D}+$"),
        f"starts_with({n}, '.')", f"contains({n}, '*')", rx(f"replace(replace({n}, '.', ''), '-', '')", rf"^{D}+$"), f"contains({n}, '=')", f"length({n}) <= 2 AND NOT " + rx(n, r"^[\p{L}\p{N}]"),
        f"starts_with({n}, '''') OR starts_with({n}, '\"')", rx(n, "^[%&]"), rx(n, rf"^{D}+x{D}+"),
    ]
    return f"CASE WHEN {n} = '' THEN false WHEN {n} IN {among(WHITELIST)} THEN true " + " ".join(f"WHEN {r} THEN false" for r in rejects) + " ELSE true END"


TOKENS = """tokens AS (
  SELECT DISTINCT token FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS token FROM documents
    UNION ALL SELECT lower(url) FROM pages UNION ALL SELECT unnest(regexp_split_to_array(lower(url), '[/?&]')) FROM pages) WHERE token != '')"""


def predicate(x: str) -> str:
    """Exact, camel case of the parts, any case, else the fallback."""
    parts = f"list_filter(regexp_split_to_array(lower({x}), '[_\\s-]+'), lambda p: p != '')"
    camel = f"coalesce({parts}[1], '') || array_to_string(list_transform({parts}[2:], lambda p: upper(p[1]) || p[2:]), '')"
    any_case = "MAP {" + ", ".join(f"{text(p.lower())}: {text(p)}" for p in ALL_PREDICATES) + "}"
    return f"CASE WHEN {x} IN {among(ALL_PREDICATES)} THEN {x} WHEN {camel} IN {among(ALL_PREDICATES)} THEN {camel} ELSE coalesce({any_case}[lower({x})], 'relatedTo') END"


def w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


ORACLES: dict[str, str] = {
    "c01_sessions": w(SESSIONS) + "SELECT session, platform, created, modified FROM sessions ORDER BY created NULLS FIRST, session",
    "c02_tool_calls": "SELECT event_id AS tool_id, event_type AS tool_name, ts AS created FROM events",
    "c03_topic_counts": w(FACTS) + "SELECT label, count(*) AS mentions FROM (SELECT message_id, subj AS e, subj_name AS label FROM facts UNION SELECT message_id, obj, obj_name FROM facts) GROUP BY label",
    "c04_thread": w(MESSAGES) + "SELECT session, seq, message_id, role, substring(content, 1, 100) AS snippet FROM messages WHERE role IN ('user', 'assistant')",
    "c05_tool_usage": "SELECT event_type AS tool_name, count(*) AS uses FROM events GROUP BY 1",
    "c06_entity_relations": w(FACTS) + "SELECT predicate, obj_name AS object_label, substring(content, 1, 120) AS snippet FROM facts WHERE lower(subj_name) = 'supplier#000000001'",
    "c07_relation_between": w(FACTS) + "SELECT predicate, substring(content, 1, 120) AS snippet FROM facts WHERE lower(subj_name) = 'supplier#000000001' AND lower(obj_name) = 'red plate'",
    "c08_cooccurrence": w(FACTS) + "SELECT subj_name AS label1, obj_name AS label2, count(DISTINCT triple_id) AS cooccurrences FROM facts WHERE subj != obj GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20",
    "c09_sessions_by_platform": w(SESSIONS) + "SELECT platform, count(*) AS sessions FROM sessions GROUP BY 1",
    "c10_cross_platform_entities": w(FACTS, SESSIONS) + "SELECT subj_name AS label, count(DISTINCT platform) AS platforms FROM facts JOIN sessions USING (session) GROUP BY 1 HAVING count(DISTINCT platform) > 1",
    "c11_triples_by_platform": w(FACTS, SESSIONS) + "SELECT platform, count(*) AS triples FROM facts JOIN sessions USING (session) GROUP BY 1",
    "c12_linked_entities": w(CANDIDATES, LINKS) + f"SELECT label, same_as FROM links WHERE starts_with(same_as, '{CATALOGUE}')",
    "c13_source_trace": w(SESSIONS) + "SELECT session, platform, source_file FROM sessions",
    "c14_sessions_by_project": w(SESSIONS) + "SELECT project AS project_label, count(*) AS sessions FROM sessions GROUP BY 1",
    "c15_hub_entities": w(FACTS) + "SELECT label, count(DISTINCT triple_id) AS degree FROM (SELECT subj_name AS label, triple_id FROM facts UNION ALL SELECT obj_name, triple_id FROM facts) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "c16_relates_contains": w(FACTS) + "SELECT DISTINCT predicate, substring(content, 1, 150) AS snippet FROM facts WHERE contains(lower(subj_name), '000001') AND contains(lower(obj_name), 'plate')",
    "c17_platform_lists": w(FACTS, SESSIONS) + "SELECT subj_name AS label, string_agg(DISTINCT platform, ', ' ORDER BY platform) AS platforms, count(DISTINCT platform) AS platform_count FROM facts JOIN sessions USING (session) GROUP BY 1 HAVING count(DISTINCT platform) > 1",
    "c18_link_lookup": w(CANDIDATES, LINKS) + f"SELECT label, same_as FROM links WHERE starts_with(same_as, '{CATALOGUE}') AND contains(lower(label), 'plate')",
    "c19_federated_description": w(CANDIDATES, LINKS) + f"SELECT l.label, l.same_as, c.description FROM links l JOIN (SELECT qid, min(description) AS description FROM candidates WHERE rank = 1 GROUP BY qid) c ON l.same_as = '{CATALOGUE}' || c.qid WHERE contains(lower(l.label), 'plate')",
    "c20_triple_count": w(FACTS, NAMES, FACT_ROWS) + "SELECT count(*) AS triples FROM rows",
    "a15_linear_parents": w(MESSAGES) + "SELECT session, seq, message_id, lag(message_id) OVER (PARTITION BY session ORDER BY seq) AS parent_id FROM messages WHERE role IN ('user', 'assistant')",
    "a19_quality_gate": w(MESSAGES) + "SELECT session FROM messages GROUP BY 1 HAVING count(*) FILTER (length(trim(content)) > 30) >= 2",
    "a23_reify_triples": w(FACTS, NAMES, FACT_ROWS) + "SELECT p, o_kind, count(*) AS n, count(DISTINCT s) AS subjects, min(o) AS least_object FROM rows GROUP BY 1, 2",
    "a24_ntriples": w(STATIC) + f"SELECT DISTINCT '<{DATA}entity/' || {slug('subj_name')} || '> <http://www.w3.org/2000/01/rdf-schema#label> \"' || subj_name || '\" .' AS value FROM static_facts",
    "a26_extractable_messages": w(MESSAGES) + "SELECT message_id, length(content) AS length FROM messages WHERE role IN ('user', 'assistant') AND length(trim(content, ' ')) >= 30",
    "b01_normalize_entity": "SELECT doc_id, (line - 1)::INT AS line, rtrim(regexp_replace(lower(" + strip("raw") + "), '[\\s\\p{Z}\\x0b\\x85]+', ' ', 'g'), '.,;:') AS name FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)",
    "b02_normalize_predicate": "SELECT raw, " + predicate("raw") + " AS predicate FROM (SELECT DISTINCT unnest(['Depends ' || string_split(p_type, ' ')[1], 'depends_on', 'BUILTWITH', 'is-part-of', 'de_pends_on', p_type]) AS raw FROM part UNION ALL SELECT DISTINCT event_type FROM events)",
    "b04_valid_entities": w(TOKENS) + f"SELECT token, {valid('token')} AS valid FROM tokens",
    "b05_linkable_entities": w(TOKENS) + f"SELECT token, {linkable('token')} AS linkable FROM tokens",
    "b08_truncation_flags": w(FACTS, ITEMS) + "SELECT message_id, message_id % 4 = 3 AS truncated FROM responses",
    "b09_salvage": w(FACTS, ITEMS) + "SELECT message_id, (n - 1)::INT AS complete FROM responses WHERE message_id % 4 = 3",
    "b10_parse_responses": w(FACTS, ITEMS) + f"""SELECT message_id, len(f)::INT AS n, array_to_string(f, ';') AS facts FROM (
  SELECT r.message_id, CASE WHEN r.message_id % 4 = 3 AND r.n = 1 THEN NULL ELSE coalesce(i.f, []) END AS f FROM responses r LEFT JOIN (
    SELECT message_id, list(item ORDER BY place)[1:10] AS f FROM (
      SELECT message_id, lower(subj_name) || '|dependsOn|' || obj_name AS item, subj_name, obj_name, row_number() OVER (PARTITION BY message_id ORDER BY lower(subj_name) || '","predicate":"depends on","object":"' || obj_name || '"}}') AS place, count(*) OVER (PARTITION BY message_id) AS n
      FROM facts) WHERE (message_id % 4 != 3 OR place < n) AND {valid('lower(subj_name)')} AND {valid('obj_name')} GROUP BY message_id) i USING (message_id))""",
    "b11_extract": w(FACTS) + f"""SELECT a.message_id, substring(sha256(a.content), 1, 16) AS text_hash, least(10, count(b.obj))::INT AS facts, 0::INT AS truncations FROM (
  SELECT message_id, 'In this order ' || max(content) || ' applies. ' || string_agg(lower(replace(subj_name, '#', ' ')) || ' provides ' || obj_name, '. ' ORDER BY lower(replace(subj_name, '#', ' ')) || ' provides ' || obj_name) AS content FROM facts GROUP BY message_id) a
LEFT JOIN (SELECT message_id, trim(split_part(sentence, ' provides ', 1)) AS subj, trim(split_part(sentence, ' provides ', 2)) AS obj FROM (
  SELECT message_id, unnest(string_split(substring('In this order ' || max(content) || ' applies. ' || string_agg(lower(replace(subj_name, '#', ' ')) || ' provides ' || obj_name, '. ' ORDER BY lower(replace(subj_name, '#', ' ')) || ' provides ' || obj_name), 1, 1500), '.')) AS sentence
  FROM facts GROUP BY message_id) WHERE trim(split_part(sentence, ' provides ', 2)) != '') b ON a.message_id = b.message_id AND ({valid("b.subj")}) AND ({valid("b.obj")}) GROUP BY 1, 2""",
    "b12_cache_misses": w(MESSAGES) + "SELECT message_id, substring(sha256(content), 1, 16) AS text_hash FROM messages WHERE role IN ('user', 'assistant') AND length(trim(content, ' ')) >= 30 AND (session % 3 != 0 OR session % 2 != 0)",
    "b_cap10": w(FACTS) + "SELECT session, triple_id, place::INT AS place FROM (SELECT session, triple_id, row_number() OVER (PARTITION BY session ORDER BY triple_id) AS place FROM facts) WHERE place <= 10",
    "b18_requests": w(MESSAGES) + "SELECT message_id, 8192::BIGINT AS max_tokens FROM messages WHERE role IN ('user', 'assistant') AND length(trim(content, ' ')) >= 30",
    "d01_alias_normalize": f"SELECT label, coalesce({MAP}[lower(trim(label))], trim(label)) AS canonical FROM (SELECT ' ' || upper(k) || ' ' AS label FROM (SELECT unnest(map_keys({MAP})) AS k) UNION ALL SELECT DISTINCT p_name FROM part)",
    "d02_entity_session_counts": w(FACTS, LABELS) + "SELECT label, sources FROM labels",
    "d03_min_sessions": w(FACTS, LABELS) + f"SELECT canonical, max(sources) AS sources FROM (SELECT coalesce({MAP}[lower(trim(label))], trim(label)) AS canonical, sources FROM labels) GROUP BY 1 HAVING max(sources) >= 40",
    "d04_entity_contexts": w(FACTS) + """SELECT label, 'appears in facts: ' || string_agg('"' || fact || '"', ', ' ORDER BY fact) AS context FROM (
  SELECT label, fact, row_number() OVER (PARTITION BY label ORDER BY fact) AS place FROM (
    SELECT DISTINCT subj_name || ' ' || predicate || ' ' || obj_name AS fact, unnest([lower(subj_name), lower(obj_name)]) AS label FROM facts)) WHERE place <= 5 GROUP BY label""",
    "d07_cache_hit_miss": w(CANDIDATES, CACHE, SPLIT) + "SELECT label, qid, cached FROM split",
    "d09_best_match": w(CANDIDATES, SCORED, BEST) + "SELECT query_label, qid, label FROM best",
    "d10_confidence": w(CANDIDATES, SCORED, BEST) + "SELECT query_label, confidence, array_to_string(aliases[1:5], '|') AS aliases FROM best",
    "d12_threshold": w(CANDIDATES, SCORED, BEST) + "SELECT query_label, qid FROM best WHERE confidence >= 0.7",
    "d13_link": w(FACTS, LABELS, CANDIDATES, SCORED, BEST, CACHE) + f"""SELECT query_label, qid, confidence FROM (
  SELECT n.label AS query_label, CASE WHEN c.label IS NOT NULL THEN c.qid ELSE b.qid END AS qid, CASE WHEN c.label IS NOT NULL THEN c.confidence ELSE b.confidence END AS confidence
  FROM (SELECT canonical AS label FROM (SELECT coalesce({MAP}[lower(trim(label))], trim(label)) AS canonical, max(sources) AS sources FROM labels GROUP BY 1) WHERE sources >= 2 AND {linkable('lower(canonical)')}) n
  LEFT JOIN cache c ON lower(n.label) = c.label LEFT JOIN best b ON b.query_label = n.label) WHERE qid IS NOT NULL AND confidence >= 0.7""",
    "d14_qid_dedup": w(CANDIDATES, SCORED, BEST) + "SELECT label, canonical, qid FROM (SELECT query_label AS label, min(query_label) OVER (PARTITION BY qid) AS canonical, qid FROM best WHERE confidence >= 0.7) WHERE label != canonical",
    "d15_snapshot_summary": w(CANDIDATES, CACHE, SPLIT) + "SELECT count(*) AS total, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached) AS uncached, count(*) FILTER (qid IS NOT NULL AND confidence >= 0.7) AS linked, count(*) FILTER (qid IS NOT NULL AND confidence >= 0.7) - count(DISTINCT qid) FILTER (qid IS NOT NULL AND confidence >= 0.7) AS duplicates FROM split",
    "d16_ambiguous": w(CANDIDATES, SCORED) + "SELECT query_label, string_agg(qid, ',' ORDER BY rank) AS qids FROM scored WHERE tech GROUP BY 1 HAVING count(*) > 1",
    "e01_summary_ratios": w(FACTS) + "SELECT count(*) AS facts, count(DISTINCT session) AS sessions, (SELECT count(DISTINCT e) FROM (SELECT subj AS e FROM facts UNION ALL SELECT obj FROM facts)) AS entities, (count(*) * 1000 // count(DISTINCT session))::BIGINT AS facts_per_session_milli FROM facts",
    "f07_ledger_delta": "SELECT 'page/' || page_id AS source, sha256(html) AS sha256 FROM pages WHERE page_id % 2 != 0 OR page_id % 4 = 0",
    "f_latest_per_session": "SELECT user_id AS session, max(event_id) AS tool_id, arg_max(event_type, event_id) AS tool_name FROM events GROUP BY 1",
    "f_replace_sessions": w(MESSAGES) + "SELECT session, message_id, content FROM messages WHERE session % 2 != 0 UNION ALL SELECT session, min(message_id), 'again' FROM messages WHERE session % 2 = 0 GROUP BY 1",
    "f_store_replace": w(MESSAGES) + "SELECT session, message_id, content FROM messages WHERE session % 2 != 0 UNION ALL SELECT session, min(message_id), 'again' FROM messages WHERE session % 2 = 0 GROUP BY 1",
    "f_store_append": "SELECT user_id AS session, event_id % 4 AS batch, count(*) AS n, min(event_type) AS least FROM events GROUP BY 1, 2",
    "f_stream_ingest": w(MESSAGES) + "SELECT 'conv-' || session AS session, message_id, role, CASE WHEN length(content) > 2000 THEN substring(content, 1, 2000) || '...' ELSE content END AS content FROM messages WHERE role IN ('user', 'assistant')",
    "x_shortest_connections": w(FACTS, STATIC).replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT DISTINCT * FROM (SELECT subj_name AS a, predicate AS p, obj_name AS b FROM facts UNION ALL SELECT subj_name, predicate, obj_name FROM static_facts) WHERE a != b),
steps AS (SELECT a AS from_name, p AS predicate, b AS to_name, true AS forward FROM e UNION ALL SELECT b, p, a, false FROM e),
links AS (SELECT DISTINCT from_name, to_name FROM steps),
near AS (SELECT 'Supplier#000000001' AS name, 0 AS d UNION SELECT to_name, d + 1 FROM near JOIN links ON from_name = name WHERE d < 3),
far AS (SELECT 'ASIA' AS name, 0 AS d UNION SELECT from_name, d + 1 FROM far JOIN links ON to_name = name WHERE d < 3),
n AS (SELECT name, min(d) AS d FROM near GROUP BY 1), f AS (SELECT name, min(d) AS d FROM far GROUP BY 1),
best AS (SELECT min(n.d + f.d) AS d FROM n JOIN f USING (name)),
sides AS (SELECT s.*, x.d + 1 AS step, (SELECT min(y.d) FROM f y WHERE y.name = s.to_name) AS rest FROM steps s JOIN n x ON x.name = s.from_name)
SELECT step, from_name, predicate, to_name, forward FROM sides, best WHERE step + rest = best.d""",
    "x_entailed": w(STATIC).replace("WITH ", "WITH RECURSIVE ", 1) + """, within AS (SELECT DISTINCT subj_name AS a, obj_name AS b FROM static_facts WHERE predicate IN ('isPartOf', 'deployedOn')),
own AS (SELECT a AS subj_name, 'isPartOf' AS predicate, b AS obj_name FROM within UNION SELECT subj_name, 'broader', obj_name FROM static_facts WHERE predicate = 'isTypeOf'),
reach AS (SELECT a, b FROM within UNION SELECT r.a, w.b FROM reach r JOIN within w ON r.b = w.a),
up AS (SELECT subj_name AS a, obj_name AS b FROM own WHERE predicate = 'broader'),
ups AS (SELECT a, b FROM up UNION SELECT r.a, u.b FROM ups r JOIN up u ON r.b = u.a)
SELECT * FROM own UNION SELECT a, 'dcterms:isPartOf', b FROM reach UNION SELECT b, 'dcterms:hasPart', a FROM reach UNION SELECT a, 'skos:broader', b FROM up UNION SELECT b, 'skos:narrower', a FROM up UNION SELECT a, 'skos:broaderTransitive', b FROM ups""",
    "x_stored_graph": w(STATIC) + f""", said AS (SELECT DISTINCT '{DATA}entity/' || {slug('subj_name')} AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, subj_name AS o, 'literal' AS o_kind FROM static_facts
  UNION SELECT '{DATA}entity/' || {slug('subj_name')}, '{TERM}' || predicate, '{DATA}entity/' || {slug('obj_name')}, 'iri' FROM static_facts
  UNION SELECT '{DATA}entity/' || {slug('subj_name')}, 'http://rdfs.org/sioc/ns#content', '"' || obj_name || '"\\' || chr(10), 'literal' FROM static_facts)
SELECT p, o_kind, count(*) AS n, min(o) AS least, count(DISTINCT s) AS subjects FROM said GROUP BY 1, 2 UNION ALL SELECT 'unreadable', '<broken> line .', 1, NULL, 1""",
    "x_paths": w(STATIC) + """SELECT 1 AS hops, subj_name || ' ' || predicate || ' ' || obj_name AS path, obj_name AS end_name FROM static_facts WHERE subj_name = 'Supplier#000000001'
UNION ALL SELECT 2, a.subj_name || ' ' || a.predicate || ' ' || a.obj_name || ' ' || b.predicate || ' ' || b.obj_name, b.obj_name FROM static_facts a JOIN static_facts b ON a.obj_name = b.subj_name WHERE a.subj_name = 'Supplier#000000001'
UNION ALL SELECT 3, a.subj_name || ' ' || a.predicate || ' ' || a.obj_name || ' ' || b.predicate || ' ' || b.obj_name || ' ' || c.predicate || ' ' || c.obj_name, c.obj_name FROM static_facts a JOIN static_facts b ON a.obj_name = b.subj_name JOIN static_facts c ON b.obj_name = c.subj_name WHERE a.subj_name = 'Supplier#000000001'""",
    "x_tool_usage_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS tool_name, count(*) AS uses FROM events GROUP BY 1, 2",
}

# The same questions, asked in SPARQL.
ORACLES["s15_sparql_hubs"] = ORACLES["c15_hub_entities"]
ORACLES["s17_sparql_platform_lists"] = ORACLES["c17_platform_lists"]

ORACLES["b21_collect"] = f"SELECT 'file-' || (message_id % 7) AS source_file, count(*) AS messages, sum(n)::BIGINT AS facts FROM ({ORACLES['b10_parse_responses']}) WHERE n IS NOT NULL GROUP BY 1"
