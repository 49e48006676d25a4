"""SQL for the corpus queries that SQL can express.

The rest (trained models, exact byte windows, packing, surrogates) is tested
against brute force, held-out accuracy or a round trip.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from .hamming_search import K, QUERY_STEP
from .jaccard_join import WORDS
from .line_dedup import MIN_CHARS, MIN_DOCS
from .mixing import BLOCK_WORDS, FEWEST, SEED, SHARD_ROWS, WEIGHTS
from .prefix_trie import FAMILY, OPENING
from .quality_rules import BOILERPLATE, BOILERPLATE_WORDS, MAX_LOSS_PERCENT, MAX_REPEAT_PERCENT, MIN_WORDS, NAVIGATION_WORDS, SHORT_LINE_WORDS, WINDOW
from .spelling import ALTERED, MIN_COUNT, TIMES
from .spelling import MIN_CHARS as MIN_CHARS_WORD
from .warc import REVISIT_BYTES

_WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"
_STOCK = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
_SYMBOLS = "length(regexp_replace(coalesce({0}, ''), '[^#*$%&|<>]', '', 'g'))"

OP2 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
                                      WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * common >= 4 * (x.n + y.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""

OP3 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN keeper IS NOT NULL AND payload_bytes >= {REVISIT_BYTES} AND page_id != keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id != keeper THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

OP4 = f"""
WITH words AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM documents),
base AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, {_SYMBOLS.format("text")} AS n_symbols FROM words),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
windows AS (SELECT doc_id, i, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))}) AS run, lead(word, {WINDOW - 1}) OVER o AS whole FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM windows WHERE whole IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM repeated) GROUP BY 1),
raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS num FROM documents),
measured AS (
  SELECT doc_id, line, num, lower(line) AS low, {_WORDS.format("line")} AS w, {_SYMBOLS.format("line")} AS sym,
         length(line) - length(replace(line, '|', '')) AS bars, length(line) - length(replace(line, '!', '')) AS bangs FROM raw),
lines AS (
  SELECT *, len(w) AS words, list_sum(list_transform(w, lambda x: length(x))) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY num) AS copy FROM measured WHERE len(w) > 0),
judged AS (
  SELECT *, 10 * sym > chars OR (words >= 3 AND bangs >= words) OR (words < {SHORT_LINE_WORDS} AND NOT regexp_matches(w[-1], '[.!?:;…"''\\)\\]”»。！？]$'))
            OR (bars >= 2 AND words - bars <= {NAVIGATION_WORDS} * (bars + 1)) OR (words <= {BOILERPLATE_WORDS} AND ({_STOCK})) AS failed FROM lines),
summed AS (
  SELECT doc_id, count(*) FILTER (copy > 1) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (failed) AS n_lines_removed, coalesce(sum(chars) FILTER (failed), 0) AS chars_removed FROM judged GROUP BY 1),
joined AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(chars_removed, 0)::BIGINT AS chars_removed
  FROM base LEFT JOIN covered USING (doc_id) LEFT JOIN summed USING (doc_id)),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * chars_removed <= {MAX_LOSS_PERCENT} * word_chars AS kept, n_lines, n_lines_removed, chars_removed FROM failed
"""

_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
OP8 = f"""
WITH keyed AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey, len({_WORDS.format("text")}) AS size, md5(concat_ws('|', doc_id::VARCHAR, md5(text), source)) AS same FROM documents),
lots AS (SELECT *, md5('{SEED}|' || same || '|' || (row_number() OVER (PARTITION BY same) - 1)) AS lot FROM keyed),
sized AS (SELECT *, ('0x' || substring(lot, 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM documents) / {SHARD_ROWS}.0))::BIGINT AS shard FROM lots),
per AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size, {_WEIGHT}::BIGINT AS weight FROM sized GROUP BY skey, source),
steps AS (
  SELECT *, source_size * 2 AS cap, row_number() OVER o AS pos,
         (sum(source_size) OVER () * 3 - coalesce(sum(source_size * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)::BIGINT AS left2,
         (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weight_left
  FROM per WINDOW o AS (ORDER BY source_size * 2 / weight, source NULLS LAST)),
fixed AS (SELECT pos AS f_at, left2 AS f_left2, weight_left AS f_weight FROM steps WHERE left2 * weight <= cap * weight_left * 2 ORDER BY pos LIMIT 1),
targets AS (SELECT skey, source_size, CASE WHEN pos < f_at THEN cap::DOUBLE ELSE (weight * f_left2)::DOUBLE / (f_weight * 2)::DOUBLE END AS target FROM steps, fixed),
cells AS (
  SELECT shard, skey, c.cell_size, c.blocks, CASE WHEN t.source_size > 0 THEN t.target * c.blocks / t.source_size ELSE 0 END AS cell_target
  FROM (SELECT shard, skey, sum(size)::BIGINT AS cell_size, greatest(1, round(sum(size) / {BLOCK_WORDS}.0), least(sum(size), {FEWEST}))::BIGINT AS blocks FROM sized GROUP BY 1, 2) c JOIN targets t USING (skey)),
seats AS (SELECT shard, skey, cell_target, unnest(range(1, ceil(cell_target * 2)::BIGINT + 60)) AS seat FROM cells WHERE cell_target > 0),
placed AS (SELECT shard, skey, row_number() OVER (PARTITION BY shard ORDER BY cell_target / (seat * 2 - 1) DESC, skey, seat) AS place FROM seats),
house AS (SELECT shard, round(sum(cell_target))::BIGINT AS seats FROM cells GROUP BY 1),
won AS (
  SELECT c.shard, c.skey, c.cell_size, c.blocks, least(coalesce(q.quota, 0), c.blocks * 2) AS quota
  FROM cells c LEFT JOIN (SELECT p.shard, p.skey, count(*) AS quota FROM placed p JOIN house h USING (shard) WHERE p.place <= h.seats GROUP BY 1, 2) q USING (shard, skey) WHERE c.cell_size > 0),
blocked AS (SELECT *, unnest(range(0, blocks)) AS block FROM won),
drawn AS (SELECT *, row_number() OVER (PARTITION BY shard, skey ORDER BY md5('{SEED}|' || skey || '|' || shard || '|' || block), block) AS place FROM blocked),
copied AS (
  SELECT *, quota // blocks + CASE WHEN place <= quota % blocks THEN 1 ELSE 0 END AS copies, (block * cell_size) // blocks AS start_at, ((block + 1) * cell_size) // blocks AS stop_at FROM drawn),
chosen AS (
  SELECT shard, skey, start_at, stop_at, copies, coalesce(sum(copies * (stop_at - start_at)) OVER (PARTITION BY shard, skey ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM copied),
streamed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY shard, skey ORDER BY lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM sized)
SELECT s.doc_id, s.size::BIGINT AS size, t.source_size, t.target,
       CASE WHEN s.size > 0 THEN (b.before + b.copies * (s.begin_at + s.size - b.start_at)) - (a.before + a.copies * (s.begin_at - a.start_at)) ELSE 0 END::BIGINT AS taken
FROM streamed s JOIN targets t USING (skey)
LEFT JOIN chosen a ON a.shard = s.shard AND a.skey = s.skey AND s.size > 0 AND s.begin_at >= a.start_at AND s.begin_at < a.stop_at
LEFT JOIN chosen b ON b.shard = s.shard AND b.skey = s.skey AND s.size > 0 AND s.begin_at + s.size - 1 >= b.start_at AND s.begin_at + s.size - 1 < b.stop_at
"""

OP9 = f"""
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0 AND NOT isnan(x)) AS code FROM embeddings WHERE len(embedding) = 64),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, len(list_filter(list_zip(q.code, r.code), lambda z: z[1] != z[2])) AS distance FROM codes q, codes r WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, rank::INT AS rank, vec_id, distance::BIGINT AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= {K}
"""

_AZ = f"'{ascii_uppercase}', '{ascii_lowercase}'"
OP11 = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS num FROM rows),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), {_AZ}) AS key FROM split),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (SELECT k.*, keeper IS NOT NULL AND doc_id != keeper AS gone FROM keyed k LEFT JOIN repeated USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY num) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM judged GROUP BY r
"""

# crc32 byte by byte, by the usual table of 256 remainders
_CRC_TABLE = "(SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"
_CRC = "xor(list_reduce([4294967295] || {0}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
_ASCII_BYTES = "list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)"

OP12 = f"""
WITH tab AS {_CRC_TABLE},
clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS turns FROM clean GROUP BY 1),
opened AS (SELECT conv_id, turns, {_CRC.format(_ASCII_BYTES.format("conv_id::VARCHAR"))} % {OPENING} AS h FROM convs, tab),
rebuilt AS (
  SELECT c.conv_id, CASE WHEN c.conv_id % {FAMILY} = 0 THEN c.turns ELSE list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) END AS t
  FROM opened c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
steps AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt),
paths AS (SELECT conv_id, d, t[1:d] AS p, len(t) = d AS last, CASE WHEN d > 0 THEN octet_length(encode(t[d].text)) ELSE 0 END AS n_bytes FROM steps),
nodes AS (SELECT d, p, min(conv_id) AS m, count(*) AS n_convs, any_value(n_bytes) AS n_bytes, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends FROM paths GROUP BY 1, 2),
visits AS (SELECT conv_id, d, m FROM paths JOIN nodes USING (d, p)),
edges AS (SELECT n.d, n.m, v.m AS parent FROM nodes n JOIN visits v ON v.conv_id = n.m AND v.d = n.d - 1),
children AS (SELECT d - 1 AS d, parent AS m, count(*) AS n_children FROM edges GROUP BY 1, 2),
full_nodes AS (SELECT n.d, n.m, n_convs, n_bytes, ends, parent, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN edges USING (d, m) LEFT JOIN children USING (d, m)),
below AS (SELECT DISTINCT a.d, a.m, b.d AS bd, b.m AS bm FROM visits a JOIN visits b ON a.conv_id = b.conv_id AND b.d >= a.d),
totals AS (
  SELECT below.d, below.m, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n_bytes)::BIGINT AS saved_tokens FROM below JOIN full_nodes f ON f.d = bd AND f.m = bm GROUP BY 1, 2)
SELECT m AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_nodes JOIN totals USING (d, m)
"""

_LATIN_BYTES = "flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END))"
OP13 = f"""
WITH RECURSIVE tab AS {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{MIN_CHARS_WORD},}}')) AS run FROM documents),
hashed AS (SELECT run, n, {_CRC.format(_LATIN_BYTES.format("doc_id::VARCHAR || ':' || run"))} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2), tab),
altered AS (SELECT CASE WHEN h % {ALTERED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= {MIN_CHARS_WORD} GROUP BY 1 HAVING sum(n) >= {MIN_COUNT}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, i, substr(word, 1, i - 1) AS front, substr(word, i + 1) AS back FROM places),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.front = b.front AND a.back = b.back AND a.word != b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.front || c.back
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.front || c.back),
best AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place FROM near JOIN words o ON o.word = other),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (word)),
follow AS (SELECT word, word AS reached, form AS next FROM formed UNION ALL SELECT f.word, g.word, g.form FROM follow f JOIN formed g ON g.word = f.next)
SELECT word, form, reached AS root, n, n_near, form_n FROM formed JOIN (SELECT word, reached FROM follow WHERE next IS NULL) USING (word)
"""

ORACLES: dict[str, str] = {
    "op2_jaccard_join": OP2,
    "op3_warc": OP3,
    "op4_quality_rules": OP4,
    "op8_source_mixing": OP8,
    "op9_exact_top_k": OP9,
    "op11_line_dedup": OP11,
    "op12_prefix_trie": OP12,
    "op13_spelling_variants": OP13,
}
