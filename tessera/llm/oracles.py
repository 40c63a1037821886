"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)
),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.s, p.n, win.item FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM place) p JOIN win ON p.win = win.win AND p.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
keyed AS (SELECT doc_id, s, md5_number(win) AS k FROM win),
least AS (SELECT k, min(doc_id) AS least FROM keyed GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM keyed JOIN least USING (k) WHERE doc_id > least),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[s:s + least(3, len(w)) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS s FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edge.b FROM reach JOIN edge ON reach.y = edge.a)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) m USING (doc_id)
"""

OP3 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq FROM r),
c AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq) AS said, coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&#124;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 13) AS chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c
"""

OP8 = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY coalesce(substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), ''), doc_id) - 1 AS idx FROM documents
),
s AS (SELECT source, count(*) AS n FROM d GROUP BY source),
e AS (SELECT source, w, row_number() OVER (ORDER BY w DESC, source) AS i FROM (SELECT source, greatest(1, CAST(floor(100 * sqrt(n) / sqrt((SELECT max(n) FROM s)) + 0.5) AS BIGINT)) AS w FROM s)),
a AS (SELECT list(w ORDER BY i) AS w, CAST(sum(w) AS BIGINT) AS period FROM e),
slot AS (
  SELECT CAST(0 AS BIGINT) AS slot, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS turn FROM a
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, j: x + CASE WHEN j = p THEN 1 ELSE 0 END), p, done[p]
  FROM (
    SELECT slot, done, CAST(list_min(list_transform(list_filter(list_transform(done, lambda x, j: {'d': ((x + 1) * period + w[j] - 1) // w[j], 'i': j, 'r': x * period // w[j]}), lambda y: y.r <= slot), lambda y: {'d': y.d, 'i': y.i})).i AS BIGINT) AS p
    FROM slot, a WHERE slot < period
  )
),
placed AS (SELECT d.doc_id, d.source, d.idx, d.idx // 16 AS block, e.w, e.i FROM d JOIN e USING (source)),
slotted AS (SELECT p.*, (p.block // p.w) * a.period + slot.slot - 1 AS spot FROM placed p JOIN slot ON slot.slot > 0 AND slot.i = p.i AND slot.turn = p.block % p.w, a)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(spot AS BIGINT) AS slot, row_number() OVER (ORDER BY spot, idx % 16) - 1 AS position FROM slotted
"""

_CRC = """
crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS t),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table
)"""

OP6 = f"""
WITH RECURSIVE {_CRC},
jump AS (
  SELECT doc_id, n, CAST(doc_id AS UHUGEINT) AS state, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents, (VALUES (40), (41)) v(n)
  UNION ALL
  SELECT doc_id, n, s, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((s >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM jump WHERE j < n)
),
shard AS (SELECT doc_id, max(b) FILTER (WHERE n = 40) AS shard, max(b) FILTER (WHERE n = 41) AS grown FROM jump WHERE j >= n GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, CAST(octet_length(encode(coalesce(d.text, ''))) + 16 AS BIGINT) AS size, crc.text_crc32, shard.shard, shard.grown,
    ((CAST(d.doc_id AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616) >> 54 AS bucket
  FROM documents d JOIN crc USING (doc_id) JOIN shard USING (doc_id)
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM sized
"""

OP11 = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents)
"""

# The checksum of each distinct feature once, byte by byte through the table of the polynomial.
OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS t),
feature AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(list_filter(string_split(regexp_replace(hex(encode(f)), '(..)', '\1,', 'g'), ','), lambda x: x <> ''), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table
),
s AS (SELECT bucket, count(*) AS n FROM df JOIN feature USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN feature USING (f) GROUP BY bucket),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT sum(n) FROM s) + 10000 AS DOUBLE) / (CAST(s.n + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket)
),
weighed AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM df JOIN feature USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(w) >= 20 AS eligible,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE eligible)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""

ORACLES = {"op1_decontaminate": OP1, "op2_substring_dedup": OP2, "op5_jaccard_join": OP5, "op3_chat_format": OP3, "op6_jump_shards": OP6, "op8_pfair_mixing": OP8, "op11_exact_dedup": OP11, "op12_importance_resampling": OP12}
