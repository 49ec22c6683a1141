"""The registered queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import (
    alignment, decontaminate, importance, jaccard_join, langid, line_dedup, merkle, multi_index, pieces, recurrent_lm, tool_calls, toxicity, warc)
from rollbook.llm.base import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard(table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("row.doc_id", "ids", "n_tokens", "round_trip"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op9_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.language_model(table(spark, sf_dir, "documents"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.from_conversations(table(spark, sf_dir, "conversations")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.alignment(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_n_chars()).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, payload,
             from_hex(sha1(payload))::BIT::VARCHAR AS bits,
             max(page_id) OVER (PARTITION BY payload) AS last_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
           + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM d
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(words) - 4, 0)), lambda i: array_to_string(words[i + 1:i + 5], ' '))) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(greatest(len(words) - 4, 0)), lambda i: array_to_string(words[i + 1:i + 5], ' '))) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INT) AS n_shared, CAST(n_item AS INT) AS n_item, count(*) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""

OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(words) - 2, least(len(words), 1))),
         lambda i: array_to_string(words[i + 1:i + 3], ' '))) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.size + q.size - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT w.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, min(r.reached) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY ALL
"""

OP10_SQL = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, length(coalesce(text, '')) AS size FROM conversations),
c AS (SELECT conv_id, turn, role, size, CAST(to_json(t) AS VARCHAR) AS query,
        CASE WHEN role = 'system' THEN 'setup' WHEN size % 3 = 0 THEN 'search' ELSE 'count' END AS name,
        CASE WHEN conv_id % 7 = 3 THEN CASE WHEN turn < 5 THEN turn + 2 END
             WHEN conv_id % 11 = 5 THEN CASE WHEN turn <= 3 THEN 4 - turn ELSE turn - 2 END
             WHEN turn > 2 THEN turn - 2 END AS needs
      FROM m WHERE role IN ('assistant', 'system')),
e AS (SELECT x.conv_id, x.turn AS a, y.turn AS b FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.needs = y.turn),
p AS (SELECT conv_id, turn AS a, turn AS b, 0 AS hops FROM c UNION
      SELECT p.conv_id, p.a, e.b, p.hops + 1 FROM p JOIN e ON e.conv_id = p.conv_id AND e.a = p.b WHERE p.hops < 20),
r AS (SELECT conv_id, a AS turn, max(b) AS ready, max(hops) AS hops FROM p GROUP BY ALL),
v AS (SELECT p.conv_id, p.a AS turn, max(p.hops) AS level FROM p JOIN r x ON x.conv_id = p.conv_id AND x.turn = p.a
      JOIN r y ON y.conv_id = p.conv_id AND y.turn = p.b WHERE x.ready = y.ready GROUP BY ALL),
u AS (SELECT m.conv_id, m.turn, m.turn - 1 AS called, CAST(to_json(m.t) AS VARCHAR) AS content FROM m WHERE role = 'user' AND turn > 0),
f AS (SELECT c.*, r.ready, CASE WHEN r.hops < 20 THEN v.level END AS level, 'call_' || c.conv_id || '_' || c.turn AS call_id,
        CASE WHEN c.needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c y WHERE y.conv_id = c.conv_id AND y.turn = c.needs)
             THEN 'missing dependency call_' || c.conv_id || '_' || c.needs END AS missing,
        CASE WHEN c.name = 'setup' THEN concat_ws('; ', CASE WHEN c.conv_id % 23 = 7 THEN 'arguments are no JSON object' END, 'unknown tool')
             WHEN c.conv_id % 23 = 7 THEN 'arguments are no JSON object'
             ELSE nullif(concat_ws('; ', CASE WHEN c.conv_id % 13 = 0 AND c.name = 'search' THEN 'missing field query' END,
               CASE WHEN c.conv_id % 17 = 1 THEN 'unknown field extra' END, CASE WHEN c.turn = 5 THEN 'value not allowed for unit' END,
               CASE WHEN c.conv_id % 9 = 4 THEN 'wrong type of size' END), '') END AS errors,
        CASE WHEN c.conv_id % 23 <> 7 THEN '"arguments":{' || CASE WHEN c.conv_id % 17 = 1 THEN '"extra":[1,2],' ELSE '' END
          || CASE WHEN c.conv_id % 13 = 0 THEN '' ELSE '"query":' || c.query || ',' END || '"size":'
          || CASE WHEN c.conv_id % 9 = 4 THEN '"' || c.size || '"' ELSE CAST(c.size AS VARCHAR) END
          || ',"unit":"' || CASE WHEN c.turn = 5 THEN 'byte' ELSE 'char' END || '"},' ELSE '' END AS arguments
      FROM c JOIN r USING (conv_id, turn) JOIN v USING (conv_id, turn))
SELECT f.conv_id, f.ready, CAST(f.level AS INT) AS level, f.turn, 0 AS part, f.call_id,
       CASE WHEN f.level IS NULL THEN 'cycle' WHEN f.missing IS NOT NULL THEN 'missing dependency' WHEN f.errors IS NOT NULL THEN 'invalid'
            WHEN u.turn IS NULL THEN 'no result' ELSE 'ok' END AS status,
       nullif(concat_ws('; ', f.errors, f.missing), '') AS errors,
       '{' || f.arguments || '"id":"' || f.call_id || '","name":"' || f.name || '","type":"tool_call"}' AS json
FROM f LEFT JOIN u ON u.conv_id = f.conv_id AND u.called = f.turn
UNION ALL
SELECT u.conv_id, f.ready, CAST(f.level AS INT), u.turn, 1, 'call_' || u.conv_id || '_' || u.called,
       CASE WHEN f.turn IS NULL THEN 'orphan' ELSE 'ok' END, NULL,
       '{"content":' || u.content || ',"id":"call_' || u.conv_id || '_' || u.called || '","type":"tool_result"}'
FROM u LEFT JOIN f ON u.conv_id = f.conv_id AND u.called = f.turn
"""

OP12_SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM s),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, k.pos, k.line, keeper IS NOT NULL AND keeper <> k.doc_id AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

OP13_SQL = """
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps),
v AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, n_chars, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS f FROM documents),
x AS (SELECT doc_id, grp, list_aggregate(list_transform(f, lambda s: coalesce(strlen(s) || ':' || s, '-')), 'string_agg', '') AS told,
             list_aggregate(list_transform([f[1], f[2], f[3], CAST(n_chars + 1 AS VARCHAR), f[5]], lambda s: coalesce(strlen(s) || ':' || s, '-')), 'string_agg', '') AS false_told
      FROM v),
l AS (SELECT doc_id, grp, sha256(told) AS leaf, sha256(false_told) AS false_leaf, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS idx,
             count(*) OVER (PARTITION BY grp) AS n FROM x),
t AS (SELECT grp, 0 AS level, idx, leaf AS h, n FROM l UNION ALL
      SELECT grp, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY grp, level, idx // 2, n),
s AS (SELECT grp, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, idx, subroot AS h, n FROM s UNION ALL
      SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, idx // 2, n),
w AS (SELECT l.doc_id, t.level AS step, CASE WHEN xor(l.idx >> t.level, 1) = b.idx THEN b.h END AS sibling, (l.idx >> t.level) % 2 = 1 AS at_left
      FROM l JOIN t ON t.grp = l.grp AND t.n > 1 AND t.idx = l.idx >> t.level
      LEFT JOIN t b ON b.grp = l.grp AND b.level = t.level AND b.idx = xor(l.idx >> t.level, 1)
      UNION ALL
      SELECT l.doc_id, s.height + u.level, b.h, (s.idx >> u.level) % 2 = 1
      FROM l JOIN s USING (grp) JOIN u ON u.n > 1 AND u.idx = s.idx >> u.level
      LEFT JOIN u b ON b.level = u.level AND b.idx = xor(s.idx >> u.level, 1)),
p AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM w GROUP BY doc_id),
m AS (SELECT doc_id, 0 AS step, CASE WHEN mod(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda a, b: xor(a >> 8, steps[xor(a & 255, b) + 1])), 4294967295), 7) = 0 THEN false_leaf ELSE leaf END AS h FROM l, c UNION ALL
      SELECT m.doc_id, m.step + 1, sha256(CASE WHEN w.at_left THEN coalesce(w.sibling, '') || m.h ELSE m.h || coalesce(w.sibling, '') END)
      FROM m JOIN w ON w.doc_id = m.doc_id AND w.step = m.step),
z AS (SELECT doc_id, max_by(h, step) AS folded_root FROM m GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, z.folded_root,
       z.folded_root = (SELECT h FROM u WHERE n = 1) AS verified
FROM l JOIN s USING (grp) LEFT JOIN p USING (doc_id) JOIN z USING (doc_id)
"""

QUERIES = {
    "op1_warc": (op1_warc, OP1_SQL),
    "op2_toxicity": (op2_toxicity, None),
    "op3_decontamination": (op3_decontamination, OP3_SQL),
    "op4_ngram_jaccard": (op4_ngram_jaccard, OP4_SQL),
    "op5_quality_resampling": (op5_quality_resampling, None),
    "op6_sentencepiece": (op6_sentencepiece, None),
    "op7_language_id": (op7_language_id, None),
    "op8_multi_index": (op8_multi_index, None),
    "op9_recurrent_lm": (op9_recurrent_lm, None),
    "op10_tool_calls": (op10_tool_calls, OP10_SQL),
    "op11_alignment": (op11_alignment, None),
    "op12_line_dedup": (op12_line_dedup, OP12_SQL),
    "op13_merkle": (op13_merkle, OP13_SQL),
}

#: The name under which the query over whole texts was registered first.
WHOLE = {"op10_tool_calls_whole_text": QUERIES["op10_tool_calls"]}
