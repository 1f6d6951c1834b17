"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treelift.llm.chat_format import canonical_turns, chat_digests
from treelift.llm.conversation_repair import repair_report
from treelift.llm.decontamination import contamination
from treelift.llm.embedding_dedup import link_embeddings
from treelift.llm.exact_dedup import exact_duplicates
from treelift.llm.hard_negatives import mine_hard_negatives
from treelift.llm.html_extract import main_texts
from treelift.llm.line_dedup import line_report
from treelift.llm.near_dedup import near_duplicates
from treelift.llm.packing import pack_documents
from treelift.llm.sharding import shard_documents
from treelift.llm.suffix_dedup import remove_repeats
from treelift.llm.toxicity import score_documents
from treelift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ip AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM ip),
dp AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp),
h AS (SELECT DISTINCT doc_id, item_id, n, p FROM dw JOIN iw USING (n, s)),
hw AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hr AS (
  SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS run
  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h)),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 800)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM d WHERE length(h) >= 800)),
r AS (SELECT doc_id, p FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
g AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
u AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY doc_id, run),
k AS (
  SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM u),
t AS (
  SELECT d.doc_id, any_value(d.h) AS h, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
         string_agg(substr(d.h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY run)
           || substr(any_value(d.h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
  FROM d JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"SELECT -1L AS conv_id, array(named_struct('role', 'user', 'content', '{said}'), "
        f"named_struct('role', 'assistant', 'content', '{said}')) AS messages"
    )
    given = canonical_turns(table(spark, sf_dir, "conversations"))
    return chat_digests(given.unionByName(canonical_turns(extra)))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|\[ROLE:|\[/ROLE\]'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
      ELSE 16 + length(base64(encode(role))) END AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INT) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5
"""


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations")).drop("n_rows")


#: The grammar has four states; the least (cost, audit) of each is carried from row to row.  DuckDB has no CRC-32, so it is worked out bit by bit.
OP12_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                               lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS how
  FROM k),
d AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM d),
o AS (
  SELECT conv_id, turn, p, role, text, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS f
  FROM n),
w AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, {'c': 0, 'a': ''} AS s0, {'c': 1000000000, 'a': ''} AS s1, {'c': 5, 'a': 'I'} AS s2, {'c': 10, 'a': 'II'} AS s3
  FROM o
  UNION ALL
  SELECT conv_id, p, n0, n1, m2, list_sort([n3, {'c': m2.c + 5, 'a': m2.a || 'I'}])[1]
  FROM (SELECT *, list_sort([n2, {'c': n0.c + 5, 'a': n0.a || 'I'}, {'c': n1.c + 5, 'a': n1.a || 'I'}, {'c': n3.c + 5, 'a': n3.a || 'I'}])[1] AS m2
    FROM (SELECT conv_id, p, {'c': s0.c + 2, 'a': s0.a || 'D'} AS n0,
        list_sort([{'c': s1.c + 2, 'a': s1.a || 'D'}, {'c': s0.c + CASE i WHEN 's' THEN stay ELSE 1000000000 END, 'a': s0.a || 'K'}])[1] AS n1,
        list_sort([{'c': s2.c + 2, 'a': s2.a || 'D'}, {'c': u.c + CASE i WHEN 'u' THEN stay ELSE 1000000000 END, 'a': u.a || 'K'}, {'c': u.c + stay + 1, 'a': u.a || 'R'}])[1] AS n2,
        list_sort([{'c': s3.c + 2, 'a': s3.a || 'D'}, {'c': s2.c + CASE i WHEN 'a' THEN stay ELSE 1000000000 END, 'a': s2.a || 'K'}, {'c': s2.c + stay + 1, 'a': s2.a || 'R'}])[1] AS n3
      FROM (SELECT w.conv_id, o.p, s0, s1, s2, s3, i, CASE f WHEN '-' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END AS stay, list_sort([s0, s1, s3])[1] AS u
        FROM w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.p = w.p + 1)))),
e AS (SELECT conv_id, list_sort([s0, s3])[1] AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1),
x AS (
  SELECT conv_id, q, best.a[q] AS edit, len(regexp_replace(best.a[1:q], 'I', '', 'g')) AS p, len(regexp_replace(best.a[1:q], 'D', '', 'g')) AS place
  FROM (SELECT conv_id, best, unnest(range(1, len(best.a) + 1)) AS q FROM e)),
y AS (
  SELECT x.conv_id, q, edit, place, CASE edit WHEN 'I' THEN '' ELSE text END AS text, role, i,
         max(CASE WHEN edit = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS sys
  FROM x LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM x.conv_id AND o.p = x.p WHERE edit <> 'D'),
z AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY q)) AS digest
  FROM y GROUP BY conv_id),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
         count(*) FILTER (f = 't') AS truncated, count(*) FILTER (p > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_html_extract": op3_html_extract,
        "op4_sharding": op4_sharding,
        "op5_near_dedup": op5_near_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_chat_format": op8_chat_format,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_embedding_dedup": op13_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op2_decontamination": OP2_SQL,
        "op5_near_dedup": OP5_SQL,
        "op7_suffix_dedup": OP7_SQL,
        "op8_chat_format": OP8_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_conversation_repair": OP12_SQL,
        "op13_embedding_dedup": OP13_SQL,
    }
