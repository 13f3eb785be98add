"""The queries of this subpackage's operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plexus.llm import chat, decontam, exact_dedup, langid, line_dedup, pii, piece, quality, sharding, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat(spark, sf_dir):
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op9_sentencepiece(spark, sf_dir):
    return piece.encode_decode(table(spark, sf_dir, "documents"), piece_model())


def op10_line_dedup(spark, sf_dir):
    return line_dedup.drop_recurring(table(spark, sf_dir, "documents")).selectExpr("doc_id", "text", "n_dropped", "sha2(coalesce(text, ''), 256) AS text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontamination, op3_exact_dedup, op4_sharding, op5_simhash, op6_language_id, op7_quality, op8_chat, op9_sentencepiece, op10_line_dedup)}


OP3 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""

# The set of words of a text; A-Z are lower-cased one by one, as lower() would change other letters too.
WORDS = "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP2 = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS k, least(13, len(w)) AS n
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

OP8 = """
WITH t AS (SELECT conv_id, turn, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' AS said,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT conv_id, k, n, string_agg(said, chr(10)) OVER (PARTITION BY conv_id ORDER BY k) AS s FROM t),
whole AS (SELECT min(conv_id) AS conv_id, n, s FROM p WHERE k = n GROUP BY n, s)
SELECT conv_id, n AS n_turns, s AS rendered, sha256(s) AS rendered_sha256
FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.n AND p.s = w.s)
"""

OP10 = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, text, line, list_transform(list_filter(regexp_split_to_array(raw, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM l),
s AS (SELECT doc_id, text, line, t, len(t) AS n, greatest(len(t) - 4, 0) AS r FROM t WHERE len(t) >= 3),
f AS (SELECT doc_id, text, line, n || ' ' || array_to_string(t[1:4], ' ') AS leaf,
             array_to_string(t[5 : 4 + r // 4], ' ') AS f0, array_to_string(t[5 + r // 4 : 4 + r * 2 // 4], ' ') AS f1,
             array_to_string(t[5 + r * 2 // 4 : 4 + r * 3 // 4], ' ') AS f2, array_to_string(t[5 + r * 3 // 4 : 4 + r], ' ') AS f3 FROM s),
k AS (SELECT DISTINCT doc_id, text, line, unnest(['a' || chr(10) || leaf || chr(10) || f0 || chr(10) || f1, 'b' || chr(10) || leaf || chr(10) || f0 || chr(10) || f2, 'c' || chr(10) || leaf || chr(10) || f0 || chr(10) || f3,
                                                  'd' || chr(10) || leaf || chr(10) || f1 || chr(10) || f2, 'e' || chr(10) || leaf || chr(10) || f1 || chr(10) || f3, 'f' || chr(10) || leaf || chr(10) || f2 || chr(10) || f3]) AS k FROM f),
o AS (SELECT k, count(DISTINCT text) AS n, arg_min(text, doc_id) AS first FROM k GROUP BY k HAVING count(DISTINCT text) >= 3),
gone AS (SELECT DISTINCT k.doc_id, k.line FROM k JOIN o ON k.k = o.k WHERE k.text <> o.first),
kept AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.line) AS text FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line WHERE gone.line IS NULL GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(c.n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op3_exact_dedup": OP3, "op8_chat": OP8, "op10_line_dedup": OP10}
