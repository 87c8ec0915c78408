"""The operators of this subpackage on the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, byte_bpe, decontaminate, line_dedup, near_dup, pii, quality, secret_scan, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op2_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_quality_rules(spark, sf_dir):
    return quality.verdicts(_table(spark, sf_dir, "documents")).drop("host_rejected")


def op4_token_counts(spark, sf_dir):
    return token_counts.counts(_table(spark, sf_dir, "documents"), WORD_BPE).withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_line_dedup(spark, sf_dir):
    out = line_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_pii_surrogates(spark, sf_dir):
    return pii.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus-key-1", counts=True)


def op7_minhash_near_dup(spark, sf_dir):
    return near_dup.classes(_table(spark, sf_dir, "documents"), words_per=3, threshold=0.85)


def op8_token_binary(spark, sf_dir):
    return binary_output.shards(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, key="order-key-1")


def op9_decontamination(spark, sf_dir):
    found = decontaminate.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


def op10_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_secret_scan, op2_byte_bpe, op3_quality_rules, op4_token_counts, op5_line_dedup, op6_pii_surrogates, op7_minhash_near_dup, op8_token_binary, op9_decontamination, op10_toxicity)
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op7_minhash_near_dup": OP7_SQL, "op9_decontamination": OP9_SQL}


OP3_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
win AS (
  SELECT doc_id, i, ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2] AS g
  FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS u(i) WHERE len(ws) >= 3),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS k FROM rep, unnest([0, 1, 2]) AS v(d) GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(ln.k, 0)::BIGINT AS n_dup_lines, coalesce(cov.k, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p0 AS (SELECT count(*) - 1 AS j, sum(n) AS t, sum(f) AS g, sum(n * n) / sum(n) AS q, sum(f * f / n) AS s, least(greatest(sum(f) / sum(n), 0.001), 0.999) AS mu FROM h),
p1 AS (SELECT mu, (s - g * g / t) / (mu * (1 - mu)) - j AS over_, t - q - j AS room FROM p0),
p AS (SELECT mu, CASE WHEN over_ > 0 AND room > 0 THEN least(greatest(room / over_ - 1, 1.0), 1000.0) ELSE 1000.0 END AS k FROM p1),
r AS (SELECT source, n, k, mu, (f + mu * k) / (n + k) AS rate FROM h, p),
bad AS (SELECT source FROM r WHERE rate - 2 * sqrt(rate * (1 - rate) / (n + k + 1)) > greatest(0.5, mu))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept
FROM b
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], chr(31)) AS g
  FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS node, x AS reach FROM e UNION SELECT e.y, r.reach FROM r JOIN e ON e.x = r.node),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.c, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.c, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS g
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM d, ks, unnest(range(1, len(ws) - k + 2)) AS u(i) WHERE len(ws) >= k),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM h, unnest(range(0, k)) AS v(o) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
runs AS (
  SELECT doc_id, item_id, max(n) AS longest FROM (
    SELECT doc_id, item_id, grp, max(i + k) - min(i) AS n FROM (
      SELECT DISTINCT h.doc_id, h.item_id, h.i, h.k, bi.i AS j, h.i - (row_number() OVER (PARTITION BY h.doc_id, h.item_id, h.i - bi.i ORDER BY h.i)) AS rn, h.i - bi.i AS diag, (h.i - bi.i) * 1000000 + h.i - (row_number() OVER (PARTITION BY h.doc_id, h.item_id, h.i - bi.i ORDER BY h.i)) AS grp
      FROM h JOIN (SELECT item_id, i, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0) bi
        ON bi.item_id = h.item_id AND bi.k = h.k JOIN dw ON dw.doc_id = h.doc_id AND dw.i = h.i AND dw.k = h.k AND dw.g = bi.g)
    GROUP BY doc_id, item_id, grp) GROUP BY doc_id, item_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, coalesce(r.longest, 0)::BIGINT AS longest
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN (SELECT doc_id, max(longest) AS longest FROM runs GROUP BY doc_id) r USING (doc_id)
"""
