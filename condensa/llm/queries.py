"""Queries of the operators in this package, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, labelled, media, mixing, ngram_join, quality, secret_scan, sentencepiece_wfst, toxicity, warc
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, _table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL_OP1 = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk FROM slim GROUP BY source),
w AS (SELECT *, (CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS pool FROM w),
l AS (SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, max(level) OVER () AS fl FROM l),
t AS (SELECT source, source_size, least(cap, fl * weight) AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (SELECT slim.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
      sum(size) OVER (PARTITION BY slim.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS cut_before
      FROM slim JOIN b ON slim.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - cut_before)))::BIGINT AS taken FROM c
"""


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    uri = scratch.folder("archives")
    scratch.table(media.write_archives(_table(spark, sf_dir, "documents"), "doc_id", "text", uri), "manifest")
    found = media.whole(media.features(media.read_archives(spark, uri, scratch.path("manifest"))))
    return found.select(F.when(F.col("key") != "", F.col("key")).cast("long").alias("doc_id"), *[c for c in found.columns if c != "key"])


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(spark, _table(spark, sf_dir, "documents"))


#: all pairs that share a shingle, and who is reached over links; for tables that the SQL engine holds
SQL_OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM c WHERE 100 * common >= 80 * (na + nb - common)), l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, any_value(len(s.sh))::BIGINT AS n_shingles, min(root) AS component_id FROM r JOIN s USING (doc_id) GROUP BY r.doc_id
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(spark, _table(spark, sf_dir, "documents"))
    return groups.withColumn("text_sha256", F.lower(F.hex("text_sha256")))


SQL_OP9 = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size,
       n.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY n.text_sha256, n.doc_id) = 1 AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.add_spans(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


SQL_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""


def _scored(spark: SparkSession, sf_dir: str, model, label_threshold: float) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = model.add_score(spark, docs.select("doc_id", "text"), model.fit(docs, labels), "score")
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= label_threshold).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, 0.3)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its piece ids, their number, and the sha256 of the text decoded from them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_wfst.add_pieces(spark, docs, decoded="decoded")
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_wfst.META, " ")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), same.alias("round_trip"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, 0.5)


#: a conversation of control strings, formatted along with the table
PLANTED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.formatted(chat.as_events(rows), chat.ORDER))


SQL_OP10 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, sha256(text) AS tie,
  length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))
  + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\n')) + 13 AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(role), tie)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(role), tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op1_mixing": op1_mixing, "op2_secret_scan": op2_secret_scan, "op3_warc": op3_warc, "op4_quality_classifier": op4_quality_classifier, "op5_sentencepiece": op5_sentencepiece, "op6_toxicity": op6_toxicity, "op7_media": op7_media, "op8_ngram_join": op8_ngram_join, "op9_exact_dedup": op9_exact_dedup, "op10_chat_formatting": op10_chat_formatting}
ORACLE_SQL = {"op1_mixing": SQL_OP1, "op3_warc": SQL_OP3, "op8_ngram_join": SQL_OP8, "op9_exact_dedup": SQL_OP9, "op10_chat_formatting": SQL_OP10}
