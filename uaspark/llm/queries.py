"""The ``opN_<name>`` queries over the shared tables, and their SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, exact_dedup, fim, langid, lm_score, mixing, ngram_join, pii, quality, resample, sharding,
               toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_sharding")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return sharding.shard_by_bytes(narrow, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register("op2_bpe")
def op2(spark, sf_dir):
    import public_tokenizers  # describes where the vocabularies lie on this machine

    vocabulary = bpe.Vocabulary.from_file(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


@register("op3_pii")
def op3(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op4_quality")
def op4(spark, sf_dir):
    trusted = (table(spark, sf_dir, "labels").groupBy("doc_id")
               .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
               .filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("id")))
    return quality.judge(table(spark, sf_dir, "documents"), trusted, max_trusted=None)


@register("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(langid.fold() != 2))
    held_out = F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", "text", held_out), model, keep_text=False)


@register("op6_ngram_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, MIN(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""")
def op6(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@register("op7_mixing")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_count(F.col("text")).alias("tokens"))
    return mixing.mix(docs, tokens=F.col("tokens"))


@register("op8_exact_dedup", """
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM MAX(doc_id) OVER w AS kept,
       sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY COALESCE(text, ''))""")
def op8(spark, sf_dir):
    found = exact_dedup.copy_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


@register("op9_lm_score", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
u AS (SELECT w, COUNT(*) AS c FROM w GROUP BY w),
ud AS (SELECT doc_id, w, COUNT(*) AS c FROM w GROUP BY doc_id, w),
b AS (SELECT p, w, COUNT(*) AS c FROM w WHERE p IS NOT NULL GROUP BY p, w),
bd AS (SELECT doc_id, p, w, COUNT(*) AS c FROM w WHERE p IS NOT NULL GROUP BY doc_id, p, w),
s AS (SELECT w.doc_id, CASE
    WHEN b.c - bd.c > 0 THEN ln(b.c - bd.c) - ln(up.c - udp.c)
    WHEN u.c - ud.c > 0 THEN ln(0.4) + ln(u.c - ud.c) - ln(greatest(n.c - len(t.ws), 1))
    ELSE 2 * ln(0.4) - ln(greatest(n.c - len(t.ws), 1)) END AS s
  FROM w JOIN t USING (doc_id) JOIN u ON u.w = w.w JOIN ud ON ud.doc_id = w.doc_id AND ud.w = w.w
  LEFT JOIN b ON b.p = w.p AND b.w = w.w LEFT JOIN bd ON bd.doc_id = w.doc_id AND bd.p = w.p AND bd.w = w.w
  LEFT JOIN u up ON up.w = w.p LEFT JOIN ud udp ON udp.doc_id = w.doc_id AND udp.w = w.p
  CROSS JOIN (SELECT SUM(len(ws)) AS c FROM t) n)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_tokens, ROUND(COALESCE(x.s, 0), 6) AS log_score,
       ROUND(x.s / len(t.ws), 6) AS mean_log_score
FROM t LEFT JOIN (SELECT doc_id, SUM(s) AS s FROM s GROUP BY doc_id) x USING (doc_id)""")
def op9(spark, sf_dir):
    found = lm_score.score_documents(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


@register("op10_nearest", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20""")
def op10(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@register("op11_resampling")
def op11(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_toxicity")
def op12(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.filter(toxicity.fold() != 1))
    held_out = F.coalesce(toxicity.fold() == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text", held_out), lexicon).select(
        "doc_id", "held_out", "score", "predicted")


@register("op13_fill_in_middle")
def op13(spark, sf_dir):
    out = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
