"""Registered queries of the corpus operators and their SQL twins."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversations, fingerprints, knn, langid, line_dedup, mixing, ngram_join, periods, pieces, private, sharding, token_files
from .shared import cut, documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op4_sharding")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(documents(spark, folder), 40)


WORDS = r"""len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"""


@query("op5_ngram_jaccard_join", r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(documents(spark, folder), 3, 90)


@query("op10_mixing", f"""WITH d AS (SELECT doc_id, source, size, (('0x' || substr(md5(concat_ws('|', '0', coalesce(CAST(doc_id AS VARCHAR), '#' || size))), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM (SELECT doc_id, source, {WORDS} AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
k AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k,
  coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM k),
f AS (SELECT *, first_value(CASE WHEN fits THEN k END IGNORE NULLS) OVER w AS cutoff, first_value(CASE WHEN fits THEN 3 * total - 2 * full_before END IGNORE NULLS) OVER w AS share,
  first_value(CASE WHEN fits THEN 2 * weight_left END IGNORE NULLS) OVER w AS spread
  FROM (SELECT *, (3 * total - 2 * full_before) * weight <= 2 * source_size * 2 * weight_left AS fits FROM o) q WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, CASE WHEN k < cutoff THEN (2 * source_size)::DOUBLE ELSE (share * weight)::DOUBLE / spread::DOUBLE END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - start)) ELSE 0 END AS BIGINT) AS taken FROM p""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(cut(mixing.sized(documents(spark, folder)).select("doc_id", "source", "size"))).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    languages, matrix = langid.learned(docs)
    return langid.predict(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), languages, matrix, keep_text=False)


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_weighted_sampling")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, folder))


@query("op2_elias_fano")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read(spark, token_files.write(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json")))


@query("op7_kd_tree_top_k", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return knn.top(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


@query("op3_private_spans")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return private.find(docs, private.learned(docs))


@query("op1_line_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, folder).select("doc_id", "text"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, kept = conversations.repaired(conversations.damaged(rows))
    told = ["gaps", *conversations.FAULTS, "illegal", "cost"]
    found = report.withColumnRenamed("conv_id", "_c").join(conversations.digests(kept).withColumnRenamed("conv_id", "_d"), F.col("_c").eqNullSafe(F.col("_d")), "left")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in told], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op12_sentencepiece")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    done = pieces.encoded(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.detect(documents(spark, folder), periods.damaged)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("run"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").alias("lines"), "collapsed")
    return told.select("doc_id", "n_runs", (-F.col("run.before")).alias("start"), F.col("run.length").alias("length"), (-F.col("run.shorter")).alias("period"),
                       F.expr("run.length * 1000 div -run.shorter").alias("exponent_milli"),
                       F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
