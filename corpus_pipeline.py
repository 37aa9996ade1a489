"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept.

STAGES names the stages; each function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents, in their order; n_chars
follows the text where a stage changes it. Rows without an id or text go through every
stage as its operator says; an empty table stays empty.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from heldout.llm import bpe, langid, line_dedup, mixing, ngram_join
from heldout.llm.shared import cut, documents

#: Near duplicates: word shingles of five, Jaccard similarity of 80 percent or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80

REST = "_rest_of_row"


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns ``apart``, and all others in one struct, so that no operator meets their names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in apart] or [F.lit(None).cast("int").alias("_none")]
    return docs.select(*[F.col(f"`{c}`") for c in apart], F.struct(*rest).alias(REST))


def unpacked(rows: DataFrame, like: DataFrame, *apart: str) -> DataFrame:
    """Back to the columns of ``like``; n_chars is that of the text."""
    out = []
    for c in like.columns:
        value = F.col(f"`{c}`") if c in apart else F.col(REST)[c]
        if c == "n_chars" and "text" in apart:
            value = F.when(F.col("text").isNotNull() & value.isNotNull(), F.length("text")).otherwise(value).cast(like.schema[c].dataType)
        out.append(value.alias(c))
    return rows.select(*out)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and is clearly of a language learned from the labelled rows of the input; held-out labelled rows say what is clear.

    Without labelled rows there is nothing to learn, and only texts without letters go.
    """
    languages, matrix = langid.learned(docs)
    if not languages:
        return docs.where(line_dedup.says_something(F.col("text")))
    return langid.clear(docs, languages, matrix, langid.limits(docs.where(langid.held_out(F.col("doc_id"))), languages, matrix))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand elsewhere already; documents that had lines with letters or digits and keep none of them go."""
    rows = packed(docs, "doc_id", "text")
    rows = rows.select("doc_id", "text", F.struct(F.col(REST).alias("rest"), F.coalesce(line_dedup.says_something(F.col("text")), F.lit(False)).alias("worded")).alias("_given"))
    done = line_dedup.dedup(rows)
    kept = done.where(~F.col("_given.worded") | line_dedup.says_something(F.col("text")))
    return unpacked(kept.select("doc_id", "text", F.col("_given.rest").alias(REST)), docs, "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id (a null comes last), then of the least hash of its text.

    Rows are told apart by a hash of id and text, so rows of one id and other texts are
    documents of their own. Of rows with the same id and text one stays, the least by a
    hash of the row. Texts without words have no group and stay.
    """
    named = lambda df: df.withColumn("_key", F.xxhash64("doc_id", "text"))
    rows = named(packed(docs, "doc_id", "text"))
    found = cut(ngram_join.join(rows.select(F.col("_key").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT).where("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("times")))
    ids = rows.select("_key", F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.xxhash64("text").alias("hash"), "_key").alias("place")).distinct()
    best = found.join(ids, F.col("doc_id") == F.col("_key")).groupBy("component").agg(F.min("place").alias("place"))
    decided = found.join(best.select(F.col("place._key").alias("_best")), F.col("doc_id") == F.col("_best"), "left").select(F.col("doc_id").alias("_worded"), "_best", "times")
    # only rows that go or have copies are looked up, so texts travel only where these are many
    apart = cut(decided.where("_best is null or times > 1"))
    kept = rows.join(apart, F.col("_key") == F.col("_worded"), "left").where("_best is not null or _worded is null")
    kept = kept.select("doc_id", "text", REST, "_key", F.coalesce("times", F.lit(1)).alias("times"))
    many = kept.where("times > 1")
    once = many.groupBy("_key").agg(F.min_by(F.struct("doc_id", "text", REST), F.xxhash64(REST)).alias("row")).select("row.*")
    return unpacked(kept.where("times = 1").select("doc_id", "text", REST).unionByName(once), docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the document in which a source's budget ends is cut there."""
    rows = mixing.mix(mixing.sized(packed(docs, "doc_id", "source", "text")))
    return unpacked(mixing.copies(rows), docs, "doc_id", "source", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian 32-bit integers, and the digest of the bytes decoded from them."""
    done = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("ngram_jaccard_join", near_duplicates), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL cannot express the models and hashes of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
