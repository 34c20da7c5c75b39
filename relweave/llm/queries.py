"""The queries of this subpackage, by the names under which __spark_entry__ registers them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import bpe, compression, decontamination, fim, jaccard_join, language_id, line_dedup, quality_rules, sharding, site_templates, toxicity, vector_codes, warc
from relweave.llm.common import in_small_batches, read
from relweave.llm.labelled import fold

#: Name of an installed public vocabulary, or a path.
VOCABULARY = "word_bpe_49k.json"
#: Date of the responses that op3 makes of pages, which have none.
CAPTURED = "2024-01-01T00:00:00Z"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.HashTree.uniform(24)
    return sharding.shard(read(spark, sf_dir, "documents"), tree, tree.grow())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality_rules.passes("web-1").alias("kept"), "fail_bits")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(read(spark, sf_dir, "pages"), CAPTURED))
    return records.select("page_id", "type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", F.length("block").cast("long").alias("content_length"), F.col("block").cast("string").alias("block"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"), F.sha2(F.concat_ws(",", "near").cast("binary"), 256).alias("near_sha256"))


def op5_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 4) == 2
    model = compression.fit(docs, read(spark, sf_dir, "labels"), "quality", held_out)
    scores = compression.scored(docs, model, "text", ["doc_id"])
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 5) == 0
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", held_out)
    found = toxicity.segments(docs, model, "text", ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("segments").cast("long").alias("n_segments"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codebooks = vector_codes.encode(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = fim.Settings(salt="7:", rate=100, spm=50)
    made = fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text"), settings)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"), settings)).alias("restored_sha256"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold("doc_id", 5) == 0
    model = language_id.fit(docs, held_out)
    found = language_id.scored(docs, model, "text", ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def _bounded(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        in_small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _bounded(f) for f in (op1_sharding, op2_quality_rules, op3_warc, op4_decontamination, op5_site_templates, op6_bpe, op7_compression, op8_line_dedup, op9_toxicity, op10_jaccard_join, op11_exponion, op12_fim, op13_language_id)}
