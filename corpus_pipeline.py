"""The corpus pipeline: quality rules, near-duplicate join, line dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import bpe, decontamination, jaccard_join, line_dedup, quality_rules
from relweave.llm.common import col, delete, folder, fresh, in_small_batches, read, row_key, staged, without

POLICY = "web-1"
VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy. Those without text fail it for want of words."""
    body = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), F.col("text"))
    return quality_rules.ledger(body).filter(quality_rules.passes(POLICY)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the id that names the group.

    Rows are told apart by id and text, so an id that comes with several texts
    stays only with those that head a group. Rows without an id come last in
    their group; of rows without shingles, each id and text stays once.
    """
    in_small_batches(spark)
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, row_key())
    heads = staged(jaccard_join.heads(docs).withColumnRenamed("key", key), "heads")
    alone = keyed.join(heads.filter("copies = 1").select(key), key, "left_semi")
    repeated = keyed.join(heads.filter("copies > 1").select(key), key, "left_semi").dropDuplicates([key])
    return alone.unionByName(repeated).select(*map(col, docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; those with no word left go. n_chars follows the text.

    A null text has no words, but nothing is removed from it: its row stays.
    """
    in_small_batches(spark)
    out = line_dedup.dedup(docs).filter("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*map(col, docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Rows of one id and text stay or go together; a null or empty text has no
    window and stays. An empty table, of documents or of items, is no error.
    """
    in_small_batches(spark)
    index = decontamination.build(docs)
    hit = decontamination.phrases(index, decontamination.ask(index, read(spark, sf_dir, "benchmark"))).select("key").distinct()
    return without(docs, hit).select(*map(col, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), and the digests of ids and of the decoded text.

    A row per row, repeated rows too; a null text has no tokens.
    """
    in_small_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", line_dedup_stage),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: The rows of run() depend on a tokenizer, which SQL can't express; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written to the shared folder and read again. A stage's input is deleted when its output is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
