"""A training corpus in four stages: language ID, MinHash near-dedup, substring dedup, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents, so a
stage can be left out or run alone. run() writes each stage's result as Parquet in the shared folder and reads it again.

For every stage: docs may have further columns, whatever their names, which are dropped; an empty table gives no row; texts
count whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import op1_language_id, op4_substring_dedup, op6_minhash_dedup, op8_pack
from keelson.llm.common import discard, documents, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shingles of the near-duplicate stage, in words, and the similarity of a link in percent.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told; name the language of those that have no label.

    That drops null and empty texts, those without a letter, and those whose best two languages are tied or nearly so. A
    repeated row is judged like the first. A row without a doc_id counts as one that may be learned from. If no document has a label, all go.
    """
    model = op1_language_id.learn(docs.where(~F.coalesce(op1_language_id.held_out(F.col("doc_id")), F.lit(False))).select("text", "lang"))
    found = op1_language_id.identify(docs.select(*COLUMNS), model).where("NOT rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies.

    Rows without a doc_id come after all others, in the order of a hash of their text. Rows equal in doc_id and text are
    one document, of which one row stays; of rows that share a doc_id but not the text, each goes or stays by its own
    text's group. A null or empty text is a copy of nothing.
    """
    own = "near_id", "text_hash"
    text_hash = F.xxhash64("text")
    late = text_hash.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(*COLUMNS).withColumn(own[0], F.coalesce(F.col("doc_id").cast("long"), late)).withColumn(own[1], text_hash)
    gone = op6_minhash_dedup.dedup(rows.select(F.col(own[0]).alias("doc_id"), "text"), SHINGLE, PERCENT).where("NOT kept")
    gone = gone.select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1])).distinct()
    # The join and what follows share one shuffle, by id and text.
    return rows.join(gone.hint("merge"), list(own), "left_anti").dropDuplicates(list(own)).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages that stand earlier already; documents of which nothing is left go, untouched ones stay as written.

    Null and empty texts have no passages and stay. Rows without a doc_id come after all others; rows equal in doc_id and
    text are one occurrence and don't cut each other. n_chars is that of what is left.
    """
    found = op4_substring_dedup.dedup_substrings(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    left = found.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, of the end id alone; repeated rows and rows without a doc_id are each packed.
    """
    return op8_pack.pack_rows(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
#: SQL can't express these stages (compression, hashing, a tokenizer); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
