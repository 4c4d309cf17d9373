"""The queries opN_<name>: each applies its operator to its whole table and derives the columns that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm import lang_id, licences, lm, mixing, token_counts, token_files
from candlework.llm._store import Scratch
from candlework.llm.decontaminate import decontaminate
from candlework.llm.html_text import main_texts
from candlework.llm.near_dup import near_duplicates
from candlework.llm.vectors import near_duplicate_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of documents; rows that repeat both id and text are one document and give one row."""
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of documents, read back."""
    path = Scratch(spark, "op2").path("tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.with_crc32(token_files.read_token_files(spark, path))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of whole documents and notices in their lines, by the texts of licence_texts; a row for each row."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, on shingles of four words as the query's contract says."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of documents."""
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return lm.score(_table(spark, sf_dir, "documents"), held_out=held)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages."""
    return main_texts(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate vectors."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from those that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    held = lang_id.is_held_out()
    known = lang_id.profiles(docs.where(~held))
    found = lang_id.identify(docs, known)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_token_files": op2_token_files,
    "op3_licence_scan": op3_licence_scan,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language_model": op5_language_model,
    "op6_token_counts": op6_token_counts,
    "op7_html_text": op7_html_text,
    "op8_near_vectors": op8_near_vectors,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
}
