"""Five operators in a row that make a training corpus of documents.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), and what it returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm import lang_id, mixing, token_files
from candlework.llm._store import Scratch
from candlework.llm.decontaminate import decontaminate
from candlework.llm.near_dup import near_duplicates

KEYS = ["key_0", "key_1"]


def _keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, tuple[Column, ...]]:
    """docs, and two longs that tell its rows apart, whatever their ids: the file of its table and the row's place in it."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at.row_index)
    except AnalysisException:  # rows that don't come from a table
        docs = Scratch(spark, "rows").keep(docs, "rows")
        at = docs.metadataColumn("_metadata")
    return docs, (F.xxhash64(at.file_path), at.row_index)


def _without(docs: DataFrame, key: tuple[Column, ...], gone: DataFrame) -> DataFrame:
    """The rows whose key isn't among those that go. The row is carried as one column, so no name can clash."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *[c.alias(x) for c, x in zip(key, KEYS)])
    return rows.join(gone.select(*KEYS), KEYS, "left_anti").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that labelled documents teach; texts without letters or unlike all languages go."""
    return lang_id.accepted(docs, lang_id.profiles(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, on shingles of five words.

    It is the one with the smallest id, nulls last; of rows that repeat an id, or all they hold, one too. Rows are told
    apart by their place in the table, so ids may be null, negative or shared. Texts without words are no duplicates.
    """
    docs, key = _keyed(spark, docs)
    return _without(docs, key, near_duplicates(docs, row_key=key).where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that share no span with a benchmark item, each by its own text whatever its id."""
    docs, key = _keyed(spark, docs)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row_key=key)
    return _without(docs, key, found.where("contaminated"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, and for each document in them where its ids start, how many they are, and their checksum."""
    path = Scratch(spark, "pipeline-tokens").path("tokens")
    token_files.write_token_files(docs, path)
    return token_files.with_crc32(token_files.read_token_files(spark, path))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_output", token_output),
]

#: SQL can't tokenize, nor do the language stage's byte work; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
        if k:  # token_output has written its files by now
            scratch.drop(STAGES[k - 1][0])
    return docs
