"""A training corpus from ``documents``: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelweave.llm import bpe, langid, linededup, minhash, mixing
from reelweave.llm.blocks import small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go."""
    small_batches(spark)
    model = langid.train(docs.filter(~langid.is_held_out()))
    return langid.score(docs, model, COLUMNS[1:]).filter("accepted").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document or line has; a document left without any word goes."""
    small_batches(spark)
    out = linededup.dedup_lines(docs.select(*COLUMNS), exact_from=1)
    left = out.filter(F.expr(r"_removed = 0 OR rlike(text, '[^\x20\x09-\x0D]')"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id; rows without id stay."""
    small_batches(spark)
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return named.select(*COLUMNS).union(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    small_batches(spark)
    return mixing.mix(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    small_batches(spark)
    return bpe.encode_documents(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("mixing", mix_sources), ("bpe", tokenize)]
#: The language model, the signatures and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    from reelweave.llm.folders import Folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = Folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = folder.write(stage(spark, docs, sf_dir), name)
    return docs
