"""The corpus pipeline: each stage reads what the one before it wrote as Parquet.

Documents are known by id and text, so rows that repeat an id, or have none, keep apart. All columns of documents stay,
whatever others there are. An empty table goes through all stages and gives no files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import arrowseq, decontaminate, jaccard, langid, mixing
from textloom.llm.common import drop_path, load, shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, with them null, empty and letterless texts; lang becomes the language
    found. The models are of the rows that have a lang."""
    return langid.accepted(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of copies and near copies stays; of rows that repeat id and text
    one. Rows with a null id stay."""
    return jaccard.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go, also those with a null id; clean ones under the same id stay."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; those of sources that need it repeat, none is dropped but those without an id,
    which no seeded order can place, or without words. A null source is a source."""
    return mixing.mixed_documents(docs)


def write_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Arrow files of token sequences, each with the ids of its documents."""
    return arrowseq.sequences(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_sequences),
]

#: SQL can't express language models or tokenizers; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next one has written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
