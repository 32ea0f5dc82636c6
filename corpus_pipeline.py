"""A corpus pipeline: quality, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its
result is written and read again as the next one's docs.  All but the last return the columns
of ``documents``; the last adds ``ids``.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnera.llm import decontamination, near_copies, quality, sentencepiece_codec
from turnera.llm.common import table
from turnera.session import remove_folder, shared_folder

TOKENIZER = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site do not reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_copies.deduplicated(docs, size=5, least=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item (nor a shorter item whole)."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), remove="documents", size=10)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its whole text."""
    import public_tokenizers

    return sentencepiece_codec.with_ids(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_stage),
    ("jaccard_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: SQL cannot express the classifier, the fingerprints or the ids; tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    earlier = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if earlier:  # only the last stage's rows are needed from here on
            remove_folder(spark, earlier)
        earlier = path
    return docs
