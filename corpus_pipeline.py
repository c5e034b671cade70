"""The corpus pipeline: from documents to packed sequences, in five stages.

Each stage works on all rows that its predecessor kept, written as Parquet and
read again, and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import minhash_dedup, mix_sources, packing, quality_model, secret_scan
from strandline.llm.shared import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go.

    Null, empty and wordless texts are rejected; rows with a null id or columns of
    any other content stay or go by their text alone, so repeated rows go
    together; an empty table stays empty.
    """
    model = quality_model.quality_model(docs)
    score = quality_model.score_column(model.weights, "text")
    return docs.where((score > 0) & (score >= model.limit))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays.

    So do rows without an id and texts without words, which are linked with
    nothing; rows that share an id stay or go together; an empty table stays empty.
    """
    gone = minhash_dedup.minhash_dedup(docs, k=5).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced in the texts; every document stays.

    Null texts stay null; ids may be null or repeat, and repeated rows are changed
    alike; an empty table stays empty.
    """
    return secret_scan.redact_live(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it as a whole, which may be never.

    Documents without words, so also null and empty texts, go; a null source is a
    source; rows that share an id, null too, are taken alike; an empty table
    stays empty.
    """
    return mix_sources.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, each window of them in the target proportions.

    A null text has only its end token; null ids and sources stay; repeated rows
    are packed as often as they come; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality classifier", quality_classifier), ("MinHash near-dedup", near_dedup), ("secret scans", secret_scans), ("mixing sources to target weights", mix), ("packing", pack)]

#: A fitted scorer, approximate candidates and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
