"""Annotation of variant streams: stateless joins of a stream with static transcripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotate


def variant_stream(spark: SparkSession, path: str, schema: str = "vid string, contig_id bigint, pos bigint, ref string, alt string") -> DataFrame:
    """Tab-separated variant files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("sep", "\t").csv(path)


def snv_stream(variants: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Consequences of streamed SNVs: bins of the static side are joined by key, so no state is kept."""
    return annotate.snv_consequence(annotate.on_transcripts(variants, transcripts))


def each_batch(stream: DataFrame, f: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Operators that a stream can't express, such as nearest joins, by micro-batch; batches that come again replace themselves."""

    def write(batch: DataFrame, number: int) -> None:
        f(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
