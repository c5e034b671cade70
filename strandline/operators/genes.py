"""Genes as a table: their transcripts nested, and the longest of them chosen there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import coords

#: What names a gene: one name may stand on several contigs and in several sources.
GENE = ["source", "contig_id", "gene_name"]


def transcript_length(exons: str = "exons") -> Column:
    return coords.total_length(F.col(exons))


def coding_length(segs: str = "segs") -> Column:
    return coords.total_length(F.col(segs), "gb", "ge")


def gene_table(transcripts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row a gene: transcripts (tid, beg, tend, length, coding), longest and longest_coding (tid), and beg and tend of the longest one.

    Of transcripts as long, the one with the smallest tid counts; a gene without
    coding transcripts has none that is longest_coding.
    """
    by = by or [c for c in GENE if c in transcripts.columns]
    t = transcripts.withColumns({"length": transcript_length(), "coding": coding_length()})
    key = F.struct(-F.col("length"), "tid")
    return t.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("tid", "beg", "tend", "length", "coding"))).alias("transcripts"), F.min_by("tid", key).alias("longest"), F.min_by("tid", F.when(F.col("coding") > 0, F.struct(-F.col("coding"), "tid"))).alias("longest_coding"),
        F.min_by("beg", key).alias("beg"), F.min_by("tend", key).alias("tend"),
    )


def longest_only(pairs: DataFrame, query: str = "vid", coding: bool = False) -> DataFrame:
    """pairs of query and transcript with only the longest transcript (by exons, or by coding sequence) of each gene that a query meets."""
    size = coding_length() if coding else transcript_length()
    by = [query, *(c for c in GENE if c in pairs.columns)]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(size.desc(), "tid"))
    return pairs.withColumn("__first", first).where("__first = 1").drop("__first")
