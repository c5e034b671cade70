"""Known variants (contig_id, pos, ref, alts, id) at the places of variants, as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _told(hits: DataFrame, ref: str, alt: str) -> DataFrame:
    one = F.concat("id", F.lit("("), F.col("contig_id").cast("string"), F.lit(":"), F.col("__kpos").cast("string"), F.col(ref), F.lit(">"), F.col(alt), F.lit(")"))
    return hits.groupBy("vid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", one.alias("s")))), lambda x: x["s"]), ",").alias("known"))


def _listed(known: DataFrame) -> DataFrame:
    return known.select("contig_id", F.col("pos").alias("__kpos"), F.col("ref").alias("__kref"), F.explode("alts").alias("__kalt"), "id")


def known_snvs(variants: DataFrame, known: DataFrame) -> DataFrame:
    """variants (vid, contig_id, pos, ref, alt) with known: id(contig:posREF>ALT) of those with their bases, by id; an alt that is null or empty takes all."""
    hit = variants.select("vid", "contig_id", F.col("pos").alias("__kpos"), "ref", "alt").join(_listed(known).where("length(__kref) = 1 and length(__kalt) = 1"), ["contig_id", "__kpos"])
    hit = hit.where("ref = __kref and (alt is null or alt = '' or alt = __kalt)")
    return variants.join(_told(hit, "__kref", "__kalt"), "vid", "left")


def known_ranges(variants: DataFrame, known: DataFrame, alt: str | None = None) -> DataFrame:
    """variants (vid, contig_id, pos) with known: those that replace what begins at pos by the column alt, or, without it, delete bases there.

    Known indels are told with the base before them, which is taken off; single-base
    substitutions aren't meant.
    """
    new = F.coalesce(F.col(alt), F.lit("")) if alt else F.lit("")
    asked = variants.select("vid", "contig_id", (F.col("pos") - 1).alias("__kpos"), new.alias("__new"))
    hit = asked.join(_listed(known).where("not (length(__kref) = 1 and length(__kalt) = 1)"), ["contig_id", "__kpos"]).where(F.substr("__kalt", F.lit(2)) == F.col("__new"))
    return variants.join(_told(hit, "__kref", "__kalt"), "vid", "left")
