"""Bases of a genome by place: contigs in chunks, and joins of rows with the chunks they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a chunk, and bases of its neighbours that it has on either side.
CHUNK, MARGIN = 1024, 256


def chunks(contigs: DataFrame, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """contig_id, chunk, first, bases of contigs (contig_id, seq): chunk c has c * chunk + 1 to (c + 1) * chunk and the margins; first is the place of its first base."""
    x = contigs.where("length(seq) > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.length("seq") - 1) / chunk))))
    first = F.greatest(F.col("chunk") * chunk + 1 - margin, F.lit(1))
    last = (F.col("chunk") + 1) * chunk + margin
    return x.select("contig_id", "chunk", first.alias("first"), F.substr("seq", first.cast("int"), (last - first + 1).cast("int")).alias("bases"))


def bases_at(rows: DataFrame, genome: DataFrame, chunk: int = CHUNK, margin: int = MARGIN, pos: str = "pos", **parts: tuple[int, int]) -> DataFrame:
    """rows (contig_id, pos) with a column of bases for each part (first place after pos, length), as far as the contig goes.

    One join on (contig_id, chunk).  Parts must lie within margin of pos.
    """
    if any(low < -margin or low + n > margin + 1 for low, n in parts.values()):
        raise ValueError(f"parts reach further than {margin} bases from their place")
    x = rows.withColumn("chunk", F.floor((F.col(pos) - 1) / chunk)).join(genome, ["contig_id", "chunk"])
    at = F.col(pos) - F.col("first") + 1  # place in the chunk

    def part(low: int, n: int) -> Column:
        beg = (at + low).cast("int")
        return F.substr("bases", F.greatest(beg, F.lit(1)), F.greatest(F.least(beg, F.lit(1)) + n - 1, F.lit(0)))

    return x.select(*(F.col(c) for c in rows.columns), *(part(*p).alias(name) for name, p in parts.items()))


def regions(rows: DataFrame, genome: DataFrame, reach: int, beg: str = "pos", end: str = "till", chunk: int = CHUNK) -> DataFrame:
    """rows (contig_id, beg, end) with region_first and region: the bases from reach before beg to reach after end, as far as the contig goes.

    Rows meet all chunks that they span, a few at a time; for rows that bases_at doesn't reach.
    """
    low, high = F.greatest(F.col(beg) - reach, F.lit(1)), F.col(end) + reach
    x = rows.withColumn("__row", F.struct(*rows.columns)).withColumn("__low", low).withColumn("__high", high)
    x = x.select("contig_id", "__row", "__low", "__high", F.explode(F.sequence(F.floor((F.col("__low") - 1) / chunk), F.floor((F.col("__high") - 1) / chunk))).alias("chunk")).join(genome, ["contig_id", "chunk"])
    a, b = F.greatest("__low", F.col("chunk") * chunk + 1), F.least("__high", (F.col("chunk") + 1) * chunk)
    part = F.substr("bases", (a - F.col("first") + 1).cast("int"), (b - a + 1).cast("int"))
    whole = x.groupBy("__row", "__low").agg(F.sort_array(F.collect_list(F.struct("chunk", part.alias("s")))).alias("__parts"))
    return whole.select("__row.*", F.col("__low").alias("region_first"), F.array_join(F.transform("__parts", lambda p: p["s"]), "").alias("region"))
