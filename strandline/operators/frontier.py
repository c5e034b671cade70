"""Questions of which a few rows need much more of the genome than the rest: each round reads more for those that are still open.

A round is a join of the open rows with the chunks they read next; how much a row
reads doubles from round to round, so that a repeat or an open frame of n bases
takes log n rounds, and no row meets a whole contig.  Open rows are written
between rounds (tables.kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from . import genome
from .tables import kept


def _bases(rows: DataFrame, chunks: DataFrame, key: str, contig: str, first: Column, n: Column, name: str) -> DataFrame:
    """rows with the column name: n bases from first on, as far as the contig has them (none, if it has none)."""
    x = rows.select(key, F.col(contig).alias("contig_id"), F.greatest(first, F.lit(1)).cast("bigint").alias("__low"), (first + n - 1).cast("bigint").alias("__high")).where("__high >= __low")
    x = x.select("*", F.explode(F.sequence(F.floor((F.col("__low") - 1) / genome.CHUNK), F.floor((F.col("__high") - 1) / genome.CHUNK))).alias("chunk")).join(chunks, ["contig_id", "chunk"])
    a, b = F.greatest("__low", F.col("chunk") * genome.CHUNK + 1), F.least("__high", (F.col("chunk") + 1) * genome.CHUNK)
    part = F.substr("bases", (a - F.col("first") + 1).cast("int"), (b - a + 1).cast("int"))
    whole = x.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", part.alias("s")))), lambda p: p["s"]), "").alias(name))
    return rows.join(whole, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def equal_run(rows: DataFrame, chunks: DataFrame, a: str, b: str, back: bool = False, start: int = 1024, most: int = 1 << 20) -> DataFrame:
    """rows (__key, unique, contig_id, places a < b) as __key, run: how many bases from a on equal those from b on, one by one, up to the contig's end; back: towards its beginning.

    Reads start bases of each open row first, then twice as many, at most `most`
    a round, until none is open.
    """
    step, done = start, None
    now = rows.select("__key", "contig_id", F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("run"))
    while True:
        low = lambda c: F.col(c) - F.col("run") - step + 1 if back else F.col(c) + F.col("run")
        # what lies before base 1 is cut off, so both parts begin at their place and go outwards
        x = now
        for c, name in (("a", "__x"), ("b", "__y")):
            x = _bases(x, chunks, "__key", "contig_id", low(c), F.lit(step), name)
            x = x.withColumn(name, F.reverse(name)) if back else x
        n = F.least(F.length("__x"), F.length("__y"))
        same = F.coalesce(sequence.first_difference(F.left("__x", n), F.left("__y", n)) - 1, n)
        x = kept(x.withColumn("__same", same).select("__key", "contig_id", "a", "b", (F.col("run") + F.col("__same")).alias("run"), (F.col("__same") == step).alias("__open")))
        ended = x.where(~F.col("__open")).select("__key", "run")
        done = ended if done is None else done.union(ended)
        now = x.where("__open").drop("__open")
        if now.isEmpty():
            return done
        step = min(2 * step, most)


def tails(transcripts: DataFrame, chunks: DataFrame, start: int = 2048, most: int = 1 << 20) -> DataFrame:
    """tid, tail: the bases behind the coding sequence (contig_id, strand, cds_beg, cds_end) until each of the three frames has had a stop, or the contig ends."""
    plus = F.col("strand") == "+"
    step, done = start, None
    now = transcripts.select(F.col("tid").alias("__key"), "contig_id", "strand", F.when(plus, F.col("cds_end")).otherwise(F.col("cds_beg")).cast("bigint").alias("edge"), F.lit("").alias("tail"))
    while True:
        beyond = F.length("tail")
        first = F.when(plus, F.col("edge") + beyond + 1).otherwise(F.col("edge") - beyond - step)
        x = _bases(now, chunks, "__key", "contig_id", first, F.lit(step), "__more")
        more = F.when(plus, F.col("__more")).otherwise(sequence.reverse_complement(F.col("__more")))
        x = x.withColumn("tail", F.concat("tail", more))
        stops = F.lit(True)
        for k in range(3):
            stops &= F.substr("tail", F.lit(k + 1), F.length("tail")).rlike("^(?s:...)*?(?:TAA|TAG|TGA)")
        x = kept(x.withColumn("__open", ~stops & (F.length("__more") == step)).drop("__more"))
        ended = x.where(~F.col("__open")).select(F.col("__key").alias("tid"), sequence.until_stops(F.col("tail")).alias("tail"))
        done = ended if done is None else done.union(ended)
        now = x.where("__open").drop("__open")
        if now.isEmpty():
            return done
        step = min(2 * step, most)
