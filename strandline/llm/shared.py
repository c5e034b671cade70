"""The folder that driver and executors share, tables written there, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Tables written by saved() and not yet removed, by session.
_SAVED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which remove() will find."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SAVED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, and survives lost executors.

    The table stays until remove(), as results that read it are lazy.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """saved(), in as many buckets by a column as there are shuffle partitions: joins and groupings by it read the table without a shuffle."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
    return spark.table(table)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the given tables of saved(), which nothing may read any more; without any, all of this application."""
    mine = _SAVED.get(spark.sparkContext.applicationId, [])
    wanted = {p for t in tables for f in t.inputFiles() for p in mine if f"/{p.rsplit('/', 1)[1]}/" in f} if tables else set(mine)
    for path in wanted:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        mine.remove(path)


#: Tasks over which the rows of one key are dealt in a split join; a bit each in a long.
PARTS = 64


def part(*by: str) -> Column:
    """The part of its key that a row belongs to."""
    return F.pmod(F.hash(*by), F.lit(PARTS))


def parts(*by: str) -> Column:
    """Aggregate of a key's rows: the parts that they are in, as bits, for spread()."""
    return F.bit_or(F.expr(f"shiftleft(1L, pmod(hash({', '.join(by)}), {PARTS}))")).alias("__parts")


def spread(keys: DataFrame) -> DataFrame:
    """keys with __parts, once for each part (__part) that has rows."""
    return keys.withColumn("__part", F.explode(F.expr(f"filter(sequence(0, {PARTS - 1}), i -> (shiftright(__parts, i) & 1) = 1)"))).drop("__parts")


def split_join(many: DataFrame, keys: DataFrame, key: str, *by: str) -> DataFrame:
    """many joined on key with keys, which hold __parts: rows of one key are dealt into parts by the columns `by`, so that no task gets all of them."""
    return many.withColumn("__part", part(*by)).join(spread(keys), [key, "__part"]).drop("__part")


def split_lookup(many: DataFrame, table: DataFrame, key: str, *by: str) -> DataFrame:
    """split_join with a table that has few rows a key; a row of it is copied only to the parts that want it."""
    return split_join(many, table.join(many.groupBy(key).agg(parts(*by)), key), key, *by)


def numbered(rows: DataFrame, order: list[str], within: str | None = None) -> DataFrame:
    """rows with place, from 0 in the order of the columns `order` (nulls first), and n, how many rows are numbered together.

    Rows are numbered on their own for each value of `within` (not null), if it is
    given.  They are laid in ranges of within and order and written with the
    range's number; a range adds what came before it to its own row numbers, so
    that no task sees more than a range, and a row for each range before.
    """
    group = [within] if within else []
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = saved(rows.repartitionByRange(ranges, *(F.col(c).asc_nulls_first() for c in group + order)).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = laid.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(*group)
    before = every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("n"))
    own = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*(F.col(c).asc_nulls_first() for c in order))) - 1
    return laid.withColumn("__own", own).join(counts, [*group, "__range"]).select(*rows.columns, (F.col("__before") + F.col("__own")).cast("long").alias("place"), "n")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Alternates large-star and small-star steps: neighbours are linked to the
    smallest one nearby until nothing changes.  A round is a few shuffles of
    edges, those of one node dealt into parts, and the number of rounds grows with
    the logarithm of the longest path.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), parts("b")).withColumn("m", F.least("a", "m"))
        large = split_join(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), parts("b"))
        small = split_join(large, least, "a", "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, now = now, saved(small, "edges")
        remove(now.sparkSession, old)
        was, mark = mark, now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select("node", F.col("node").alias("component")))
