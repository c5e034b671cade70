"""Tables between steps, and sites outside of features."""

from pyspark.sql import functions as F

from strandline.operators import intervals, tables


def test_kept_is_computed_once(spark):
    """One evaluation of each row, nulls and nested values kept, Parquet behind it."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize(range(50), 2).map(lambda i: (seen.add(1), (i, None if i % 7 == 0 else str(i), [(i, "x")]))[1])
    d = spark.createDataFrame(rows, "a long, b string, c array<struct<n:long,s:string>>")
    out = tables.kept(d)
    assert out.schema == d.schema and sorted(r.a for r in out.collect()) == list(range(50)) and out.where("b is null").count() == 8
    assert seen.value == 50 and out.inputFiles()[0].endswith(".parquet")


def test_outside(spark):
    sites = spark.createDataFrame([(1, 1, 5), (2, 1, 10), (3, 1, 20), (4, 1, 21), (5, 2, 12), (6, 1, 4005)], "vid int, contig_id int, pos long")
    features = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 3990, 4010)], "tid int, contig_id int, beg long, tend long")
    got = intervals.outside(sites, features, "contig_id", "pos", ("beg", "tend"), width=1000)
    assert got.columns == sites.columns and sorted(r.vid for r in got.collect()) == [1, 4, 5]
