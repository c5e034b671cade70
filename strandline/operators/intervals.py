"""Range and nearest joins on (contig, interval) by bins; no side is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.sequence import bind
from .tables import kept

#: Width of a bin in bases.
BIN = 100_000
#: Bins of the lists that contained looks up, and how many features a list holds at most.
NEAR, CROWD = 32_768, 1000


def range_join(left: DataFrame, right: DataFrame, contig: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN, flank: int = 0) -> DataFrame:
    """Pairs on one contig with right.beg - flank <= left.end and right.end + flank >= left.beg.

    Both sides are listed in their bins; a pair that shares several is kept in
    the first one only, so no distinct is needed.  Column names must differ, but
    for contig.
    """
    (lb, le), (rb, re) = left_span, right_span
    bins = lambda b, e: F.explode(F.sequence(F.floor(b / width), F.floor(e / width)))
    a = left.withColumn("__bin", bins(F.col(lb), F.col(le)))
    b = right if "__bin" in right.columns else right.withColumn("__bin", bins(F.col(rb) - flank, F.col(re) + flank))
    hit = (F.col(rb) - flank <= F.col(le)) & (F.col(re) + flank >= F.col(lb))
    own = F.col("__bin") == F.greatest(F.floor(F.col(lb) / width), F.floor((F.col(rb) - flank) / width))
    return a.join(b, [contig, "__bin"]).where(hit & own).drop("__bin")


def in_bins(spans: DataFrame, features: DataFrame, contig: str, span: tuple[str, str], feature: tuple[str, str], near: int = NEAR, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked, lists, far): spans within one bin of `near` bases, with __bin; for each bin __list, the features that overlap it, as structs; and all other spans.

    asked meet lists in one join by contig and __bin, for which they are shuffled
    once, whatever is to be told of the features.  far are spans over several bins,
    those in bins that more than `crowd` features overlap, and those without a
    place, so that no list is longer.
    """
    (beg, end), (fbeg, fend) = span, feature
    bin_of = lambda c: F.floor(F.col(c) / near)
    f = features.withColumn("__bin", F.explode(F.sequence(bin_of(fbeg), bin_of(fend))))
    x = spans.withColumn("__bin", F.when(F.col(contig).isNotNull() & (F.col(beg) <= F.col(end)) & (bin_of(beg) == bin_of(end)), bin_of(end)))
    asked, far = x.where(F.col("__bin").isNotNull()), x.where(F.col("__bin").isNull()).drop("__bin")
    crowded = kept(f.groupBy(contig, "__bin").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > crowd).drop("__n"))
    if not crowded.isEmpty():
        far = far.union(asked.join(crowded, [contig, "__bin"], "left_semi").select(*spans.columns))
        asked, f = asked.join(crowded, [contig, "__bin"], "left_anti").select(*x.columns), f.join(crowded, [contig, "__bin"], "left_anti")
    return asked, f.groupBy(contig, "__bin").agg(F.collect_list(F.struct(*(F.col(c) for c in features.columns if c != contig))).alias("__list")), far


def pairs_by_lists(left: DataFrame, right: DataFrame, contig: str, left_span: tuple[str, str], right_span: tuple[str, str], near: int = NEAR, crowd: int = CROWD) -> DataFrame:
    """The pairs of range_join, for features that are few in a bin of `near` bases: these are listed there, so that wide bins do, and a span is in few of them.

    Bins that more than `crowd` features overlap are joined row by row.
    """
    (lb, le), (rb, re) = left_span, right_span
    bin_of = lambda c: F.floor(c / near)
    listed = lambda rows, b, e: rows.withColumn("__bin", F.explode(F.sequence(bin_of(F.col(b)), bin_of(F.col(e)))))
    x, f = listed(left, lb, le), listed(right, rb, re)
    fits = lambda b, e: (b <= F.col(le)) & (e >= F.col(lb)) & (F.col("__bin") == F.greatest(bin_of(F.col(lb)), bin_of(b)))
    crowded = kept(f.groupBy(contig, "__bin").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > crowd).drop("__n"))
    few, many = f, None
    if not crowded.isEmpty():
        few = f.join(crowded, [contig, "__bin"], "left_anti")
        many = x.join(f.join(crowded, [contig, "__bin"], "left_semi"), [contig, "__bin"]).where(fits(F.col(rb), F.col(re)))
    own = [c for c in right.columns if c != contig]
    lists = few.groupBy(contig, "__bin").agg(F.collect_list(F.struct(*own)).alias("__list"))
    met = x.join(lists, [contig, "__bin"]).select(*left.columns, F.inline(F.filter("__list", lambda t: fits(t[rb], t[re]))))
    return met if many is None else met.union(many.select(*met.columns))


def outside(sites: DataFrame, features: DataFrame, contig: str, pos: str, span: tuple[str, str], width: int = BIN) -> DataFrame:
    """sites that lie in no feature; a site has one bin, so an anti-join by bins tells, and sites needn't meet again by name."""
    beg, end = span
    a = sites.withColumn("__bin", F.floor(F.col(pos) / width)).alias("a")
    b = features.select(contig, beg, end, F.explode(F.sequence(F.floor(F.col(beg) / width), F.floor(F.col(end) / width))).alias("__bin")).alias("b")
    same = (F.col(f"a.{contig}") == F.col(f"b.{contig}")) & (F.col("a.__bin") == F.col("b.__bin"))
    return a.join(b, same & F.col(f"a.{pos}").between(F.col(f"b.{beg}"), F.col(f"b.{end}")), "left_anti").select(*(F.col(f"a.{c}") for c in sites.columns))


def stored_bins(features: DataFrame, contig: str, span: tuple[str, str], table: str, width: int = BIN, flank: int = 0, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """features listed in their bins, stored as a table bucketed by contig and bin, and read again: an index for range_join, whose side of the join needs no shuffle.

    buckets: as many as there are shuffle partitions, unless told; path: the
    table's folder, else the warehouse.
    """
    spark = features.sparkSession
    beg, end = span
    bins = F.explode(F.sequence(F.floor((F.col(beg) - flank) / width), F.floor((F.col(end) + flank) / width)))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = features.withColumn("__bin", bins).repartition(n, contig, "__bin").write.format("parquet").bucketBy(n, contig, "__bin").sortBy(contig, "__bin")
    (out.option("path", path) if path else out).saveAsTable(table)
    return spark.table(table)


def nearest(sites: DataFrame, features: DataFrame, contig: str, pos: str, beg: str, end: str, name: str, upstream: bool, width: int = BIN) -> DataFrame:
    """sites with near_name, near_dist: the feature that ends last before pos, or begins first after it.

    Within a bin a sorted pass carries the last feature on; what reaches a bin
    from earlier ones comes from a running maximum over bins.  So no task sees
    more than a bin's rows, and a row a bin of its contig.  Of features as near,
    the smallest name counts, whatever its type; none gives null.
    """
    sign = 1 if upstream else -1
    edge, at = F.col(end if upstream else beg), F.col(pos)
    bin_of = lambda c: F.floor(c * sign / width)
    edges = features.groupBy(contig, (edge * sign).alias("__at")).agg(F.min(name).alias("__name"))
    marks = edges.select(contig, F.floor(F.col("__at") / width).alias("__bin"), "__at", F.lit(1).alias("__kind"), F.struct(F.col("__at").alias("at"), F.col("__name").alias("id")).alias("__near"))
    tops = marks.groupBy(contig, "__bin").agg(F.max("__near").alias("__top"))
    asked = sites.select(contig, F.struct(*[F.col(c) for c in sites.columns]).alias("__row"), bin_of(at).alias("__bin"), (at * sign).alias("__at"), F.lit(0).alias("__kind"))
    inside = Window.partitionBy(contig, "__bin").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, -1)
    local = asked.unionByName(marks, allowMissingColumns=True).withColumn("__in", F.max("__near").over(inside)).where("__kind = 0")
    steps = asked.select(contig, "__bin").distinct().join(tops, [contig, "__bin"], "full")
    earlier = Window.partitionBy(contig).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("__carry", F.max("__top").over(earlier)).select(contig, "__bin", "__carry")
    found = local.join(carried, [contig, "__bin"], "left").withColumn("__best", F.coalesce("__in", "__carry"))
    return found.select("__row.*", F.col("__best.id").alias("near_name"), (F.col("__at") - F.col("__best.at")).alias("near_dist"))


def _carried(sites: DataFrame, features: DataFrame, contig: str, edge: str, at: str, width: int) -> DataFrame:
    """Rows of sites and features with __n, how many features have an edge up to the row's place: within bins by a sorted pass, across them by sums of bins."""
    bin_of = lambda c: F.floor(F.col(c) / width)
    marks = features.groupBy(contig, F.col(edge).alias("__at")).agg(F.count(F.lit(1)).alias("__many")).withColumn("__bin", bin_of("__at")).withColumn("__kind", F.lit(0))
    sums = marks.groupBy(contig, "__bin").agg(F.sum("__many").alias("__sum"))
    asked = sites.select(contig, F.struct(*(F.col(c) for c in sites.columns)).alias("__row"), F.col(at).alias("__at"), bin_of(at).alias("__bin"), F.lit(1).alias("__kind"))
    inside = Window.partitionBy(contig, "__bin").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = asked.unionByName(marks, allowMissingColumns=True).withColumn("__in", F.coalesce(F.sum("__many").over(inside), F.lit(0))).where("__kind = 1")
    steps = asked.select(contig, "__bin").distinct().join(sums, [contig, "__bin"], "full")
    earlier = Window.partitionBy(contig).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.select(contig, "__bin", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    return local.join(before, [contig, "__bin"]).withColumn("__n", F.col("__before") + F.col("__in"))


def counted(sites: DataFrame, features: DataFrame, contig: str, edge: str, at: str, name: str, width: int = BIN) -> DataFrame:
    """sites with `name`: how many features of the contig have an edge at or before the place `at`; no task sees more than a bin's rows, and a row a bin of its contig."""
    return _carried(sites, features, contig, edge, at, width).select("__row.*", F.col("__n").cast("long").alias(name))


def ranked(features: DataFrame, contig: str, edge: str, order: str, width: int = BIN) -> DataFrame:
    """features with rank, from 1 in each contig, by edge and then by order."""
    x = features.withColumn("__bin", F.floor(F.col(edge) / width))
    sums = x.groupBy(contig, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = sums.select(contig, "__bin", F.coalesce(F.sum("__n").over(Window.partitionBy(contig).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(contig, "__bin").orderBy(edge, order))
    return x.withColumn("__own", own).join(before, [contig, "__bin"]).select(*features.columns, (F.col("__before") + F.col("__own")).cast("long").alias("rank"))


def contained(spans: DataFrame, features: DataFrame, contig: str, span: tuple[str, str], feature: tuple[str, str], name: str, most: int = 5, width: int = BIN, near: int = NEAR, crowd: int = CROWD) -> DataFrame:
    """spans with n_inside, how many features lie wholly in each, and inside, their names in order, if there are no more than `most` (else null).

    A span within one bin of `near` bases meets the list of features that end in
    that bin, and is shuffled for this once.  Spans over several bins, and those in
    bins where more than `crowd` features end, are told by the order of ends.
    """
    (beg, end), (fbeg, fend) = span, feature
    bin_of = lambda c: F.floor(F.col(c) / near)
    f = features.select(contig, F.col(fbeg).alias("__fb"), F.col(fend).alias("__fe"), F.col(name).alias("__name")).withColumn("__bin", bin_of("__fe"))
    x = spans.where(F.col(contig).isNotNull()).withColumn("__bin", F.when((F.col(beg) <= F.col(end)) & (bin_of(beg) == bin_of(end)), bin_of(end)))
    far = x.where(F.col("__bin").isNull())
    crowded = kept(f.groupBy(contig, "__bin").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > crowd).drop("__n"))
    if not crowded.isEmpty():
        far = far.union(x.join(crowded, [contig, "__bin"], "left_semi").select(*x.columns))
        x, f = x.join(crowded, [contig, "__bin"], "left_anti"), f.join(crowded, [contig, "__bin"], "left_anti")
    lists = f.groupBy(contig, "__bin").agg(F.collect_list(F.struct("__fb", "__name", "__fe")).alias("__list"))
    hit = F.filter("__list", lambda e: (e["__fb"] >= F.col(beg)) & e["__fe"].between(F.col(beg), F.col(end)))

    def told(y: Column) -> Column:
        n = F.size(y["hit"]).cast("long")
        names = F.transform(F.sort_array(y["hit"]), lambda e: e["__name"])
        return F.struct(n.alias("n_inside"), F.when((n == 0) | (n <= most), names).alias("inside"))

    hit = F.coalesce(hit, F.array().cast(lists.schema["__list"].dataType))
    met = x.where(F.col("__bin").isNotNull()).join(lists, [contig, "__bin"], "left").select(*spans.columns, F.inline(F.array(bind({"hit": hit}, told))))
    far = kept(far.drop("__bin"))
    return met if far.isEmpty() else met.union(_by_ends(far, features, contig, span, feature, name, most, width))


def _by_ends(spans: DataFrame, features: DataFrame, contig: str, span: tuple[str, str], feature: tuple[str, str], name: str, most: int, width: int) -> DataFrame:
    """contained for spans of any length.

    The count is that of features that end by the span's end, less those that end
    before it begins, less those that end in it but begin before; only these
    last ones, which lie over the span's first base, are met one by one.  Names
    are looked up by rank among the ends, where few are to be told.  So the rows
    of the plan don't grow with the length of spans.
    """
    (beg, end), (fbeg, fend) = span, feature
    x = spans.select(*spans.columns).withColumn("__span", F.struct(contig, beg, end))
    places = x.select("__span", contig, beg, end, (F.col(beg) - 1).alias("__below")).distinct()
    places = counted(counted(places, features, contig, fend, end, "__upto", width), features, contig, fend, "__below", "__under", width)
    f = features.select(contig, F.col(fbeg).alias("__fb"), F.col(fend).alias("__fe"), F.col(name).alias("__name"))
    over = range_join(places.select("__span", contig, F.col(beg).alias("__p"), F.col(end).alias("__q")), f, contig, ("__p", "__p"), ("__fb", "__fe"), width).where("__fb < __p and __fe <= __q")
    over = over.groupBy("__span").agg(F.count(F.lit(1)).alias("__over"))
    n = F.col("__upto") - F.col("__under") - F.coalesce("__over", F.lit(0))
    found = places.join(over, "__span", "left").withColumn("n_inside", n)
    few = found.where((F.col("n_inside") > 0) & (F.col("n_inside") <= most)).withColumn("rank", F.explode(F.sequence(F.col("__under") + 1, F.col("__upto"))))
    told = few.join(ranked(f, contig, "__fe", "__name", width), [contig, "rank"]).where(F.col("__fb") >= F.col(beg))
    told = told.groupBy("__span").agg(F.transform(F.sort_array(F.collect_list(F.struct("__fb", "__name"))), lambda s: s["__name"]).alias("inside"))
    found = found.select("__span", "n_inside").join(told, "__span", "left")
    return x.join(found, "__span").select(*spans.columns, "n_inside", F.when(F.col("n_inside") == 0, F.array().cast("array<string>")).otherwise(F.col("inside")).alias("inside"))
