"""Mixing sources to target weights by Pareto order sampling (operator 10, DataFrame functions only).

Sources get target words by weight, up to a number of epochs of what they have.
A target is whole copies of the source, which every document gets for certain,
and a part of one more copy.  For that part documents are ranked by their random
odds u / (1 - u) over their inclusion odds, and the first ones fill the words
wanted: a sample of fixed size.  Probabilities are unequal: a document's odds are
those of its source, p / (1 - p), times its utility, which by default is its
size over the mean size of its source, from a quarter to four, so that the
extra copy goes to fuller documents rather than to scraps.

Ranks are cut at fine buckets of the ranking value, whose sums are small; only
the documents of the one bucket a source's target falls into are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import saved

WEIGHTS, SHARE, EPOCHS, SEED, BUCKETS = (3, 1, 2), 1.5, 2, "mix-1", 8192
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, rows, target for sizes (source, size).

    Sources by code point, null last, have the weights in turn.  Targets share
    `share` of all words by weight, none above `epochs` times its size, the
    excess shared by weight among the rest: with sources ordered by size over
    weight, the first ones are full, and the others get the rest by weight.
    One row a source is all that is sorted here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    ranked = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("limit", (F.col("source_size") * epochs).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    # the level of the first source that isn't full holds for it and all after it; those computed after it are lower
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return ranked.select("source", "source_size", "rows", F.when(F.col("full"), F.col("limit")).otherwise(final * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, utility: str | None = None, whole: bool = False, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken.

    size: words of the text, null as none.  taken: words the mix takes of the
    document, repeats counted.  One document a source is taken in part, so that
    the sum is the target; with whole=True it is taken if half or more is wanted.
    utility names a column that multiplies a document's inclusion odds in place
    of its size (null: 1, under 0: 0).  A null source is a source, the last one.  Ties in rank go by
    id, then size; rows alike are interchangeable, so repeated ones get results
    that are right together.  The same rows and seed give the same results.
    Other columns are ignored; an empty table gives no rows.
    """
    tilt = F.greatest(F.coalesce(F.col(utility).cast("double"), F.lit(1.0)), F.lit(0.0)) if utility else F.lit(None).cast("double")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), tilt.alias("tilt"))
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("long")
    own = saved(own.withColumn("u", (code + 0.5) / float(1 << 52)), "sizes")

    aims = targets(own, weights, share, epochs)
    aims = aims.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    aims = aims.withColumn("wanted", F.round(F.col("target")).cast("long") - F.col("copies") * F.col("source_size"))
    aims = aims.withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("copies")).otherwise(0.0))
    aims = saved(aims.select(F.col("source").alias("of"), "source_size", "rows", "target", "copies", "wanted", "p"), "targets")

    fuller = F.least(F.greatest(F.col("size").cast("double") * F.col("rows") / F.col("source_size"), F.lit(0.25)), F.lit(4.0))
    odds = F.col("p") / (1 - F.col("p")) * F.coalesce(F.col("tilt"), fuller)
    ratio = F.when(odds > 0, F.col("u") / (1 - F.col("u")) / odds).otherwise(F.lit(float("inf")))
    place = F.when(odds > 0, F.least(F.floor(F.col("ratio") / (1 + F.col("ratio")) * buckets), F.lit(buckets - 1))).otherwise(buckets - 1)
    ranked = own.join(aims, F.col("source").eqNullSafe(F.col("of"))).withColumn("ratio", ratio).withColumn("bucket", place)
    sums = ranked.groupBy("of", "bucket").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("before", before).where("before < wanted and wanted <= before + words").select(F.col("of").alias("cut_of"), F.col("bucket").alias("cut_bucket"), "before")
    ranked = ranked.join(saved(cut, "cuts"), F.col("of").eqNullSafe(F.col("cut_of")), "left")

    # wanted is none, or falls into cut_bucket
    clear = ranked.where("cut_bucket is null or bucket <> cut_bucket").withColumn("part", F.when(F.col("bucket") < F.col("cut_bucket"), F.col("size")).otherwise(0))
    inside = ranked.where("bucket = cut_bucket")
    upto = F.sum("size").over(Window.partitionBy("of").orderBy("ratio", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = F.greatest(F.least(F.col("wanted") - F.col("before") - (upto - F.col("size")), F.col("size")), F.lit(0))
    inside = inside.withColumn("room", room).withColumn("part", F.when(F.lit(whole), F.when(2 * F.col("room") >= F.col("size"), F.col("size")).otherwise(0)).otherwise(F.col("room"))).drop("room")
    return clear.union(inside).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """docs with each row as often as the mix takes it as a whole; all columns stay.

    Rows that share an id are taken alike, as often as the first of them by size.
    """
    taken = mix_sources(docs, whole=True, **options).where("size > 0").groupBy("doc_id").agg(F.min(F.expr("cast(taken div size as int)")).alias("__times")).withColumnRenamed("doc_id", "__id")
    many = docs.join(taken, F.col(options.get("doc_id", "doc_id")).eqNullSafe(F.col("__id"))).withColumn("__copy", F.explode(F.when(F.col("__times") > 0, F.sequence(F.lit(1), F.col("__times"))).otherwise(F.array().cast("array<int>"))))
    return many.select(*docs.columns)
