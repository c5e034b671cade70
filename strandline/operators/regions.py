"""Which transcripts a place or span of the genome is told by, or what lies between genes.

A place is told by every transcript over it.  So is a span, if all transcripts
that it meets overlap; if they don't, it is told by its two ends, each pair of
what lies there.  Where nothing is met, the neighbours are told.

The branch of a span needs the last begin and the first end among all transcripts
that it meets.  Those come from nearest joins and from the transcripts over its
two ends, so that a span of a whole chromosome costs no more than a short one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DataType

from ..functions import coords
from . import annotate, genes, intervals, records
from .tables import kept

#: Bases before and after the start of transcription that make a promoter.
PROMOTER = (1000, 0)
_SPAN = ["vid", "contig_id", "pos", "till"]


class Told(NamedTuple):
    """pairs: spans and transcripts, with outside_beg and outside_end, what lies at an end beyond the transcript, and spanning; wide: spans by their two ends, with transcript, names, gene, strand, region and label; between: spans that meet nothing, with region, promoters."""

    pairs: DataFrame
    wide: DataFrame
    between: DataFrame


def contig_sizes(chunks: DataFrame) -> DataFrame:
    """contig_id, len of a genome in chunks."""
    return chunks.groupBy("contig_id").agg(F.max(F.col("first") + F.length("bases") - 1).alias("len"))


def side_text(name: Column, distance: Column, strand: Column, upstream: bool) -> Column:
    """NAME(n_bp_downstream): which side of its neighbour a place lies on, in the neighbour's direction."""
    behind = "+" if upstream else "-"
    return F.concat(name, F.lit("("), distance.cast("string"), F.when(strand == behind, "_bp_downstream)").otherwise("_bp_upstream)"))


def _before(low: str) -> Column:
    """The text of what lies before low, of the column up."""
    return F.coalesce(side_text(F.col("up.gene_name"), F.col("up.dist"), F.col("up.strand"), True), F.concat(F.lit("5'-telomere("), F.col(low).cast("string"), F.lit("_bp)")))


def _after(high: str) -> Column:
    """The text of what lies after high, of the columns down and len."""
    return F.coalesce(side_text(F.col("down.gene_name"), F.col("down.dist"), F.col("down.strand"), False), F.concat(F.lit("3'-telomere("), F.greatest(F.col("len") - F.col(high), F.lit(0)).cast("string"), F.lit("_bp)")))


def neighbours(places: DataFrame, transcripts: DataFrame, sizes: DataFrame, low: str = "pos", high: str = "till", width: int = intervals.BIN) -> DataFrame:
    """places with up and down, structs (dist, gene_name, strand, tid) of the transcripts that end last before low and begin first after high (null at the ends of a contig), and the texts before and after.

    Of several as near, the one that begins first counts, then the smallest tid.
    """
    known = transcripts.select("contig_id", "beg", "tend", F.struct("beg", "tid", "gene_name", "strand").alias("who"))
    x = intervals.nearest(places, known, "contig_id", low, "beg", "tend", "who", True, width).withColumnsRenamed({"near_name": "__up", "near_dist": "__up_dist"})
    x = intervals.nearest(x, known, "contig_id", high, "beg", "tend", "who", False, width).join(sizes, "contig_id", "left")
    side = lambda who, dist: F.when(F.col(who).isNotNull(), F.struct(F.col(dist).alias("dist"), F.col(who)["gene_name"].alias("gene_name"), F.col(who)["strand"].alias("strand"), F.col(who)["tid"].alias("tid")))
    x = x.withColumn("up", side("__up", "__up_dist")).withColumn("down", side("near_name", "near_dist"))
    return x.withColumn("before", _before(low)).withColumn("after", _after(high)).drop("__up", "__up_dist", "near_name", "near_dist", "len")


def between_text(before: Column, after: Column) -> Column:
    return F.concat(F.lit("intergenic_between_"), before, F.lit("_and_"), after)


def branches(spans: DataFrame, transcripts: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """vid, contig_id, pos, till, way, at: way is near, if all transcripts that a span meets overlap (they do at the place `at`), wide, if not all do, and between, if it meets none."""
    t = transcripts.select("contig_id", "tid", "beg", "tend")
    x = spans.select(*_SPAN).withColumn("__from", F.col("pos") - 1).withColumn("__to", F.col("till") + 1)
    x = intervals.nearest(x, t, "contig_id", "__to", "beg", "beg", "tid", True, width).withColumn("__last", F.col("__to") - F.col("near_dist")).drop("near_name", "near_dist")
    x = intervals.nearest(x, t, "contig_id", "__from", "tend", "tend", "tid", False, width).withColumn("__first", F.col("__from") + F.col("near_dist")).drop("near_name", "near_dist")
    over = lambda at: intervals.range_join(spans.select(*_SPAN), t, "contig_id", (at, at), ("beg", "tend"), width).groupBy("vid")
    x = x.join(over("pos").agg(F.max("beg").alias("__beg")), "vid", "left").join(over("till").agg(F.min("tend").alias("__end")), "vid", "left")
    last = F.when(F.col("__last") > F.col("pos"), F.col("__last")).otherwise(F.col("__beg"))
    first = F.when(F.col("__first") < F.col("till"), F.col("__first")).otherwise(F.col("__end"))
    way = F.when(last.isNull(), "between").when(last < first, "near").otherwise("wide")
    return x.select(*_SPAN, way.alias("way"), F.greatest("pos", last).alias("at"))


def gene_spans(transcripts: DataFrame) -> DataFrame:
    """contig_id, gene_name, gene_beg, gene_end: the place of a gene's longest transcript, whatever its source."""
    return genes.gene_table(transcripts, ["contig_id", "gene_name"]).select("contig_id", "gene_name", F.col("beg").alias("gene_beg"), F.col("tend").alias("gene_end"))


def spanning_text(n: Column, names: Column) -> Column:
    """_spanning_[...]: up to five genes by name, more by number, none as nothing."""
    return F.when(n == 0, "").when(names.isNotNull(), F.concat(F.lit("_spanning_["), F.array_join(names, ","), F.lit("]"))).otherwise(F.concat(F.lit("_spanning_["), n.cast("string"), F.lit("_genes]")))


def promoter_items(pairs: DataFrame, before: int = PROMOTER[0], after: int = PROMOTER[1]) -> Column:
    """What info says of a transcript's promoter at a place pos, or in a span pos to till: its gene, bases in common and their share of the span; null for none."""
    plus = F.col("strand") == "+"
    low = F.when(plus, F.col("pos") - F.col("beg")).otherwise(F.col("tend") - F.col("till"))
    return promoter_text(low, low + F.col("till") - F.col("pos"), F.col("gene_name"), before, after)


def promoter_text(low: Column, high: Column, gene: Column, before: int = PROMOTER[0], after: int = PROMOTER[1]) -> Column:
    """The same for a span from low to high, counted from the start of transcription."""
    common = F.least(high, F.lit(after)) - F.greatest(low, F.lit(-before)) + 1
    named = F.concat(F.lit("promoter_region_of_["), gene, F.lit("]"))
    share = F.format_string("_overlaping_%d_bp(%.2f%%)", common.cast("long"), (common * 100 / (high - low + 1)).cast("double"))
    return F.when((high >= -before) & (low <= after), F.when(low == high, named).otherwise(F.concat(named, share)))


def _described(spans: DataFrame, transcripts: DataFrame, sizes: DataFrame, at: str, width: int) -> DataFrame:
    """vid and what lies at one end of a span: a transcript each (tid, name, type, gene, strand, text, exon of an intron, utr), or the space between genes (nulls but for text)."""
    ends = spans.select("vid", "contig_id", F.col(at).alias("place"))
    met = intervals.range_join(ends, transcripts, "contig_id", ("place", "place"), ("beg", "tend"), width)
    coding = F.col("transcript_type") == "protein_coding"
    met = annotate.once(met, site=coords.site(F.col("place"), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"), coding), c=coords.cdna(F.col("place"), F.col("segs"), F.col("strand")))
    text = records.place_text(F.col("site"), F.coalesce(F.col("c.offset") == 0, F.lit(False)), F.col("strand"))
    told = met.select("vid", "tid", F.col("name").alias("name"), records.transcript_text().alias("full"), F.col("gene_name").alias("gene"), "strand", text.alias("text"), F.when(F.col("site.part") == "intronic", F.col("site.exon")).alias("intron"), F.col("site.utr").alias("utr"))
    empty = ends.join(told.select("vid").distinct(), "vid", "left_anti")
    lone = neighbours(empty, transcripts, sizes, "place", "place", width)
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return told.union(lone.select("vid", null(told.schema["tid"].dataType, "tid"), *(null("string", n) for n in ("name", "full", "gene", "strand")), between_text(F.col("before"), F.col("after")).alias("text"), null("int", "intron"), null("int", "utr")))


def _carried(asked: DataFrame, t: DataFrame, sizes: DataFrame, near: int) -> DataFrame:
    """contig_id, __bin of asked with __up, __down, the nearest transcripts that end in earlier bins and begin in later ones, and len of the contig: a row a bin, with all that places in it need of other bins."""
    who = F.struct("beg", "tid", "gene_name", "strand").alias("who")
    tops = t.groupBy("contig_id", F.floor(F.col("tend") / near).alias("__bin")).agg(F.min(F.struct((-F.col("tend")).alias("at"), who)).alias("__u"))
    lows = t.groupBy("contig_id", F.floor(F.col("beg") / near).alias("__bin")).agg(F.min(F.struct(F.col("beg").alias("at"), who)).alias("__d"))
    x = asked.withColumn("__asked", F.lit(True)).join(tops, ["contig_id", "__bin"], "full").join(lows, ["contig_id", "__bin"], "full")
    w = Window.partitionBy("contig_id")
    up = F.min("__u").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    down = F.min("__d").over(w.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("__up", up).withColumn("__down", down).where("__asked").select("contig_id", "__bin", "__up", "__down").join(sizes.select("contig_id", "len"), "contig_id", "left")


def _sides(rows: DataFrame, low: str, high: str) -> DataFrame:
    """rows (with __list, __up, __down, len) with up, down, before and after, as neighbours gives them."""
    who = lambda x: F.struct(x["beg"].alias("beg"), x["tid"].alias("tid"), x["gene_name"].alias("gene_name"), x["strand"].alias("strand"))
    own_up = F.array_min(F.transform(F.filter("__list", lambda x: x["tend"] < F.col(low)), lambda x: F.struct((-x["tend"]).alias("at"), who(x).alias("who"))))
    own_down = F.array_min(F.transform(F.filter("__list", lambda x: x["beg"] > F.col(high)), lambda x: F.struct(x["beg"].alias("at"), who(x).alias("who"))))
    x = annotate.once(rows, __u=F.coalesce(own_up, F.col("__up")), __d=F.coalesce(own_down, F.col("__down")))
    side = lambda c, dist: F.when(F.col(c).isNotNull(), F.struct(dist.alias("dist"), F.col(c)["who"]["gene_name"].alias("gene_name"), F.col(c)["who"]["strand"].alias("strand"), F.col(c)["who"]["tid"].alias("tid")))
    x = x.withColumn("up", side("__u", F.col(low) + F.col("__u.at"))).withColumn("down", side("__d", F.col("__d.at") - F.col(high)))
    return x.withColumn("before", _before(low)).withColumn("after", _after(high)).drop("__u", "__d")


def told_by_lists(spans: DataFrame, transcripts: DataFrame, sizes: DataFrame, near: int = intervals.NEAR, crowd: int = intervals.CROWD, longest: bool = False, promoter: tuple[int, int] = PROMOTER, ranges: bool = True) -> tuple[Told, DataFrame]:
    """Told of spans that lie within a bin of `near` bases, and the other spans.

    A bin's row has the list of its transcripts and genes and the nearest ones
    outside of it, so a span is shuffled once for all that is told of it.
    """
    t, none = transcripts, F.lit(None).cast("string")
    own = [c for c in t.columns if c != "contig_id"]
    asked, lists, far = intervals.in_bins(spans, t, "contig_id", ("pos", "till"), ("beg", "tend"), near, crowd)
    index = _carried(asked.select("contig_id", "__bin").distinct(), t.select("contig_id", "tid", "beg", "tend", "gene_name", "strand"), sizes, near).join(lists, ["contig_id", "__bin"], "left")
    if ranges:
        g = gene_spans(t).groupBy("contig_id", F.floor(F.col("gene_end") / near).alias("__bin")).agg(F.collect_list(F.struct(F.col("gene_beg").alias("beg"), F.col("gene_name").alias("name"), F.col("gene_end").alias("end"))).alias("__genes"))
        index = index.join(g, ["contig_id", "__bin"], "left")
    x = asked.join(index, ["contig_id", "__bin"])
    met = F.filter("__list", lambda a: (a["beg"] <= F.col("till")) & (a["tend"] >= F.col("pos")))
    x = annotate.once(x, __met=F.coalesce(met, F.array().cast(lists.schema["__list"].dataType)))
    alone = _alone(_sides(x.where(F.size("__met") == 0), "pos", "till"), spans, promoter)

    if not ranges:
        pairs = x.select(*spans.columns, F.inline("__met"))
        pairs = genes.longest_only(pairs) if longest else pairs
        return Told(pairs.withColumns({c: none for c in ("outside_beg", "outside_end", "spanning")}), spans.limit(0), alone), far
    apart = (F.col("pos") < F.col("till")) & (F.array_max(F.transform("__met", lambda a: a["beg"])) >= F.array_min(F.transform("__met", lambda a: a["tend"])))
    inside = F.filter(F.coalesce("__genes", F.array().cast(g.schema["__genes"].dataType)), lambda e: (e["beg"] >= F.col("pos")) & (e["end"] <= F.col("till")))

    def spanning(rows: DataFrame) -> DataFrame:
        rows = annotate.once(rows, __inside=inside)
        names = F.when(F.size("__inside") <= 5, F.transform(F.sort_array("__inside"), lambda e: e["name"]))
        return rows.withColumn("spanning", spanning_text(F.size("__inside").cast("long"), names)).drop("__inside")

    near_rows = _sides(spanning(x.where((F.size("__met") > 0) & ~apart)), "pos", "till")
    pairs = near_rows.select(*spans.columns, "before", "after", "spanning", F.inline("__met"))
    pairs = genes.longest_only(pairs) if longest else pairs
    low, high = _ends_outside()
    ranged = lambda c: F.when(F.col("pos") < F.col("till"), c)
    pairs = pairs.select(*spans.columns, *own, ranged(low).alias("outside_beg"), ranged(high).alias("outside_end"), ranged(F.col("spanning")).alias("spanning"))

    wide = spanning(x.where((F.size("__met") > 0) & apart))
    for at, side in (("pos", "l"), ("till", "r")):
        place = F.col(at)
        over = F.filter("__met", lambda a: place.between(a["beg"], a["tend"]))  # noqa: B023  called at once
        wide = _sides(wide, at, at).withColumn("__empty", between_text(F.col("before"), F.col("after"))).drop("up", "down", "before", "after")
        wide = wide.withColumn("__over", over).select("*", F.explode_outer("__over").alias("__t")).drop("__over")
        wide = _with_end(wide, at).withColumn(side, F.when(F.col("__t").isNotNull(), F.col("__end")).otherwise(_no_transcript(F.col("__empty"), t.schema["tid"].dataType))).drop("__t", "__end", "__empty")
    return Told(pairs, _two_ends(wide, spans), alone), far


def _with_end(rows: DataFrame, at: str) -> DataFrame:
    """rows with __end, what the transcript __t has at the place `at`, as _described tells it."""
    t = lambda c: F.col(f"__t.{c}")
    x = annotate.once(rows, __s=coords.site(F.col(at), t("exons"), t("strand"), t("cds_beg"), t("cds_end"), t("transcript_type") == "protein_coding"), __c=coords.cdna(F.col(at), t("segs"), t("strand")))
    text = records.place_text(F.col("__s"), F.coalesce(F.col("__c.offset") == 0, F.lit(False)), t("strand"))
    end = F.struct(t("tid").alias("tid"), t("name").alias("name"), records.transcript_text("__t.name", "__t.").alias("full"), t("gene_name").alias("gene"), t("strand").alias("strand"), text.alias("text"), F.when(F.col("__s.part") == "intronic", F.col("__s.exon")).cast("int").alias("intron"), F.col("__s.utr").cast("int").alias("utr"))
    return x.withColumn("__end", end).drop("__s", "__c")


def _no_transcript(text: Column, tid: DataType) -> Column:
    """The same of a place between genes."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(null(tid).alias("tid"), *(null("string").alias(n) for n in ("name", "full", "gene", "strand")), text.alias("text"), null("int").alias("intron"), null("int").alias("utr"))


def _ends_outside() -> tuple[Column, Column]:
    """outside_beg and outside_end of pairs with before and after: what lies at the ends of a span beyond its transcript."""
    low = F.when(F.col("pos") < F.col("beg"), between_text(F.col("before"), side_text(F.col("gene_name"), F.col("beg") - F.col("pos"), F.col("strand"), False)))
    high = F.when(F.col("till") > F.col("tend"), between_text(side_text(F.col("gene_name"), F.col("till") - F.col("tend"), F.col("strand"), True), F.col("after")))
    return low, high


def told(spans: DataFrame, transcripts: DataFrame, sizes: DataFrame, width: int = intervals.BIN, longest: bool = False, promoter: tuple[int, int] = PROMOTER, ranges: bool = True, near: int = intervals.NEAR, crowd: int = intervals.CROWD) -> Told:
    """Told of spans (vid, one row each, contig_id, pos, till and other columns).

    A place (pos = till) needs one range join only; ranges=False says that all
    are places.  longest keeps, of each gene that a span meets, the longest
    transcript.  Spans within a bin are told by lists, others by joins.
    """
    close, far = told_by_lists(spans, transcripts, sizes, near, crowd, longest, promoter, ranges)
    far = kept(far)
    if far.isEmpty():
        return close
    beyond = told_by_joins(far, transcripts, sizes, width, longest, promoter, ranges)
    return Told(*(a.unionByName(b) for a, b in zip(close, beyond, strict=True)))


def told_by_joins(spans: DataFrame, transcripts: DataFrame, sizes: DataFrame, width: int = intervals.BIN, longest: bool = False, promoter: tuple[int, int] = PROMOTER, ranges: bool = True) -> Told:
    """told for spans of any length; what the parts share is written between steps (tables.kept)."""
    t, none = transcripts, F.lit(None).cast("string")
    if not ranges:
        pairs = annotate.on_transcripts(spans, t)
        alone = neighbours(spans.join(pairs.select("vid").distinct(), "vid", "left_anti"), t, sizes, width=width)
        pairs = genes.longest_only(pairs) if longest else pairs
        return Told(pairs.withColumns({c: none for c in ("outside_beg", "outside_end", "spanning")}), spans.limit(0), _alone(alone, spans, promoter))
    points, ranged = spans.where("pos = till"), spans.where("pos < till")
    way = kept(branches(ranged, t, width))
    near = ranged.join(way.where("way = 'near'").select("vid", "at"), "vid")
    single, several = annotate.on_transcripts(points, t), intervals.range_join(near, t, "contig_id", ("at", "at"), ("beg", "tend"), width).drop("at")
    if longest:
        single, several = genes.longest_only(single), genes.longest_only(several)

    # ends of a span that lie beyond its transcript
    cut = several.select("vid", "contig_id", "pos", "till", "tid", "beg", "tend", "strand", "gene_name").where("pos < beg or till > tend")
    lone = neighbours(cut.select("vid", "contig_id", "pos", "till").distinct(), t, sizes, width=width).select("vid", "before", "after")
    cut = cut.join(lone, "vid")
    low, high = _ends_outside()
    cut = kept(cut.select("vid", "tid", low.alias("outside_beg"), high.alias("outside_end")))

    asked = way.where("way <> 'between'").select(*_SPAN)
    inside = intervals.contained(asked, gene_spans(t), "contig_id", ("pos", "till"), ("gene_beg", "gene_end"), "gene_name", width=width)
    inside = kept(inside.select("vid", spanning_text(F.col("n_inside"), F.col("inside")).alias("spanning")))
    several = several.join(cut, ["vid", "tid"], "left").join(inside, "vid", "left")
    pairs = several.unionByName(single.withColumns({"outside_beg": none, "outside_end": none, "spanning": none}))

    apart = ranged.join(way.where("way = 'wide'").select("vid"), "vid", "left_semi")
    side = lambda at, as_: _described(apart, t, sizes, at, width).select("vid", F.struct("tid", "name", "full", "gene", "strand", "text", "intron", "utr").alias(as_))
    wide = apart.join(side("pos", "l"), "vid").join(side("till", "r"), "vid").join(inside, "vid", "left")
    wide = _two_ends(wide, spans)

    met = annotate.on_transcripts(points, t.select("tid", "contig_id", "beg", "tend")).select("vid").union(way.where("way <> 'between'").select("vid"))
    alone = neighbours(spans.join(met.distinct(), "vid", "left_anti"), t, sizes, width=width)
    return Told(pairs, kept(wide), kept(_alone(alone, spans, promoter)))


def _two_ends(wide: DataFrame, spans: DataFrame) -> DataFrame:
    """Told.wide of spans with l and r, what lies at each end, and spanning."""
    both, one = F.col("l.tid").isNotNull() & F.col("r.tid").isNotNull(), F.col("l.tid").isNotNull()
    same = both & (F.col("l.tid") == F.col("r.tid"))
    named = lambda s: F.concat_ws(";", f"{s}.text", f"{s}.gene")
    inner = F.concat(F.lit("inside_["), "l.text", F.lit("]"))
    outer = lambda a, b: F.concat(F.lit("from_["), a, F.lit("]_to_["), b, F.lit("]"), "spanning")
    region = F.when((F.col("l.text") == F.col("r.text")) & (same | ~both), inner).when(same, outer(F.col("l.text"), F.col("r.text"))).otherwise(outer(named("l"), named("r")))
    comma = F.lit(",")
    pair = lambda f: F.when(same, F.col(f"l.{f}")).when(both, F.concat(f"l.{f}", comma, f"r.{f}"))
    label = F.when(F.col("l.intron") == F.col("r.intron"), "Intronic").when(F.col("l.utr") == F.col("r.utr"), F.concat(F.col("l.utr").cast("string"), F.lit("-UTR"))).otherwise("Unclassified")
    return wide.select(
        *spans.columns, pair("full").alias("__full"), F.coalesce(pair("full"), F.when(one, F.concat("l.full", comma)).when(F.col("r.tid").isNotNull(), F.concat(comma, "r.full"))).alias("transcript"),
        F.coalesce(pair("gene"), F.when(one, F.concat("l.gene", comma)).otherwise(F.concat("r.gene", comma))).alias("gene"), F.coalesce(pair("strand"), F.col("l.strand"), F.col("r.strand")).alias("strand"),
        F.coalesce(pair("name"), F.col("l.name"), F.col("r.name")).alias("names"), F.coalesce(pair("gene"), F.col("l.gene"), F.col("r.gene")).alias("genes"), region.alias("region"), label.alias("label"),
    ).drop("__full")


def _alone(alone: DataFrame, spans: DataFrame, promoter: tuple[int, int]) -> DataFrame:
    """neighbours of spans as Told.between."""
    length = F.col("till") - F.col("pos")
    up = F.when(F.col("up.strand") == "-", promoter_text(-F.col("up.dist") - length, -F.col("up.dist"), F.col("up.gene_name"), *promoter))
    down = F.when(F.col("down.strand") == "+", promoter_text(-F.col("down.dist") - length, -F.col("down.dist"), F.col("down.gene_name"), *promoter))
    return alone.select(*spans.columns, F.concat(F.lit("inside_["), between_text(F.col("before"), F.col("after")), F.lit("]")).alias("region"), F.nullif(F.concat_ws(";", up, down), F.lit("")).alias("promoters"))
