"""Deletions, insertions and block substitutions on coding sequences, and what they do to the protein.

An edit replaces bases cbeg..cend of the coding sequence by alt, in the
direction of the transcript; an insertion has cend = cbeg - 1.  Everything is a
projection of single rows, so partitioning is that of the join before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords, sequence
from . import annotate


def _part(s: Column, first: Column, last: Column) -> Column:
    """Characters first..last, none if last < first or first < 1."""
    return F.substr(s, first, F.when(first < 1, 0).otherwise(F.greatest(last - first + 1, F.lit(0))))


def on_coding(variants: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Variants (pos, till, alt on the + strand) and transcripts, with cbeg, cend and alt in transcript direction.

    Bases pos..till are replaced; an insertion goes between pos and till = pos + 1
    and is marked by a true column `between`.  Kept are pairs whose bases lie in
    one CDS segment; a null position or alt drops the row.
    """
    pairs = annotate.on_transcripts(variants, transcripts, "pos", "till")
    at = lambda name: coords.cdna(F.col(name), F.col("segs"), F.col("strand"))
    x = pairs.withColumn("__a", at("pos")).withColumn("__b", at("till")).where("__a.offset = 0 and __b.offset = 0 and abs(__a.pos - __b.pos) = till - pos and alt is not null")
    low, high = F.least("__a.pos", "__b.pos").cast("int"), F.greatest("__a.pos", "__b.pos").cast("int")
    own = F.when(F.col("strand") == "+", F.col("alt")).otherwise(sequence.reverse_complement(F.col("alt")))
    x = x.withColumn("cbeg", F.when(F.col("between"), high).otherwise(low)).withColumn("cend", F.when(F.col("between"), low).otherwise(high))
    return x.withColumn("alt", own).drop("__a", "__b")


def _deletion_text(p: Column, beg: Column, end: Column, seqmax: int) -> Column:
    aa = lambda i: F.concat(F.substr(p, i, F.lit(1)), i.cast("string"))
    size = end - beg + 1
    gone = F.when(size > seqmax, size.cast("string")).otherwise(_part(p, beg, end)) if seqmax >= 0 else _part(p, beg, end)
    return F.when(size == 1, F.concat(aa(beg), F.lit("del"), F.substr(p, beg, F.lit(1)))).otherwise(F.concat(aa(beg), F.lit("_"), aa(end), F.lit("del"), gone))


def _insertion_text(p: Column, at: Column, ins: Column) -> Column:
    aa = lambda i: F.concat(_part(p, i, i), i.cast("string"))  # noqa: E731  before the first amino acid only 0
    n = F.length(ins)
    first = at - n + 1
    twice = (first > 0) & (_part(p, first, at) == ins)
    dup = F.concat(F.when(n == 1, aa(at)).otherwise(F.concat(aa(first), F.lit("_"), aa(at))), F.lit("dup"), ins)
    return F.when(twice, dup).otherwise(F.concat(aa(at), F.lit("_"), aa(at + 1), F.lit("ins"), ins))


def protein_change(edits: DataFrame, seqmax: int = 10) -> DataFrame:
    """edits (cds, tail, cbeg, cend, alt) with csqn, change and variant_protein.

    In frame, the codons touched are translated before and after: equal ones are
    Synonymous, `(=)`; what remains after trimming (the common prefix first, for
    deletions the suffix first) is a deletion or insertion, moved as far right as
    the protein allows, or a substitution.  A deletion that leaves a stop codon
    is Nonsense.  An edit out of frame, or an insertion that brings a stop codon,
    names the first amino acid that changes and the codons from there to the
    stop; it reads on into `tail`, the bases after the coding sequence, and ends
    in `?` if these hold no stop (sequence.until_stops of all bases up to the
    contig's end is tail enough for any edit).  A coding sequence cut off inside the last
    codon touched gives null, as does a null input; a null tail is empty.
    """
    cds, b, e, alt = (F.col(c) for c in ("cds", "cbeg", "cend", "alt"))
    tail = F.coalesce("tail", F.lit(""))
    size = F.length(cds)
    x = edits.withColumn("__one", F.floor((b + 2) / 3).cast("int")).withColumn("__last", F.floor((e + 2) / 3).cast("int"))
    one, last = F.col("__one"), F.col("__last")
    x = x.withColumn("__new_cds", F.concat(_part(cds, F.lit(1), b - 1), alt, _part(cds, e + 1, size)))
    x = x.withColumn("__old", sequence.translate_all(_part(cds, 3 * one - 2, 3 * last))).withColumn("__new", sequence.translate_all(F.concat(_part(cds, 3 * one - 2, b - 1), alt, _part(cds, e + 1, 3 * last))))
    p, old, new = F.col("__p"), F.col("__old"), F.col("__new")
    deleted, inserted = F.length(alt) == 0, e < b
    x = x.withColumn("__framed", ((F.length(alt) - (e - b + 1)) % 3 == 0) & ~(inserted & new.contains("*")))
    framed = F.col("__framed")
    # what rolls along the protein; other edits don't need it
    x = x.withColumn("__p", F.when(framed & (old != new), sequence.translate_all(cds)))

    # out of frame: both readings from the first codon touched
    read = lambda s: F.concat(F.substr(s, 3 * one - 2, F.lit(2**31 - 1)), tail)
    x = x.withColumn("__was", F.when(~framed, read(cds))).withColumn("__is", F.when(~framed, read(F.col("__new_cds"))))
    x = x.withColumn("__at", F.when(~framed, sequence.first_change(F.col("__was"), F.col("__is")))).withColumn("__stop", sequence.first_stop(F.col("__is")))
    at, stop = F.col("__at"), F.col("__stop")
    silent = at.isNull() | ((stop > 0) & (stop < at))
    aa_at = lambda s: sequence.translate_all(F.substr(s, 3 * at - 2, F.lit(3)))
    x = x.withColumn("__lost", aa_at("__was")).withColumn("__put", aa_at("__is"))
    shift = F.concat("__lost", (one + at - 1).cast("string"), "__put", F.lit("fs*"), F.when(stop > 0, (stop - at + 1).cast("string")).otherwise("?"))

    # in frame: what is left between common ends
    flip = lambda s: F.when(deleted, F.reverse(s)).otherwise(s)
    x = x.withColumn("__t", F.when(framed, sequence.trim(flip(old), flip(new))))
    x = x.withColumn("__ref", flip(F.col("__t.ref"))).withColumn("__alt", flip(F.col("__t.alt")))
    x = x.withColumn("__beg", one + F.when(deleted, F.length(old) - F.length("__ref") - F.col("__t.head")).otherwise(F.col("__t.head"))).withColumn("__end", F.col("__beg") + F.length("__ref") - 1)
    ref, sub, beg, end = (F.col(c) for c in ("__ref", "__alt", "__beg", "__end"))
    x = x.withColumn("__roll", F.when(framed & (sub == "") & (ref != ""), annotate.roll_right(p, beg, end)).when(framed & (ref == "") & (sub != ""), annotate.roll_insertion(p, end, sub)))
    roll = F.col("__roll")
    turned = F.substr(F.concat(sub, sub), roll % F.greatest(F.length(sub), F.lit(1)) + 1, F.length(sub))
    swapped = F.concat(F.substr(ref, F.lit(1), F.lit(1)), beg.cast("string"), F.when(F.length(ref) == 1, F.when((F.length(sub) == 1) & ~deleted, "").otherwise("delins")).otherwise(F.concat(F.lit("_"), F.substr(p, end, F.lit(1)), end.cast("string"), F.lit("delins"))), sub)
    nonsense = deleted & (sub == "*")
    whole = ((3 * last <= size) | ~framed) & cds.isNotNull() & alt.isNotNull()
    csqn = (
        F.when(~framed, F.when(silent, "Synonymous").when(inserted & (F.col("__put") == "*"), "Nonsense").otherwise("Frameshift"))
        .when(old == new, "Synonymous")
        .when(sub == "", "InFrameDeletion")
        .when(ref == "", "InFrameInsertion")
        .when(nonsense, "Nonsense")
        .when((F.length(ref) == 1) & (F.length(sub) == 1) & ~deleted, "Missense")
        .when(ref.isNotNull() & sub.isNotNull(), "MultiAAMissense")
    )
    change = (
        F.when(~framed, F.when(silent, "(=)").otherwise(shift))
        .when(old == new, "(=)")
        .when(sub == "", _deletion_text(p, beg + roll, end + roll, seqmax))
        .when(ref == "", _insertion_text(p, end + roll, turned))
        .when(nonsense, F.concat(F.substr(ref, F.lit(1), F.lit(1)), beg.cast("string"), F.lit("*")))
        .otherwise(swapped)
    )
    protein = F.when(framed, sequence.translate(F.col("__new_cds"))).otherwise(sequence.translate(F.concat(F.col("__new_cds"), tail)))
    # the protein stays outside of the generator, so that who doesn't ask for it doesn't make it
    x = annotate.once(x, csqn=F.when(whole, csqn), change=F.when(whole, change)).withColumn("variant_protein", protein)
    return x.drop("__one", "__last", "__new_cds", "__p", "__old", "__new", "__framed", "__was", "__is", "__at", "__stop", "__lost", "__put", "__t", "__ref", "__alt", "__beg", "__end", "__roll")


def span_site(beg: Column, end: Column, exons: Column, strand: Column, cds_beg: Column, cds_end: Column) -> Column:
    """struct(whole, donors, acceptors, start, stop): what a span beg..end does to a transcript.

    whole counts exons inside; donors and acceptors those splice sites whose
    exon, not inside, begins or ends within a base of the span (the outer edges
    of first and last exons are none); start and stop whether a CDS end lies in it.
    """
    plus = strand == "+"
    n = F.size(exons)
    inside = lambda x: (x["beg"] >= beg) & (x["end"] <= end)
    at_beg = lambda x, i: ~inside(x) & x["beg"].between(beg - 1, end + 1) & (i > 0)
    at_end = lambda x, i: ~inside(x) & ~at_beg(x, i) & x["end"].between(beg - 1, end + 1) & (i < n - 1)
    count = lambda test: F.size(F.filter(exons, test)).cast("bigint")
    low, high = cds_beg.between(beg, end), cds_end.between(beg, end)
    return F.struct(
        count(inside).alias("whole"), F.when(plus, count(at_end)).otherwise(count(at_beg)).alias("donors"), F.when(plus, count(at_beg)).otherwise(count(at_end)).alias("acceptors"),
        F.when(plus, low).otherwise(high).alias("start"), F.when(plus, high).otherwise(low).alias("stop"),
    )
