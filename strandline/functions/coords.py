"""Genomic and cDNA coordinates by arithmetic on the CDS segments of a transcript.

Exons are arrays of struct(beg, end) in genomic order, 1-based and closed;
segments are their parts in the CDS, with the CDS bases before each in `cprev`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import bind

SEGMENTS = "array<struct<gb:bigint,ge:bigint,cprev:bigint>>"


def total_length(spans: Column, beg: str = "beg", end: str = "end") -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x[end] - x[beg] + 1)


def segments(exons: Column, cds_beg: Column, cds_end: Column, strand: Column) -> Column:
    """CDS segments in genomic order; cprev counts in the transcript's direction."""
    cut = F.filter(F.transform(exons, lambda e: F.struct(F.greatest(e["beg"], cds_beg).alias("gb"), F.least(e["end"], cds_end).alias("ge"))), lambda s: s["gb"] <= s["ge"])
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast(SEGMENTS).alias("out"))

    def step(state: Column, s: Column) -> Column:
        one = F.struct(s["gb"].alias("gb"), s["ge"].alias("ge"), state["n"].alias("cprev"))
        return F.struct((state["n"] + s["ge"] - s["gb"] + 1).alias("n"), F.concat(state["out"], F.array(one)).alias("out"))

    run = lambda x: F.aggregate(x, start, step, lambda s: s["out"])
    return F.when(strand == "+", run(cut)).otherwise(F.reverse(run(F.reverse(cut))))


#: Which CDS base a position in an intron is told from: the nearer one, or that with the smaller or greater number in the coding sequence or in the genome.
POLICIES = ("closer", "c_smaller", "c_greater", "g_smaller", "g_greater")


def cdna(pos: Column, segs: Column, strand: Column, policy: str = "closer") -> Column:
    """struct(pos, offset) of a genomic position.

    A CDS base has offset 0.  Between two CDS bases the policy says which one
    counts; by default the nearer, the later one if both are as near.  Before the
    first base it is 1 and after the last one the CDS length, by genomic
    distance, whatever the policy.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    plus = strand == "+"
    known = {
        "plus": plus, "pos": pos, "size": total_length(segs, "gb", "ge"), "first": F.get(segs, F.lit(0))["gb"], "last": F.try_element_at(segs, F.lit(-1))["ge"],
        "inside": F.try_element_at(F.filter(segs, lambda s: (s["gb"] <= pos) & (pos <= s["ge"])), F.lit(1)),
        "low": F.try_element_at(F.filter(segs, lambda s: s["ge"] < pos), F.lit(-1)), "high": F.try_element_at(F.filter(segs, lambda s: s["gb"] > pos), F.lit(1)),
    }

    def place(x: Column) -> Column:
        by = lambda a, b: F.when(x["plus"], a).otherwise(b)
        low, high, at = x["low"], x["high"], x["pos"]
        # the CDS base before and after, in the direction of the transcript
        gap = {
            "before": by(at - low["ge"], high["gb"] - at), "after": by(high["gb"] - at, at - low["ge"]), "index": by(low["cprev"] + low["ge"] - low["gb"] + 1, high["cprev"] + high["ge"] - high["gb"] + 1),
            "lead": by(x["first"] - at, at - x["last"]), "tail": by(at - x["last"], x["first"] - at), "own": x["inside"]["cprev"] + by(at - x["inside"]["gb"], x["inside"]["ge"] - at) + 1, "size": x["size"], "plus": x["plus"],
        }
        return bind(gap, choose)

    def choose(y: Column) -> Column:
        smaller = {"closer": y["before"] < y["after"], "c_smaller": F.lit(True), "c_greater": F.lit(False), "g_smaller": y["plus"], "g_greater": ~y["plus"]}[policy]

        def pick(own: Column, lead: Column, tail: Column, near: Column, far: Column) -> Column:
            return F.when(y["own"].isNotNull(), own).when(y["lead"] > 0, lead).when(y["tail"] > 0, tail).when(smaller, near).otherwise(far).cast("bigint")

        zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        return F.struct(pick(y["own"], one, y["size"], y["index"], y["index"] + 1).alias("pos"), pick(zero, -y["lead"], y["tail"], y["before"], -y["after"]).alias("offset"))

    return F.when(F.size(segs) > 0, bind(known, place))


def genomic(cpos: Column, segs: Column, strand: Column) -> Column:
    """Genomic position of CDS base cpos, null beyond the CDS."""
    s = F.try_element_at(F.filter(segs, lambda x: (x["cprev"] < cpos) & (cpos <= x["cprev"] + x["ge"] - x["gb"] + 1)), F.lit(1))
    return F.when(strand == "+", s["gb"] + cpos - s["cprev"] - 1).otherwise(s["ge"] - (cpos - s["cprev"] - 1))


def genomic_at(p: Column, segs: Column, strand: Column) -> Column:
    """Genomic position of struct(pos, offset); pos -1 is the last CDS base."""
    at = F.when(p["pos"] == -1, total_length(segs, "gb", "ge")).otherwise(p["pos"].cast("bigint"))
    return bind({"base": genomic(at, segs, strand), "shift": p["offset"].cast("bigint"), "plus": strand == "+"}, lambda x: F.when(x["plus"], x["base"] + x["shift"]).otherwise(x["base"] - x["shift"]))


def codon_places(index: Column, segs: Column, strand: Column) -> Column:
    """The three genomic positions of a codon, ascending; null unless all are in the CDS."""
    three = F.array_sort(F.transform(F.array(*(3 * index - 2 + i for i in range(3))), lambda c: genomic(c.cast("bigint"), segs, strand)))
    return F.when(F.forall(three, lambda g: g.isNotNull()), three)


def lean(p: Column, segs: Column, strand: Column, later: bool) -> Column:
    """The CDS base that struct(pos, offset) leans to: itself, or else the next one in the given direction (of the transcript)."""
    size = total_length(segs, "gb", "ge")
    return F.when(p["offset"] == 0, p["pos"]).when(p["offset"] > 0, F.when(F.lit(later), F.least(p["pos"] + 1, size)).otherwise(p["pos"])).otherwise(F.when(F.lit(later), p["pos"]).otherwise(F.greatest(p["pos"] - 1, F.lit(1))))


def on_boundary(p: Column, segs: Column, strand: Column) -> Column:
    """Whether n+k and n-k name a real edge: a positive offset follows the last base of a segment, a negative one comes before the first; the CDS ends are free."""
    size = total_length(segs, "gb", "ge")
    edge = F.exists(segs, lambda s: F.when(p["offset"] > 0, s["cprev"] + s["ge"] - s["gb"] + 1 == p["pos"]).otherwise(s["cprev"] + 1 == p["pos"]))
    free = (p["offset"] == 0) | (p["pos"] == -1) | ((p["offset"] > 0) & (p["pos"] == size)) | ((p["offset"] < 0) & (p["pos"] == 1))
    return free | edge


def same_intron(a: Column, b: Column) -> Column:
    """Whether two structs (pos, offset) lie between the same CDS bases, or beyond the same end of the CDS."""
    before = lambda p: F.when(p["offset"] > 0, p["pos"]).when(p["offset"] < 0, p["pos"] - 1)  # noqa: E731  the CDS base before
    return F.coalesce(before(a) == before(b), F.lit(False))


def segment_numbers(beg: Column, end: Column, segs: Column, strand: Column) -> Column:
    """Numbers of the segments that CDS bases beg..end lie in, in the direction of the transcript."""
    n = F.size(segs)
    hit = F.transform(segs, lambda s, i: F.when((s["cprev"] + 1 <= end) & (s["cprev"] + s["ge"] - s["gb"] + 1 >= beg), F.when(strand == "+", i + 1).otherwise(n - i)))
    return F.array_sort(F.filter(hit, lambda i: i.isNotNull()))


def position_text(p: Column) -> Column:
    return F.concat(p["pos"].cast("string"), F.when(p["offset"] > 0, F.concat(F.lit("+"), p["offset"].cast("string"))).when(p["offset"] < 0, p["offset"].cast("string")).otherwise(""))


def site(pos: Column, exons: Column, strand: Column, cds_beg: Column, cds_end: Column, coding: Column) -> Column:
    """struct(part, exon, utr, splice, codon, edge) of a position in a transcript.

    part: exonic, intronic or outside; exon: its number, or that of the exon
    before an intron; utr: 5 or 3; splice: SpliceDonor or SpliceAcceptor for two
    intronic bases beside an exon, NextToDonor or NextToAcceptor for an exon's
    own outer base (on one-base exons the genomically first rule wins); codon:
    CdsStart or CdsStop; edge: TSS or TES.
    """
    n = F.size(exons)
    index = lambda test: F.try_element_at(F.filter(F.sequence(F.lit(0), n - 1), lambda i: test(F.get(exons, i))), F.lit(1))
    known = {
        "plus": strand == "+", "n": n, "pos": pos, "inside": index(lambda e: (e["beg"] <= pos) & (pos <= e["end"])), "later": index(lambda e: e["beg"] > pos), "first": F.get(exons, F.lit(0))["beg"], "last": F.try_element_at(exons, F.lit(-1))["end"],
        "cds_beg": cds_beg, "cds_end": cds_end, "coding": coding,
    }

    def around(x: Column) -> Column:
        more = {f: x[f] for f in known} | {"here": F.get(exons, x["inside"]), "prior": F.get(exons, x["later"] - 1), "following": F.get(exons, x["later"]), "part": F.when((x["pos"] < x["first"]) | (x["pos"] > x["last"]), "outside").when(x["inside"].isNotNull(), "exonic").otherwise("intronic")}
        return bind(more, described)

    def described(y: Column) -> Column:
        by = lambda a, b: F.when(y["plus"], a).otherwise(b)
        number = lambda i: by(i + 1, y["n"] - i)
        at, part = y["pos"], y["part"]
        splice = (
            F.when(part == "outside", None)
            .when(at == y["here"]["beg"], by("NextToAcceptor", "NextToDonor"))
            .when(at == y["here"]["end"], by("NextToDonor", "NextToAcceptor"))
            .when((part == "intronic") & (at <= y["prior"]["end"] + 2), by("SpliceDonor", "SpliceAcceptor"))
            .when((part == "intronic") & (at >= y["following"]["beg"] - 2), by("SpliceAcceptor", "SpliceDonor"))
        )
        utr = F.when(y["coding"] & (part != "outside"), F.when(at < y["cds_beg"], by(F.lit(5), F.lit(3))).when(at > y["cds_end"], by(F.lit(3), F.lit(5))))
        low, high = (at >= y["cds_beg"]) & (at <= y["cds_beg"] + 2), (at <= y["cds_end"]) & (at >= y["cds_end"] - 2)
        codon = F.when(y["coding"] & (part == "exonic"), F.when(low, by("CdsStart", "CdsStop")).when(high, by("CdsStop", "CdsStart")))
        edge = F.when(at == y["first"], by("TSS", "TES")).when(at == y["last"], by("TES", "TSS"))
        exon = F.when(part == "exonic", number(y["inside"])).when(part == "intronic", by(number(y["later"] - 1), number(y["later"])))
        return F.struct(part.alias("part"), exon.cast("int").alias("exon"), utr.cast("int").alias("utr"), splice.alias("splice"), codon.alias("codon"), edge.alias("edge"))

    return bind(known, around)
