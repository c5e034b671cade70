"""Records of annotated variants: identifiers, regions, and the seven fields of the text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords, sequence
from . import annotate, coding

FIELDS = ("input", "transcript", "gene", "strand", "coordinates", "region", "info")


def text(c: Column) -> Column:
    return c.cast("string")


def elided(bases: Column, seqmax: int) -> Column:
    """Bases, or their number if there are more than seqmax (-1: never)."""
    return F.when(F.length(bases) > seqmax, text(F.length(bases))).otherwise(bases) if seqmax >= 0 else bases


def deletion_id(beg: Column, end: Column, bases: Column, seqmax: int = 10, one: Column | None = None) -> Column:
    """b_edelSEQ, bdelX for one base; beg and end are texts."""
    return F.concat(beg, F.when((beg == end) if one is None else one, "").otherwise(F.concat(F.lit("_"), end)), F.lit("del"), elided(bases, seqmax))


def insertion_id(before: Column, after: Column, first: Column, bases: Column, dup: Column, seqmax: int = 10) -> Column:
    """before_afterinsSEQ, or, if dup, first_beforedupSEQ."""
    twice = F.concat(F.when(first == before, "").otherwise(F.concat(first, F.lit("_"))), before, F.lit("dup"), elided(bases, seqmax))
    return F.when(dup, twice).otherwise(F.concat(before, F.lit("_"), after, F.lit("ins"), elided(bases, seqmax)))


def block_id(beg: Column, end: Column, ref: Column, alt: Column) -> Column:
    """bR>A for one base by one, bdelinsA for one by many, else b_edelinsA."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), F.concat(beg, ref, F.lit(">"), alt)).when(F.length(ref) == 1, F.concat(beg, F.lit("delins"), alt)).otherwise(F.concat(beg, F.lit("_"), end, F.lit("delins"), alt))


def transcript_text(t: str = "name", of: str = "") -> Column:
    """NAME.VERSION (type); of: where version and type are, if not among the columns."""
    return F.concat(F.col(t), F.coalesce(F.concat(F.lit("."), text(F.col(f"{of}version"))), F.lit("")), F.lit(" ("), F.col(f"{of}transcript_type"), F.lit(")"))


def optional(rows: DataFrame, name: str) -> Column:
    """The column, or null where rows don't have it."""
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def place_text(site: Column, coding_site: Column, strand: Column, outside: Column | None = None) -> Column:
    """What a region says of one point: UTR first, then exon or intron (numbered in the direction of the transcript); outside: what it says beyond the transcript."""
    utr = F.when(site["utr"].isNotNull(), F.concat(text(site["utr"]), F.lit("-UTR")))
    # intron k of a transcript lies between exons k and k + 1; text names the lower one first
    between = F.concat(F.lit("intron_between_exon_"), text(site["exon"]), F.lit("_and_"), text(site["exon"] + 1))
    exon = F.concat(F.when(coding_site, "cds_in_exon_").otherwise("noncoding_exon_"), text(site["exon"]))
    beyond = F.lit("outside") if outside is None else F.coalesce(outside, F.lit("outside"))
    return F.concat_ws(";", utr, F.when(site["part"] == "intronic", between).when(site["part"] == "exonic", exon).otherwise(beyond))


def splice_text(site: Column, exons: Column, strand: Column, contig: Column, pos: Column) -> Column:
    """C2= of a splice site, or of a site next to one; null for others.

    The place is the first intronic base; of an intron, the exon that is later
    in the genome gives the number.
    """
    after = F.array_max(F.transform(F.filter(exons, lambda e: e["end"] <= pos), lambda e: e["end"])) + 1
    before = F.array_min(F.transform(F.filter(exons, lambda e: e["beg"] >= pos), lambda e: e["beg"])) - 1
    begins = site["splice"].endswith("Acceptor") == (strand == "+")  # it lies before an exon of the genome
    number = F.when((site["part"] == "intronic") & (strand == "+"), site["exon"] + 1).otherwise(site["exon"])
    name = F.when(site["splice"].startswith("NextTo"), F.concat(F.lit("NextToSplice"), F.regexp_replace(site["splice"], "NextTo", ""))).otherwise(site["splice"])
    return F.concat(F.lit("C2="), name, F.lit("OfExon"), text(number), F.lit("_At_"), contig, F.lit(":"), text(F.when(begins, before).otherwise(after)))


def info(*items: Column) -> Column:
    """Items in their order, nulls left out; . if none is left."""
    joined = F.concat_ws(";", *items)
    return F.when(joined == "", ".").otherwise(joined)


def tail_items() -> list[Column]:
    """dbxref, aliases and source, which always come last."""
    return [F.concat(F.lit("dbxref="), F.col("gene_dbxref")), F.when(F.size("aliases") > 0, F.concat(F.lit("aliases="), F.array_join("aliases", ","))), F.concat(F.lit("source="), F.col("source"))]


def site_items(site: Column) -> list[Column]:
    """What info says of a point at pos: splice site, start or stop codon, end of the transcript."""
    where = F.concat(F.col("contig_id").cast("string"), F.lit(":"), text(F.col("pos")))
    codon = F.when(site["codon"].isNotNull(), F.concat(F.when(site["codon"] == "CdsStart", "C2=cds_start_at_").otherwise("C2=cds_end_at_"), where))
    edge = F.when(site["edge"] == "TSS", "transcription_start_at_").when(site["edge"] == "TES", "transcription_end_at_")
    return [splice_text(site, F.col("exons"), F.col("strand"), F.col("contig_id").cast("string"), F.col("pos")), codon, F.concat(edge, where)]


def span_labels(span: Column, word: str) -> Column:
    """Labels of a span that takes splice sites or the ends of the coding sequence (coding.span_site)."""
    found = F.when(span["donors"] > 0, "SpliceDonor" + word), F.when(span["acceptors"] > 0, "SpliceAcceptor" + word), F.when(span["start"], "CdsStart" + word), F.when(span["stop"], "CdsStop" + word)
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def point_labels(site: Column, word: str) -> Column:
    """Labels of a point at a splice site, or in the first or last codon."""
    return F.filter(F.array(F.when(site["splice"].startswith("Splice"), F.concat(site["splice"], F.lit(word))), F.concat(site["codon"], F.lit(word))), lambda s: s.isNotNull())


def one_label(labels: Column) -> Column:
    """The label; Multi: and all of them, if there are more; Unclassified, if none."""
    return F.when(F.size(labels) == 0, "Unclassified").when(F.size(labels) == 1, F.get(labels, F.lit(0))).otherwise(F.concat(F.lit("Multi:"), F.array_join(labels, ",")))


def placed(pairs: DataFrame, *points: Column) -> DataFrame:
    """pairs with __c, the cDNA positions of points, and __sites, what the transcript has at pos and till."""
    site = lambda p: coords.site(p, F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"), F.col("transcript_type") == "protein_coding")
    return annotate.once(pairs, __c=F.transform(F.array(*points), lambda p: coords.cdna(p, F.col("segs"), F.col("strand"))), __sites=F.transform(F.array("pos", "till"), site))


def between_text(rows: DataFrame, a: Column, b: Column, ca: Column, cb: Column) -> Column:
    """inside_[] of two ends that are in one place, or from_[]_to_[], with the genes that lie between; rows may have the columns of regions.told."""
    coding_site = lambda c: F.coalesce(c["offset"] == 0, F.lit(False))
    begin, last = place_text(a, coding_site(ca), F.col("strand"), optional(rows, "outside_beg")), place_text(b, coding_site(cb), F.col("strand"), optional(rows, "outside_end"))
    return F.when(begin == last, F.concat(F.lit("inside_["), begin, F.lit("]"))).otherwise(F.concat(F.lit("from_["), begin, F.lit("]_to_["), last, F.lit("]"), F.coalesce(optional(rows, "spanning"), F.lit(""))))


def dbsnp(rows: DataFrame) -> Column:
    """dbsnp= of known variants, if rows have the column known and it isn't null."""
    return F.concat(F.lit("dbsnp="), optional(rows, "known"))


def named_fields(coordinates: Column, region: Column, *items: Column) -> list[Column]:
    """vid, tid and FIELDS."""
    return [F.col("vid"), F.col("tid"), F.col("input"), transcript_text().alias("transcript"), F.col("gene_name").alias("gene"), F.col("strand"), coordinates.alias("coordinates"), region.alias("region"), info(*items, *tail_items()).alias("info")]


def snv_records(pairs: DataFrame) -> DataFrame:
    """pairs of SNV (vid, input, contig_id, pos, ref, alt) and transcript, with vid, tid and FIELDS, and the columns CHROM, POS, REF, ALT.

    Where a splice site, a start or stop codon, or an end of the transcript is
    hit, no protein change is told.
    """
    x = annotate.snv_consequence(pairs)
    x = annotate.located(x)
    site, c = F.col("__site"), F.col("__c")
    turn = lambda b: F.when(F.col("strand") == "+", F.col(b)).otherwise(F.translate(b, "ACGT", "TGCA"))
    told = F.col("csqn").isin("Missense", "Nonsense", "Synonymous")
    protein = F.when(told, F.concat(F.lit("p."), "aa_ref", text(F.col("aa_pos")), "aa_alt")).otherwise(".")
    coordinates = F.concat(F.col("contig_id").cast("string"), F.lit(":g."), text(F.col("pos")), "ref", F.lit(">"), "alt", F.lit("/c."), "cpos", turn("ref"), F.lit(">"), turn("alt"), F.lit("/"), protein)
    three = coords.codon_places(F.col("aa_pos"), F.col("segs"), F.col("strand"))
    codon = F.when(told, F.concat(F.lit("codon_pos="), F.array_join(F.transform(three, text), "-"), F.lit(";ref_codon_seq="), "codon"))
    items = (F.concat(F.lit("CSQN="), "csqn"), dbsnp(x), *site_items(site), codon, optional(x, "warning"))
    return x.select(
        "vid", "tid", "input", transcript_text().alias("transcript"), F.col("gene_name").alias("gene"), "strand", coordinates.alias("coordinates"),
        F.concat(F.lit("inside_["), place_text(site, F.coalesce(c["offset"] == 0, F.lit(False)), F.col("strand")), F.lit("]")).alias("region"), info(*items, *tail_items()).alias("info"),
        F.col("contig_id").cast("string").alias("CHROM"), text(F.col("pos")).alias("POS"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"),
    )


def deletion_records(pairs: DataFrame, seqmax: int = 10) -> DataFrame:
    """pairs of deletion (vid, input, contig_id, pos, till, bases, right, left) and transcript with vid, tid and FIELDS.

    The main identifiers are aligned right, in the direction of the genome and
    of the transcript; the others stand in the info, with what the deletion takes
    besides the protein.  Splice sites, start and stop come first, then the
    protein, then the region.  pairs may have warning, known, and the columns of
    regions.told.
    """
    x = pairs.withColumn("between", F.lit(False)).withColumn("alt", F.lit(""))
    x = annotate.once(x, __span=coding.span_site(F.col("pos"), F.col("till"), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end")))
    at = lambda p: F.struct(coords.site(p, F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"), F.col("transcript_type") == "protein_coding").alias("site"), coords.cdna(p, F.col("segs"), F.col("strand")).alias("c"))
    shifts = {"right": F.col("right").cast("bigint"), "left": -F.col("left").cast("bigint"), "own": F.lit(0).cast("bigint")}
    both = F.struct(*(at(F.col(c) + by).alias(f"{c}_{name}") for name, by in shifts.items() for c in ("pos", "till")))
    x = annotate.once(x, __ends=both)
    a, b = F.col("__ends.pos_own"), F.col("__ends.till_own")
    framed = (a["c"]["offset"] == 0) & (b["c"]["offset"] == 0) & (F.abs(a["c"]["pos"] - b["c"]["pos"]) == F.col("till") - F.col("pos"))
    x = x.withColumn("cbeg", F.when(framed, F.least(a["c"]["pos"], b["c"]["pos"])).cast("int")).withColumn("cend", F.when(framed, F.greatest(a["c"]["pos"], b["c"]["pos"])).cast("int"))
    x = coding.protein_change(x)
    plus, n = F.col("strand") == "+", F.length("bases")
    moved = lambda by: F.substr(F.concat("bases", "bases"), (F.pmod(by, n) + 1).cast("int"), n)
    genomic = lambda by: F.concat(F.lit("g."), deletion_id(text(F.col("pos") + by), text(F.col("till") + by), moved(by), seqmax, n == 1))

    def transcript(name: str) -> Column:
        # what is right in the genome is left in a transcript of the other strand
        mirror = {"right": "left", "left": "right", "own": "own"}[name]
        one = lambda which, first, last, turn: F.concat(F.lit("c."), deletion_id(coords.position_text(F.col(f"__ends.{first}_{which}.c")), coords.position_text(F.col(f"__ends.{last}_{which}.c")), turn(moved(shifts[which])), seqmax, n == 1))
        return F.when(plus, one(name, "pos", "till", lambda s: s)).otherwise(one(mirror, "till", "pos", sequence.reverse_complement))

    span = F.col("__span")
    same = coords.same_intron(a["c"], b["c"])
    point = F.col("pos") == F.col("till")
    labels = F.when(point, point_labels(a["site"], "Deletion")).otherwise(span_labels(span, "Deletion"))
    hit = (F.size(labels) > 0) | F.when(point, a["site"]["edge"].isNotNull()).otherwise(span["whole"] > 0)
    region = F.concat(annotate.region_text(a["site"]), F.lit("Deletion"))
    coding_type = F.col("transcript_type") == "protein_coding"
    csqn = F.when(~same & hit, one_label(labels)).when(framed, F.col("csqn")).when(same, region).otherwise("UnclassifiedDeletion")
    protein = F.when(framed & ~hit, F.concat(F.lit("p."), "change")).otherwise(".")
    where = between_text(x, a["site"], b["site"], a["c"], b["c"])
    gene = F.when((F.col("till") > F.col("cds_end") - 2) & (F.col("pos") < F.col("cds_beg") + 2), "whole_gene_deletion")
    lost = [F.when(coding_type & ~same, F.when(point, i) if at_point else F.when(~point, i)) for at_point, items in ((True, site_items(a["site"])), (False, span_items(F.col("pos"), F.col("till"), "_lost"))) for i in items]
    items = [F.concat(F.lit("CSQN="), csqn), optional(x, "warning"), dbsnp(x), gene, F.concat(F.lit("left_align_gDNA="), genomic(shifts["left"])), F.concat(F.lit("unaligned_gDNA="), genomic(shifts["own"])), F.concat(F.lit("left_align_cDNA="), transcript("left")), F.concat(F.lit("unalign_cDNA="), transcript("own")), *lost]
    coordinates = F.concat(F.col("contig_id").cast("string"), F.lit(":"), genomic(shifts["right"]), F.lit("/"), F.coalesce(transcript("right"), F.lit(".")), F.lit("/"), protein)
    return x.select(*named_fields(coordinates, where, *items))


def insertion_records(pairs: DataFrame, both: bool = False) -> DataFrame:
    """pairs of insertion (vid, input, contig_id, pos, ins, right, left), after pos, and transcript with vid, tid and FIELDS.

    both: the bases on both sides, as a span, give the region and the splice sites
    that are affected, not the one before alone.

    An insertion that repeats the bases before it is a duplication; it does so
    wherever it can shift back by its own length.  A splice site, start or stop
    at pos comes before the protein, and that before the region.
    """
    n = F.length("ins")
    shifts = {"right": F.col("right").cast("bigint"), "left": -F.col("left").cast("bigint"), "own": F.lit(0).cast("bigint")}
    x = pairs.withColumn("till", F.col("pos") + 1)
    x = placed(x, *((F.col("pos") + by + d).cast("bigint") for by in shifts.values() for d in (F.lit(0), F.lit(1), 1 - n, n)))
    c = lambda name, side: F.get("__c", F.lit(4 * list(shifts).index(name) + side))
    a, b, site = c("own", 0), c("own", 1), F.get("__sites", F.lit(0))
    plus, framed = F.col("strand") == "+", (a["offset"] == 0) & (b["offset"] == 0) & (F.abs(a["pos"] - b["pos"]) == 1)
    x = x.withColumn("cbeg", F.when(framed, F.greatest(a["pos"], b["pos"])).cast("int")).withColumn("cend", F.col("cbeg") - 1)
    x = coding.protein_change(x.withColumn("alt", F.when(plus, F.col("ins")).otherwise(sequence.reverse_complement(F.col("ins")))))
    whole = F.col("right") + F.col("left") >= n
    copies_before = {"right": whole, "left": F.lit(False), "own": F.col("left") >= n}
    copies_after = {"left": whole, "right": F.lit(False), "own": F.col("right") >= n}
    moved = lambda name: F.substr(F.concat("ins", "ins"), (F.pmod(shifts[name], n) + 1).cast("int"), n)

    def genomic(name: str) -> Column:
        at = F.col("pos") + shifts[name]
        return F.concat(F.lit("g."), insertion_id(text(at), text(at + 1), text(at - n + 1), moved(name), copies_before[name], -1))

    def transcript(name: str) -> Column:
        mirror = {"right": "left", "left": "right", "own": "own"}[name]
        told = lambda which, side: coords.position_text(c(which, side))
        forward = insertion_id(told(name, 0), told(name, 1), told(name, 2), moved(name), copies_before[name], -1)
        back = insertion_id(told(mirror, 1), told(mirror, 0), told(mirror, 3), sequence.reverse_complement(moved(mirror)), copies_after[mirror], -1)
        return F.concat(F.lit("c."), F.when(plus, forward).otherwise(back))

    span = coding.span_site(F.col("pos"), F.col("till"), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"))
    labels = span_labels(span, "Insertion") if both else point_labels(site, "Insertion")
    hit = (F.size(labels) > 0) | (span["whole"] > 0 if both else site["edge"].isNotNull())
    csqn = F.when(hit, one_label(labels)).when(framed, F.col("csqn")).otherwise(F.concat(annotate.region_text(site), F.lit("Insertion")))
    protein = F.when(framed & ~hit, F.concat(F.lit("p."), "change"))
    phase = F.when(framed & ~hit & F.col("csqn").isin("InFrameInsertion", "MultiAAMissense"), F.concat(F.lit("phase="), text(F.col("cend") % 3)))
    coordinates = F.concat(F.col("contig_id").cast("string"), F.lit(":"), genomic("right"), F.lit("/"), F.coalesce(transcript("right"), F.lit(".")), F.lit("/"), F.coalesce(protein, F.lit(".")))
    items = [F.concat(F.lit("CSQN="), csqn), F.concat(F.lit("left_align_gDNA="), genomic("left")), F.concat(F.lit("unalign_gDNA="), genomic("own")), F.concat(F.lit("left_align_cDNA="), transcript("left")), F.concat(F.lit("unalign_cDNA="), transcript("own"))]
    where = F.concat(F.lit("inside_["), place_text(site, F.coalesce(a["offset"] == 0, F.lit(False)), F.col("strand")), F.lit("]"))
    if both:
        where = between_text(x, site, F.get("__sites", F.lit(1)), a, b)
    touched = span_items(F.col("pos"), F.col("till"), "_affected") if both else site_items(site)
    return x.select(*named_fields(coordinates, where, *items, *touched, phase))


def block_records(pairs: DataFrame) -> DataFrame:
    """pairs of block substitution (vid, input, contig_id, pos, till, ref, alt, without common ends) and transcript with vid, tid and FIELDS."""
    x = placed(pairs.withColumnRenamed("alt", "galt"), F.col("pos"), F.col("till"))
    x = annotate.once(x, __span=coding.span_site(F.col("pos"), F.col("till"), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end")))
    a, b, plus, span = F.get("__c", F.lit(0)), F.get("__c", F.lit(1)), F.col("strand") == "+", F.col("__span")
    framed = (a["offset"] == 0) & (b["offset"] == 0) & (F.abs(a["pos"] - b["pos"]) == F.col("till") - F.col("pos"))
    turn = lambda s: F.when(plus, F.col(s)).otherwise(sequence.reverse_complement(F.col(s)))
    x = x.withColumn("cbeg", F.when(framed, F.least(a["pos"], b["pos"])).cast("int")).withColumn("cend", F.when(framed, F.greatest(a["pos"], b["pos"])).cast("int"))
    x = coding.protein_change(x.withColumn("alt", turn("galt")))
    first, last = (F.get("__sites", F.lit(i)) for i in (0, 1))
    point = F.col("pos") == F.col("till")
    labels = F.when(point, point_labels(first, "BlockSubstitution")).otherwise(span_labels(span, "BlockSubstitution"))
    hit = (F.size(labels) > 0) | F.when(point, first["edge"].isNotNull()).otherwise(span["whole"] > 0)
    lost = [F.when(point, i) for i in site_items(first)] + [F.when(~point, i) for i in span_items(F.col("pos"), F.col("till"), "_lost")]
    region = F.when(annotate.region_text(first) == annotate.region_text(last), annotate.region_text(first)).otherwise("Unclassified")
    csqn = F.when(hit, one_label(labels)).when(framed, F.col("csqn")).otherwise(F.concat(region, F.lit("BlockSubstitution")))
    codon = lambda i: F.concat_ws("-", *(text(3 * i - 2 + k) for k in range(3)))
    one, two = (F.floor((F.col(e) + 2) / 3) for e in ("cbeg", "cend"))
    inside = framed & ~hit & ((F.length("alt") - F.length("ref")) % 3 == 0)
    codons = F.when(inside, F.when(one == two, F.concat(F.lit("codon_cDNA="), codon(one))).otherwise(F.concat(F.lit("begin_codon_cDNA="), codon(one), F.lit(";end_codon_cDNA="), codon(two))))
    ends = [coords.position_text(p) for p in (a, b)]
    coding_id = F.concat(F.lit("c."), block_id(F.when(plus, ends[0]).otherwise(ends[1]), F.when(plus, ends[1]).otherwise(ends[0]), turn("ref"), F.col("alt")))
    coordinates = F.concat(F.col("contig_id").cast("string"), F.lit(":g."), block_id(text(F.col("pos")), text(F.col("till")), F.col("ref"), F.col("galt")), F.lit("/"), F.coalesce(coding_id, F.lit(".")), F.lit("/"), F.coalesce(F.when(framed & ~hit, F.concat(F.lit("p."), "change")), F.lit(".")))
    return x.select(*named_fields(coordinates, between_text(x, first, last, a, b), F.concat(F.lit("CSQN="), csqn), dbsnp(x), *lost, codons))


def span_items(beg: Column, end: Column, action: str) -> list[Column]:
    """What info says of a span: splice sites by their first intronic base, whole exons, and the ends of the coding sequence in it."""
    exons, plus, n = F.col("exons"), F.col("strand") == "+", F.size("exons")
    contig = F.col("contig_id").cast("string")
    number = lambda i: text(F.when(plus, i + 1).otherwise(n - i))
    inside = lambda e: (e["beg"] >= beg) & (e["end"] <= end)
    at_beg = lambda e, i: ~inside(e) & e["beg"].between(beg - 1, end + 1) & (i > 0)
    at_end = lambda e, i: ~inside(e) & ~at_beg(e, i) & e["end"].between(beg - 1, end + 1) & (i < n - 1)
    told = lambda kind, i, p: F.concat(F.lit(f"C2={kind}_splice_site_on_exon_"), number(i), F.lit("_at_"), contig, F.lit(":"), text(p), F.lit(action))
    every = lambda kind, test, p: F.nullif(F.array_join(F.transform(exons, lambda e, i: F.when(test(e, i), told(kind, i, p(e)))), ";"), F.lit(""))
    low, high = (lambda e: e["beg"] - 1), (lambda e: e["end"] + 1)
    donors = F.when(plus, every("donor", at_end, high)).otherwise(every("donor", at_beg, low))
    acceptors = F.when(plus, every("acceptor", at_beg, low)).otherwise(every("acceptor", at_end, high))
    numbers = F.array_join(F.transform(exons, lambda e, i: F.when(inside(e), number(i))), ",")
    edge = lambda c, forward, back: F.when(F.col(c).between(beg, end), F.concat(F.when(plus, forward).otherwise(back), F.lit("_at_"), contig, F.lit(":"), text(F.col(c)), F.lit(action)))
    return [donors, acceptors, F.when(numbers != "", F.concat(F.lit("whole_exon_["), numbers, F.lit("]" + action))), edge("cds_beg", "cds_start", "cds_stop"), edge("cds_end", "cds_end", "cds_start")]


def region_records(pairs: DataFrame, promoter: Column | None = None) -> DataFrame:
    """pairs of region (vid, input, contig_id, pos, till, ref, the base of a point) and transcript, with vid, tid and FIELDS; promoter: an item that comes first.

    There is no label, as nothing changes.  An end in an intron leans to the
    coding base inside the region.
    """
    x = placed(pairs, F.col("pos"), F.col("till"))
    a, b, plus, point = F.get("__c", F.lit(0)), F.get("__c", F.lit(1)), F.col("strand") == "+", F.col("pos") == F.col("till")
    size = F.length("cds")
    index = lambda p, later: F.floor((coords.lean(p, F.col("segs"), F.col("strand"), later) + 2) / 3).cast("bigint")
    x = annotate.once(x, __one=F.when(plus, index(a, True)).otherwise(index(b, True)), __two=F.when(plus, index(b, False)).otherwise(index(a, False)))
    one, two = F.col("__one"), F.col("__two")
    amino = lambda i: F.concat(sequence.codon_aa(F.substr("cds", (3 * i - 2).cast("int"), F.lit(3))), text(i))
    places = lambda i: F.array_join(F.transform(coords.codon_places(i, F.col("segs"), F.col("strand")), text), "-")
    told = (F.col("transcript_type") == "protein_coding") & ~coords.same_intron(a, b) & (size >= 3 * F.greatest(one, two))
    protein = F.when(point, F.when(a["offset"] == 0, amino(one))).when(told, F.when(one == two, amino(one)).otherwise(F.concat_ws("_", amino(one), amino(two))))
    start, end = F.when(plus, one).otherwise(two), F.when(plus, two).otherwise(one)
    codons = F.when(told, F.when(one == two, F.concat(F.lit("codon="), places(one))).otherwise(F.concat(F.lit("start_codon="), places(start), F.lit(";end_codon="), places(end))))
    own = F.when(plus, F.col("ref")).otherwise(F.translate("ref", "ACGT", "TGCA"))
    ends = [coords.position_text(p) for p in (a, b)]
    genomic = F.when(point, F.concat(text(F.col("pos")), "ref", F.lit(">"))).otherwise(F.concat(text(F.col("pos")), F.lit("_"), text(F.col("till"))))
    cdna = F.when(point, F.concat(ends[0], own, F.lit(">"))).when(plus, F.concat(ends[0], F.lit("_"), ends[1])).otherwise(F.concat(ends[1], F.lit("_"), ends[0]))
    coordinates = F.concat(F.col("contig_id").cast("string"), F.lit(":g."), genomic, F.lit("/"), F.coalesce(F.concat(F.lit("c."), cdna), F.lit(".")), F.lit("/"), F.coalesce(F.concat(F.lit("p."), protein), F.lit(".")))
    near = F.floor((a["pos"] + 2) / 3).cast("bigint")
    body = F.concat(F.lit("is_gene_body"), F.coalesce(F.concat(F.lit(";codon_pos="), places(near)), F.lit("")))
    items = [F.when(~point, s) for s in span_items(F.col("pos"), F.col("till"), "_included")]
    region = between_text(x, F.get("__sites", F.lit(0)), F.get("__sites", F.lit(1)), a, b)
    return x.select(*named_fields(coordinates, region, *([promoter] if promoter is not None else []), F.when(point, body), *items, F.when(~point, codons)))


def unplaced_records(rows: DataFrame, coordinates: Column, *items: Column) -> DataFrame:
    """vid and FIELDS of rows (vid, input, region) that no single transcript tells of: the genome's coordinates, dots for the transcript's, or the columns transcript, gene and strand."""
    dot = F.lit(".")
    where = F.concat(F.col("contig_id").cast("string"), F.lit(":g."), coordinates, F.lit("/./."))
    return rows.select("vid", "input", *(F.coalesce(optional(rows, c), dot).alias(c) for c in ("transcript", "gene", "strand")), where.alias("coordinates"), "region", info(*items).alias("info"))


def deletion_ids(seqmax: int = 10) -> dict[str, Column]:
    """Identifiers, without contig and level, of deletions (pos, till, bases, right, left) as they stand (own) and shifted right and left."""
    n = F.length("bases")
    moved = lambda by: F.substr(F.concat("bases", "bases"), (F.pmod(by, n) + 1).cast("int"), n)
    shifts = {"right": F.col("right").cast("bigint"), "left": -F.col("left").cast("bigint"), "own": F.lit(0).cast("bigint")}
    return {k: deletion_id(text(F.col("pos") + by), text(F.col("till") + by), moved(by), seqmax, n == 1) for k, by in shifts.items()}


def insertion_ids() -> dict[str, Column]:
    """The same of insertions (pos, ins, right, left) after pos; one that repeats the bases before it is a duplication."""
    n, out = F.length("ins"), {}
    dup = {"right": F.col("right") + F.col("left") >= n, "left": F.lit(False), "own": F.col("left") >= n}
    for k, by in {"right": F.col("right").cast("bigint"), "left": -F.col("left").cast("bigint"), "own": F.lit(0).cast("bigint")}.items():
        at, moved = F.col("pos") + by, F.substr(F.concat("ins", "ins"), (F.pmod(by, n) + 1).cast("int"), n)
        out[k] = insertion_id(text(at), text(at + 1), text(at - n + 1), moved, dup[k], -1)
    return out


def lines(records: DataFrame, *more: str) -> DataFrame:
    """records as text: FIELDS, and more columns (CHROM, POS, REF, ALT), by tabs; a null is a dot."""
    return records.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in (*FIELDS, *more))).alias("value"))


def write_lines(records: DataFrame, path: str, *more: str) -> None:
    lines(records, *more).write.text(path)


def write_vcf(rows: DataFrame, header: DataFrame, path: str, columns: tuple[str, ...] = FIELDS[1:]) -> None:
    """A VCF with annotation: the lines of header (value), with the columns added to its last line, then line of rows, each with the columns.

    Both have `place`, where the line stood in its file (tracks.line_place), and
    the output is in that order, records of one line by tid or transcript: rows
    are laid in ranges of places and sorted there, and the header leads.
    """
    added = "\t".join(columns)
    order = [c for c in ("alt_number", "transcript", "coordinates", "info") if c in rows.columns]
    top = header.select(F.when(F.col("value").startswith("#CHROM"), F.concat("value", F.lit("\t" + added))).otherwise(F.col("value")).alias("value"), "place", F.lit(0).alias("__kind"))
    body = rows.select(F.concat_ws("\t", "line", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns)).alias("value"), "place", F.lit(1).alias("__kind"), *order)
    keys = ["__kind", "place", *order]
    top.unionByName(body, allowMissingColumns=True).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.text(path)
