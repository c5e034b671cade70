"""Text records of amino acids changed, by transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords, sequence
from . import annotate, genome, levels, records
from . import known as known_variants
from .records import text
from .tables import kept


def amino_label(ref: Column, alt: Column) -> Column:
    return F.when(ref == alt, "Synonymous").when(alt == "*", "Nonsense").otherwise("Missense")


def codon_change(codon: Column, new: Column, three: Column, strand: Column) -> Column:
    """g. text, without the contig, of a codon at places three (ascending) that becomes new: bR>A, or b_edelRinsA from the first to the last base that differs."""
    differ = F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda i: F.substr(codon, i, F.lit(1)) != F.substr(new, i, F.lit(1)))

    def told(x: Column) -> Column:
        plus = strand == "+"
        i, j = x["i"], x["j"]
        part = lambda c: F.substr(c, i, j - i + 1)
        turn = lambda c: F.when(plus, part(c)).otherwise(sequence.reverse_complement(part(c)))
        beg, end = F.get(three, F.when(plus, i - 1).otherwise(3 - j)), F.get(three, F.when(plus, j - 1).otherwise(3 - i))
        return F.when(i == j, F.concat(F.lit("g."), text(beg), turn(codon), F.lit(">"), turn(new))).otherwise(F.concat(F.lit("g."), text(beg), F.lit("_"), text(end), F.lit("del"), turn(codon), F.lit("ins"), turn(new)))

    return sequence.bind({"i": F.array_min(differ), "j": F.array_max(differ)}, told)


def protein_snv_records(snvs: DataFrame) -> DataFrame:
    """vid (qid), tid and FIELDS of levels.protein_snvs, with input: the codon nearest to the old one gives the change, and info lists the others.

    Bases of the genome are those of the + strand everywhere.
    """
    places = coords.codon_places(F.col("p.beg"), F.col("segs"), F.col("strand"))
    x = annotate.once(snvs.withColumn("vid", F.col("qid")), __three=places, __aa=sequence.codon_aa(F.col("codon"))).where("__three is not null")
    x = annotate.once(x, __a=_site_of(x, 0), __b=_site_of(x, 2))
    contig, strand, three = text(F.col("contig_id")), F.col("strand"), F.col("__three")
    own = lambda c: F.when(strand == "+", F.col(c)).otherwise(sequence.reverse_complement(F.col(c)))
    first = F.array_min(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda i: F.substr("codon", i, F.lit(1)) != F.substr("best", i, F.lit(1))))
    cbeg = 3 * F.col("p.beg") - 3 + first
    cdna = F.when(F.length("vref") == 1, F.concat(text(cbeg), own("vref"), F.lit(">"), own("valt"))).otherwise(F.concat(text(cbeg), F.lit("_"), text(cbeg + F.length("vref") - 1), F.lit("del"), own("vref"), F.lit("ins"), own("valt")))
    coordinates = F.concat(contig, F.lit(":"), codon_change(F.col("codon"), F.col("best"), three, strand), F.lit("/c."), cdna, F.lit("/p."), "__aa", text(F.col("p.beg")), "aa_alt")
    exon = lambda e: text(F.col(e)["exon"])
    region = F.when(exon("__a") == exon("__b"), F.concat(F.lit("inside_[cds_in_exon_"), exon("__a"), F.lit("]"))).otherwise(F.concat(F.lit("inside_[cds_in_exons_["), text(F.least("__a.exon", "__b.exon")), F.lit(","), text(F.greatest("__a.exon", "__b.exon")), F.lit("]]")))
    others = F.filter(F.split("others", ","), lambda c: c != "")
    each = F.transform(others, lambda c: codon_change(F.col("codon"), c, three, strand))
    named = lambda word, test: F.concat(F.lit(word), F.nullif(F.array_join(F.transform(F.filter(each, test), lambda s: F.concat(contig, F.lit(":"), s)), ","), F.lit("")))
    choices = F.array_join(F.filter(sequence.codons_of(F.col("aa_alt")), lambda c: c != F.col("codon")), ",")
    items = [F.concat(F.lit("CSQN="), amino_label(F.col("__aa"), F.col("aa_alt"))), F.concat(F.lit("reference_codon="), "codon", F.lit(";candidate_codons="), choices), named("candidate_snv_variants=", lambda s: s.contains(">")), named("candidate_mnv_variants=", lambda s: ~s.contains(">"))]
    return x.select(*records.named_fields(coordinates, region, *items))


def _site_of(x: DataFrame, i: int) -> Column:
    return coords.site(F.get("__three", F.lit(i)), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"), F.lit(True))


def place_told(p: Column) -> Column:
    """A place in or around a coding sequence as text; what follows the last base is *n."""
    return F.when(p["pos"] == -1, F.concat(F.lit("*"), text(p["offset"]))).otherwise(coords.position_text(p))


def _coding_snvs(x: DataFrame) -> DataFrame:
    """Records of c. SNVs (pos, ref and alt of the + strand): the codon before and after; in introns and beyond the ends the region alone."""
    site = coords.site(F.col("pos"), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"), F.col("transcript_type") == "protein_coding")
    inside = (F.col("__p.offset") == 0) & (F.col("transcript_type") == "protein_coding")
    at = F.when(F.col("__p.pos") == -1, F.length("cds")).otherwise(F.col("__p.pos")).cast("int")
    index = F.floor((at + 2) / 3).cast("int")
    own = lambda c: F.when(F.col("strand") == "+", F.col(c)).otherwise(F.translate(c, "ACGT", "TGCA"))
    x = annotate.once(x, __site=site, __i=F.when(inside, index), __codon=F.when(inside, F.substr("cds", 3 * index - 2, F.lit(3))), __k=((at - 1) % 3).cast("int"), __own=own("alt"), __was=own("ref"))
    new = F.concat(F.substr("__codon", F.lit(1), F.col("__k")), "__own", F.substr("__codon", F.col("__k") + 2, F.lit(3)))
    x = annotate.once(x, __new=new, __aa=sequence.codon_aa(F.col("__codon")), __to=sequence.codon_aa(new))
    told = F.col("__own") != ""
    label = F.when(F.col("__codon").isNull(), F.concat(annotate.region_text(F.col("__site")), F.lit("SNV"))).when(told & F.col("__to").isNotNull(), amino_label(F.col("__aa"), F.col("__to"))).otherwise("Unclassified")
    protein = F.coalesce(F.concat(F.lit("p."), "__aa", text(F.col("__i")), F.coalesce("__to", F.lit(""))), F.lit("."))
    coordinates = F.concat(text(F.col("contig_id")), F.lit(":g."), text(F.col("pos")), "ref", F.lit(">"), "alt", F.lit("/c."), place_told(F.col("__p")), "__was", F.lit(">"), "__own", F.lit("/"), protein)
    region = F.concat(F.lit("inside_["), records.place_text(F.col("__site"), F.coalesce(inside, F.lit(False)), F.col("strand")), F.lit("]"))
    codons = F.when(told, F.concat(F.lit("reference_codon="), "__codon", F.lit(";alternative_codon="), "__new"))
    return x.select(*records.named_fields(coordinates, region, F.concat(F.lit("CSQN="), label), records.dbsnp(x), codons))


def _coding_regions(x: DataFrame) -> DataFrame:
    """Records of c. regions (pos, till, bases of the + strand): all bases, what the span holds, and the amino acids it covers."""
    plus, point = F.col("strand") == "+", F.col("pos") == F.col("till")
    own = F.when(plus, F.col("bases")).otherwise(sequence.reverse_complement(F.col("bases")))
    size = F.length("cds")
    base = lambda p, later: coords.lean(F.struct(F.when(p["pos"] == -1, size).otherwise(p["pos"]).cast("int").alias("pos"), p["offset"].alias("offset")), F.col("segs"), F.col("strand"), later)
    one, two = (F.floor((base(F.col(c), later) + 2) / 3).cast("int") for c, later in (("__p", True), ("__q", False)))
    x = records.placed(x, F.col("pos"), F.col("till"))
    exon = F.exists("exons", lambda e: (e["beg"] <= F.col("till")) & (e["end"] >= F.col("pos")))
    covers = ~point & (F.col("transcript_type") == "protein_coding") & exon & (F.col("pos") <= F.col("cds_end")) & (F.col("till") >= F.col("cds_beg"))
    x = annotate.once(x, __own=own, __one=F.when(covers, one), __two=F.when(covers, two))
    amino = sequence.translate_all(F.substr("cds", 3 * F.col("__one") - 2, 3 * (F.col("__two") - F.col("__one") + 1)))
    protein = F.when(F.col("__one") == F.col("__two"), F.concat(F.lit("p."), amino, text(F.col("__one")))).when(F.col("__one") < F.col("__two"), F.concat(F.lit("p."), text(F.col("__one")), F.lit("_"), text(F.col("__two")), amino))
    span = lambda a, b: F.when(point, a).otherwise(F.concat(a, F.lit("_"), b))
    coordinates = F.concat(text(F.col("contig_id")), F.lit(":g."), span(text(F.col("pos")), text(F.col("till"))), "bases", F.lit("/c."), span(place_told(F.col("__p")), place_told(F.col("__q"))), "__own", F.lit("/"), F.coalesce(protein, F.lit(".")))
    sites = [F.get("__sites", F.lit(i)) for i in (0, 1)]
    region = records.between_text(x, *sites, F.get("__c", F.lit(0)), F.get("__c", F.lit(1)))
    items = [F.when(point, i) for i in records.site_items(sites[0])] + [F.when(~point, i) for i in records.span_items(F.col("pos"), F.col("till"), "_included")]
    return x.select(*records.named_fields(coordinates, region, *items))


def coding_records(pairs: DataFrame, chunks: DataFrame, known: DataFrame | None = None, ignore: bool = False, seqmax: int = 10) -> DataFrame:
    """vid (qid, a number), tid and FIELDS of c. changes and regions: pairs (levels.named, with qid and input) of a change and a transcript.

    The change is taken to the genome; SNVs tell their codons, regions their bases
    and amino acids, and deletions, insertions, duplications and blocks what a
    change of the genome at that place tells of the transcript.  A place that
    isn't there, or other bases than the genome's (unless ignore is set), drop the
    pair.  An insertion lies between two bases side by side.
    """
    x = levels.coding_places(pairs).withColumns({"kind": F.col("__h.kind"), "pos": F.least("__a", "__b"), "till": F.greatest("__a", "__b"), "vid": F.concat_ws("/", F.col("qid").cast("string"), F.col("tid").cast("string"))})
    x = x.where((F.col("kind") != "INS") | (F.col("till") == F.col("pos") + 1))
    bases = genome.regions(x.select("vid", "contig_id", "pos", "till").distinct(), chunks, 0).select("vid", F.col("region").alias("bases"))
    turn = lambda c: F.when(F.col("strand") == "+", c).otherwise(sequence.reverse_complement(c))
    x = x.join(bases, "vid").withColumn("galt", turn(F.col("__h.alt")))
    fits = (F.col("__h.ref") == "") | (F.col("kind") == "INS") | (F.col("__h.ref") == turn(F.col("bases")))
    x = kept(x if ignore else x.where(fits))
    t = [c for c in pairs.columns if c not in ("change", "qid", "tok")]
    of = lambda *kinds: x.where(F.col("kind").isin(*kinds))
    place = ["vid", "contig_id", "pos"]
    look = (lambda rows, f, *more: f(rows, known, *more)) if known is not None else (lambda rows, f, *more: rows)

    snv = look(of("SNV").withColumn("ref", F.col("bases")).withColumn("alt", F.col("galt")), known_variants.known_snvs)
    cut = annotate.align_deletions(of("DEL").select(*place, "till"), chunks).select("vid", "right", "left")
    cut = look(of("DEL").join(cut, "vid"), known_variants.known_ranges).select(*t, "vid", "pos", "till", "bases", "right", "left", *(["known"] if known is not None else []))
    # a duplication goes in after itself, in the transcript's direction
    put = of("INS").select(*t, "vid", "pos", F.col("galt").alias("ins")).union(of("DUP").select(*t, "vid", F.when(F.col("strand") == "+", F.col("till")).otherwise(F.col("pos") - 1), "bases"))
    shifts = annotate.align_insertions(put.select(*place, "ins"), chunks, left=True).select("vid", "right", "left")
    block = look(of("MNV").withColumn("ref", F.col("bases")), known_variants.known_ranges, "galt").withColumn("alt", F.col("galt")).drop("galt")
    region = of("REG")
    parts = [_coding_snvs(snv), records.deletion_records(cut, seqmax), records.insertion_records(put.join(shifts, "vid"), both=True), records.block_records(block), _coding_regions(region)]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.withColumn("vid", F.substring_index("vid", "/", 1).cast("bigint"))
