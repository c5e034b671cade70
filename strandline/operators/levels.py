"""Queries that name a transcript: changes of coding sequences and of proteins, taken to the genome and to each other.

queries have qid, tok and change (what follows the colon); transcripts have
source, gene_name, name, version, transcript_type and what annotate needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import coords, hgvs, sequence
from . import annotate, coding, intervals
from .lookup import cascade
from .tables import kept


def named(queries: DataFrame, transcripts: DataFrame, idmap: DataFrame, strict_version: bool = False, coding_only: bool = False, only: str | None = None) -> DataFrame:
    """queries with the transcripts that their tok finds (lookup.cascade); only: a column that restricts them to one name."""
    t = transcripts.where("transcript_type = 'protein_coding'") if coding_only else transcripts
    found = cascade(queries.select("qid", "tok"), t, idmap, strict_version).select("qid", "source", "name")
    rows = queries.join(found, "qid").join(t, ["source", "name"])
    return rows.where(F.col(only).isNull() | (F.upper(only) == F.upper("name"))) if only else rows


def coding_places(pairs: DataFrame) -> DataFrame:
    """pairs of c. change and transcript with __h, the parsed change, __p and __q, its two places, and __a and __b, these in the genome; places that aren't there, or don't name a real edge, go."""
    x = annotate.once(pairs, __h=hgvs.parse_coding(F.col("change"))).where("__h.kind is not null").drop("change")
    x = annotate.once(x, __p=hgvs.parse_position(F.col("__h.beg")), __q=hgvs.parse_position(F.col("__h.end")))
    place = lambda c: coords.genomic_at(F.col(c), F.col("segs"), F.col("strand"))
    edge = lambda c: coords.on_boundary(F.col(c), F.col("segs"), F.col("strand"))
    return annotate.once(x, __fits=edge("__p") & edge("__q"), __a=place("__p"), __b=place("__q")).where("__fits and __a is not null and __b is not null").drop("__fits")


def coding_changes(pairs: DataFrame, ignore_reference: bool = False) -> DataFrame:
    """pairs of c. change and transcript with kind, gbeg, gend, gref, galt (+ strand), cbeg, cend, alt, csqn and change of the protein.

    Places beyond an end of the coding sequence count from that end, those in
    introns from the base beside them, which must be a real edge; what isn't
    there, or tells another reference than the transcript's, goes.  A
    duplication is an insertion after itself.  A change outside the CDS bases is
    labelled by its region.
    """
    x = coding_places(pairs)
    inside = (F.col("__p.offset") == 0) & (F.col("__q.offset") == 0)
    last = lambda p: F.when(p["pos"] == -1, F.length("cds")).otherwise(p["pos"]).cast("int")
    x = annotate.once(x, __beg=last(F.col("__p")), __end=last(F.col("__q"))).where("__beg <= __end")
    own = F.when(inside, F.substr("cds", F.col("__beg"), F.col("__end") - F.col("__beg") + 1))
    x = annotate.once(x, kind=F.col("__h.kind"), __own=own)
    if not ignore_reference:
        x = x.where("__own is null or __h.ref = '' or __h.ref = __own")
    dup, ins = F.col("kind") == "DUP", F.col("kind") == "INS"
    x = x.where(~ins | (F.col("__end") == F.col("__beg") + 1) | ~inside)
    x = x.withColumns({
        "cbeg": F.when(ins, F.col("__end")).when(dup, F.col("__end") + 1).otherwise(F.col("__beg")), "cend": F.when(ins, F.col("__beg")).otherwise(F.col("__end")),
        "alt": F.when(dup, F.col("__own")).otherwise(F.col("__h.alt")), "gbeg": F.least("__a", "__b"), "gend": F.greatest("__a", "__b"),
    })
    turn = lambda c: F.when(F.col("strand") == "+", c).otherwise(sequence.reverse_complement(c))
    x = x.withColumn("gref", turn(F.when(ins, "").otherwise(F.col("__own")))).withColumn("galt", turn(F.col("alt")))
    keep = [c for c in pairs.columns if c != "change"] + ["kind", "gbeg", "gend", "gref", "galt", "cbeg", "cend", "alt"]
    edits = coding.protein_change(x.where(F.col("__own").isNotNull() & (F.col("kind") != "REG")).select(*keep))
    edits = edits.withColumn("csqn", F.when((F.col("kind") == "SNV") & (F.col("csqn") == "Missense") & F.col("change").endswith("*"), "Nonsense").otherwise(F.col("csqn")))
    word = F.element_at(sequence.literal_map({"SNV": "SNV", "DEL": "Deletion", "INS": "Insertion", "DUP": "Insertion", "MNV": "BlockSubstitution"}), F.col("kind"))
    other = annotate.located(x.where("__own is null and kind <> 'REG'").select(*keep), "gbeg")
    other = other.withColumn("csqn", F.concat(annotate.region_text(F.col("__site")), word))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return edits.select(*keep, "csqn", "change", "variant_protein").union(other.select(*keep, "csqn", none("change"), none("variant_protein")))


def codons(pairs: DataFrame, beg: Column, end: Column) -> DataFrame:
    """pairs with gbeg, gend and bases of codons beg..end; those beyond the coding sequence, or cut by an intron only, stay by their outer bases."""
    x = annotate.once(pairs, __b=beg.cast("bigint"), __e=end.cast("bigint")).where("__b >= 1 and __e >= __b and 3 * __e <= length(cds)")
    place = lambda c: coords.genomic(c, F.col("segs"), F.col("strand"))
    a, b = place(3 * F.col("__b") - 2), place(3 * F.col("__e"))
    return annotate.once(x, **{"gbeg": F.least(a, b), "gend": F.greatest(a, b), "bases": F.substr("cds", (3 * F.col("__b") - 2).cast("int"), (3 * (F.col("__e") - F.col("__b") + 1)).cast("int"))}).drop("__b", "__e")


def first_codons(aa: Column) -> Column:
    """The first codon of each amino acid."""
    return F.array_join(F.transform(F.filter(F.split(aa, ""), lambda x: x != ""), lambda x: F.get(sequence.codons_of(x), F.lit(0))), "")


def redundancy(aa: Column) -> Column:
    """How many sequences of codons give these amino acids."""
    return F.aggregate(F.filter(F.split(aa, ""), lambda x: x != ""), F.lit(1).cast("bigint"), lambda n, x: n * F.size(sequence.codons_of(x)))


def protein_changes(pairs: DataFrame) -> DataFrame:
    """pairs of p. change and transcript with kind, p (the parsed change), gbeg, gend, bases (the codons touched), put and n_put.

    The amino acids named must be those of the transcript (a motif with x for
    any); else the pair goes.  put: one way to write the new bases in
    transcript direction, by the first codon of each amino acid; n_put: how many
    ways there are.  An insertion lies between two codons, whose places it has.
    """
    x = annotate.once(pairs, __p=hgvs.parse_protein(F.col("change"))).where("__p.kind is not null").withColumn("kind", F.col("__p.kind"))
    p = F.col("__p")
    x = annotate.once(codons(x, p["beg"], p["end"]), __aa=sequence.translate_all(F.col("bases")))
    same = ((p["beg_aa"] == "") | F.startswith("__aa", p["beg_aa"])) & ((p["end_aa"] == "") | F.endswith("__aa", p["end_aa"]))
    told = (p["ref"] == "") | p["kind"].isin("SNV", "FS") | F.regexp_like("__aa", F.concat(F.lit("^"), F.regexp_replace(F.replace(p["ref"], F.lit("*"), F.lit("\\*")), "[xX]", "[A-Z]")))
    x = x.where(same & told & ((p["kind"] != "INS") | (p["end"] == p["beg"] + 1)))
    made = F.when(p["kind"].isin("INS", "MNV"), p["alt"]).when(p["kind"] == "DUP", F.col("__aa"))
    return annotate.once(x, put=first_codons(made), n_put=redundancy(made)).withColumnRenamed("__p", "p").drop("__aa")


def protein_snvs(pairs: DataFrame) -> DataFrame:
    """protein_changes of kind SNV, with codon, best, apart, others, and the change of the best codon: vbeg, vend, vref, valt on the + strand.

    The change runs from the first to the last base that differs, also where an
    intron lies between; candidates are those of annotate.candidate_codons.
    """
    x = protein_changes(pairs).where("kind = 'SNV' and p.alt <> ''").withColumn("codon", F.col("bases")).withColumn("aa_alt", F.col("p.alt"))
    x = annotate.protein_candidates(x).where("best is not null")
    differ = F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda i: F.substr("codon", i, F.lit(1)) != F.substr("best", i, F.lit(1)))
    x = annotate.once(x, __i=F.array_min(differ), __j=F.array_max(differ))
    place = lambda i: coords.genomic((3 * F.col("p.beg") - 3 + i).cast("bigint"), F.col("segs"), F.col("strand"))
    part = lambda c: F.substr(c, F.col("__i"), F.col("__j") - F.col("__i") + 1)
    turn = lambda c: F.when(F.col("strand") == "+", c).otherwise(sequence.reverse_complement(c))
    a, b = place(F.col("__i")), place(F.col("__j"))
    return x.withColumns({"vbeg": F.least(a, b), "vend": F.greatest(a, b), "vref": turn(part("codon")), "valt": turn(part("best"))}).drop("__i", "__j")


def codon_known(codons: DataFrame, known: DataFrame) -> DataFrame:
    """codons (a key tid, index, contig_id, strand, segs, codon) with ids: known single-base variants (contig_id, pos, ref, alt, id) in each, with the amino acid that they make, by id."""
    each = codons.select("tid", "index", "contig_id", "strand", "codon", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: coords.genomic((3 * F.col("index") - 3 + i).cast("bigint"), F.col("segs"), F.col("strand")))).alias("i", "pos"))
    base = F.when(F.col("strand") == "+", F.col("alt")).otherwise(F.translate("alt", "ACGT", "TGCA"))
    hit = each.join(known.select("contig_id", "pos", "alt", "id"), ["contig_id", "pos"])
    new = F.concat(F.substr("codon", F.lit(1), F.col("i")), base, F.substr("codon", F.col("i") + 2, F.lit(3)))
    hit = hit.select("tid", "index", F.struct("id", sequence.codon_aa(new).alias("aa")).alias("k"))
    ids = hit.groupBy("tid", "index").agg(F.array_join(F.transform(F.sort_array(F.collect_set("k")), lambda k: F.concat(k["id"], F.lit(":"), k["aa"])), ",").alias("ids"))
    return codons.select("tid", "index", "codon").join(ids, ["tid", "index"], "left")


def shared_codons(transcripts: DataFrame) -> DataFrame:
    """tid1, tid2, codon1, codon2, gpos: whole codons of two transcripts that share a base under different numbers, with the first such base.

    Transcripts that overlap are paired once; their bases in common follow from
    the segments of both by arithmetic.  The pairs are dealt out before their
    bases are listed, so that these are grouped where they are.
    """
    n = int(transcripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = transcripts.where("length(cds) > 2")
    side = lambda k: t.select("contig_id", *(F.col(c).alias(c + k) for c in ("tid", "beg", "tend", "strand", "segs")), (F.length("cds") if k == "1" else coords.total_length(F.col("segs"), "gb", "ge")).alias("size" + k))
    pairs = intervals.range_join(side("1"), side("2"), "contig_id", ("beg1", "tend1"), ("beg2", "tend2")).where("tid1 <> tid2").drop("contig_id", "beg1", "tend1", "beg2", "tend2")
    x = pairs.repartition(n, "tid1", "tid2").withColumn("s1", F.explode("segs1")).drop("segs1").withColumn("s2", F.explode("segs2")).drop("segs2").where("s1.gb <= s2.ge and s2.gb <= s1.ge")
    x = x.withColumn("gpos", F.explode(F.sequence(F.greatest("s1.gb", "s2.gb"), F.least("s1.ge", "s2.ge"))))
    codon = lambda k: F.floor((F.col(f"s{k}.cprev") + F.when(F.col(f"strand{k}") == "+", F.col("gpos") - F.col(f"s{k}.gb")).otherwise(F.col(f"s{k}.ge") - F.col("gpos")) + 3) / 3).cast("bigint")
    x = x.select("tid1", "tid2", codon("1").alias("codon1"), codon("2").alias("codon2"), "gpos", "size1", "size2").where("codon1 <> codon2 and 3 * codon1 <= size1 and 3 * codon2 <= size2")
    return x.groupBy("tid1", "tid2", "codon1", "codon2").agg(F.min("gpos").alias("gpos"))


def summary(transcripts: DataFrame, before: int = 1000, after: int = 0) -> DataFrame:
    """name, promoter (beg, end), n_exons, the coding bounds, first and last amino acid and length of the protein of each transcript."""
    plus = F.col("strand") == "+"
    t = transcripts.withColumn("__p", sequence.translate(F.col("cds")))
    return t.select(
        "tid", F.when(plus, F.col("beg") - before).otherwise(F.col("tend") - after).alias("promoter_beg"), F.when(plus, F.col("beg") + after).otherwise(F.col("tend") + before).alias("promoter_end"),
        F.size("exons").cast("bigint").alias("n_exons"), "cds_beg", "cds_end", F.left("__p", F.lit(1)).alias("first_aa"), F.right("__p", F.lit(1)).alias("last_aa"), F.length("__p").cast("bigint").alias("protein_len"),
    )


def long_regions(spans: DataFrame, transcripts: DataFrame, near: int = intervals.NEAR, crowd: int = intervals.CROWD) -> DataFrame:
    """spans (vid, contig_id, pos, till) with every pair of a transcript at the beginning (beg_tid) and one at the end (end_tid), null where none is, and n_spanned, the transcripts between.

    A span within one bin meets the transcripts of that bin, once for its ends and
    what lies between.  For others the two ends are looked up on their own, and what
    lies between is counted by the order of ends (intervals.contained), so that a
    long region costs no more than its ends.
    """
    ends = spans.select("vid", "contig_id", "pos", "till")
    t = transcripts.select("tid", "contig_id", "beg", "tend")
    asked, lists, far = intervals.in_bins(ends, t, "contig_id", ("pos", "till"), ("beg", "tend"), near, crowd)
    over = lambda c: F.transform(F.filter("__list", lambda x: F.col(c).between(x["beg"], x["tend"])), lambda x: x["tid"])
    between = F.size(F.filter("__list", lambda x: (x["beg"] >= F.col("pos")) & (x["tend"] <= F.col("till"))))
    x = asked.join(lists, ["contig_id", "__bin"], "left").select("vid", over("pos").alias("b"), over("till").alias("e"), F.when(F.col("__list").isNull(), 0).otherwise(between).cast("bigint").alias("n_spanned"))
    met = x.select("vid", F.explode_outer("b").alias("beg_tid"), "e", "n_spanned").select("vid", "beg_tid", F.explode_outer("e").alias("end_tid"), "n_spanned")
    far = kept(far)
    return met if far.isEmpty() else met.union(_far_regions(far, t))


def _far_regions(ends: DataFrame, t: DataFrame) -> DataFrame:
    """long_regions of spans of any length."""
    at = lambda c, name: annotate.on_transcripts(ends, t, c, c).select("vid", F.col("tid").alias(name))
    inside = intervals.contained(ends, t, "contig_id", ("pos", "till"), ("beg", "tend"), "tid", most=0).select("vid", F.col("n_inside").alias("n"))
    return ends.join(at("pos", "beg_tid"), "vid", "left").join(at("till", "end_tid"), "vid", "left").join(inside, "vid", "left").select("vid", "beg_tid", "end_tid", F.coalesce("n", F.lit(0)).alias("n_spanned"))


def _shifted_deletions(x: DataFrame, lengths: tuple[int, ...], reach: int) -> DataFrame:
    """Deletions of the given lengths that begin at one of the last `reach` bases up to the end of the codon named, and leave a frame that may fit."""
    at = F.explode(F.sequence(F.greatest(3 * F.col("want.beg") - reach + 1, F.lit(2)), 3 * F.col("want.beg"))).alias("cbeg")
    cut = x.select("*", at).withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).withColumns({"cend": F.col("cbeg") + F.col("n") - 1, "alt": F.lit("")}).where("cend <= length(cds)")
    new = F.concat(F.substr("cds", F.lit(1), F.col("cbeg") - 1), F.substr("cds", F.col("cend") + 1, F.length("cds")), F.coalesce("tail", F.lit("")))
    codon = lambda i: sequence.codon_aa(F.substr(new, 3 * i - 2, F.lit(3)))
    first, last = F.col("want.beg"), F.col("want.beg") + F.col("want.stop") - 1
    return cut.where((F.col("want.alt") == "") | (codon(first) == F.col("want.alt"))).where(F.col("want.stop").isNull() | (codon(last) == "*"))


def _shifted_insertions(x: DataFrame, lengths: tuple[int, ...], reach: int) -> DataFrame:
    """Insertions before one of the last `reach` bases that may give the change asked for, found codon by codon.

    What follows the codons that hold inserted bases is the same for all
    insertions of a length at a place, so it is read once: it must keep the
    protein up to the codon named, and stop where it is told to.  The codons with
    inserted bases are then chosen one after the other among those that have the
    bases around, and the amino acid, or stop, that is wanted there; a choice that
    fails ends at its first codon.
    """
    p = F.col("want")
    at = F.explode(F.sequence(F.greatest(3 * p["beg"] - reach + 1, F.lit(2)), 3 * p["beg"])).alias("cbeg")
    x = x.select("*", at).withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).withColumn("cend", F.col("cbeg") - 1)
    # codons first..last of the new sequence hold inserted bases; base b beyond them is base b - n of the old one
    x = x.withColumns({"first": F.floor((F.col("cbeg") + 2) / 3).cast("int"), "last": F.floor((F.col("cbeg") + F.col("n") + 1) / 3).cast("int"), "old": F.concat("cds", F.coalesce("tail", F.lit("")))})
    x = x.where(F.col("first") <= p["beg"])
    first, last, n, old = (F.col(c) for c in ("first", "last", "n", "old"))
    protein = lambda low, codons: sequence.translate_all(F.substr("old", low, 3 * F.greatest(codons, F.lit(0))))
    after = 3 * last + 1 - n
    kept_codons = p["beg"] - 1 - last  # between the insertion and the codon named
    x = x.where((kept_codons <= 0) | (protein(after, kept_codons) == protein(3 * last + 1, kept_codons)))
    x = x.where((p["beg"] <= last) | (p["alt"] == "") | (protein(after + 3 * kept_codons, F.lit(1)) == p["alt"]))
    stop = p["beg"] + p["stop"] - 1
    x = x.where(p["stop"].isNull() | (stop <= last) | (F.instr(protein(after, stop - last), "*") == stop - last))

    codons = F.array(*(F.struct(F.lit(a + b + c).alias("codon"), F.lit(sequence.STANDARD_CODE[16 * i + 4 * j + k]).alias("aa")) for i, a in enumerate(sequence.BASES) for j, b in enumerate(sequence.BASES) for k, c in enumerate(sequence.BASES)))
    x = annotate.once(x.withColumn("made", F.lit("")), codons=codons)
    for step in range((max(lengths) + 4) // 3):
        q = first + step

        def base(i: int, q: Column = q) -> Column:
            b = 3 * q - 3 + i
            return F.when(b < F.col("cbeg"), F.substr("cds", b, F.lit(1))).when(b < F.col("cbeg") + n, ".").otherwise(F.substr("old", b - n, F.lit(1)))

        known = F.concat(F.lit("^"), base(1), base(2), base(3), F.lit("$"))
        was = sequence.codon_aa(F.substr("cds", 3 * q - 2, F.lit(3)))
        wanted = F.struct(known.alias("known"), was.alias("was"), q.alias("q"))
        x = annotate.once(x, w=wanted)
        w = F.col("w")

        def fits(c: Column) -> Column:
            w = F.col("w")
            told = F.when(w["q"] < p["beg"], c["aa"] == w["was"]).when((w["q"] == p["beg"]) & (p["alt"] != ""), c["aa"] == p["alt"]).when(w["q"] == p["beg"], c["aa"] != w["was"]).otherwise(F.lit(True))
            ends = F.when(p["stop"].isNull() | (w["q"] < p["beg"]), F.lit(True)).otherwise((c["aa"] == "*") == (w["q"] == stop))
            return F.regexp_like(c["codon"], w["known"]) & told & ends

        choices = F.when(w["q"] > last, F.array(F.lit(""))).otherwise(F.transform(F.filter("codons", fits), lambda c: c["codon"]))
        x = x.withColumn("__c", F.explode(choices)).withColumn("made", F.concat("made", "__c")).drop("__c", "w")
    return x.withColumn("alt", F.substr("made", (F.col("cbeg") - 1) % 3 + 1, n)).drop("made", "codons", "first", "last", "old")


def frameshift_candidates(pairs: DataFrame, max_deletion: int = 4, max_insertion: int = 5, reach: int = 10, most: int = 10) -> DataFrame:
    """qid, tid, edit, size, rank, n_omitted: deletions and insertions that give the frameshift of each pair (a p. change of kind FS).

    Every edit at the last `reach` bases up to the end of the codon named counts
    whose protein change is the one asked for (any new amino acid, or stop, if it
    isn't told); insertions are searched codon by codon, so none of the
    4 ** max_insertion is missed or spelled out in vain.  Edits that give the same
    coding sequence are one, the last in the transcript's direction; shorter ones
    come first, deletions before insertions, and the `most` first of a pair are
    listed, with the number of the others.  Names must be those of the transcript.
    """
    # pairs are few bytes and much work, so they are dealt out by number; what follows groups by the same keys
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = protein_changes(pairs.repartition(n, "qid", "tid")).where("kind = 'FS'").select("qid", "tid", "cds", "tail", F.col("p").alias("want"))
    lengths = lambda longest: tuple(n for n in range(1, longest + 1) if n % 3)
    keep = ["qid", "tid", "cds", "tail", "want", "cbeg", "cend", "alt", "n"]
    tried = _shifted_deletions(x, lengths(max_deletion), reach).select(*keep).unionByName(_shifted_insertions(x, lengths(max_insertion), reach).select(*keep))
    edits = coding.protein_change(tried.withColumn("__key", F.md5(F.concat(F.substr("cds", F.lit(1), F.col("cbeg") - 1), "alt", F.substr("cds", F.col("cend") + 1, F.length("cds"))))))
    told = F.concat("want.beg_aa", F.col("want.beg").cast("string"), "want.alt")
    stop = F.when(F.col("want.stop").isNull(), F.col("change").contains("fs*")).otherwise(F.endswith("change", F.concat(F.lit("fs*"), F.col("want.stop").cast("string"))))
    fits = edits.where(F.startswith("change", told) & stop & F.col("change").contains("fs*"))
    text = F.when(F.col("alt") == "", F.concat(F.col("cbeg").cast("string"), F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("_"), F.col("cend").cast("string"))), F.lit("del"), F.substr("cds", F.col("cbeg"), F.col("n")))).otherwise(F.concat(F.col("cend").cast("string"), F.lit("_"), F.col("cbeg").cast("string"), F.lit("ins"), "alt"))
    one = fits.groupBy("qid", "tid", "__key").agg(F.max_by(F.struct(text.alias("edit"), F.col("n").cast("int").alias("size"), (F.col("alt") != "").alias("put"), F.col("cbeg").alias("at")), F.col("cbeg")).alias("e"))
    window = Window.partitionBy("qid", "tid")
    ranked = one.select("qid", "tid", "e.*").withColumn("rank", F.row_number().over(window.orderBy("size", "put", F.desc("at"), "edit"))).withColumn("n_omitted", F.greatest(F.count(F.lit(1)).over(window) - most, F.lit(0)))
    return ranked.where(F.col("rank") <= most).select("qid", "tid", "edit", "size", "rank", "n_omitted")
