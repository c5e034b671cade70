"""Variants on transcripts: consequence labels and coordinates as projections of a range join.

Transcripts have tid, contig_id, strand, beg, tend, cds_beg, cds_end, exons and
segs (functions.coords); with cds, the spliced coding sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, sequence
from . import frontier, genome
from .intervals import range_join
from .tables import kept


def on_transcripts(variants: DataFrame, transcripts: DataFrame, beg: str = "pos", end: str = "pos") -> DataFrame:
    return range_join(variants, transcripts, "contig_id", (beg, end), ("beg", "tend"))


def region_text(s: Column) -> Column:
    """UTR for the prefix of a label first, but Intronic wins over it."""
    return F.when(s["part"] == "intronic", "Intronic").when(s["utr"] == 5, "5-UTR").when(s["utr"] == 3, "3-UTR").otherwise("Unclassified")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, made by a generator of one row: filters and projections after it don't evaluate them again."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def located(pairs: DataFrame, pos: str = "pos") -> DataFrame:
    """pairs with __site and __c, of coords.site and coords.cdna."""
    s = coords.site(F.col(pos), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"), F.lit(True))
    return once(pairs, __site=s, __c=coords.cdna(F.col(pos), F.col("segs"), F.col("strand")))


def snv_consequence(pairs: DataFrame) -> DataFrame:
    """pairs of SNV (pos, ref, alt) and transcript (with cds), with cpos, codon, aa_pos, aa_ref, aa_alt and csqn.

    True splice sites and start or stop codons come first, and end the matter;
    transcription start and end leave Unclassified; then amino acids; then the region.
    """
    x = located(pairs)
    c, site = F.col("__c"), F.col("__site")
    coding = c["offset"] == 0
    index = F.floor((c["pos"] + 2) / 3).cast("bigint")
    own = F.when(F.col("strand") == "+", F.col("alt")).otherwise(F.translate("alt", "ACGT", "TGCA"))
    first = {"index": F.when(coding, index), "codon": F.when(coding, F.substr("cds", (3 * index - 2).cast("int"), F.lit(3))), "place": ((c["pos"] - 1) % 3).cast("int")}

    def changed(y: Column) -> Column:
        new = F.concat(F.substr(y["codon"], F.lit(1), y["place"]), own, F.substr(y["codon"], y["place"] + 2, F.lit(3)))
        aa = {"index": y["index"], "codon": y["codon"], "ref": sequence.codon_aa(y["codon"]), "alt": F.when(F.length(y["codon"]) == 3, sequence.codon_aa(new))}
        return sequence.bind(aa, labelled)

    def labelled(z: Column) -> Column:
        amino = F.when(z["ref"] == z["alt"], "Synonymous").when(z["alt"] == "*", "Nonsense").otherwise("Missense")
        label = (
            F.when(site["splice"].startswith("Splice"), F.concat(site["splice"], F.lit("SNV")))
            .when(site["codon"].isNotNull(), F.concat(site["codon"], F.lit("SNV")))
            .when(site["edge"].isNotNull(), "Unclassified")
            .when(z["ref"].isNotNull() & z["alt"].isNotNull(), amino)
            .otherwise(F.concat(region_text(site), F.lit("SNV")))
        )
        return F.struct(z["index"].alias("aa_pos"), z["ref"].alias("aa_ref"), z["alt"].alias("aa_alt"), coords.position_text(c).alias("cpos"), z["codon"].alias("codon"), label.alias("csqn"))

    return x.select(*pairs.columns, F.inline(F.array(sequence.bind(first, changed))))


def roll_right(seq: Column, beg: Column, end: Column) -> Column:
    """How far a deletion of beg..end in a whole sequence shifts right: the common prefix of what it deletes on and what follows."""
    rest = lambda first: F.substr(seq, first, F.lit(2**31 - 1))
    return F.coalesce(sequence.first_difference(rest(beg), F.concat(rest(end + 1), F.lit("-"))) - 1, F.lit(0))


def roll_left(seq: Column, beg: Column, end: Column) -> Column:
    """How far it shifts left: the mirror image; base 1 stays in place."""
    head = lambda last: F.reverse(F.substr(seq, F.lit(1), last))
    return F.when(beg <= 1, 0).otherwise(sequence.first_difference(head(end), F.concat(head(beg - 1), F.lit("-"))) - 1)


def roll_insertion(seq: Column, at: Column, ins: Column) -> Column:
    """How far an insertion after position at shifts right; the inserted string turns with it."""
    rest = F.substr(seq, at + 1, F.lit(2**31 - 1))
    return F.coalesce(sequence.first_difference(F.concat(ins, rest), F.concat(rest, F.lit("-"))) - 1, F.lit(0))


def turned(ins: Column, by: Column) -> Column:
    """The inserted string after a shift to the right."""
    n = F.length(ins)
    return F.substr(F.concat(ins, ins), by % F.greatest(n, F.lit(1)) + 1, n)


def align_deletions(rows: DataFrame, chunks: DataFrame, window: int = 64, most: int = 64) -> DataFrame:
    """rows (contig_id, pos, till) with right and left, how far the deletion of pos..till shifts either way.

    Compared in a window taken from chunks; rows that are longer than `most`, or
    whose window ends before the repeat does, read on in rounds
    (frontier.equal_run), however far it goes.
    """
    n = (F.col("till") - F.col("pos") + 1).cast("int")
    x = genome.bases_at(rows, chunks, __back=(-window, window), __fore=(0, window + most)).withColumn("__short", n <= most)
    fore, back = F.col("__fore"), F.col("__back")
    right = sequence.common_prefix(F.substr(fore, F.lit(1), F.lit(window)), F.substr(fore, n + 1, F.lit(window)))
    left = sequence.common_prefix(F.substr(F.reverse(F.concat(back, F.substr(fore, F.lit(1), n))), F.lit(1), F.lit(window)), F.reverse(back))
    x = x.withColumn("__right", F.when(F.col("__short"), right)).withColumn("__left", F.when(F.col("__short"), left))
    done = F.col("__short") & (F.col("__right") < window) & (F.col("__left") < window)
    x = kept(x.select(*rows.columns, F.col("__right").alias("right"), F.col("__left").alias("left"), done.alias("__done"), F.monotonically_increasing_id().alias("__key")))
    near, far = x.where("__done").select(*rows.columns, "right", "left"), x.where("not __done").select(*rows.columns, "__key")
    if far.isEmpty():
        return near
    to_right = frontier.equal_run(far.withColumn("__after", F.col("till") + 1), chunks, "pos", "__after").withColumnRenamed("run", "right")
    to_left = frontier.equal_run(far.withColumn("__before", F.col("pos") - 1), chunks, "__before", "till", back=True).withColumnRenamed("run", "left")
    return near.union(far.join(to_right, "__key").join(to_left, "__key").select(*rows.columns, F.col("right").cast("int"), F.col("left").cast("int")))


def align_insertions(rows: DataFrame, chunks: DataFrame, window: int = 64, left: bool = False, before: int = 0) -> DataFrame:
    """rows (contig_id, pos, ins) with right, how far the insertion after pos shifts right, like align_deletions; left: with left, too.

    Where the inserted bases are also those that follow, it shifts as the deletion
    of these would, and by their number more.  before: with `before`, up to so many
    bases (no more than window) before the insertion's place after the shift.  rows
    may have __fore and __back, the bases of the window after and up to pos, and
    are then read without meeting chunks.
    """
    x = rows if "__fore" in rows.columns else genome.bases_at(rows, chunks, __fore=(1, window), __back=(1 - window, window))
    rows = rows.drop("__fore", "__back")
    x = x.withColumn("__right", sequence.common_prefix(F.concat("ins", "__fore"), F.col("__fore")))
    behind = F.reverse("__back")
    x = x.withColumn("__left", sequence.common_prefix(F.concat(F.reverse("ins"), behind), behind) if left else F.lit(0))
    done = (F.col("__right") < window) & (F.col("__left") < window) & (F.length("ins") <= window)
    x = x.withColumn("before", F.right(F.concat("__back", F.left("__fore", F.col("__right"))), F.lit(before))) if before else x
    x = kept(x.select(*rows.columns, *(["before"] if before else []), F.col("__right").alias("right"), F.col("__left").alias("left"), done.alias("__done"), F.monotonically_increasing_id().alias("__key")))
    near, far = x.where("__done").select(*rows.columns, "right", *(["left"] if left else []), *(["before"] if before else [])), x.where("not __done").select(*rows.columns, "__key")
    if far.isEmpty():
        return near
    n = F.length("ins")
    far = genome.regions(far.withColumn("__low", F.col("pos") - n + 1).withColumn("__high", F.col("pos") + n), chunks, 0, "__low", "__high")
    at = (F.col("pos") - F.col("region_first") + 1).cast("int")
    lead = lambda s, t: F.coalesce(sequence.first_difference(s, F.left(t, F.length(s))) - 1, F.least(F.length(s), F.length(t)))
    after, prior = F.substr("region", at + 1, n), F.reverse(F.left("region", at))
    far = kept(far.withColumn("__after", lead(F.col("ins"), after)).withColumn("__prior", lead(F.reverse("ins"), prior)).withColumn("__n", n).drop("region", "region_first", "__low", "__high"))

    def shift(rows: DataFrame, own: str, back: bool, name: str) -> DataFrame:
        whole = rows.where(F.col(own) == F.col("__n"))
        x, y = (F.col("pos") - F.col("__n"), F.col("pos")) if back else (F.col("pos") + 1, F.col("pos") + 1 + F.col("__n"))
        run = frontier.equal_run(whole.withColumn("__a", x).withColumn("__b", y), chunks, "__a", "__b", back)
        return rows.join(run, "__key", "left").withColumn(name, (F.col(own) + F.coalesce("run", F.lit(0))).cast("int")).drop("run")

    far = shift(far, "__after", False, "right")
    far = shift(far, "__prior", True, "left") if left else far
    far = far.select(*rows.columns, "right", *(["left"] if left else []))
    if before:
        far = genome.bases_at(far.withColumn("__to", F.col("pos") + F.col("right")), chunks, pos="__to", before=(1 - before, before)).drop("__to")
    return near.union(far)


def candidate_codons(spark: SparkSession) -> DataFrame:
    """codon, aa_alt, best, apart, others: alternative codons of each amino acid, fewest differing bases first, then in table order; 64 x 23 rows at most."""
    rows = []
    for codon in (a + b + c for a in sequence.BASES for b in sequence.BASES for c in sequence.BASES):
        for aa in sequence.CODONS_OF:
            if found := sequence.alternatives(codon, aa):
                rows.append((codon, aa, found[0][1], found[0][0], ",".join(c for _, c in found[1:])))
    return spark.createDataFrame(rows, "codon string, aa_alt string, best string, apart int, others string")


def protein_candidates(rows: DataFrame) -> DataFrame:
    """rows with codon and aa_alt, and the best alternative codon, how many bases it differs in, and the others."""
    return rows.join(F.broadcast(candidate_codons(rows.sparkSession)), ["codon", "aa_alt"], "left")


def collapse(labels: DataFrame, key: str) -> DataFrame:
    """key, csqn: its one label, or Multi: and all distinct ones in order."""
    found = labels.groupBy(key).agg(F.sort_array(F.collect_set("csqn")).alias("all"))
    return found.select(key, F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.concat(F.lit("Multi:"), F.array_join("all", ","))).alias("csqn"))
