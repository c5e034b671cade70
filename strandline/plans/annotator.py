"""From annotation files to text records: transcripts with their sequences, and queries of single identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, hgvs, sequence
from ..operators import annotate, frontier, genes, genome, haplotypes, intervals, level_records, levels, records, regions
from ..operators import known as known_variants
from ..operators.tables import kept
from ..sources import tracks


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """contig_id, chunk, first, bases of a FASTA file, with chromosome names made alike; written once (tables.kept)."""
    g = tracks.read_fasta(spark, path, genome.CHUNK, genome.MARGIN, genome.MARGIN)
    return kept(g.select(hgvs.normalize_chromosome(F.col("chrom")).alias("contig_id"), F.col("chunk").cast("bigint").alias("chunk"), F.col("beg").alias("first"), F.col("seq").alias("bases")))


def _fetch(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    return tracks.fetch(spans, chunks.select(F.col("contig_id").alias("chrom"), F.col("chunk").cast("int").alias("chunk"), F.col("first").alias("beg"), F.col("bases").alias("seq")), genome.CHUNK)


def prepare(transcripts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Transcripts of the readers with tid, contig_id, segs, cds and tail, as the operators want them.

    tail is what lies behind the coding sequence as far as a shifted frame can
    read on: until each frame has had a stop, or the contig ends (frontier.tails).
    The table is written once (tables.kept).
    """
    t = transcripts.withColumn("tid", F.concat_ws("/", "source", "name", "chrm")).withColumn("contig_id", hgvs.normalize_chromosome(F.col("chrm")))
    coding = F.col("transcript_type") == "protein_coding"
    t = t.withColumn("segs", coords.segments(F.col("exons"), F.col("cds_beg"), F.col("cds_end"), F.col("strand"))).withColumn("segs", F.when(coding, F.col("segs")).otherwise(F.array().cast(coords.SEGMENTS)))
    spans = t.select("tid", "strand", F.col("contig_id").alias("chrom"), F.posexplode("segs").alias("i", "s")).select("tid", "strand", "chrom", "i", F.col("s.gb").alias("beg"), F.col("s.ge").alias("end"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "bases"))), lambda x: x["bases"]), "")
    cds = _fetch(spans, chunks).groupBy("tid").agg(F.when(F.first("strand") == "+", joined).otherwise(sequence.reverse_complement(joined)).alias("cds"))

    tail = frontier.tails(t.where(coding), chunks)
    return kept(t.join(cds, "tid", "left").join(tail, "tid", "left").withColumn("cds", F.coalesce("cds", F.lit(""))))


def read_queries(lines: DataFrame) -> DataFrame:
    """qid, input, tok, change, level of identifiers (value), one a line."""
    x = lines.where(F.trim("value") != "").withColumn("qid", F.monotonically_increasing_id())
    return x.select("qid", F.trim("value").alias("input"), F.inline(F.array(hgvs.split_identifier(F.col("value")))))


def genomic_changes(queries: DataFrame) -> DataFrame:
    """vid (qid), input, contig_id, kind, pos, till, told, alt of queries at the genome's level; those without a known form go."""
    q = annotate.once(queries.where("coalesce(level, 'g') = 'g'"), __h=hgvs.parse_genomic(F.col("change"))).where("__h.kind is not null")
    return q.select(F.col("qid").alias("vid"), "input", hgvs.normalize_chromosome(F.col("tok")).alias("contig_id"), F.col("__h.kind").alias("kind"), F.col("__h.beg").cast("bigint").alias("pos"), F.col("__h.end").cast("bigint").alias("till"), F.col("__h.ref").alias("told"), "__h.alt")


def vcf_changes(variants: DataFrame) -> DataFrame:
    """The same of tracks.read_vcf, with its line, place and alt_number; a variant's input is its line."""
    told = F.when(F.col("kind") == "DEL", F.col("bases")).when(F.col("kind") == "INS", "").otherwise(F.col("ref"))
    return variants.select(F.monotonically_increasing_id().alias("vid"), F.col("line").alias("input"), hgvs.normalize_chromosome(F.col("chrom")).alias("contig_id"), "kind", F.col("beg").alias("pos"), F.col("end").alias("till"), told.alias("told"), F.when(F.col("kind") == "INS", F.col("bases")).when(F.col("kind") == "DEL", "").otherwise(F.col("alt")).alias("alt"), "line", "place", "alt_number")


def genomic_records(queries: DataFrame, transcripts: DataFrame, chunks: DataFrame, **options: object) -> DataFrame:
    """change_records of queries (read_queries) at the genome's level."""
    return change_records(genomic_changes(queries), transcripts, chunks, **options)


def vcf_records(spark: SparkSession, path: str, transcripts: DataFrame, chunks: DataFrame, **options: object) -> DataFrame:
    """change_records of all alternatives of a VCF, with line, place and alt_number, as records.write_vcf takes them."""
    q = vcf_changes(tracks.read_vcf(spark, path))
    return change_records(q, transcripts, chunks, **options).join(q.select("vid", "line", "place", "alt_number"), "vid")


def annotate_vcf(spark: SparkSession, path: str, transcripts: DataFrame, chunks: DataFrame, to: str, **options: object) -> None:
    """A VCF read, annotated, and written in its own order with its header."""
    records.write_vcf(vcf_records(spark, path, transcripts, chunks, **options), tracks.vcf_header(spark, path), to)


def change_records(q: DataFrame, transcripts: DataFrame, chunks: DataFrame, sizes: DataFrame | None = None, known: DataFrame | None = None, longest: bool = False, ignore: bool = False, haplotype: bool = False, promoter: tuple[int, int] = regions.PROMOTER, seqmax: int = 10, width: int = intervals.BIN) -> DataFrame:
    """vid (a number) and the seven FIELDS of changes and regions of the genome (genomic_changes), one or more for each.

    What no transcript meets is told by its neighbours, and a span over
    transcripts apart by its two ends (operators.regions).  A duplication is an
    insertion after itself.  A block substitution loses its common ends, and is
    what remains; with haplotype it is taken apart by alignment first.
    Deletions and regions are cut to their contig.  An SNV or block that tells
    other bases than the genome's is an error record, unless ignore is set; such a
    deletion gets a warning.  known: known variants (contig_id, pos, ref, alts,
    id); sizes: contig_id, len.  A change on an unknown contig, or beyond its
    end, gets a record of dots.
    """
    q = q.select("vid", "input", "contig_id", "kind", "pos", "till", "told", "alt")
    sizes = regions.contig_sizes(chunks) if sizes is None else sizes
    place = ["vid", "input", "contig_id", "pos"]
    kind = lambda *names: q.where(F.col("kind").isin(*names)).drop("kind")
    read = lambda rows, name: genome.regions(rows, chunks, 0).withColumnRenamed("region", name).drop("region_first")
    cut_to = lambda rows: rows.join(sizes, "contig_id").withColumn("__c", sequence.clamped(F.col("pos"), F.col("till"), F.col("len"))).withColumns({"pos": F.col("__c.beg"), "till": F.col("__c.end")}).drop("__c", "len")
    right = (F.col("told") == "") | (F.col("told") == F.col("ref"))
    fits = F.lit(True) if ignore else right
    single = genome.bases_at(kind("SNV"), chunks, ref=(0, 1)).where("ref <> ''")
    whole = read(kind("MNV"), "ref")
    block = whole.where(fits)
    if haplotype:
        block = haplotypes.decomposed(block)
    block = annotate.once(block, __t=sequence.trim(F.col("ref"), F.col("alt"))).select("vid", "input", "contig_id", (F.col("pos") + F.col("__t.head")).alias("pos"), "__t.ref", "__t.alt")
    block = block.withColumn("till", F.col("pos") + F.length("ref") - 1)
    one = (F.length("ref") == 1) & (F.length("alt") == 1)
    error = F.concat(F.lit("invalid_reference_base_"), "told", F.lit(";expect_"), "ref")
    warned = F.when(~right, F.concat(F.lit("Warning="), error)).alias("warning")
    snv = single.where(fits).select(*place, "ref", "alt", warned).union(block.where(one).select(*place, "ref", "alt", F.lit(None).cast("string")))
    cut = cut_to(kind("DEL")).select(*place, "till", "told").union(block.where("alt = '' and ref <> ''").select(*place, "till", F.lit("")))
    cut = read(annotate.align_deletions(cut, chunks), "bases")
    cut = cut.withColumn("warning", F.when((F.col("told") != "") & (F.col("told") != F.col("bases")), F.concat(F.lit("invalid_deletion_seq_"), "bases", F.lit("_(expect_"), "told", F.lit(")")))).drop("told")
    twice = read(kind("DUP"), "ins").select("vid", "input", "contig_id", F.col("till").alias("pos"), "ins")
    put = kind("INS").select(*place, F.col("alt").alias("ins")).union(twice).union(block.where("ref = '' and alt <> ''").select("vid", "input", "contig_id", F.col("pos") - 1, "alt"))
    put = annotate.align_insertions(put, chunks, left=True)
    region = genome.bases_at(cut_to(kind("REG")).select(*place, "till"), chunks, ref=(0, 1))
    swapped = block.where(~one & (F.col("ref") != "") & (F.col("alt") != ""))

    # parts of one query may be several: each gets a number of its own
    own = lambda rows, name: rows.withColumn("query", F.col("vid")).withColumn("vid", F.concat_ws("/", F.col("vid").cast("string"), F.lit(name), F.col("pos").cast("string")))
    t = transcripts.drop("source_file")
    snv, put, cut, swapped, region = own(snv, "s"), own(put, "i"), own(cut, "d"), own(swapped, "b"), own(region, "r")
    if known is not None:
        snv, cut, swapped = known_variants.known_snvs(snv, known), known_variants.known_ranges(cut, known), known_variants.known_ranges(swapped, known, "alt")
    points = kept(snv.withColumn("kind", F.lit("SNV")).unionByName(put.withColumn("kind", F.lit("INS")), allowMissingColumns=True).withColumn("till", F.col("pos")))
    spans = kept(cut.withColumn("kind", F.lit("DEL")).unionByName(swapped.withColumn("kind", F.lit("MNV")), allowMissingColumns=True).unionByName(region.withColumn("kind", F.lit("REG")), allowMissingColumns=True))
    at = regions.told(points, t, sizes, width, longest, promoter, ranges=False)
    over = regions.told(spans, t, sizes, width, longest, promoter)
    of = lambda rows, name: rows.where(F.col("kind") == name)
    snvs, puts = of(at.pairs, "SNV").drop("till"), of(at.pairs, "INS").drop("till", "alt", "ref")
    text = records.text
    label = lambda prefix, word: F.concat(F.lit("CSQN="), prefix, F.lit(word))
    beyond = F.lit("Intergenic")
    cut_ids, put_ids = records.deletion_ids(seqmax), records.insertion_ids()
    g = lambda name, ids, key: F.concat(F.lit(f"{name}=g."), ids[key])
    lost = lambda prefix, rows: (label(prefix, "Deletion"), records.optional(rows, "warning"), records.dbsnp(rows), g("left_align_gDNA", cut_ids, "left"), g("unaligned_gDNA", cut_ids, "own"))
    named = F.concat(text(F.col("pos")), F.lit("_"), text(F.col("till")))
    swap_id = records.block_id(text(F.col("pos")), text(F.col("till")), F.col("ref"), F.col("alt"))
    bare = lambda rows: rows.drop("transcript", "gene", "strand")
    wide, lone = (lambda name: of(over.wide, name)), (lambda name: of(over.between, name))
    blocks = wide("MNV").drop("transcript", "gene").withColumnsRenamed({"names": "transcript", "genes": "gene"})
    alone = lone("MNV")
    parts = [
        records.snv_records(snvs), records.insertion_records(puts), records.deletion_records(of(over.pairs, "DEL").drop("alt", "ref"), seqmax), records.block_records(of(over.pairs, "MNV")), records.region_records(of(over.pairs, "REG").drop("alt"), regions.promoter_items(over.pairs, *promoter)),
        records.unplaced_records(of(at.between, "SNV"), F.concat(text(F.col("pos")), "ref", F.lit(">"), "alt"), label(beyond, "SNV"), records.dbsnp(at.between)),
        records.unplaced_records(of(at.between, "INS"), put_ids["right"], label(beyond, "Insertion"), g("left_align_gDNA", put_ids, "left"), g("unalign_gDNA", put_ids, "own")),
        records.unplaced_records(bare(wide("DEL")), cut_ids["right"], *lost(F.col("label"), over.wide)), records.unplaced_records(lone("DEL"), cut_ids["right"], *lost(beyond, over.between)),
        records.unplaced_records(blocks, swap_id, label(F.col("label"), "BlockSubstitution"), records.dbsnp(blocks)),
        records.unplaced_records(alone, swap_id, F.when(F.col("pos") == F.col("till"), "CSQN=Unclassified").otherwise(label(beyond, "BlockSubstitution")), records.dbsnp(alone)),
        records.unplaced_records(wide("REG"), named), records.unplaced_records(lone("REG"), F.when(F.col("pos") == F.col("till"), F.concat(text(F.col("pos")), F.lit(">"))).otherwise(named), F.col("promoters")),
    ]
    out = parts[0].select("vid", *records.FIELDS)
    for more in parts[1:]:
        out = out.union(more.select("vid", *records.FIELDS))
    out = out.withColumn("vid", F.substring_index("vid", "/", 1).cast("bigint"))
    other = F.concat(F.lit("CSQN=Unclassified;invalid_reference_seq_"), "told", F.lit("_(expect_"), "ref", F.lit(")"))
    wrong = single.where(~right).select("vid", F.concat(F.lit("Error="), error).alias("__error"))
    if not ignore:
        wrong = wrong.union(whole.where(~right).select("vid", other))
    told = points.select("query").union(spans.select("query")).distinct()  # each of these has a record
    none = q.join(told, q["vid"] == told["query"], "left_anti").join(wrong, "vid", "left")
    if ignore:  # the error is told besides the record
        none = none.select(*q.columns, "__error").union(q.join(wrong, "vid"))
    dot = F.lit(".")
    return out.union(none.select("vid", "input", dot, dot, dot, dot, dot, F.coalesce("__error", F.lit("no_valid_transcript_found"))))


def coding_records(queries: DataFrame, transcripts: DataFrame, idmap: DataFrame) -> DataFrame:
    """qid, input and what a c. query changes in the genome and the protein, by transcript."""
    return levels.coding_changes(levels.named(queries.where("level = 'c'").select("qid", "input", "tok", "change"), transcripts, idmap))


def coding_text_records(queries: DataFrame, transcripts: DataFrame, idmap: DataFrame, chunks: DataFrame, longest: bool = False, longest_coding: bool = False, **options: object) -> DataFrame:
    """vid (qid) and the seven FIELDS of c. queries, one for each transcript that their name finds and that fits; a query that fits none gets a record of dots.

    longest and longest_coding keep the longest transcript of each gene.
    """
    q = queries.where("level = 'c'").select("qid", "input", "tok", "change")
    pairs = levels.named(q, transcripts, idmap)
    if longest or longest_coding:
        pairs = genes.longest_only(pairs, "qid", coding=longest_coding)
    out = level_records.coding_records(pairs, chunks, **options).select("vid", *records.FIELDS)
    out = kept(out)
    dot = F.lit(".")
    none = q.join(out.select(F.col("vid").alias("qid")).distinct(), "qid", "left_anti")
    return out.union(none.select("qid", "input", dot, dot, dot, dot, dot, F.lit("no_valid_transcript_found")))
