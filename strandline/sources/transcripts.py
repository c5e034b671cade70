"""Readers of transcript annotation files: text in, one row a transcript out.

All give TRANSCRIPT columns; exons are 1-based and closed, in genomic order.
Files are read as lines, so plain and gz ones, and folders of them, work alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

TRANSCRIPT = ("source", "gene_name", "name", "version", "transcript_type", "beg", "tend", "chrm", "strand", "cds_beg", "cds_end", "exons", "aliases", "gene_dbxref")


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.split("value", "\t").alias("f")).where(F.size("f") >= least)


def _features(spark: SparkSession, path: str) -> DataFrame:
    """Columns of GTF and GFF files, the attributes as text, and the place of the line in its file."""
    f = lambda i: F.col("f")[i]
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("line"))
    lines = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"), "line").where(F.size("f") >= 9)
    return lines.select("line", f(0).alias("chrm"), f(1).alias("origin"), f(2).alias("feature"), f(3).cast("bigint").alias("b"), f(4).cast("bigint").alias("e"), f(6).alias("strand"), f(8).alias("attributes"))


def quoted(attribute: str) -> Column:
    """The value of `attribute "value";`, or null."""
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{attribute} "?([^";]*)"?', 1), F.lit(""))


def assigned(attribute: str) -> Column:
    """The value of attribute=value;, or null."""
    return F.nullif(F.regexp_extract("attributes", rf"(?:^|;)\s*{attribute}=([^;]*)", 1), F.lit(""))


def _gather(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Rows of transcript, exon and CDS features to transcripts: one shuffle on the transcript's name."""
    spans = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("feature").isin(*kinds), F.struct(F.col("b").alias("beg"), F.col("e").alias("end")))))
    edge = lambda f, kinds, c: f(F.when(F.col("feature").isin(*kinds), F.col(c)))
    t = rows.groupBy("name", "chrm", "strand").agg(
        F.max("gene_name").alias("gene_name"), F.max("version").alias("version"), F.max("transcript_type").alias("transcript_type"), spans(["exon"]).alias("own"), spans(["CDS"]).alias("coding"), F.sort_array(F.collect_set("alias")).alias("aliases"),
        edge(F.min, ["transcript", "mRNA"], "b").alias("tb"), edge(F.max, ["transcript", "mRNA"], "e").alias("te"), edge(F.min, ["CDS"], "b").alias("cb"), edge(F.max, ["CDS"], "e").alias("ce"), F.max("gene_dbxref").alias("gene_dbxref"),
    )
    t = t.withColumn("exons", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("coding"))).where(F.size("exons") > 0)
    beg, end = F.coalesce("tb", F.get("exons", F.lit(0))["beg"]), F.coalesce("te", F.array_max(F.transform("exons", lambda x: x["end"])))
    return t.select(F.lit(source).alias("source"), F.upper("gene_name").alias("gene_name"), "name", "version", "transcript_type", beg.alias("beg"), end.alias("tend"), "chrm", "strand", F.coalesce("cb", beg).alias("cds_beg"), F.coalesce("ce", end).alias("cds_end"), "exons", "aliases", "gene_dbxref")


def read_gtf(spark: SparkSession, path: str, source: str = "Ensembl") -> DataFrame:
    """Ensembl and GENCODE GTF; also old files without transcript rows, whose bounds are those of the exons."""
    full = quoted("transcript_id")
    rows = _features(spark, path).where(F.col("feature").isin("transcript", "exon", "CDS")).withColumn("full", full).where("full is not null")
    kind = F.coalesce(quoted("transcript_biotype"), quoted("transcript_type"), F.col("origin"))
    rows = rows.withColumns({
        "name": F.regexp_extract("full", r"^(.*?)(\.\d+)?$", 1), "version": F.coalesce(quoted("transcript_version"), F.nullif(F.regexp_extract("full", r"\.(\d+)$", 1), F.lit(""))).try_cast("int"),
        "gene_name": F.coalesce(quoted("gene_name"), quoted("gene_id")), "transcript_type": kind, "alias": quoted("protein_id"), "gene_dbxref": quoted("gene_id"),
    })
    return _gather(rows, source)


def read_aceview(spark: SparkSession, path: str) -> DataFrame:
    """AceView GFF with unquoted attributes; only transcripts with exons and CDS."""
    rows = _features(spark, path).where(F.col("feature").isin("exon", "CDS")).withColumns({"name": quoted("transcript_id"), "gene_name": quoted("gene_id"), "version": F.lit(None).cast("int"), "transcript_type": F.lit("protein_coding"), "alias": F.lit(None).cast("string"), "gene_dbxref": F.lit(None).cast("string")})
    both = rows.groupBy("name").agg(F.countDistinct("feature").alias("n")).where("n = 2").select("name")
    return _gather(rows.join(both, "name"), "AceView")


def read_refseq(spark: SparkSession, path: str) -> DataFrame:
    """RefSeq GFF3: chromosomes from the region row of each sequence, genes by parent; pseudogenes and unlocalised sequences go.

    A region row names its sequence, so that the state of the file (which region
    came last) is a join on the sequence's name, and files can be split.  Of
    genes that share a name on a sequence, the one that comes first counts.
    """
    rows = _features(spark, path).withColumnRenamed("chrm", "seqid").withColumns({"id": assigned("ID"), "parent": assigned("Parent")})
    regions = rows.where("feature = 'region'").where(assigned("chromosome").isNotNull() & ~F.coalesce(assigned("map"), F.lit("")).isin("unlocalized")).select("seqid", F.concat(F.lit("chr"), assigned("chromosome")).alias("chrm")).dropDuplicates(["seqid"])
    rows = rows.join(regions, "seqid")
    genes = rows.where((F.col("feature") == "gene") & (F.coalesce(assigned("pseudo"), F.lit("")) != "true")).select("chrm", F.col("id").alias("gene_id"), assigned("Name").alias("gene_name"), assigned("Dbxref").alias("gene_dbxref"), "line")
    first = F.row_number().over(Window.partitionBy("chrm", "gene_name").orderBy("line"))
    genes = genes.withColumn("r", first).where("r = 1").drop("r", "line")
    kinds = F.when(F.col("feature") == "mRNA", "protein_coding").when(F.col("feature") == "ncRNA", assigned("ncrna_class")).otherwise(F.col("feature"))
    made = rows.where(F.col("feature").isin("mRNA", "ncRNA", "rRNA", "tRNA", "lnc_RNA", "transcript", "primary_transcript")).select(F.col("id").alias("tx_id"), F.col("parent").alias("gene_id"), F.coalesce(assigned("Name"), F.col("id")).alias("full"), kinds.alias("transcript_type"), "chrm", F.col("b").alias("tb"), F.col("e").alias("te"))
    parts = rows.where(F.col("feature").isin("exon", "CDS")).select("feature", "b", "e", "strand", "parent", "chrm", assigned("protein_id").alias("alias"))
    direct = parts.join(genes.withColumnRenamed("gene_id", "parent").select("parent", F.col("gene_name").alias("full")), "parent").select(F.col("parent").alias("tx_id"), F.col("parent").alias("gene_id"), "full", F.lit("protein_coding").alias("transcript_type"), "chrm").distinct()
    named = made.drop("tb", "te").unionByName(direct).join(genes.drop("chrm"), "gene_id")
    joined = parts.withColumnRenamed("parent", "tx_id").join(named, ["tx_id", "chrm"])
    return _gather(joined.withColumns({"name": F.regexp_extract("full", r"^(.*?)(\.\d+)?$", 1), "version": F.regexp_extract("full", r"\.(\d+)$", 1).try_cast("int")}), "RefSeq")


def _table(t: DataFrame, source: str) -> DataFrame:
    blank = {"version": F.lit(None).cast("int"), "aliases": F.array().cast("array<string>"), "gene_dbxref": F.lit(None).cast("string"), "transcript_type": F.lit("protein_coding")}
    for c, v in blank.items():
        t = t if c in t.columns else t.withColumn(c, v)
    return t.withColumn("source", F.lit(source)).select(*TRANSCRIPT)


def _pairs(begs: Column, ends: Column, shift: int) -> Column:
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    return F.array_sort(F.zip_with(numbers(begs), numbers(ends), lambda b, e: F.struct((b + shift).alias("beg"), e.alias("end"))))


def read_ccds(spark: SparkSession, path: str) -> DataFrame:
    """CCDS table: Public rows; begins and ends are 0-based and closed."""
    f = lambda i: F.col("f")[i]
    t = _fields(spark, path, 10).where(f(5) == "Public")
    ints = F.transform(F.regexp_extract_all(f(9), F.lit(r"(\d+)-(\d+)"), F.lit(0)), lambda x: F.struct((F.split_part(x, F.lit("-"), F.lit(1)).cast("bigint") + 1).alias("beg"), (F.split_part(x, F.lit("-"), F.lit(2)).cast("bigint") + 1).alias("end")))
    t = t.select(F.concat(F.lit("chr"), f(0)).alias("chrm"), F.upper(f(2)).alias("gene_name"), F.regexp_extract(f(4), r"^(.*?)(\.\d+)?$", 1).alias("name"), F.regexp_extract(f(4), r"\.(\d+)$", 1).try_cast("int").alias("version"), f(6).alias("strand"), (f(7).cast("bigint") + 1).alias("cds_beg"), (f(8).cast("bigint") + 1).alias("cds_end"), F.array_sort(ints).alias("exons"))
    return _table(t.withColumn("beg", F.col("cds_beg")).withColumn("tend", F.col("cds_end")), "CCDS")


def read_refgene(spark: SparkSession, path: str) -> DataFrame:
    """UCSC refGene: complete coding sequences only; begins are 0-based."""
    f = lambda i: F.col("f")[i]
    t = _fields(spark, path, 15).where((f(13) == "cmpl") & (f(14) == "cmpl"))
    n = lambda i, shift=0: f(i).cast("bigint") + shift
    return _table(t.select(f(1).alias("name"), f(2).alias("chrm"), f(3).alias("strand"), n(4, 1).alias("beg"), n(5).alias("tend"), n(6, 1).alias("cds_beg"), n(7).alias("cds_end"), _pairs(f(9), f(10), 1).alias("exons"), F.upper(f(12)).alias("gene_name")), "UCSC")


def read_knowngene(spark: SparkSession, path: str, aliases: str | None = None, shift: int = 1) -> DataFrame:
    """UCSC knownGene, named by transcript, with the table of aliases; begins are 0-based (shift=0: taken as they are)."""
    f = lambda i: F.col("f")[i]
    n = lambda i, s=0: f(i).cast("bigint") + s
    t = _fields(spark, path, 10).select(f(0).alias("name"), F.upper(f(0)).alias("gene_name"), f(1).alias("chrm"), f(2).alias("strand"), n(3, shift).alias("beg"), n(4).alias("tend"), n(5, shift).alias("cds_beg"), n(6).alias("cds_end"), _pairs(f(8), f(9), shift).alias("exons"))
    if aliases:
        other = _fields(spark, aliases, 2).groupBy(f(0).alias("name")).agg(F.sort_array(F.collect_set(f(1))).alias("aliases"))
        t = t.join(other, "name", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return _table(t, "UCSC_knownGene")


def write_transcripts(t: DataFrame, path: str) -> None:
    """Parquet by chromosome, sorted by place within files, so that row groups can be skipped."""
    t.repartitionByRange("chrm", "beg").sortWithinPartitions("chrm", "beg", "tend", "name").write.partitionBy("chrm").parquet(path)


def write_by_gene(t: DataFrame, path: str) -> None:
    """Parquet in the order of genes, for by_gene."""
    t.repartitionByRange("gene_name").sortWithinPartitions("gene_name", "name").write.parquet(path)


def by_gene(spark: SparkSession, path: str, gene: str) -> DataFrame:
    """Transcripts of one gene from a table of write_by_gene; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("gene_name") == gene.upper())


def at_place(spark: SparkSession, path: str, chrm: str, beg: int, end: int) -> DataFrame:
    """Transcripts that overlap a place, from a table of write_transcripts; chrm picks the folder, the bounds reach the scan."""
    return spark.read.parquet(path).where((F.col("chrm") == chrm) & (F.col("beg") <= end) & (F.col("tend") >= beg))
