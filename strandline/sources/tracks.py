"""Readers of features, known variants, identifier maps, sequences and variant queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.hgvs import split_identifier

from .transcripts import _fields


def read_bed(spark: SparkSession, path: str, name: str = "bed") -> DataFrame:
    f = lambda i: F.col("f")[i]
    return _fields(spark, path, 4).select(F.lit(name).alias("source"), f(0).alias("chrom"), f(1).cast("bigint").alias("beg"), f(2).cast("bigint").alias("end"), f(3).alias("label"))


def read_gff_features(spark: SparkSession, path: str, name: str = "gff") -> DataFrame:
    f = lambda i: F.col("f")[i]
    return _fields(spark, path, 5).select(F.lit(name).alias("source"), f(0).alias("chrom"), f(3).cast("bigint").alias("beg"), f(4).cast("bigint").alias("end"), f(2).alias("label"))


def read_vcf_features(spark: SparkSession, path: str, name: str = "vcf") -> DataFrame:
    """The end is pos + length of REF; the label is ID|REF|ALT."""
    f = lambda i: F.col("f")[i]
    pos = f(1).cast("bigint")
    return _fields(spark, path, 5).select(F.lit(name).alias("source"), f(0).alias("chrom"), pos.alias("beg"), (pos + F.length(f(3))).alias("end"), F.concat_ws("|", f(2), f(3), f(4)).alias("label"))


def read_known_variants(spark: SparkSession, path: str) -> DataFrame:
    f = lambda i: F.col("f")[i]
    return _fields(spark, path, 5).select(f(0).alias("chrom"), f(1).cast("bigint").alias("pos"), f(2).alias("id"), f(3).alias("ref"), F.split(f(4), ",").alias("alts"))


def read_idmap(spark: SparkSession, path: str) -> DataFrame:
    """synonym, canonical: a row for each canonical name of a synonym, as lookup.cascade takes them."""
    f = lambda i: F.col("f")[i]
    return _fields(spark, path, 2).select(F.upper(f(0)).alias("synonym"), F.upper(f(1)).alias("canonical")).distinct()


def idmap_of(transcripts: DataFrame) -> DataFrame:
    """synonym, canonical of transcripts themselves: their aliases (proteins) and cross references, to their genes."""
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(F.split("gene_dbxref", ","), F.array().cast("array<string>")))
    x = transcripts.select(F.explode(names).alias("n"), F.upper("gene_name").alias("canonical"))
    return x.select(F.upper(F.regexp_replace(F.trim("n"), r"^\w+:(?=\S)", "")).alias("synonym"), "canonical").where("synonym <> ''").distinct()


def union_features(*tables: DataFrame) -> DataFrame:
    """Features of several sources as one table; each row tells its source."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def write_features(features: DataFrame, path: str) -> None:
    """Parquet in the order of chrom and beg, so that row groups can be skipped."""
    features.repartitionByRange("chrom", "beg").sortWithinPartitions("chrom", "beg").write.parquet(path)


def write_idmap(idmap: DataFrame, path: str) -> None:
    idmap.repartitionByRange("synonym").sortWithinPartitions("synonym").write.parquet(path)


def one_query(spark: SparkSession, text: str) -> DataFrame:
    """A single identifier (tok:change, or a bare tok) as a query: qid, input, tok, change, level."""
    return spark.createDataFrame([(0, text)], "qid bigint, input string").withColumn("s", split_identifier(F.col("input"))).select("qid", "input", "s.*")


def _pieces(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of FASTA splits to pieces of about `size` bases: split, record (0: begun in an earlier split), its name and the bases of it before."""
    fields = (("file", pa.string()), ("block", pa.int64()), ("record", pa.int64()), ("name", pa.string()), ("at", pa.int64()), ("bases", pa.string()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, record, name, at, parts, held = None, 0, None, 0, [], 0

        def cut() -> None:
            nonlocal at, held
            if parts or name is not None and at == 0:
                rows.append((*key, record, name, at, "".join(parts)))
            at, held = at + held, 0
            parts.clear()

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != key:
                    if key:
                        cut()
                    key, record, name, at = (file, block), 0, None, 0
                if line.startswith(">"):
                    cut()
                    record, name, at = record + 1, (line[1:].split() or [""])[0], 0
                elif line := line.strip().upper():
                    parts.append(line)
                    held += len(line)
                    if held >= size:
                        cut()
            if len(rows) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
                rows.clear()
        if key:
            cut()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return of


def read_fasta(spark: SparkSession, path: str, chunk: int = 1_000_000, overlap: int = 4096, before: int = 0) -> DataFrame:
    """chrom, chunk, beg, seq: upper-case sequence in chunks, chunk c from base c * chunk + 1 on, with overlap bases more and before bases ahead.

    Lines are read by split; a record that runs over splits is put together from
    running sums over a row for each record and split, so that no task holds a
    chromosome.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = lines.mapInArrow(_pieces(min(chunk, 1 << 20)), "file string, block bigint, record bigint, name string, at bigint, bases string")
    heads = pieces.groupBy("file", "block", "record").agg(F.max("name").alias("name"), F.sum(F.length("bases")).alias("n"))
    order = Window.partitionBy("file").orderBy("block", "record")
    heads = heads.withColumn("begun", F.count("name").over(order)).withColumn("chrom", F.last("name", True).over(order))
    earlier = Window.partitionBy("file", "begun").orderBy("block", "record").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("file", "block", "record", "chrom", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    x = pieces.join(heads, ["file", "block", "record"]).where("chrom is not null and bases <> ''").select("chrom", (F.col("base") + F.col("at") + 1).alias("b"), "bases").withColumn("e", F.col("b") + F.length("bases") - 1)
    # each piece gives its part to every chunk that shows it
    low, high = F.greatest(F.floor((F.col("b") - 1 - overlap) / chunk), F.lit(0)), F.floor((F.col("e") - 1 + before) / chunk)
    x = x.withColumn("chunk", F.explode(F.sequence(low, high)))
    first, last = F.greatest("b", F.col("chunk") * chunk + 1 - before), F.least("e", (F.col("chunk") + 1) * chunk + overlap)
    part = F.substr("bases", (first - F.col("b") + 1).cast("int"), (last - first + 1).cast("int"))
    x = x.where(first <= last).groupBy("chrom", "chunk").agg(F.sort_array(F.collect_list(F.struct(first.alias("b"), part.alias("s")))).alias("parts"), F.max(F.when(F.col("e") > F.col("chunk") * chunk, True)).alias("own"))
    return x.where("own").select("chrom", F.col("chunk").cast("int").alias("chunk"), F.col("parts")[0]["b"].alias("beg"), F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("seq"))


def fetch(spans: DataFrame, genome: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """spans (chrom, beg, end) with their bases, as far as the contig goes; a span may run over any number of chunks.

    A chromosome that the genome doesn't have is looked up with the prefix chr
    added, or taken off.
    """
    key = ["chrom", "beg", "end"]
    first = F.floor((F.greatest("beg", F.lit(1)) - 1) / chunk).cast("int")
    last = F.greatest(F.floor((F.col("end") - 1) / chunk).cast("int"), first)
    g = genome.select(F.regexp_replace("chrom", "^chr", "").alias("__bare"), F.col("chrom").alias("__chrom"), "chunk", F.col("beg").alias("__beg"), "seq")
    # chunks overlap: each gives what lies before the next one
    low, high = F.greatest("beg", F.col("chunk").cast("bigint") * chunk + 1), F.least(F.col("end"), (F.col("chunk").cast("bigint") + 1) * chunk)
    part = F.substr("seq", (low - F.col("__beg") + 1).cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))
    asked = spans.select(*key).distinct().where("beg is not null and end is not null").withColumn("__bare", F.regexp_replace("chrom", "^chr", ""))
    parts = asked.withColumn("chunk", F.explode(F.sequence(first, last))).join(g, ["__bare", "chunk"])
    named = parts.groupBy(*key, "__chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("part")))), lambda x: x["part"]), "").alias("bases"))
    # the name itself before the other form
    whole = named.groupBy(*key).agg(F.min_by("bases", (F.col("__chrom") != F.col("chrom")).cast("int")).alias("bases"))
    return spans.join(whole, key, "left").select(*spans.columns, "bases")


def line_place() -> Column:
    """Where a line of text stands: its file, the split of the file, and its number in that; lines of one scan are in this order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines (value, place) of a VCF, for records.write_vcf."""
    return spark.read.text(path).select("value", line_place().alias("place")).where(F.col("value").startswith("#"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ALT: line, place, alt_number, chrom, pos, id, ref, alt, kind, beg, end, bases.

    kind: SNV, DEL (also <DEL> with END=, from pos on), INS, MNV; the padding
    base of DEL and INS is taken off.  place and alt_number order rows as the
    file does.
    """
    lines = spark.read.text(path).select("value", line_place().alias("place")).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = lambda i: F.get("f", F.lit(i))
    rows = lines.withColumn("f", F.split("value", "\t")).where(F.size("f") >= 5)
    rows = rows.select(F.col("value").alias("line"), "place", f(0).alias("chrom"), f(1).try_cast("bigint").alias("pos"), f(2).alias("id"), F.upper(f(3)).alias("ref"), f(7).alias("info"), F.posexplode(F.split(f(4), ",")).alias("alt_number", "alt"))
    r, a, n = F.col("ref"), F.upper("alt"), F.length("ref")
    symbol = F.col("alt").startswith("<DEL")
    pad = (F.substr(r, F.lit(1), F.lit(1)) == F.substr(a, F.lit(1), F.lit(1)))
    kind = F.when(symbol, "DEL").when((n == 1) & (F.length(a) == 1), "SNV").when(pad & (F.length(a) == 1), "DEL").when(pad & (n == 1), "INS").otherwise("MNV")
    stop = F.regexp_extract("info", r"(?:^|;)END=(\d+)", 1).try_cast("bigint")
    x = rows.withColumn("alt", a).withColumn("kind", kind)
    beg = F.when((F.col("kind") == "DEL") & ~symbol, F.col("pos") + 1).otherwise(F.col("pos"))
    end = F.when(symbol, F.coalesce(stop, F.col("pos") + n - 1)).when(F.col("kind") == "INS", F.col("pos") + 1).otherwise(F.col("pos") + n - 1)
    bases = F.when(F.col("kind") == "DEL", F.when(symbol, "").otherwise(F.substr(r, F.lit(2)))).when(F.col("kind") == "INS", F.substr(a, F.lit(2))).otherwise(a)
    return x.select("line", "place", "alt_number", "chrom", "pos", "id", "ref", "alt", "kind", beg.alias("beg"), end.alias("end"), bases.alias("bases"))


def columns_of(spec: str, n: int) -> list[int]:
    """0-based columns of a selection like 3,4,7-9 or 5- of n columns."""
    out: list[int] = []
    for part in filter(None, spec.split(",")):
        low, dash, high = part.partition("-")
        out += range(int(low) - 1, int(high or n) if dash else int(low))
    return out


def read_list(spark: SparkSession, path: str, gene: int | None = None, position: int | None = None, ref: int | None = None, alt: int | None = None, mutation: int | None = None, transcript: int | None = None, keep: str = "", sep: str = "\t", skip_header: bool = False) -> DataFrame:
    """Variant tables: op (kept columns), tok, mutation, pos, ref, alt, tpt by 1-based column.

    A mutation column may hold tok:mutation; a position column with ref and alt
    makes an SNV's mutation.
    """
    lines = spark.read.option("header", skip_header).option("sep", sep).csv(path, inferSchema=False)
    c = lambda i: F.col(f"`{lines.columns[i - 1]}`") if i else F.lit(None).cast("string")
    both = c(mutation).contains(":") & F.lit(gene is None)
    tok = F.when(both, F.split_part(c(mutation), F.lit(":"), F.lit(1))).otherwise(c(gene) if gene else F.when(F.lit(position is None), c(mutation)))
    made = F.concat(F.lit("g."), c(position), F.coalesce(c(ref), F.lit("")), F.lit(">"), F.coalesce(c(alt), F.lit("")))
    change = F.when(both, F.substring_index(c(mutation), ":", -1)).otherwise(c(mutation) if mutation else made)
    kept = [c(i + 1) for i in columns_of(keep, len(lines.columns))]
    return lines.select(F.concat_ws("|", *kept).alias("op") if kept else F.lit("").alias("op"), tok.alias("tok"), change.alias("mutation"), c(position).cast("bigint").alias("pos"), c(ref).alias("ref"), c(alt).alias("alt"), c(transcript).alias("tpt"))
