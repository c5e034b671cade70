"""Transcripts of queries by gene name, transcript name or other identifiers, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType


def cascade(queries: DataFrame, transcripts: DataFrame, idmap: DataFrame, strict_version: bool = False) -> DataFrame:
    """queries (qid, tok) with the transcripts (source, gene_name, name, version) of the first way that finds any, in each source.

    1: the gene's name; 2: the transcript's, without version, or with an equal
    one if strict_version; 3: idmap (synonym, and canonical, one name or a list of
    them) to a gene's name.  Upper and lower case are alike in tok and in all names.
    """
    q = queries.withColumn("tok", F.upper("tok")).withColumn("__base", F.regexp_extract("tok", r"^(.*?)(\.\d+)?$", 1)).withColumn("__version", F.regexp_extract("tok", r"\.(\d+)$", 1).try_cast("int"))
    t = transcripts.select("source", "gene_name", "name", "version")
    other = F.explode("canonical") if isinstance(idmap.schema["canonical"].dataType, ArrayType) else F.col("canonical")
    known = idmap.select(F.upper("synonym").alias("__synonym"), other.alias("__canonical")).withColumn("__canonical", F.upper("__canonical")).distinct()
    by_gene = q.join(t, F.col("tok") == F.upper("gene_name")).withColumn("way", F.lit(1))
    same = F.col("__version").isNull() | (F.col("__version") == F.col("version")) if strict_version else F.lit(True)
    by_name = q.join(t, F.col("__base") == F.upper("name")).where(same).withColumn("way", F.lit(2))
    by_other = q.join(known, F.col("tok") == F.col("__synonym")).join(t, F.col("__canonical") == F.upper("gene_name")).drop("__synonym", "__canonical").withColumn("way", F.lit(3))
    found = by_gene.unionByName(by_name).unionByName(by_other).drop("__base", "__version")
    first = F.min("way").over(Window.partitionBy("qid", "source"))
    return found.withColumn("__first", first).where("way = __first").drop("__first")
