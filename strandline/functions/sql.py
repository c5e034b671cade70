"""The sequence functions for SQL texts: registered as SQL functions, so that they are as native as the columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sequence import STANDARD_CODE, _CODONS


def register(spark: SparkSession) -> None:
    """revcomp(s), codon2aa(codon) and translate_cds(s), up to and with the first stop, for this session."""
    aa = "nullif(substr('{code}', ((instr('{codons}', concat(' ', {c})) + 3) div 4), if(length({c}) = 3 and instr('{codons}', concat(' ', {c})) > 0, 1, 0)), '')"
    one = lambda c: aa.format(code=STANDARD_CODE, codons=_CODONS, c=c)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTN', 'TGCAN'))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION codon2aa(codon STRING) RETURNS STRING RETURN {one('codon')}")
    whole = f"array_join(transform(sequence(1, greatest(length(s) - 2, 1), 3), i -> coalesce({one('substr(s, i, 3)')}, 'X')), '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION translate_cds(s STRING) RETURNS STRING RETURN if(length(s) < 3, '', regexp_extract({whole}, '^[^*]*[*]?', 0))")
