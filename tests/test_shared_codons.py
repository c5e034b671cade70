"""Codons of overlapping transcripts by arithmetic on segments, against a walk over bases; and how the frameshift search is dealt out."""

import random

from pyspark.sql import functions as F

from strandline.functions import coords
from strandline.operators import levels


def _transcript(tid, draw):
    at, exons = draw.randrange(1, 60), []
    for _ in range(draw.randrange(1, 4)):
        exons.append((at, at + draw.randrange(4, 20)))
        at = exons[-1][1] + draw.randrange(2, 12)
    strand = draw.choice("+-")
    places = [p for b, e in exons for p in range(b, e + 1)]
    return (tid, draw.randrange(2), strand, exons[0][0], exons[-1][1], exons, "A" * len(places)), places if strand == "+" else places[::-1]


def test_shared_codons(spark):
    draw = random.Random(7)
    made = [_transcript(i, draw) for i in range(30)]
    t = spark.createDataFrame([m[0] for m in made], "tid long, contig_id long, strand string, beg long, tend long, exons array<struct<beg:long,end:long>>, cds string")
    t = t.withColumn("segs", coords.segments(F.col("exons"), F.col("beg"), F.col("tend"), F.col("strand")))
    want = {}
    for a, x in made:
        for b, y in made:
            if a[0] != b[0] and a[1] == b[1]:
                for i, g in enumerate(x):
                    if g in y:
                        j = y.index(g)
                        if i // 3 != j // 3 and i // 3 < len(x) // 3 and j // 3 < len(y) // 3:
                            key = (a[0], b[0], i // 3 + 1, j // 3 + 1)
                            want[key] = min(want.get(key, g), g)
    got = {(r.tid1, r.tid2, r.codon1, r.codon2): r.gpos for r in levels.shared_codons(t).collect()}
    assert got == want and len(want) > 100


def test_frameshift_search_is_dealt_out(spark):
    """Pairs of one partition are searched in as many tasks as there are shuffle partitions, whatever their bytes."""
    cds = "ATGGCAGCCAAATCTACTTTATAA"
    row = spark.createDataFrame([(1, 1, "p.A3Qfs*2", cds, "", "+", 1)], "qid int, tid int, change string, cds string, tail string, strand string, contig_id int")
    x = row.withColumn("segs", F.array(F.struct(F.lit(1).cast("long").alias("gb"), F.lit(24).cast("long").alias("ge"), F.lit(0).cast("long").alias("cprev")))).coalesce(1)
    plan = levels.frameshift_candidates(x)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
