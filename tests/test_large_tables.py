"""Steps that must grow no faster than their input: what they shuffle, evaluate and derive."""

import random

from pyspark.sql import functions as F

from strandline.operators import annotate, genome, haplotypes, intervals, levels
from strandline.plans import queries
from strandline.plans.fixture import Genome


def _plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_edits_stay_with_their_rows(spark):
    """Blocks aren't joined with their edits, and the runs found for a batch are those of each row."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACG") for _ in range(n))
    pairs = [(a, a[:2] + word(rng.randrange(3)) + a[3:]) for a in (word(rng.randrange(3, 20)) for _ in range(300))] + [("A", "C"), ("ACC", "ACC")]
    refs, alts = map(list, zip(*pairs, strict=True))
    cells = haplotypes.align(refs, alts)
    assert haplotypes.aligned_edits(refs, alts) == [haplotypes.edits(*p, c) for p, c in zip(pairs, cells, strict=True)]
    blocks = spark.createDataFrame([(i, 1, 100 * i, *p) for i, p in enumerate([*pairs, ("", "AC"), ("AC", "")])], "vid long, contig_id int, pos long, ref string, alt string")
    out = haplotypes.decomposed(blocks)
    assert "Exchange" not in _plan(out) and out.columns == blocks.columns
    told = haplotypes.with_edits(blocks)
    edit = F.transform("edits", lambda e: F.struct((F.col("pos") + e["at"]).alias("pos"), F.length(e["ref"]).alias("gone"), e["alt"].alias("alt")))
    assert told.where(haplotypes.rebuilt(F.col("ref"), F.col("pos"), edit) != F.col("alt")).isEmpty()
    assert {r.vid for r in out.collect()} == {i for i, p in enumerate([*pairs, ("", "AC"), ("AC", "")]) if p[0] != p[1]}


def test_lengths_are_enough(spark):
    """What needs no bases derives no sequences."""
    g = Genome(spark, "/root/testdata/sf0.001")
    queries.longest_tx_per_gene(g), queries.cds_overlap(g)
    assert not {"contigs", "chunks", "transcripts", "variants"} & set(vars(g))
    assert g.sizes.exceptAll(g.contigs.select("contig_id", F.length("seq").cast("bigint").alias("len"))).isEmpty()


def test_contained_meets_lists(spark):
    """Spans in one bin are shuffled once, with no windows; longer ones and crowded bins give the same."""
    rng = random.Random(7)
    f = [(f"g{i}", c, b, b + rng.randrange(60)) for i, (c, b) in enumerate((rng.choice("ab"), rng.choice([rng.randrange(400), rng.randrange(40)])) for _ in range(80))]
    spans = [(i, rng.choice("abc"), b, b + rng.choice([0, 5, 40, 300])) for i, b in enumerate(rng.randrange(420) for _ in range(150))]
    features = spark.createDataFrame(f, "name string, contig string, fb long, fe long")
    x = spark.createDataFrame(spans, "vid int, contig string, beg long, end long")
    args = (x, features, "contig", ("beg", "end"), ("fb", "fe"), "name")
    near = intervals.contained(*args)
    assert "Window" not in _plan(near) and _plan(near).count("Exchange hashpartitioning") <= 3
    for got in (near, intervals.contained(*args, width=90, near=64, crowd=6)):
        assert got.columns == ["vid", "contig", "beg", "end", "n_inside", "inside"]
        for r in got.collect():
            names = [n for _, n in sorted((b, n) for n, c, b, e in f if c == r.contig and b >= r.beg and e <= r.end)]
            assert (r.n_inside, r.inside) == (len(names), names if len(names) <= 5 else None)
        assert got.count() == len(spans)


def test_spans_meet_lists(spark):
    """Pairs of spans and features, and regions by their ends, need no bases and are the same by lists, over bins and in crowded bins; duplicates of names count."""
    rng = random.Random(11)
    f = [(i, rng.choice("ab"), b, b + rng.randrange(60)) for i, b in enumerate(rng.randrange(400) for _ in range(90))]
    spans = [(i, rng.choice("abc"), b, b + rng.choice([0, 5, 40, 300])) for i, b in enumerate(rng.randrange(420) for _ in range(120))]
    t = spark.createDataFrame(f, "tid long, contig_id string, beg long, tend long")
    x = spark.createDataFrame(spans, "vid long, contig_id string, pos long, till long")
    want = sorted((v, i) for v, c, b, e in spans for i, d, fb, fe in f if c == d and fb <= e and fe >= b)
    over = lambda c, p: [i for i, d, fb, fe in f if c == d and fb <= p <= fe] or [None]
    ends = sorted(((v, i, j, sum(c == d and fb >= b and fe <= e for _, d, fb, fe in f)) for v, c, b, e in spans for i in over(c, b) for j in over(c, e)), key=str)
    for at in ({}, {"near": 64, "crowd": 6}, {"near": 64}):
        pairs = intervals.pairs_by_lists(x, t, "contig_id", ("pos", "till"), ("beg", "tend"), **at)
        assert sorted((r.vid, r.tid) for r in pairs.collect()) == want
        assert sorted((tuple(r) for r in levels.long_regions(x, t, **at).collect()), key=str) == ends
    g = Genome(spark, "/root/testdata/sf0.001")
    queries.span_tx_overlap(g), queries.long_region_endpoints(g)
    assert not {"contigs", "chunks", "transcripts", "variants"} & set(vars(g))


def test_bases_are_met_once(spark):
    """Queries of bases around variants keep no tables of the genome, and an insertion's window serves its shift and what lies before it."""
    g = Genome(spark, "/root/testdata/sf0.001")
    queries.ins_dup_detect(g), queries.dbsnp_indel(g), queries.mnv_coding(g), queries.variant_protein(g)
    assert not {"contigs", "chunks", "transcripts", "variants"} & set(vars(g))
    seq = "ACGT" * 20 + "A" * 90 + "CGCGCGT" * 9
    chunks = genome.chunks(spark.createDataFrame([("c", seq)], "contig_id string, seq string"))
    puts = [("c", p, ins) for p in (1, 2, 7, 60, 82, 100, 169, 170, 180, 228) for ins in ("A", "CG", "ACG", seq[p : p + 2])]
    x = spark.createDataFrame(puts, "contig_id string, pos long, ins string")
    plain = {tuple(r) for r in annotate.align_insertions(x, chunks).collect()}
    window = genome.bases_at(x, chunks, __fore=(1, 64), __back=(-63, 64))
    got = annotate.align_insertions(window, chunks, before=3).collect()
    assert {(r.contig_id, r.pos, r.ins, r.right) for r in got} == plain and any(r.right > 64 for r in got)
    assert all(r.before == seq[max(r.pos + r.right - 3, 0) : r.pos + r.right] for r in got)
