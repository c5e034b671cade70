"""The region driver, counts, policies, haplotypes and reading on, against step-by-step versions; and records between and across genes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import coords
from strandline.operators import annotate, frontier, genes, genome, haplotypes, intervals, records, regions
from strandline.plans import annotator
from strandline.sources import tracks

EXONS = "array<struct<beg:bigint,end:bigint>>"


@pytest.fixture(scope="module")
def crowd(spark):
    """Transcripts of genes on two contigs, as tuples and as a table."""
    rng = random.Random(3)
    rows = []
    for tid in range(60):
        beg = rng.randrange(50, 4000)
        rows.append((tid, ["c1", "c2"][tid % 3 == 0], beg, beg + rng.choice([5, 60, 300, 900]), f"G{rng.randrange(25)}", rng.choice("+-")))
    t = spark.createDataFrame(rows, "tid bigint, contig_id string, beg bigint, tend bigint, gene_name string, strand string")
    t = t.withColumns({"name": F.concat(F.lit("T"), F.col("tid").cast("string")), "version": F.lit(1), "transcript_type": F.lit("lincRNA"), "exons": F.array(F.struct("beg", F.col("tend").alias("end"))).cast(EXONS), "segs": F.array().cast(coords.SEGMENTS), "cds_beg": F.lit(None).cast("bigint"), "cds_end": F.lit(None).cast("bigint"), "source": F.lit("S")})
    return rows, t.persist()


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(8)
    out = []
    for vid in range(150):
        pos = rng.randrange(1, 4900)
        out.append((vid, rng.choice(["c1", "c2"]), pos, min(pos + rng.choice([0, 0, 3, 40, 200, 1000, 4000]), 5000)))
    return out


def hits(rows, contig, beg, end):
    return [r for r in rows if r[1] == contig and r[2] <= end and r[3] >= beg]


def sides(rows, contig, low, high, size=5000):
    up = min((r for r in rows if r[1] == contig and r[3] < low), key=lambda r: (-r[3], r[2], r[0]), default=None)
    down = min((r for r in rows if r[1] == contig and r[2] > high), key=lambda r: (r[2], r[2], r[0]), default=None)
    before = f"{up[4]}({low - up[3]}_bp_{'downstream' if up[5] == '+' else 'upstream'})" if up else f"5'-telomere({low}_bp)"
    after = f"{down[4]}({down[2] - high}_bp_{'downstream' if down[5] == '-' else 'upstream'})" if down else f"3'-telomere({size - high}_bp)"
    return before, after, up, down


def gene_places(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2] - r[3], r[0])):
        out.setdefault((r[1], r[4]), (r[2], r[3]))
    return out


def brute(rows, span):
    """way, and a set of (tid, region) of a span."""
    vid, contig, pos, till = span
    met = hits(rows, contig, pos, till)
    inside = sorted((b, g) for (c, g), (b, e) in gene_places(rows).items() if c == contig and b >= pos and e <= till)
    more = "" if not inside else f"_spanning_[{','.join(g for _, g in inside)}]" if len(inside) <= 5 else f"_spanning_[{len(inside)}_genes]"
    between = lambda low, high: "intergenic_between_%s_and_%s" % sides(rows, contig, low, high)[:2]
    if not met:
        return "between", {(None, f"inside_[{between(pos, till)}]")}
    if pos == till:
        return "near", {(r[0], "inside_[noncoding_exon_1]") for r in met}
    if max(r[2] for r in met) < min(r[3] for r in met):
        out = set()
        for r in met:
            before, after, _, _ = sides(rows, contig, pos, till)
            a = "noncoding_exon_1" if pos >= r[2] else f"intergenic_between_{before}_and_{r[4]}({r[2] - pos}_bp_{'downstream' if r[5] == '-' else 'upstream'})"
            b = "noncoding_exon_1" if till <= r[3] else f"intergenic_between_{r[4]}({till - r[3]}_bp_{'downstream' if r[5] == '+' else 'upstream'})_and_{after}"
            out.add((r[0], f"inside_[{a}]" if a == b else f"from_[{a}]_to_[{b}]{more}"))
        return "near", out
    ends = [[("noncoding_exon_1", r[4], r[0]) for r in hits(rows, contig, at, at)] or [(between(at, at), None, None)] for at in (pos, till)]
    out = []
    for a in ends[0]:
        for b in ends[1]:
            named = lambda x: x[0] + (f";{x[1]}" if x[1] else "")
            same = a[2] is not None and a[2] == b[2]
            text = f"inside_[{a[0]}]" if a[0] == b[0] and (same or a[2] is None or b[2] is None) else f"from_[{a[0]}]_to_[{b[0]}]{more}" if same else f"from_[{named(a)}]_to_[{named(b)}]{more}"
            out.append((f"{a[1] or ''}/{b[1] or ''}", text))
    return "wide", set(out)


@pytest.mark.parametrize("width", [97, 100_000])
def test_driver(spark, crowd, spans, width):
    rows, t = crowd
    s = spark.createDataFrame(spans, "vid bigint, contig_id string, pos bigint, till bigint")
    sizes = spark.createDataFrame([("c1", 5000), ("c2", 5000)], "contig_id string, len bigint")
    told = regions.told(s, t, sizes, width)
    got = {}
    x = records.placed(told.pairs, F.col("pos"), F.col("till"))
    text = records.between_text(x, F.get("__sites", F.lit(0)), F.get("__sites", F.lit(1)), F.get("__c", F.lit(0)), F.get("__c", F.lit(1)))
    for r in x.select("vid", "tid", text.alias("region")).collect():
        got.setdefault(r["vid"], ("near", set()))[1].add((r["tid"], r["region"]))
    for r in told.between.collect():
        got[r["vid"]] = ("between", {(None, r["region"])})
    for r in told.wide.collect():
        got.setdefault(r["vid"], ("wide", set()))[1].add((r["region"],))
        assert r["label"] == "Unclassified" and (r["gene"] is None) == (r["transcript"] is None)
    want = {s[0]: brute(rows, s) for s in spans}
    want = {v: (w, {(r,) for _, r in x} if w == "wide" else x) for v, (w, x) in want.items()}
    assert {w for w, _ in want.values()} == {"near", "wide", "between"}
    assert got == want


@pytest.mark.parametrize("width", [97, 100_000])
def test_contained_and_ranked(spark, crowd, spans, width):
    rows, t = crowd
    s = spark.createDataFrame(spans, "vid bigint, contig_id string, pos bigint, till bigint")
    got = {r["vid"]: (r["n_inside"], r["inside"]) for r in intervals.contained(s, t, "contig_id", ("pos", "till"), ("beg", "tend"), "tid", 3, width).collect()}
    for vid, contig, pos, till in spans:
        inside = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[1] == contig and r[2] >= pos and r[3] <= till]
        assert got[vid] == (len(inside), inside if len(inside) <= 3 else None)
    for contig in ("c1", "c2"):
        mine = sorted((r[3], r[0]) for r in rows if r[1] == contig)
        assert [r["tid"] for r in intervals.ranked(t, "contig_id", "tend", "tid", width).where(F.col("contig_id") == contig).orderBy("rank").collect()] == [i for _, i in mine]


def test_genes(crowd):
    rows, t = crowd
    table = {(r["contig_id"], r["gene_name"]): r for r in genes.gene_table(t).collect()}
    for key, (beg, end) in gene_places(rows).items():
        assert (table[key]["beg"], table[key]["tend"]) == (beg, end) and table[key]["longest_coding"] is None
    pairs = t.withColumn("vid", F.lit(1))
    assert sorted(r["tid"] for r in genes.longest_only(pairs).collect()) == sorted(r["longest"] for r in table.values())


@pytest.mark.parametrize("strand", ["+", "-"])
def test_intron_policies_by_walking(spark, strand):
    exons = [(11, 16), (24, 24), (30, 41)]
    bases = [p for b, e in exons for p in range(b, e + 1)]
    bases = bases if strand == "+" else bases[::-1]
    t = spark.range(1).select(F.lit(strand).alias("strand"), F.array(*(F.struct(F.lit(b).cast("bigint").alias("beg"), F.lit(e).cast("bigint").alias("end")) for b, e in exons)).alias("exons"))
    t = t.withColumn("segs", coords.segments(F.col("exons"), F.lit(11), F.lit(41), F.col("strand"))).withColumn("pos", F.explode(F.sequence(F.lit(11), F.lit(41))))
    t = t.select("pos", *(coords.cdna(F.col("pos"), F.col("segs"), F.col("strand"), p).alias(p) for p in coords.POLICIES))
    for r in t.collect():
        for policy in coords.POLICIES:
            if r["pos"] in bases:
                assert tuple(r[policy]) == (bases.index(r["pos"]) + 1, 0)
                continue
            step = 1 if strand == "+" else -1
            before = max(i for i, b in enumerate(bases) if (b - r["pos"]) * step < 0)
            low, high = (before + 1, (r["pos"] - bases[before]) * step), (before + 2, (r["pos"] - bases[before + 1]) * step)
            ends = {"closer": low if low[1] < -high[1] else high, "c_smaller": low, "c_greater": high, "g_smaller": low if strand == "+" else high, "g_greater": high if strand == "+" else low}
            assert tuple(r[policy]) == ends[policy], (r["pos"], policy)
    with pytest.raises(ValueError, match="policy"):
        coords.cdna(F.col("pos"), F.col("segs"), F.col("strand"), "nearest")


def walk(a, b):
    """Best score of a local alignment with affine gaps, cell by cell, and the scores of all cells."""
    m, n = len(a), len(b)
    low = -(10**6)
    h, e, f = ([[x] * (n + 1) for _ in range(m + 1)] for x in (0, low, low))
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(h[i][j - 1] + haplotypes.OPEN, e[i][j - 1] + haplotypes.EXTEND)
            f[i][j] = max(h[i - 1][j] + haplotypes.OPEN, f[i - 1][j] + haplotypes.EXTEND)
            h[i][j] = max(0, h[i - 1][j - 1] + (haplotypes.MATCH if a[i - 1] == b[j - 1] else haplotypes.MISMATCH), e[i][j], f[i][j])
    return max(max(row) for row in h)


def worth(a, b, cells):
    path, score, last = cells[::-1], 0, None
    for (i, j), (p, q) in zip(path, path[1:], strict=False):
        kind = (p - i, q - j)
        score += (haplotypes.MATCH if a[i] == b[j] else haplotypes.MISMATCH) if kind == (1, 1) else haplotypes.EXTEND if kind == last else haplotypes.OPEN
        last = kind
    return score


def test_alignments_cell_by_cell():
    rng = random.Random(5)
    pairs = [("GGGCGTACCCTGGAG", "GTGCGATACCCAGGAG"), ("A", "C"), ("ACGT", "ACGT"), ("AAAA", "TTTTTT")]
    for _ in range(120):
        a = "".join(rng.choices("ACGT", k=rng.randrange(1, 40)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(4)] = rng.choices("ACGT", k=rng.randrange(4))
        pairs.append((a, "".join(b) or "G"))
    for (a, b), cells in zip(pairs, haplotypes.align(*map(list, zip(*pairs, strict=True))), strict=True):
        assert worth(a, b, cells) == walk(a, b)
        made, upto = "", 0
        for at, old, new in haplotypes.edits(a, b, cells):
            assert at >= upto and a[at : at + len(old)] == old and old != new
            made, upto = made + a[upto:at] + new, at + len(old)
        assert made + a[upto:] == b
    assert haplotypes.edits(*pairs[0], haplotypes.align([pairs[0][0]], [pairs[0][1]])[0]) in ([(1, "G", "T"), (5, "", "A"), (10, "T", "A")], [(0, "GG", "GT"), (5, "", "A"), (10, "T", "A")])


@pytest.fixture(scope="module")
def far(spark):
    """A repeat of 40,000 bases and, on another contig, 310,000 bases without a stop in one frame."""
    contigs = [("r", "G" * 1500 + "ACT" * 13_400 + "GG" + "A" * 700), ("o", "ATGGCTTAA" + "GCC" * 103_400 + "TAAATAAATAAA"), ("m", "TTATTTATTTAT" + "GGC" * 900 + "TTAAGCCAT"), ("e", "ATGGCTTAAGCCGCC")]
    return {n: s for n, s in contigs}, genome.chunks(spark.createDataFrame(contigs, "contig_id string, seq string")).persist()


def test_rolls_beyond_every_window(spark, far):
    seqs, chunks = far
    s = seqs["r"]
    cuts = [("r", 1501, 1503), ("r", 20_000, 20_005), ("r", 1, 1), ("r", 1500, 1500), ("r", len(s), len(s)), ("r", 41_000, 41_060), ("r", 5, 200), ("r", 1501, 1501)]
    rows = spark.createDataFrame(cuts, "contig_id string, pos bigint, till bigint")
    for r in annotate.align_deletions(rows, chunks).collect():
        b, e = r["pos"], r["till"]
        right = next((k for k in range(len(s)) if e + k >= len(s) or s[b - 1 + k] != s[e + k]))
        left = next((k for k in range(len(s)) if b - 2 - k < 0 or s[e - 1 - k] != s[b - 2 - k]))
        assert (r["right"], r["left"]) == (right, left), (b, e)
    puts = [("r", 1500, "ACT"), ("r", 20_000, s[20_000:20_003]), ("r", 3, "T"), ("r", 1503, "ACT" * 30), ("r", 1503, "ACT" * 30 + "A"), ("r", len(s), "AAA")]
    for r in annotate.align_insertions(spark.createDataFrame(puts, "contig_id string, pos bigint, ins string"), chunks, left=True).collect():
        at, ins = r["pos"], r["ins"]
        tail, head = s[at:], s[:at][::-1]
        right = next(k for k in range(len(s) + 1) if k >= len(tail) or (ins + tail)[k] != tail[k])
        left = next(k for k in range(len(s) + 1) if k >= len(head) or (ins[::-1] + head)[k] != head[k])
        assert (r["right"], r["left"]) == (right, left), (at, len(ins))


def test_frames_open_for_long(spark, far):
    _, chunks = far
    t = spark.createDataFrame([(1, "o", "+", 1, 9), (2, "m", "-", 2713, 2721), (3, "e", "+", 1, 9), (4, "e", "+", 1, 15)], "tid bigint, contig_id string, strand string, cds_beg bigint, cds_end bigint")
    got = {r["tid"]: r["tail"] for r in frontier.tails(t, chunks, start=64).collect()}
    assert got[1].startswith("GCCGCC") and len(got[1]) == 3 * 103_400 + 11 and got[1].endswith("TAAATAAATAA")
    assert got[2] == "GCC" * 900 + "ATAAATAAATAA" and got[3] == "GCCGCC" and got[4] == ""


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    """Records of changes between, over and across three genes, of a haplotype, and of a VCF."""
    folder = tmp_path_factory.mktemp("told")
    rng = random.Random(12)
    seq = list("".join(rng.choices("ACGT", k=6000)))
    seq[99:109] = "TGGGGGGGGA"
    seq[500:503] = "ATG"
    seq[2000:2015] = "GGGCGTACCCTGGAG"
    seq = "".join(seq)
    (folder / "g.fa").write_text(">7\n" + "\n".join(seq[i : i + 70] for i in range(0, 6000, 70)) + "\n")
    chunks = annotator.read_genome(spark, str(folder / "g.fa"))
    rows = [("A", 501, 800, "+"), ("B", 1501, 1700, "-"), ("C", 2501, 2800, "+"), ("D", 3001, 3100, "+")]
    t = spark.createDataFrame(rows, "gene_name string, beg bigint, end bigint, strand string")
    t = t.withColumns({"name": F.concat(F.lit("N"), "gene_name"), "version": F.lit(1), "transcript_type": F.when(F.col("gene_name") == "D", "lincRNA").otherwise("protein_coding"), "source": F.lit("S"), "chrm": F.lit("chr7"), "exons": F.array(F.struct("beg", "end")).cast(EXONS), "cds_beg": F.col("beg"), "cds_end": F.col("end"), "aliases": F.array().cast("array<string>"), "gene_dbxref": F.lit(None).cast("string"), "tend": F.col("end")}).drop("end")
    t = annotator.prepare(t, chunks)
    known = spark.createDataFrame([("chr7", 50, seq[49], ["A", "C", "G", "T"], "rs1"), ("chr7", 50, seq[49], ["A"], "rs0"), ("chr7", 99, seq[98:101], [seq[98]], "rs2"), ("chr7", 101, "G", ["T"], "rs3")], "contig_id string, pos bigint, ref string, alts array<string>, id string")
    other = next(b for b in "ACGT" if b != seq[49])
    swap = "7:g.300_1600delins" + next(b for b in "ACGT" if b not in (seq[299], seq[1599]))
    lines = [f"7:g.50{seq[49]}>{other}", "7:g.100_101del", "7:g.101_102delGG", "7:g.103_104delAA", "7:g.104dup", "7:g.60_62delinsTTTTTTT", "7:g.61delinsTTTT", "7:g.3", "7:g.5990_9999", "7:g.700_3050", "7:g.700_2900", "7:g.900_1600del", "7:g.700_1600del", swap, "7:g.790_900", "9:g.5A>T", "7:g.450_460", "7:g.2801_3000", "7:g.7000A>T", "7:g.1550"]
    q = annotator.read_queries(spark.createDataFrame([(x,) for x in lines], "value string"))
    out = {}
    for r in annotator.genomic_records(q, t, chunks, known=known).collect():
        out.setdefault(r["input"], []).append(r)
    hap = "7:g.2001_2015delinsGTGCGATACCCAGGAG"
    vcf = ["##fileformat=VCFv4.1", "##z=1", "##a=2", "#CHROM\tPOS\tID\tREF\tALT", f"7\t3050\t.\t{seq[3049]}\tTTTT", f"7\t60\t.\t{seq[59]}\t<DEL>\t.\t.\tEND=70", f"7\t510\trs9\t{seq[509]}\t{'A' if seq[509] != 'A' else 'C'},{'G' if seq[509] != 'G' else 'T'}", f"7\t9\t.\t{seq[8:10]}\t{seq[8]}"]
    (folder / "v.vcf").write_text("\n".join(vcf) + "\n")
    annotator.annotate_vcf(spark, str(folder / "v.vcf"), t, chunks, str(folder / "out"))
    written = "".join(f.read_text() for f in sorted((folder / "out").glob("part-*"))).splitlines()
    split = annotator.genomic_records(annotator.read_queries(spark.createDataFrame([(hap,)], "value string")), t, chunks, haplotype=True).collect()
    return seq, out, vcf, written, split


def one(out, key):
    (r,) = out[key]
    return r["transcript"], r["coordinates"], r["region"], r["info"]


def test_records_between_genes(told):
    seq, out, *_ = told
    lone = "inside_[intergenic_between_5'-telomere({}_bp)_and_A({}_bp_upstream)]"
    snv = next(k for k in out if k.startswith("7:g.50"))
    alt = snv[-1]
    both = "dbsnp=" + ",".join(f"{i}(chr7:50{seq[49]}>{alt})" for i in ("rs0", "rs1") if i == "rs1" or alt == "A")
    assert one(out, snv) == (".", f"chr7:g.50{seq[49]}>{alt}/./.", lone.format(50, 451), f"CSQN=IntergenicSNV;{both}")
    r = one(out, "7:g.100_101del")
    assert r[1].startswith("chr7:g.100_101delTG/./.") and r[3] == f"CSQN=IntergenicDeletion;dbsnp=rs2(chr7:99{seq[98:101]}>{seq[98]});left_align_gDNA=g.100_101delTG;unaligned_gDNA=g.100_101delTG"
    assert one(out, "7:g.101_102delGG")[1::2] == ("chr7:g.107_108delGG/./.", "CSQN=IntergenicDeletion;left_align_gDNA=g.101_102delGG;unaligned_gDNA=g.101_102delGG")
    assert one(out, "7:g.103_104delAA")[3].startswith("CSQN=IntergenicDeletion;invalid_deletion_seq_GG_(expect_AA);left_align_gDNA=")
    assert one(out, "7:g.104dup")[1::2] == ("chr7:g.108dupG/./.", "CSQN=IntergenicInsertion;left_align_gDNA=g.100_101insG;unalign_gDNA=g.104dupG")
    assert one(out, "7:g.60_62delinsTTTTTTT")[3].startswith("CSQN=Intergenic") and one(out, "7:g.61delinsTTTT")[3].startswith("CSQN=")
    assert one(out, "7:g.3") == (".", "chr7:g.3>/./.", lone.format(3, 498), "promoter_region_of_[A]")
    assert one(out, "7:g.450_460") == (".", "chr7:g.450_460/./.", lone.format(450, 41), "promoter_region_of_[A]_overlaping_11_bp(100.00%)")
    assert one(out, "7:g.5990_9999") == (".", "chr7:g.5990_6000/./.", "inside_[intergenic_between_D(2890_bp_downstream)_and_3'-telomere(0_bp)]", ".")
    assert one(out, "7:g.2801_3000") == (".", "chr7:g.2801_3000/./.", "inside_[intergenic_between_C(1_bp_downstream)_and_D(1_bp_upstream)]", "promoter_region_of_[D]_overlaping_200_bp(100.00%)")
    assert one(out, "9:g.5A>T")[3] == one(out, "7:g.7000A>T")[3] == "no_valid_transcript_found"


def test_records_across_genes(told):
    _, out, *_ = told
    assert one(out, "7:g.700_3050") == ("NA.1 (protein_coding),ND.1 (lincRNA)", "chr7:g.700_3050/./.", "from_[cds_in_exon_1;A]_to_[noncoding_exon_1;D]_spanning_[B,C]", ".")
    r = out["7:g.700_2900"][0]
    assert (r["transcript"], r["gene"], r["strand"]) == ("NA.1 (protein_coding),", "A,", "+") and r["region"] == "from_[cds_in_exon_1;A]_to_[intergenic_between_C(100_bp_downstream)_and_D(101_bp_upstream)]_spanning_[B,C]"
    t, c, region, info = one(out, "7:g.700_1600del")
    assert t == "." and c == "chr7:g.700_1600del901/./." and region == "from_[cds_in_exon_1;A]_to_[cds_in_exon_1;B]" and info.startswith("CSQN=UnclassifiedDeletion;left_align_gDNA=g.")
    t, c, region, info = one(out, "7:g.900_1600del")
    assert t == "NB.1 (protein_coding)" and region == "from_[intergenic_between_A(100_bp_downstream)_and_B(601_bp_downstream)]_to_[cds_in_exon_1]"
    t, c, region, info = one(out, next(k for k in out if k.startswith("7:g.300_1600delins")))
    assert t == "NB" and info == "CSQN=UnclassifiedBlockSubstitution" and region.startswith("from_[intergenic_between_5'-telomere(300_bp)_and_A(201_bp_upstream)]_to_[cds_in_exon_1;B]_spanning_[A]")
    r = one(out, "7:g.790_900")
    assert r[0] == "NA.1 (protein_coding)" and r[2] == "from_[cds_in_exon_1]_to_[intergenic_between_A(100_bp_downstream)_and_B(601_bp_downstream)]"
    assert one(out, "7:g.1550")[0] == "NB.1 (protein_coding)"


def test_haplotype_records(told):
    split = told[4]
    assert sorted(r["coordinates"] for r in split) == ["chr7:g.2002G>T/./.", "chr7:g.2005_2006insA/./.", "chr7:g.2011T>A/./."] and len({r["vid"] for r in split}) == 1


def test_vcf_in_its_own_order(told):
    _, _, vcf, written, _ = told
    assert written[:3] == vcf[:3] and written[3].startswith(vcf[3] + "\ttranscript\t")
    body = written[4:]
    assert [next(i for i, line in enumerate(vcf) if w.startswith(line + "\t")) for w in body] == [4, 5, 6, 6, 7]
    assert "CSQN=IntergenicDeletion" in body[1] and "g.60_70del" in body[1] and "\tNA.1 (protein_coding)\t" in body[2] and np.all([w.count("\t") >= 10 for w in body])
    assert tracks.line_place is not None


def test_coded_forms(spark):
    from strandline.functions import hgvs

    rows = spark.createDataFrame([("g.10del1insA", "10AC>GT"), ("10.A>T", "c.10AC>GT"), ("g.10delCinsA", "10_12AC>GT"), ("g.10_12delinsA", "c.10+1delA")], "g string, c string")
    got = [(tuple(r["x"]), tuple(r["y"])) for r in rows.select(hgvs.parse_genomic(F.col("g")).alias("x"), hgvs.parse_coding(F.col("c")).alias("y")).collect()]
    assert [x for x, _ in got] == [("SNV", "10", "10", "", "A"), ("SNV", "10", "10", "A", "T"), ("SNV", "10", "10", "C", "A"), ("MNV", "10", "12", "", "A")]
    assert [y for _, y in got] == [("MNV", "10", "10", "AC", "GT"), ("MNV", "10", "10", "AC", "GT"), ("MNV", "10", "12", "AC", "GT"), ("DEL", "10+1", "10+1", "A", "")]


def test_stored_bins_are_not_shuffled(spark, crowd, spans, tmp_path):
    _, t = crowd
    s = spark.createDataFrame(spans, "vid bigint, contig_id string, pos bigint, till bigint")
    index = intervals.stored_bins(t, "contig_id", ("beg", "tend"), "crowd_bins", 500, path=str(tmp_path / "bins"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = intervals.range_join(s, index, "contig_id", ("pos", "till"), ("beg", "tend"), 500)
        plain = intervals.range_join(s, t, "contig_id", ("pos", "till"), ("beg", "tend"), 500)
        shuffles = [d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(contig_id") for d in (joined, plain)]
        assert shuffles == [1, 2]
        assert sorted(map(tuple, joined.select("vid", "tid").collect())) == sorted(map(tuple, plain.select("vid", "tid").collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE crowd_bins")


def test_driver_by_lists(spark, crowd, spans):
    """Spans within a bin meet its list once; over bins, in crowded bins, without a place or by joins alone they are told the same."""
    rows, t = crowd
    s = spark.createDataFrame([*spans, (900, "c9", 5, 9), (901, None, 5, 9), (902, "c1", 6000, 6000), (903, "c2", 6000, 7000)], "vid bigint, contig_id string, pos bigint, till bigint")
    sizes = spark.createDataFrame([("c1", 5000), ("c2", 5000)], "contig_id string, len bigint")
    point = s.where("pos = till")
    pick = lambda told: [sorted(map(str, x.collect())) for x in (told.pairs.select("vid", "tid", "name", "segs", "outside_beg", "outside_end", "spanning"), told.wide, told.between)]
    want, places = pick(regions.told_by_joins(s, t, sizes)), pick(regions.told_by_joins(point, t, sizes, ranges=False))
    assert pick(regions.told(s, t, sizes, near=1000, crowd=12)) == want
    assert pick(regions.told(point, t, sizes, ranges=False)) == places
    near, far = regions.told_by_lists(s, t, sizes)
    assert sorted(r.vid for r in far.collect()) == [901]
    assert "vid" not in str([line for line in near.pairs._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in line])
