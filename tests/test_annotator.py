"""End to end, from files to text records; the lines are documented ones, on small references that hold the same bases."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals, levels, records
from strandline.plans import annotator
from strandline.sources import tracks, transcripts


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """chr3: a + transcript with codon 545 GAG, split by an intron after c.1664; chr12: a - transcript with GGGGGG at c.667 to c.672."""
    folder = tmp_path_factory.mktemp("world")
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cds = "ATG" + "GCT" * 543 + "GAG" + "GCT" * 54 + "TAA"
    one = "T" * 100 + cds[:1664] + "GT" + "C" * 96 + "AG" + cds[1664:] + "T" * 200
    other = "ATG" + "GCT" * 221 + "GGGGGG" + "ACA" * 75 + "TAA"
    two = "A" * 100 + flip(other) + "A" * 150
    (folder / "g.fa").write_text("".join(f">{n}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in (("3", one), ("12", two))))
    a = lambda g, t: f'gene_id "{g}"; gene_name "{g}"; transcript_id "{t}.1"; transcript_biotype "protein_coding";'
    rows = [("3", "exon", 101, 1764, "+", a("PIK3CA", "CCDS43171")), ("3", "exon", 1865, 100 + len(cds) + 100, "+", a("PIK3CA", "CCDS43171")), ("12", "exon", 101, 100 + len(other), "-", a("AAAS", "CCDS53797"))]
    rows += [(c, "CDS", *x) for c, _, *x in rows]
    (folder / "t.gtf").write_text("".join(f"{c}\tx\t{f}\t{b}\t{e}\t.\t{s}\t.\t{t}\n" for c, f, b, e, s, t in rows))
    chunks = annotator.read_genome(spark, str(folder / "g.fa")).persist()
    t = annotator.prepare(transcripts.read_gtf(spark, str(folder / "t.gtf"), source="CCDS"), chunks).persist()
    return chunks, t, len(other)


def test_prepared(world):
    _, t, n = world
    rows = {r["gene_name"]: r for r in t.collect()}
    assert rows["PIK3CA"]["cds"][1632:1635] == "GAG" and rows["PIK3CA"]["cds"].endswith("TAA") and rows["AAAS"]["cds"][666:672] == "GGGGGG" and len(rows["AAAS"]["cds"]) == n


def test_genomic_records(spark, world):
    chunks, t, n = world
    g = lambda c: 101 + n - c  # noqa: E731  place of c. in AAAS
    beg = g(671)
    lines = ["chr3:g.1733G>A", "3:g.1733C>A", "chr3:g.1764G>A", "chr3:g.1765G>A", "chr3:g.5A>T", f"chr12:g.{beg}_{beg + 2}del"]
    q = annotator.read_queries(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["input"]: r for r in annotator.genomic_records(q, t, chunks).collect()}
    r = got["chr3:g.1733G>A"]
    assert [r[f] for f in records.FIELDS] == ["chr3:g.1733G>A", "CCDS43171.1 (protein_coding)", "PIK3CA", "+", "chr3:g.1733G>A/c.1633G>A/p.E545K", "inside_[cds_in_exon_1]", "CSQN=Missense;codon_pos=1733-1734-1735;ref_codon_seq=GAG;dbxref=PIK3CA;source=CCDS"]
    assert got["3:g.1733C>A"]["info"].startswith("Error=invalid_reference_base")
    assert got["chr3:g.5A>T"]["info"].startswith("Error=") or got["chr3:g.5A>T"]["info"] == "no_valid_transcript_found"
    r = got["chr3:g.1765G>A"]
    assert r["coordinates"] == "chr3:g.1765G>A/c.1664+1G>A/." and r["region"] == "inside_[intron_between_exon_1_and_2]" and r["info"].startswith("CSQN=SpliceDonorSNV;C2=SpliceDonorOfExon2_At_chr3:1765")
    r = got[f"chr12:g.{beg}_{beg + 2}del"]
    want = f"chr12:g.{beg + 2}_{beg + 4}delCCC/c.670_672delGGG/p.G224delG"
    assert r["coordinates"] == want
    assert r["info"].startswith(f"CSQN=InFrameDeletion;left_align_gDNA=g.{beg - 1}_{beg + 1}delCCC;unaligned_gDNA=g.{beg}_{beg + 2}delCCC;left_align_cDNA=c.667_669delGGG;unalign_cDNA=c.669_671delGGG;")


def test_insertions_blocks_regions(spark, world):
    chunks, t, n = world
    g = lambda c: 101 + n - c  # noqa: E731  place of c. in AAAS
    e = g(667)  # the last base of CCCCCC in the genome
    lines = ["chr3:g.1733_1735dup", f"chr12:g.{e - 6}_{e - 5}insC", "chr3:g.1733_1734delinsTT", "chr3:g.1733_1734delinsTTT", "chr3:g.1732_1733delCTinsCA", "chr3:g.1733_1800", "chr3:g.1733", "chr3:g.1735_1736insTAA"]
    got = {r["input"]: r for r in annotator.genomic_records(annotator.read_queries(spark.createDataFrame([(x,) for x in lines], "value string")), t, chunks).collect()}
    assert set(got) == set(lines)
    r = got["chr3:g.1733_1735dup"]
    assert r["coordinates"] == "chr3:g.1734_1736dupAGG/c.1634_1636dupAGG/p.E545dupE" and r["region"] == "inside_[cds_in_exon_1]"
    assert r["info"] == "CSQN=InFrameInsertion;left_align_gDNA=g.1732_1733insGAG;unalign_gDNA=g.1733_1735dupGAG;left_align_cDNA=c.1632_1633insGAG;unalign_cDNA=c.1633_1635dupGAG;phase=0;dbxref=PIK3CA;source=CCDS"
    r = got[f"chr12:g.{e - 6}_{e - 5}insC"]
    assert r["coordinates"].startswith(f"chr12:g.{e}dupC/c.672dupG/p.") and "fs*" in r["coordinates"]
    assert r["info"].startswith(f"CSQN=Frameshift;left_align_gDNA=g.{e - 6}_{e - 5}insC;unalign_gDNA=g.{e - 6}_{e - 5}insC;left_align_cDNA=c.666_667insG;unalign_cDNA=c.672dupG;")
    r = got["chr3:g.1733_1734delinsTT"]
    assert r["coordinates"] == "chr3:g.1733_1734delinsTT/c.1633_1634delinsTT/p.E545L" and r["info"].startswith("CSQN=Missense;codon_cDNA=1633-1634-1635;")
    assert "fs*" in got["chr3:g.1733_1734delinsTTT"]["coordinates"]
    assert got["chr3:g.1732_1733delCTinsCA"]["info"] == "CSQN=Unclassified;invalid_reference_seq_CT_(expect_TG)"
    r = got["chr3:g.1733_1800"]
    assert r["coordinates"] == "chr3:g.1733_1800/c.1633_1664+36/p.E545_A555" and r["region"] == "from_[cds_in_exon_1]_to_[intron_between_exon_1_and_2]"
    assert r["info"] == "C2=donor_splice_site_on_exon_1_at_chr3:1765_included;start_codon=1733-1734-1735;end_codon=1763-1764-1865;dbxref=PIK3CA;source=CCDS"
    r = got["chr3:g.1733"]
    assert r["coordinates"] == "chr3:g.1733G>/c.1633G>/p.E545" and r["info"].startswith("is_gene_body;codon_pos=1733-1734-1735;")
    assert got["chr3:g.1735_1736insTAA"]["info"].startswith("CSQN=Nonsense;")


def test_coding_and_protein_queries(spark, world):
    _, t, _ = world
    q = annotator.read_queries(spark.createDataFrame([(x,) for x in ["PIK3CA:c.1633G>A", "CCDS43171.1:c.1633C>A", "PIK3CA:c.1664+1G>A", "PIK3CA:c.1600+1G>A", "AAAS:c.669_671del", "nobody:c.1A>T"]], "value string"))
    got = {r["input"]: r for r in annotator.coding_records(q, t, tracks.idmap_of(t)).collect()}
    assert set(got) == {"PIK3CA:c.1633G>A", "PIK3CA:c.1664+1G>A", "AAAS:c.669_671del"}
    r = got["PIK3CA:c.1633G>A"]
    assert (r["gbeg"], r["gref"], r["galt"], r["change"], r["csqn"]) == (1733, "G", "A", "E545K", "Missense")
    assert (got["PIK3CA:c.1664+1G>A"]["gbeg"], got["PIK3CA:c.1664+1G>A"]["csqn"]) == (1765, "IntronicSNV")
    assert got["AAAS:c.669_671del"]["change"] == "G224delG"
    p = spark.createDataFrame([(1, "PIK3CA", "p.E545K"), (2, "PIK3CA", "p.D545K"), (3, "PIK3CA", "p.Glu545_Ala546del")], "qid bigint, tok string, change string")
    pairs = levels.named(p, t, tracks.idmap_of(t), coding_only=True)
    (s,) = levels.protein_snvs(pairs).collect()
    assert (s["qid"], s["best"], s["vbeg"], s["vend"], s["vref"], s["valt"], s["others"]) == (1, "AAG", 1733, 1733, "G", "A", "AAA")
    (d,) = levels.protein_changes(pairs).where("kind = 'DEL'").collect()
    assert (d["gbeg"], d["gend"], d["bases"]) == (1733, 1738, "GAGGCT")


def test_coding_text_records(spark, world):
    chunks, t, n = world
    g = lambda c: 101 + n - c  # noqa: E731  place of c. in AAAS
    lines = ["PIK3CA:c.1633G>A", "PIK3CA:c.1633C>A", "PIK3CA:c.1664+5C>T", "PIK3CA:c.*3T>A", "AAAS:c.669_671del", "AAAS:c.672_673insG", "AAAS:c.670_672dup", "PIK3CA:c.1633_1634delGAinsTT", "PIK3CA:c.1661_1664+3", "AAAS:c.4_9", "AAAS:c.4", "PIK3CA:c.1600+1G>A", "PIK3CA:c.1663_1664insA"]
    q = annotator.read_queries(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["input"]: r for r in annotator.coding_text_records(q, t, tracks.idmap_of(t), chunks, longest=True).collect()}
    assert set(got) == set(lines)
    tail = "dbxref=PIK3CA;source=CCDS"
    want = {
        "PIK3CA:c.1633G>A": ("chr3:g.1733G>A/c.1633G>A/p.E545K", "inside_[cds_in_exon_1]", "CSQN=Missense;reference_codon=GAG;alternative_codon=AAG;" + tail),
        "PIK3CA:c.1664+5C>T": ("chr3:g.1769C>T/c.1664+5C>T/.", "inside_[intron_between_exon_1_and_2]", "CSQN=IntronicSNV;" + tail),
        "PIK3CA:c.1661_1664+3": ("chr3:g.1761_1767CTGCGTC/c.1661_1664+3CTGCGTC/p.554_555AA", "from_[cds_in_exon_1]_to_[intron_between_exon_1_and_2]", "C2=donor_splice_site_on_exon_1_at_chr3:1765_included;" + tail),
        "AAAS:c.4_9": (f"chr12:g.{g(9)}_{g(4)}AGCAGC/c.4_9GCTGCT/p.2_3AA", "inside_[cds_in_exon_1]", "dbxref=AAAS;source=CCDS"),
        "AAAS:c.4": (f"chr12:g.{g(4)}C/c.4G/.", "inside_[cds_in_exon_1]", "dbxref=AAAS;source=CCDS"),
    }
    for k, w in want.items():
        assert (got[k]["coordinates"], got[k]["region"], got[k]["info"]) == w
    assert got["PIK3CA:c.1633C>A"]["info"] == got["PIK3CA:c.1600+1G>A"]["info"] == "no_valid_transcript_found"
    assert got["PIK3CA:c.*3T>A"]["coordinates"].endswith("/c.*3T>A/.") or got["PIK3CA:c.*3T>A"]["info"] == "no_valid_transcript_found"
    r = got["AAAS:c.669_671del"]
    assert r["coordinates"] == f"chr12:g.{g(669)}_{g(667)}delCCC/c.670_672delGGG/p.G224delG" and "unalign_cDNA=c.669_671delGGG;" in r["info"]
    r = got["AAAS:c.672_673insG"]
    assert r["coordinates"].startswith(f"chr12:g.{g(667)}dupC/c.672dupG/p.") and r["info"].startswith("CSQN=Frameshift;") and "unalign_cDNA=c.672dupG;" in r["info"]
    assert got["AAAS:c.670_672dup"]["coordinates"] == f"chr12:g.{g(669)}_{g(667)}dupCCC/c.670_672dupGGG/p.G224dupG"
    r = got["PIK3CA:c.1633_1634delGAinsTT"]
    assert r["coordinates"] == "chr3:g.1733_1734delinsTT/c.1633_1634delinsTT/p.E545L" and r["info"].startswith("CSQN=Missense;codon_cDNA=1633-1634-1635;")
    assert got["PIK3CA:c.1663_1664insA"]["info"].startswith("CSQN=SpliceDonorInsertion;") and "C2=donor_splice_site_on_exon_1_at_chr3:1765_affected" in got["PIK3CA:c.1663_1664insA"]["info"]


def test_text_sinks(spark, tmp_path):
    row = spark.createDataFrame([("i", "t", None, "+", "c", "r", "x", "chr1", "5", "1\t5\t.\tA\tC", 2)], "input string, transcript string, gene string, strand string, coordinates string, region string, info string, CHROM string, POS string, line string, place int")
    records.write_lines(row, str(tmp_path / "o"), "CHROM", "POS")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["i\tt\t.\t+\tc\tr\tx\tchr1\t5"]
    header = spark.createDataFrame([("#CHROM\tPOS", 1), ("##z", 0)], "value string, place int")
    records.write_vcf(row, header, str(tmp_path / "v"))
    files = sorted((tmp_path / "v").glob("part-*"))
    text = "".join(f.read_text() for f in files).splitlines()
    assert text[0] == "##z" and text[1].startswith("#CHROM\tPOS\ttranscript\tgene") and text[2] == "1\t5\t.\tA\tC\tt\t.\t+\tc\tr\tx"


def test_nearest_by_text_names(spark):
    sites = spark.createDataFrame([("s", "chr1", 100)], "id string, c string, p bigint")
    genes = spark.createDataFrame([("B", "chr1", 10, 90), ("A", "chr1", 20, 90), ("Z", "chr1", 150, 160)], "g string, c string, b bigint, e bigint")
    up = intervals.nearest(sites, genes, "c", "p", "b", "e", "g", True).first()
    down = intervals.nearest(sites, genes, "c", "p", "b", "e", "g", False).first()
    assert (up["near_name"], up["near_dist"], down["near_name"], down["near_dist"]) == ("A", 10, "Z", 50)


def test_names_in_any_case(spark):
    t = spark.createDataFrame([("S", "Abc", "uc001", 1)], "source string, gene_name string, name string, version int")
    none = spark.createDataFrame([("x", ["Abc"])], "synonym string, canonical array<string>")
    q = spark.createDataFrame([(1, "uc001"), (2, "ABC"), (3, "X"), (4, "UC001.1")], "qid int, tok string")
    from strandline.operators import lookup

    assert {(r["qid"], r["way"]) for r in lookup.cascade(q, t, none).select("qid", "way").collect()} == {(1, 2), (2, 1), (3, 3), (4, 2)}
    assert F


def test_frameshifts_step_by_step(spark):
    import random

    from strandline.functions import sequence

    rng = random.Random(6)
    code = {a + b + c: sequence.STANDARD_CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    read = lambda s: "".join(code[s[i : i + 3]] for i in range(0, len(s) // 3 * 3, 3))
    cds = "ATG" + "".join(rng.choice(["GCT", "AAA", "CCG", "TTC", "GGA", "CAT"]) for _ in range(40)) + "TAA"
    tail = "".join(rng.choices("ACGT", k=300))
    old = read(cds + tail)

    def change(new):
        got = read(new + tail)
        at = next(i for i in range(len(got)) if got[i] != old[i])
        stop = got.find("*")
        return at + 1, f"{old[at]}{at + 1}{got[at]}", stop - at + 1 if stop >= at else None

    n, head, stop = change(cds[:60] + cds[61:])
    want = set()
    for b in range(3 * n - 9, 3 * n + 1):
        for new in [cds[: b - 1] + cds[b - 1 + k :] for k in (1, 2, 4)] + [cds[: b - 1] + "".join(x) + cds[b - 1 :] for k in (1, 2, 4, 5) for x in itertools.product("ACGT", repeat=k)]:
            if change(new)[1:] == (head, stop):
                want.add(new)
    t = spark.createDataFrame([(1, 7, f"p.{head}fs*{stop}", "+", cds, tail)], "qid bigint, tid bigint, change string, strand string, cds string, tail string").withColumn("segs", F.array(F.struct(F.lit(1).cast("bigint").alias("gb"), F.lit(len(cds)).cast("bigint").alias("ge"), F.lit(0).cast("bigint").alias("cprev"))))
    most = max(1, len(want) - 1)
    rows = levels.frameshift_candidates(t, most=most).orderBy("rank").collect()
    made = set()
    for r in rows:
        span, kind, bases = re.match(r"([0-9_]+)(del|ins)(.*)", r["edit"]).groups()
        a = int(span.split("_")[0])
        made.add(cds[: a - 1] + cds[a - 1 + len(bases) :] if kind == "del" else cds[:a] + bases + cds[a:])
    assert len(made) == len(rows) == most and made <= want and {r["n_omitted"] for r in rows} == {len(want) - most}
    assert rows[0]["size"] == 1 and [r["size"] for r in rows] == sorted(r["size"] for r in rows)
