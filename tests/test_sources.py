import pytest
from pyspark.sql import functions as F

from strandline.sources import tracks, transcripts
from strandline.streaming import annotate as streaming


def put(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join("\t".join(map(str, x)) if isinstance(x, tuple) else x for x in lines) + "\n")
    return str(path)


def test_gtf(spark, tmp_path):
    a = 'gene_id "ENSG1"; gene_name "abc"; transcript_id "ENST1.4"; transcript_biotype "protein_coding";'
    path = put(tmp_path, "x.gtf", "#!build", ("1", "e", "transcript", 11, 60, ".", "+", ".", a), ("1", "e", "exon", 41, 60, ".", "+", ".", a), ("1", "e", "exon", 11, 30, ".", "+", ".", a), ("1", "e", "CDS", 15, 30, ".", "+", "0", a + ' protein_id "P1";'))
    (r,) = transcripts.read_gtf(spark, path).collect()
    assert (r["gene_name"], r["name"], r["version"], r["beg"], r["tend"], r["cds_beg"], r["cds_end"]) == ("ABC", "ENST1", 4, 11, 60, 15, 30)
    assert [tuple(e) for e in r["exons"]] == [(11, 30), (41, 60)] and r["aliases"] == ["P1"]


def test_ccds_refgene_knowngene(spark, tmp_path):
    ccds = put(tmp_path, "ccds", "#head", ("1", "nc", "abc", 5, "CCDS1.2", "Public", "+", 9, 39, "[9-19, 29-39]", "x"), ("1", "nc", "abc", 5, "CCDS2.1", "Withdrawn", "+", 9, 39, "[9-19]", "x"))
    (r,) = transcripts.read_ccds(spark, ccds).collect()
    assert (r["name"], r["version"], r["cds_beg"], r["cds_end"], [tuple(e) for e in r["exons"]]) == ("CCDS1", 2, 10, 40, [(10, 20), (30, 40)])
    row = (0, "NM_1", "chr1", "-", 9, 40, 12, 38, 2, "9,29,", "20,40,", 0, "abc", "cmpl", "cmpl", "0,0,")
    (r,) = transcripts.read_refgene(spark, put(tmp_path, "rg", row, (*row[:13], "incmpl", "cmpl", ""))).collect()
    assert (r["beg"], r["cds_beg"], [tuple(e) for e in r["exons"]]) == (10, 13, [(10, 20), (30, 40)])
    known = put(tmp_path, "kg", ("uc1", "chr1", "+", 9, 40, 12, 38, 2, "9,29,", "20,40,", "", ""))
    (r,) = transcripts.read_knowngene(spark, known, put(tmp_path, "ka", ("uc1", "XYZ"), ("uc1", "ABC"))).collect()
    assert r["aliases"] == ["ABC", "XYZ"] and r["beg"] == 10


def test_refseq(spark, tmp_path):
    g = lambda f, b, e, a, s="NC_1": (s, "R", f, b, e, ".", "+", ".", a)
    path = put(tmp_path, "x.gff3", "##gff", g("region", 1, 900, "ID=r1;chromosome=7"), g("region", 1, 90, "ID=r2;map=unlocalized;chromosome=7", "NT_1"), g("gene", 11, 60, "ID=gene1;Name=ABC;Dbxref=GeneID:5"), g("mRNA", 11, 60, "ID=rna1;Parent=gene1;Name=NM_1.3"), g("exon", 11, 60, "ID=e1;Parent=rna1"), g("CDS", 21, 50, "ID=c1;Parent=rna1;protein_id=NP_1"), g("gene", 100, 160, "ID=gene2;Name=PSE;pseudo=true"), g("exon", 100, 160, "ID=e2;Parent=gene2"), g("gene", 200, 260, "ID=gene3;Name=DIR"), g("CDS", 200, 260, "ID=c3;Parent=gene3"), g("gene", 5, 50, "ID=gene4;Name=LOST", "NT_1"), g("CDS", 5, 50, "ID=c4;Parent=gene4", "NT_1"))
    got = {r["gene_name"]: r for r in transcripts.read_refseq(spark, path).collect()}
    assert set(got) == {"ABC", "DIR"}
    assert (got["ABC"]["name"], got["ABC"]["version"], got["ABC"]["chrm"], got["ABC"]["cds_beg"], got["ABC"]["cds_end"], got["ABC"]["aliases"]) == ("NM_1", 3, "chr7", 21, 50, ["NP_1"])
    assert got["DIR"]["name"] == "DIR"


def test_tracks(spark, tmp_path):
    assert tracks.read_bed(spark, put(tmp_path, "b", ("chr1", 1, 5, "x"), ("chr1", 1, 5))).count() == 1
    assert tracks.read_vcf_features(spark, put(tmp_path, "v", ("1", 5, "rs1", "AC", "A"))).first()["label"] == "rs1|AC|A"
    assert sorted(tuple(r) for r in tracks.read_idmap(spark, put(tmp_path, "m", "#x", ("p1", "abc"), ("p1", "abd"), ("p1", "abc"))).collect()) == [("P1", "ABC"), ("P1", "ABD")]
    rows = tracks.read_vcf(spark, put(tmp_path, "q.vcf", "##x", ("1", 5, ".", "A", "T,G", ".", ".", ""), ("1", 9, ".", "ACT", "A", ".", ".", ""), ("1", 9, ".", "A", "ATT", ".", ".", ""), ("1", 9, ".", "C", "TCAG", ".", ".", ""), ("1", 9, ".", "C", "<DEL>", ".", ".", "SVTYPE=DEL;END=30"))).collect()
    assert sorted((r["kind"], r["beg"], r["end"], r["bases"]) for r in rows) == [("DEL", 9, 30, ""), ("DEL", 10, 11, "CT"), ("INS", 9, 10, "TT"), ("MNV", 9, 9, "TCAG"), ("SNV", 5, 5, "G"), ("SNV", 5, 5, "T")]


def test_fasta_chunks(spark, tmp_path):
    g = tracks.read_fasta(spark, put(tmp_path, "x.fa", ">c1 one", "acgta", "cgt", ">c2", "GGGG"), chunk=4, overlap=3)
    assert sorted((r["chrom"], r["beg"], r["seq"]) for r in g.collect()) == [("c1", 1, "ACGTACG"), ("c1", 5, "ACGT"), ("c2", 1, "GGGG")]
    spans = spark.createDataFrame([("c1", 3, 6), ("c1", 7, 9), ("c9", 1, 2)], "chrom string, beg bigint, end bigint")
    assert {(r["chrom"], r["beg"]): r["bases"] for r in tracks.fetch(spans, g, chunk=4).collect()} == {("c1", 3): "GTAC", ("c1", 7): "GT", ("c9", 1): None}


def test_fetch_over_many_chunks(spark, tmp_path):
    seq = "ACGTTGCATTACGGATCCAGT"
    g = tracks.read_fasta(spark, put(tmp_path, "x.fa", ">c1", seq), chunk=4, overlap=3)
    rows = [("c1", b, e) for b in range(1, len(seq) + 1) for e in range(b - 1, len(seq) + 3)] + [("c1", 2, 20), ("c1", None, 3), ("c9", 1, 9)]
    spans = spark.createDataFrame(rows, "chrom string, beg bigint, end bigint")
    got = sorted((tuple(r) for r in tracks.fetch(spans, g, chunk=4).collect()), key=str)
    assert got == sorted(((c, b, e, seq[b - 1 : e] if c == "c1" and b else None) for c, b, e in rows), key=str)


def test_lists(spark, tmp_path):
    path = put(tmp_path, "l", ("chr1", 5, "A", "T", "NM_1"))
    (r,) = tracks.read_list(spark, path, gene=1, position=2, ref=3, alt=4, transcript=5, keep="1,4-").collect()
    assert (r["op"], r["tok"], r["mutation"], r["tpt"]) == ("chr1|T|NM_1", "chr1", "g.5A>T", "NM_1")
    (r,) = tracks.read_list(spark, put(tmp_path, "m", ("PIK3CA:E545K",)), mutation=1).collect()
    assert (r["tok"], r["mutation"]) == ("PIK3CA", "E545K")
    assert tracks.columns_of("3,5-", 7) == [2, 4, 5, 6]


def test_stream_equals_batch(spark, tmp_path):
    exons = F.array(F.struct(F.lit(11).cast("bigint").alias("beg"), F.lit(40).cast("bigint").alias("end")))
    t = spark.createDataFrame([(1, 1, "+", 11, 40, 11, 40, "ATGAAACCCGGGTTTATGAAACCCGGGTAA")], "tid bigint, contig_id bigint, strand string, beg bigint, tend bigint, cds_beg bigint, cds_end bigint, cds string").withColumn("exons", exons)
    t = t.withColumn("segs", F.array(F.struct(F.lit(11).cast("bigint").alias("gb"), F.lit(40).cast("bigint").alias("ge"), F.lit(0).cast("bigint").alias("cprev"))))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("v1\t1\t20\tG\tT\nv2\t1\t14\tA\tT\nv3\t1\t90\tA\tT\n")
    stream = streaming.variant_stream(spark, str(tmp_path / "in"))
    q = streaming.each_batch(stream, lambda b: streaming.snv_stream(b, t).select("vid", "csqn"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r["vid"]: r["csqn"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"v1": "Missense", "v2": "Nonsense"}


@pytest.mark.parametrize("spec", ["", "1"])
def test_columns(spec):
    assert tracks.columns_of(spec, 3) == [0][: len(spec)]


def test_stop_codons_do_not_move_the_ends(spark, tmp_path):
    for strand in "+-":
        a = f'gene_id "G"; transcript_id "T{strand}"; gene_name "abc";'
        path = put(tmp_path, f"{ord(strand)}.gtf", ("1", "e", "exon", 11, 60, ".", strand, ".", a), ("1", "e", "CDS", 20, 40, ".", strand, ".", a), ("1", "e", "stop_codon", *((41, 43) if strand == "+" else (17, 19)), ".", strand, ".", a))
        (r,) = transcripts.read_gtf(spark, path).collect()
        assert (r["cds_beg"], r["cds_end"]) == (20, 40)


def test_aceview_and_old_gtf(spark, tmp_path):
    g = lambda f, b, e, t: ("1", "AceView", f, b, e, ".", "+", ".", f"gene_id abc; transcript_id {t};")
    rows = transcripts.read_aceview(spark, put(tmp_path, "a.gff", g("exon", 5, 30, "t1"), g("CDS", 9, 20, "t1"), g("exon", 5, 30, "t2"))).collect()
    assert [(r["name"], r["cds_beg"], r["cds_end"]) for r in rows] == [("t1", 9, 20)]
    a = 'gene_id "ENSG1"; transcript_id "ENST9";'
    (r,) = transcripts.read_gtf(spark, put(tmp_path, "o.gtf", ("1", "protein_coding", "exon", 41, 60, ".", "-", ".", a), ("1", "protein_coding", "exon", 11, 30, ".", "-", ".", a))).collect()
    assert (r["beg"], r["tend"], r["gene_name"], r["transcript_type"]) == (11, 60, "ENSG1", "protein_coding")


def test_first_gene_by_line(spark, tmp_path):
    g = lambda f, b, e, a: ("NC_1", "R", f, b, e, ".", "+", ".", a)
    path = put(tmp_path, "y.gff3", g("region", 1, 900, "ID=r1;chromosome=7"), g("gene", 500, 600, "ID=gene2;Name=ABC"), g("exon", 500, 600, "ID=e2;Parent=gene2"), g("gene", 11, 60, "ID=gene1;Name=ABC"), g("exon", 11, 60, "ID=e1;Parent=gene1"))
    assert [r["beg"] for r in transcripts.read_refseq(spark, path).collect()] == [500]


def test_tables_of_transcripts_and_features(spark, tmp_path):
    row = (0, "NM_1", "chr1", "-", 9, 40, 12, 38, 2, "9,29,", "20,40,", 0, "abc", "cmpl", "cmpl", "0,0,")
    t = transcripts.read_refgene(spark, put(tmp_path, "rg", row, (*row[:1], "NM_2", "chr2", *row[3:12], "xyz", *row[13:])))
    transcripts.write_transcripts(t, str(tmp_path / "by_place"))
    transcripts.write_by_gene(t, str(tmp_path / "by_gene"))
    assert [r["name"] for r in transcripts.at_place(spark, str(tmp_path / "by_place"), "chr1", 40, 90).collect()] == ["NM_1"] and not transcripts.at_place(spark, str(tmp_path / "by_place"), "chr1", 41, 90).collect()
    assert [r["name"] for r in transcripts.by_gene(spark, str(tmp_path / "by_gene"), "xyz").collect()] == ["NM_2"]
    f = tracks.union_features(tracks.read_bed(spark, put(tmp_path, "b", ("chr1", 1, 5, "x"))), tracks.read_gff_features(spark, put(tmp_path, "g", ("chr1", "s", "promoter", 3, 9, ".", "+", ".", "."))))
    tracks.write_features(f, str(tmp_path / "features"))
    assert sorted((r["source"], r["beg"], r["label"]) for r in spark.read.parquet(str(tmp_path / "features")).collect()) == [("bed", 1, "x"), ("gff", 3, "promoter")]
    tracks.write_idmap(tracks.idmap_of(t.withColumn("aliases", F.array(F.lit("NP_7"))).withColumn("gene_dbxref", F.lit("GeneID:5,HGNC:9"))), str(tmp_path / "idmap"))
    assert {(r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "idmap")).collect()} == {(i, g) for i in ("NP_7", "5", "9") for g in ("ABC", "XYZ")}
    assert tracks.read_known_variants(spark, put(tmp_path, "k", ("1", 5, "rs1", "A", "C,G"))).first()["alts"] == ["C", "G"]
    q = tracks.one_query(spark, "PIK3CA:p.E545K").first()
    assert (q["tok"], q["change"], q["level"]) == ("PIK3CA", "p.E545K", "p") and tracks.one_query(spark, "PIK3CA").first()["change"] is None


@pytest.mark.parametrize("width", [7, 64, 100_000])
def test_fasta_over_splits(spark, tmp_path, width):
    """Records that run over many splits, with lines of any width."""
    import random

    rng = random.Random(width)
    seqs = {"c1": "".join(rng.choices("ACGT", k=5000)), "c2": "ACG", "c3": "".join(rng.choices("acgt", k=2100))}
    path = put(tmp_path, "x.fa", *(x for n, s in seqs.items() for x in (f">{n} text", *(s[i : i + width] for i in range(0, len(s), width)))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 900)
    try:
        got = {(r["chrom"], r["chunk"]): (r["beg"], r["seq"]) for r in tracks.read_fasta(spark, path, chunk=1000, overlap=30, before=20).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(n, c): (max(1, c * 1000 - 19), s.upper()[max(0, c * 1000 - 20) : (c + 1) * 1000 + 30]) for n, s in seqs.items() for c in range((len(s) - 1) // 1000 + 1)}
    assert got == want
