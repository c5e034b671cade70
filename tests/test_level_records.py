"""Text records of p. changes; lines are documented ones, at the places of the small references of test_annotator."""

from test_annotator import world  # noqa: F401

from strandline.operators import level_records, levels, records
from strandline.plans import annotator
from strandline.sources import tracks


def test_protein_snv_records(spark, world):  # noqa: F811
    _, t, n = world
    g = lambda c: 101 + n - c
    q = annotator.read_queries(spark.createDataFrame([(x,) for x in ["PIK3CA:p.E545K", "PIK3CA:p.A555A", "AAAS:p.G223K", "PIK3CA:p.D545K"]], "value string"))
    pairs = levels.named(q.select("qid", "input", "tok", "change"), t, tracks.idmap_of(t), coding_only=True)
    got = {r["input"]: r for r in level_records.protein_snv_records(levels.protein_snvs(pairs)).collect()}
    assert set(got) == {"PIK3CA:p.E545K", "PIK3CA:p.A555A", "AAAS:p.G223K"}
    r = got["PIK3CA:p.E545K"]
    assert [r[f] for f in records.FIELDS] == ["PIK3CA:p.E545K", "CCDS43171.1 (protein_coding)", "PIK3CA", "+", "chr3:g.1733G>A/c.1633G>A/p.E545K", "inside_[cds_in_exon_1]", "CSQN=Missense;reference_codon=GAG;candidate_codons=AAG,AAA;candidate_mnv_variants=chr3:g.1733_1735delGAGinsAAA;dbxref=PIK3CA;source=CCDS"]
    r = got["PIK3CA:p.A555A"]  # its codon is split by the intron
    assert r["region"] == "inside_[cds_in_exons_[1,2]]" and r["info"].startswith("CSQN=Synonymous;reference_codon=GCT;") and r["info"].count("chr3:g.1865T>") == 2 and r["coordinates"].startswith("chr3:g.1865T>")
    r = got["AAAS:p.G223K"]
    assert r["coordinates"] == f"chr12:g.{g(668)}_{g(667)}delCCinsTT/c.667_668delGGinsAA/p.G223K"
    assert f"candidate_mnv_variants=chr12:g.{g(669)}_{g(667)}delCCCinsTTT" in r["info"]
