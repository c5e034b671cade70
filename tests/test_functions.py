import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import coords, hgvs, sequence
from strandline.operators import annotate

EXONS = [(101, 130), (161, 190), (221, 250)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_codons_cover_the_code(spark):
    for aa, codons in sequence.CODONS_OF.items():
        if aa not in "ZB":
            got = spark.createDataFrame([(c,) for c in codons], "c string").select(sequence.codon_aa(F.col("c"))).collect()
            assert {r[0] for r in got} == {aa}
    assert one(spark, sequence.codon_aa(F.lit("ATN"))) is None


@pytest.mark.parametrize(("cds", "protein"), [("ATGTTTTAAATG", "MF*"), ("ATGTT", "M"), ("", ""), ("AT", "")])
def test_translate(spark, cds, protein):
    assert one(spark, sequence.translate(F.lit(cds))) == protein


@pytest.mark.parametrize(("ref", "alt", "want"), [("ACGT", "ACTT", ("G", "T", 2)), ("AAA", "AA", ("A", "", 2)), ("A", "A", ("", "", 1)), ("GAT", "GCCAT", ("", "CC", 1)), ("", "A", ("", "A", 0))])
def test_trim_prefix_first(spark, ref, alt, want):
    assert tuple(one(spark, sequence.trim(F.lit(ref), F.lit(alt)))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("g.12A>T", ("SNV", "12", "12", "A", "T")), ("12?>T", ("SNV", "12", "12", "", "T")), ("5_7del", ("DEL", "5", "7", "", "")), ("5_7del3", ("DEL", "5", "7", "", "")), ("5delA", ("DEL", "5", "5", "A", "")),
        ("5_6insac", ("INS", "5", "6", "", "AC")), ("5_6ins", (None, None, None, None, None)), ("5delAinsT", ("SNV", "5", "5", "A", "T")), ("5_6delACinsT", ("MNV", "5", "6", "AC", "T")),
        ("5ACG>T", ("MNV", "5", "7", "ACG", "T")), ("5_7dup", ("DUP", "5", "7", "", "")), ("5_7", ("REG", "5", "7", "", "")), ("nonsense", (None, None, None, None, None)),
    ],
)
def test_genomic_precedence(spark, text, want):
    assert tuple(one(spark, hgvs.parse_genomic(F.lit(text)))) == want


@pytest.mark.parametrize(("text", "want"), [("12", (12, 0)), ("12+3", (12, 3)), ("12-3", (12, -3)), ("-5", (1, -5)), ("*5", (-1, 5)), ("+5", (-1, 5)), ("x", (None, None))])
def test_position(spark, text, want):
    assert tuple(one(spark, hgvs.parse_position(F.lit(text)))) == want


def _cdna(strand, cds, pos):
    """Step by step, over the list of CDS bases."""
    bases = [p for b, e in EXONS for p in range(b, e + 1) if cds[0] <= p <= cds[1]]
    bases = bases if strand == "+" else bases[::-1]
    sign = 1 if strand == "+" else -1
    if pos in bases:
        return bases.index(pos) + 1, 0
    if sign * (pos - bases[0]) < 0:
        return 1, sign * (pos - bases[0])
    if sign * (pos - bases[-1]) > 0:
        return len(bases), sign * (pos - bases[-1])
    i = max(i for i, p in enumerate(bases) if sign * (pos - p) > 0)
    a, b = abs(pos - bases[i]), abs(bases[i + 1] - pos)
    return (i + 1, a) if a < b else (i + 2, -b)


@pytest.mark.parametrize("strand", ["+", "-"])
def test_cdna_against_steps_and_back(spark, strand):
    cds = (107, 240)
    t = spark.range(90, 262).select(F.col("id").alias("pos"), F.array(*(F.struct(F.lit(b).cast("bigint").alias("beg"), F.lit(e).cast("bigint").alias("end")) for b, e in EXONS)).alias("exons"))
    t = t.withColumn("segs", coords.segments(F.col("exons"), F.lit(cds[0]), F.lit(cds[1]), F.lit(strand)))
    rows = t.withColumn("c", coords.cdna(F.col("pos"), F.col("segs"), F.lit(strand))).withColumn("back", coords.genomic(F.col("c.pos"), F.col("segs"), F.lit(strand))).collect()
    for r in rows:
        assert tuple(r["c"]) == _cdna(strand, cds, r["pos"]), r["pos"]
        if r["c"]["offset"] == 0:
            assert r["back"] == r["pos"]


def test_rolls_keep_the_edited_sequence(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        seq = "".join(rng.choices("AC", k=40))
        beg = rng.randint(1, 39)
        rows.append((i, seq, beg, min(40, beg + rng.randint(0, 4))))
    d = spark.createDataFrame(rows, "i int, seq string, b int, e int")
    for r in d.withColumn("right", annotate.roll_right(F.col("seq"), F.col("b"), F.col("e"))).withColumn("left", annotate.roll_left(F.col("seq"), F.col("b"), F.col("e"))).collect():
        edit = lambda by: r["seq"][: r["b"] - 1 + by] + r["seq"][r["e"] + by :]  # noqa: B023, E731
        assert edit(r["right"]) == edit(0) == edit(-r["left"])
        assert r["e"] + r["right"] >= 40 or edit(r["right"] + 1) != edit(0)
        assert r["b"] - r["left"] <= 1 or edit(-r["left"] - 1) != edit(0)


def test_site_of_a_one_base_exon(spark):
    exons = F.array(*(F.struct(F.lit(b).alias("beg"), F.lit(e).alias("end")) for b, e in [(10, 20), (30, 30), (40, 50)]))
    get = lambda pos, strand: one(spark, coords.site(F.lit(pos), exons, F.lit(strand), F.lit(12), F.lit(48), F.lit(True)))
    assert get(30, "+")["splice"] == "NextToAcceptor" and get(30, "+")["exon"] == 2
    assert get(21, "+")["splice"] == "SpliceDonor" and get(21, "-")["splice"] == "SpliceAcceptor"
    assert get(29, "+")["splice"] == "SpliceAcceptor"
    assert get(11, "+")["utr"] == 5 and get(11, "-")["utr"] == 3
    assert get(12, "+")["codon"] == "CdsStart" and get(12, "-")["codon"] == "CdsStop"
    assert get(50, "-")["edge"] == "TSS" and get(9, "+")["part"] == "outside"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("p.A12fs", ("FS", 12, 12, "A", "A", "A", "", None)), ("p.Ala12Glyfs*7", ("FS", 12, 12, "A", "A", "A", "G", 7)), ("p.A12del", ("DEL", 12, 12, "A", "A", "", "", None)), ("p.E17_K18del", ("DEL", 17, 18, "E", "K", "", "", None)),
        ("p.A12dup", ("DUP", 12, 12, "A", "A", "", "", None)), ("p.T5delinsQQ", ("MNV", 5, 5, "T", "T", "", "QQ", None)), ("p.T5delinsQ", ("SNV", 5, 5, "T", "T", "T", "Q", None)), ("p.Glu17Lys", ("SNV", 17, 17, "E", "E", "E", "K", None)),
        ("A12*", ("SNV", 12, 12, "A", "A", "A", "*", None)), ("p.A12?", ("REG", 12, 12, "A", "A", "", "", None)), ("p.D10_E20DxxE", ("REG", 10, 20, "D", "E", "DXXE", "", None)), ("p.??", (None,) * 8),
    ],
)
def test_protein_forms(spark, text, want):
    assert tuple(one(spark, hgvs.parse_protein(F.lit(text)))) == want


def test_small_texts(spark):
    assert one(spark, hgvs.three_letters(F.lit("AW*"))) == "AlaTrpX" and one(spark, hgvs.one_letter(F.lit("AlaTrpTer"))) == "AW*" and one(spark, hgvs.one_letter(F.lit("12"))) == ""
    assert one(spark, sequence.shortened(F.lit("ABCDEFGHIJ"))) == "ABC..HIJ" and one(spark, sequence.shortened(F.lit("ABCD"))) == "ABCD"
    assert one(spark, sequence.context(F.lit("MKTAYIAK"), F.lit(3), 2)) == "MK[T]AY"
    assert tuple(one(spark, sequence.clamped(F.lit(-5), F.lit(99), F.lit(40)))) == (1, 40)
    assert [one(spark, hgvs.normalize_chromosome(F.lit(c))) for c in ("23", "chr24", "MT", "7", "chrUn_1")] == ["chrX", "chrY", "chrM", "chr7", "chrUn_1"]


def test_sql_functions(spark):
    from strandline.functions import sql

    sql.register(spark)
    assert tuple(spark.sql("SELECT revcomp('ACGTN'), codon2aa('ATG'), codon2aa('ATN'), translate_cds('ATGTTTTAAATG'), translate_cds('AT')").first()) == ("NACGT", "M", None, "MF*", "")


@pytest.mark.parametrize("strand", ["+", "-"])
def test_segments_by_coding_places(spark, strand):
    exons = F.array(*(F.struct(F.lit(b).cast("bigint").alias("beg"), F.lit(e).cast("bigint").alias("end")) for b, e in EXONS))
    t = spark.range(1).withColumn("s", coords.segments(exons, F.lit(107), F.lit(240), F.lit(strand)))
    bases = [p for b, e in EXONS for p in range(b, e + 1) if 107 <= p <= 240][:: 1 if strand == "+" else -1]
    place = lambda pos, offset: F.struct(F.lit(pos).alias("pos"), F.lit(offset).alias("offset"))
    get = lambda c: t.select(c.alias("x")).first()["x"]
    edge = 24 if strand == "+" else 20
    assert get(coords.codon_places(F.lit(8), F.col("s"), F.lit(strand))) == sorted(bases[21:24]) and get(coords.codon_places(F.lit(99), F.col("s"), F.lit(strand))) is None
    assert get(coords.genomic_at(place(edge, 3), F.col("s"), F.lit(strand))) == bases[edge - 1] + (3 if strand == "+" else -3) and get(coords.genomic_at(place(-1, 2), F.col("s"), F.lit(strand))) == bases[-1] + (2 if strand == "+" else -2)
    assert get(coords.on_boundary(place(edge, 1), F.col("s"), F.lit(strand))) and get(coords.on_boundary(place(edge + 1, -1), F.col("s"), F.lit(strand))) and not get(coords.on_boundary(place(edge, -1), F.col("s"), F.lit(strand)))
    assert get(coords.segment_numbers(F.lit(edge), F.lit(edge + 1), F.col("s"), F.lit(strand))) == [1, 2]
    assert get(coords.lean(place(edge, 4), F.col("s"), F.lit(strand), True)) == edge + 1 and get(coords.lean(place(edge + 1, -4), F.col("s"), F.lit(strand), False)) == edge
    assert get(coords.same_intron(place(edge, 5), place(edge + 1, -7))) and not get(coords.same_intron(place(edge, 0), place(edge, 5)))
