"""Protein changes against a step-by-step version, and texts worked out by hand."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence
from strandline.operators import coding
from strandline.plans import fixture

AA = {c: sequence.STANDARD_CODE[i] for i, c in enumerate(a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG")}


def _read(s):
    return "".join(AA[s[i : i + 3]] for i in range(0, len(s) // 3 * 3, 3))


def _changed(spark, rows):
    d = spark.createDataFrame(rows, "id int, cds string, tail string, cbeg int, cend int, alt string")
    return {r["id"]: r for r in coding.protein_change(d).collect()}


# M  A  A  K  S  T  L  *
CDS = "ATGGCAGCCAAATCTACTTTATAA"


@pytest.mark.parametrize(
    ("beg", "end", "alt", "csqn", "change"),
    [
        (4, 6, "", "InFrameDeletion", "A3delA"), (10, 15, "", "InFrameDeletion", "K4_S5delKS"), (12, 14, "", "MultiAAMissense", "K4_S5delinsN"), (4, 4, "", "Frameshift", "A2Qfs*?"),
        (7, 6, "GCC", "InFrameInsertion", "A3dupA"), (13, 12, "TGG", "InFrameInsertion", "K4_S5insW"), (13, 12, "TAG", "Nonsense", "S5*fs*1"), (11, 10, "GGG", "MultiAAMissense", "K4delinsRE"),
        (10, 12, "GGG", "Missense", "K4G"), (12, 12, "G", "Synonymous", "(=)"), (10, 15, "GGGTGG", "MultiAAMissense", "K4_S5delinsGW"), (22, 24, "", "InFrameDeletion", "*8del*"), (13, 12, "A", "Frameshift", "S5Ifs*?"),
    ],
)
def test_texts(spark, beg, end, alt, csqn, change):
    r = _changed(spark, [(0, CDS, "", beg, end, alt)])[0]
    assert (r["csqn"], r["change"]) == (csqn, change)


def test_a_change_names_what_the_edited_protein_is(spark):
    rng, rows = random.Random(5), []
    for i in range(400):
        cds, tail = "ATG" + "".join(rng.choices("ACG", k=57)) + "TAA", "".join(rng.choices("ACGT", k=60))
        beg = rng.randint(4, 50)
        end = beg - 1 if i % 3 == 0 else beg + (rng.randint(0, 6) if i % 2 else 0)
        rows.append((i, cds, tail, beg, end, "" if i % 3 == 1 else "".join(rng.choices("ACGT", k=rng.randint(1, 7) if i % 2 else 1))))
    kinds = set()
    for i, r in _changed(spark, rows).items():
        _, cds, tail, beg, end, alt = rows[i]
        new = cds[: beg - 1] + alt + cds[end:]
        framed = len(new) % 3 == 0
        old, got = _read(cds), _read(new if framed else new + tail)
        kinds.add(r["csqn"])
        assert r["variant_protein"] == got.split("*")[0] + "*" * ("*" in got)
        if r["csqn"] == "Synonymous":
            assert r["variant_protein"] == old
        elif r["csqn"] == "Missense":
            at = int(r["change"][1:-1])
            assert old[: at - 1] + r["change"][-1] + old[at:] == got
        elif "fs*" in r["change"]:
            full = _read(cds + tail)
            at = next(j for j in range(len(got)) if got[j] != full[j])
            stop = got.find("*")
            assert r["change"] == f"{full[at]}{at + 1}{got[at]}fs*{stop - at + 1 if stop >= 0 else '?'}"
    assert kinds >= {"Synonymous", "Missense", "MultiAAMissense", "Frameshift", "InFrameDeletion", "InFrameInsertion"}


def test_nulls_and_cut_sequences(spark):
    got = _changed(spark, [(0, None, "", 4, 4, ""), (1, "ATGGC", "", 4, 6, "GGG"), (2, CDS, "", 4, 6, None)])
    assert [got[i]["change"] for i in range(3)] == [None, None, None]


def test_tail_ends_where_no_frame_reads_on(spark):
    rng = random.Random(8)
    rests = ["", "TA", "TAA", "ACG" * 500 + "TAA" + "C", "".join(rng.choices("ACG", k=700)) + "TAACTAACTAAGGGGGGG", "C" * 20_000 + "TAGCTAGCTAG" + "C" * 50, *("".join(rng.choices("ACGT", k=rng.randint(1, 400))) for _ in range(200))]
    d = spark.createDataFrame(list(enumerate(rests)), "id int, rest string").withColumn("tail", sequence.until_stops(F.col("rest")))
    for r in d.collect():
        read = [_read(r["rest"][k:]) for k in range(3)]
        ends = [k + 3 * p.index("*") + 3 if "*" in p else len(r["rest"]) for k, p in enumerate(read)]
        assert r["tail"] == r["rest"][: max(ends)]


@pytest.mark.parametrize("strand", ["+", "-"])
def test_shifted_frame_is_read_on_to_its_stop(spark, tmp_path, strand):
    """One contig whose only stop in the shifted frame lies 900 bases behind the coding sequence."""
    tid, seq = (50, "C" * 1200 + "TAACTAACTAA" + "C" * 100) if strand == "+" else (199, "G" * 1500)
    spark.createDataFrame([(1, "".join({"A": "a", "C": "b", "G": "c", "T": "d"}[x] for x in seq) + " " * 300)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(tid, 0)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    (t,) = fixture.Genome(spark, str(tmp_path)).transcripts.collect()
    rest = seq[t["cds_end"] :] if strand == "+" else "C" * (t["cds_beg"] - 1)
    assert t["tail"] == (rest[: rest.rindex("TAA") + 3] if strand == "+" else rest)
    got = _changed(spark, [(k, t["cds"], t["tail"], 4, 3 + k, "") for k in (1, 2)])
    for k in (1, 2):
        whole = _read(t["cds"][:3] + t["cds"][3 + k :] + rest)
        assert got[k]["variant_protein"] == (whole[: whole.index("*") + 1] if "*" in whole else whole)
        assert got[k]["csqn"] == "Synonymous" or got[k]["change"].endswith("?") == ("*" not in whole)


def test_contigs_are_numbered_by_ranges(spark):
    rng = random.Random(2)
    ids = [None, *rng.sample(range(-500, 5000), 900), 10**12]
    d = fixture.numbered(spark.createDataFrame([(i,) for i in ids], "doc_id bigint").repartition(5), width=64)
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert {r["doc_id"]: r["contig_id"] for r in d.collect()} == {x: i + 1 for i, x in enumerate(order)}


def test_long_trim(spark):
    a, b = "A" * 100 + "G" + "C" * 90, "A" * 100 + "TT" + "C" * 90
    from pyspark.sql import functions as F

    assert tuple(spark.range(1).select(sequence.trim(F.lit(a), F.lit(b)).alias("x")).first()["x"]) == ("G", "TT", 100)


def test_long_proteins_cost_their_length(spark):
    """A frame that stays open over 400,000 bases: the codons are cut in one pass, not by a walk from the beginning each."""
    n = 400_000 // 3
    d = spark.range(1).select(F.lit("ATGGCAGCC").alias("cds"), F.repeat(F.lit("GCA"), F.lit(n)).alias("tail"), F.lit(5).alias("cbeg"), F.lit(4).alias("cend"), F.lit("C").alias("alt"))
    start = time.time()
    r = coding.protein_change(d).select("csqn", "change", F.length("variant_protein").alias("n")).first()
    assert (r.csqn, r.change, r.n) == ("Frameshift", "A3Sfs*?", 3 + n)
    assert time.time() - start < 20


def test_first_change(spark):
    """Codons that read alike are passed over, near and far; one protein that begins with the other gives null."""
    rows = [("GCAGCAAAA", "GCTGCAAAC", 3), ("GCA" * 300 + "AAA", "GCT" * 300 + "AAC", 301), ("GCA" * 300, "GCT" * 299, None), ("", "GCA", None), ("GCAG", "GCAT", None), (None, "GCA", None)]
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, a string, b string").select("i", sequence.first_change(F.col("a"), F.col("b")).alias("d"), sequence.first_stop(F.col("a")).alias("s")).orderBy("i").collect()
    assert [r.d for r in got] == [r[2] for r in rows] and [r.s for r in got] == [0, 0, 0, 0, 0, None]
