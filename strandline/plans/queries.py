"""Registered queries over the derived genome, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, hgvs, sequence
from ..operators import annotate, coding, genes, genome, intervals, levels, lookup, records
from .fixture import SQL, Genome

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, bare: bool = False) -> Callable:
    """Registers a function of a Genome; sql follows the fixture's views, unless bare."""

    def of(f: Callable[[Genome], DataFrame]) -> Callable[[Genome], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Genome.of(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql if bare else SQL + sql
        return f

    return of


KEYS = ("vid", "tid")


@query("SELECT vid, tid, contig_id, pos, ref, alt, cpos, aa_pos, aa_ref, aa_alt, csqn FROM consequence")
def gsnv_consequence(g: Genome) -> DataFrame:
    out = annotate.snv_consequence(annotate.on_transcripts(g.variants, g.transcripts))
    return out.select("vid", "tid", "contig_id", "pos", "ref", "alt", F.when(F.col("aa_pos").isNotNull(), F.col("cpos").try_cast("bigint")).alias("cpos"), "aa_pos", "aa_ref", "aa_alt", "csqn")


@query("SELECT contig_id, length(seq) AS len, length(seq) - length(replace(seq, 'A', '')) AS n_a, length(seq) - length(replace(seq, 'C', '')) AS n_c, length(seq) - length(replace(seq, 'G', '')) AS n_g, length(seq) - length(replace(seq, 'T', '')) AS n_t FROM contig")
def contig_stats(g: Genome) -> DataFrame:
    count = lambda b: (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("bigint").alias(f"n_{b.lower()}")
    return g.contigs.select("contig_id", "len", *map(count, "ACGT"))


@query("SELECT contig_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5, md5(seq) AS seq_md5 FROM contig")
def revcomp_contig(g: Genome) -> DataFrame:
    return g.contigs.select("contig_id", F.md5(sequence.reverse_complement(F.col("seq"))).alias("rc_md5"), F.md5("seq").alias("seq_md5"))


@query("SELECT tid, contig_id, strand, beg, tend, cds_beg, cds_end, nex AS n_exons FROM tx")
def tx_build(g: Genome) -> DataFrame:
    return g.transcripts.select("tid", "contig_id", "strand", "beg", "tend", "cds_beg", "cds_end", F.size("exons").cast("bigint").alias("n_exons"))


@query("SELECT tid, CASE WHEN strand = '+' THEN i + 1 ELSE nex - i END AS exon, eb AS beg, ee AS end_pos, lag(ee) OVER (PARTITION BY tid ORDER BY i) AS previous_end FROM exon")
def exon_explode(g: Genome) -> DataFrame:
    e = g.transcripts.select("tid", "strand", F.size("exons").alias("n"), "exons", F.posexplode("exons").alias("i", "e"))
    number = F.when(F.col("strand") == "+", F.col("i") + 1).otherwise(F.col("n") - F.col("i"))
    return e.select("tid", number.cast("bigint").alias("exon"), F.col("e.beg").alias("beg"), F.col("e.end").alias("end_pos"), F.get("exons", F.col("i") - 1)["end"].alias("previous_end"))


@query("SELECT tid, gb, ge, cprev FROM segment")
def segment_cumulative(g: Genome) -> DataFrame:
    return g.transcripts.select("tid", F.inline("segs")).select("tid", "gb", "ge", "cprev")


@query("SELECT tid, sum(ee - eb + 1)::BIGINT AS tlen, sum(greatest(0, least(ee, cds_end) - greatest(eb, cds_beg) + 1))::BIGINT AS cdslen FROM exon GROUP BY tid")
def tlen_cdslen(g: Genome) -> DataFrame:
    return g.transcripts.select("tid", coords.total_length(F.col("exons")).alias("tlen"), coords.total_length(F.col("segs"), "gb", "ge").alias("cdslen"))


@query("SELECT contig_id, tid, tlen FROM (SELECT contig_id, tid, nex * elen AS tlen, row_number() OVER (PARTITION BY contig_id, tid // 4 ORDER BY nex * elen DESC, tid) AS r FROM tx) WHERE r = 1")
def longest_tx_per_gene(g: Genome) -> DataFrame:
    t = genes.gene_table(g.named_layout)
    one = F.filter("transcripts", lambda x: x["tid"] == F.col("longest"))[0]
    return t.select("contig_id", F.col("longest").alias("tid"), one["length"].alias("tlen"))


@query("SELECT tid, length(cds) AS cds_len, md5(cds) AS cds_md5 FROM cds")
def cds_sequence(g: Genome) -> DataFrame:
    return g.transcripts.select("tid", F.length("cds").cast("bigint").alias("cds_len"), F.md5("cds").alias("cds_md5"))


@query("""SELECT tid, CASE WHEN strpos(p, '*') > 0 THEN substr(p, 1, strpos(p, '*')) ELSE p END AS protein FROM (
 SELECT tid, string_agg(a.aa, '' ORDER BY i) AS p FROM cds, range(0, 200) r(i) JOIN aa a ON true WHERE i < length(cds) // 3 AND a.codon = substr(cds, 3 * i + 1, 3) GROUP BY tid)""")
def cds_translate(g: Genome) -> DataFrame:
    return g.transcripts.select("tid", sequence.translate(F.col("cds")).alias("protein"))


@query("SELECT vid, tid, pos FROM pair")
def snv_tx_overlap(g: Genome) -> DataFrame:
    return annotate.on_transcripts(g.variants, g.transcripts).select("vid", "tid", "pos")


SPAN = "SELECT *, pos + qty * 20 AS till FROM snv"


@query(f"SELECT s.vid, t.tid FROM ({SPAN}) s JOIN tx t ON s.contig_id = t.contig_id AND t.beg <= s.till AND t.tend >= s.pos")
def span_tx_overlap(g: Genome) -> DataFrame:
    spans = g.places.select("vid", "contig_id", "pos", (F.col("pos") + F.col("qty") * 20).alias("till"))
    t = g.layout.select("tid", "contig_id", "beg", "tend")
    return intervals.pairs_by_lists(spans, t, "contig_id", ("pos", "till"), ("beg", "tend")).select("vid", "tid")


@query("SELECT s.vid, t.tid FROM snv s JOIN tx t ON s.contig_id = t.contig_id AND t.beg - 100 <= s.pos AND t.tend + 100 >= s.pos")
def flank_overlap(g: Genome) -> DataFrame:
    return intervals.range_join(g.variants, g.transcripts, "contig_id", ("pos", "pos"), ("beg", "tend"), flank=100).select("vid", "tid")


@query("SELECT s.vid, t.tid FROM snv s JOIN tx t ON s.contig_id = t.contig_id AND s.pos BETWEEN t.cds_beg AND t.cds_end")
def cds_overlap(g: Genome) -> DataFrame:
    v, t = g.places.select("vid", "contig_id", "pos"), g.layout.select("tid", "contig_id", "cds_beg", "cds_end")
    return intervals.range_join(v, t, "contig_id", ("pos", "pos"), ("cds_beg", "cds_end")).select("vid", "tid")


def _near(edge: str, test: str, best: str) -> str:
    return f"""SELECT s.vid, (SELECT min(t.tid) FROM tx t WHERE t.contig_id = s.contig_id AND t.{edge} = n.e) AS near_tid, abs(s.pos - n.e) AS near_dist
FROM snv s LEFT JOIN (SELECT p.contig_id, p.pos, {best}(t.{edge}) AS e FROM (SELECT DISTINCT contig_id, pos FROM snv) p JOIN tx t ON t.contig_id = p.contig_id AND t.{edge} {test} p.pos GROUP BY 1, 2) n ON n.contig_id = s.contig_id AND n.pos = s.pos"""


def _nearest(g: Genome, upstream: bool) -> DataFrame:
    found = intervals.nearest(g.variants, g.transcripts, "contig_id", "pos", "beg", "tend", "tid", upstream, width=200)
    return found.select("vid", F.col("near_name").alias("near_tid"), "near_dist")


@query(_near("tend", "<", "max"))
def nearest_upstream(g: Genome) -> DataFrame:
    return _nearest(g, True)


@query(_near("beg", ">", "min"))
def nearest_downstream(g: Genome) -> DataFrame:
    return _nearest(g, False)


@query(f"""SELECT s.vid, 'intergenic_between_' || coalesce('T' || u.near_tid || '(' || u.near_dist || '_bp_upstream)', '5''-telomere') || '_and_' || coalesce('T' || d.near_tid || '(' || d.near_dist || '_bp_downstream)', '3''-telomere') AS region
FROM snv s JOIN ({_near("tend", "<", "max")}) u USING (vid) JOIN ({_near("beg", ">", "min")}) d USING (vid) WHERE NOT EXISTS (SELECT 1 FROM tx t WHERE t.contig_id = s.contig_id AND s.pos BETWEEN t.beg AND t.tend)""")
def intergenic_desc(g: Genome) -> DataFrame:
    v, t = g.variants.select("vid", "contig_id", "pos"), g.transcripts.select("tid", "contig_id", "beg", "tend")
    outside = intervals.outside(v, t, "contig_id", "pos", ("beg", "tend"))
    args = ("contig_id", "pos", "beg", "tend", "tid")
    up = intervals.nearest(outside, t, *args, True, width=200).withColumnsRenamed({"near_name": "u", "near_dist": "ud"})
    both = intervals.nearest(up, t, *args, False, width=200)
    side = lambda name, dist, word: F.concat(F.lit("T"), F.col(name).cast("string"), F.lit("("), F.col(dist).cast("string"), F.lit(f"_bp_{word})"))
    text = F.concat(F.lit("intergenic_between_"), F.coalesce(side("u", "ud", "upstream"), F.lit("5'-telomere")), F.lit("_and_"), F.coalesce(side("near_name", "near_dist", "downstream"), F.lit("3'-telomere")))
    return both.select("vid", text.alias("region"))


@query("SELECT vid, tid, part, CAST(exon AS INT) AS exon, utr, splice, codon, edge FROM site")
def site_region(g: Genome) -> DataFrame:
    s = coords.site(F.col("pos"), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"), F.lit(True))
    return annotate.on_transcripts(g.variants, g.transcripts).select(*KEYS, s.alias("s")).select(*KEYS, "s.*")


@query("SELECT s.vid, t.tid, CASE t.strand WHEN '+' THEN s.pos - t.beg ELSE t.tend - s.pos END AS dist2tss FROM snv s JOIN tx t ON s.contig_id = t.contig_id AND CASE t.strand WHEN '+' THEN s.pos - t.beg ELSE t.tend - s.pos END BETWEEN -100 AND 0")
def promoter_site(g: Genome) -> DataFrame:
    plus = F.col("strand") == "+"
    t = g.transcripts.withColumn("p_beg", F.when(plus, F.col("beg") - 100).otherwise(F.col("tend"))).withColumn("p_end", F.when(plus, F.col("beg")).otherwise(F.col("tend") + 100))
    hit = intervals.range_join(g.variants, t, "contig_id", ("pos", "pos"), ("p_beg", "p_end"))
    return hit.select("vid", "tid", F.when(plus, F.col("pos") - F.col("beg")).otherwise(F.col("tend") - F.col("pos")).alias("dist2tss"))


@query(f"SELECT s.vid, t.tid, round(100.0 * (least(s.till, pe) - greatest(s.pos, pb) + 1) / (s.till - s.pos + 1), 2) AS promoter_pct FROM ({SPAN}) s JOIN (SELECT *, CASE strand WHEN '+' THEN beg - 100 ELSE tend END AS pb, CASE strand WHEN '+' THEN beg ELSE tend + 100 END AS pe FROM tx) t ON s.contig_id = t.contig_id AND pb <= s.till AND pe >= s.pos")
def promoter_overlap_pct(g: Genome) -> DataFrame:
    plus = F.col("strand") == "+"
    t = g.transcripts.withColumn("p_beg", F.when(plus, F.col("beg") - 100).otherwise(F.col("tend"))).withColumn("p_end", F.when(plus, F.col("beg")).otherwise(F.col("tend") + 100))
    spans = g.variants.withColumn("till", F.col("pos") + F.col("qty") * 20)
    hit = intervals.range_join(spans, t, "contig_id", ("pos", "till"), ("p_beg", "p_end"), width=200)
    share = 100.0 * (F.least("till", "p_end") - F.greatest("pos", "p_beg") + 1) / (F.col("till") - F.col("pos") + 1)
    return hit.select("vid", "tid", F.round(share, 2).alias("promoter_pct"))


CDNA_SQL = """SELECT p.vid, p.tid, CASE WHEN inside IS NOT NULL THEN inside || ''
 WHEN lead > 0 THEN '1-' || lead WHEN tail > 0 THEN size || '+' || tail
 WHEN b < a THEN idx || '+' || b ELSE (idx + 1) || '-' || a END AS cpos FROM (
 SELECT p.vid, p.tid, max(c.cpos) AS inside, max(s.cdslen) AS size,
  max(CASE p.strand WHEN '+' THEN s.first - p.pos ELSE p.pos - s.last END) AS lead, max(CASE p.strand WHEN '+' THEN p.pos - s.last ELSE s.first - p.pos END) AS tail,
  min(CASE p.strand WHEN '+' THEN CASE WHEN g.ge < p.pos THEN p.pos - g.ge END ELSE CASE WHEN g.gb > p.pos THEN g.gb - p.pos END END) AS b,
  min(CASE p.strand WHEN '+' THEN CASE WHEN g.gb > p.pos THEN g.gb - p.pos END ELSE CASE WHEN g.ge < p.pos THEN p.pos - g.ge END END) AS a,
  max(CASE WHEN (p.strand = '+' AND g.ge < p.pos) OR (p.strand = '-' AND g.gb > p.pos) THEN g.cprev + g.ge - g.gb + 1 END) AS idx
 FROM pair p JOIN segment g ON g.tid = p.tid JOIN (SELECT tid, min(gb) AS first, max(ge) AS last, sum(ge - gb + 1)::BIGINT AS cdslen FROM segment GROUP BY tid) s ON s.tid = p.tid
 LEFT JOIN cbase c ON c.vid = p.vid AND c.tid = p.tid GROUP BY 1, 2) p"""


@query(CDNA_SQL)
def cdna_position(g: Genome) -> DataFrame:
    p = coords.cdna(F.col("pos"), F.col("segs"), F.col("strand"))
    return annotate.on_transcripts(g.variants, g.transcripts).select(*KEYS, coords.position_text(p).alias("cpos"))


@query("SELECT vid, tid, cpos, pos AS back FROM cbase JOIN pair USING (vid, tid)")
def tnuc2gnuc_roundtrip(g: Genome) -> DataFrame:
    p = annotate.on_transcripts(g.variants, g.transcripts).withColumn("c", coords.cdna(F.col("pos"), F.col("segs"), F.col("strand"))).where("c.offset = 0")
    return p.select(*KEYS, F.col("c.pos").alias("cpos"), coords.genomic(F.col("c.pos"), F.col("segs"), F.col("strand")).alias("back"))


@query("""SELECT tid, 1 + (tid * 7) % cdslen AS cpos, s.cprev IS NOT NULL AS found, CASE strand WHEN '+' THEN gb + (1 + (tid * 7) % cdslen) - cprev - 1 ELSE ge - ((1 + (tid * 7) % cdslen) - cprev - 1) END AS pos, substr(cds, 1 + (tid * 7) % cdslen, 1) AS ref
FROM (SELECT tid, length(cds) AS cdslen, cds FROM cds) JOIN segment s USING (tid) WHERE 1 + (tid * 7) % cdslen BETWEEN cprev + 1 AND cprev + ge - gb + 1""")
def csnv_annotate(g: Genome) -> DataFrame:
    """cDNA positions, as if from queries, to genomic ones."""
    t = g.transcripts.withColumn("cpos", (1 + (F.col("tid") * 7) % F.length("cds")).cast("bigint"))
    pos = coords.genomic(F.col("cpos"), F.col("segs"), F.col("strand"))
    return t.select("tid", "cpos", pos.isNotNull().alias("found"), pos.alias("pos"), F.substr("cds", F.col("cpos").cast("int"), F.lit(1)).alias("ref"))


@query("SELECT vid, tid, qty, cpos FROM cbase JOIN pair USING (vid, tid) WHERE CASE WHEN qty % 3 = 0 THEN alt ELSE ref END = ref")
def ref_mismatch_filter(g: Genome) -> DataFrame:
    """Queries that claim a wrong reference base in a third of cases go."""
    p = annotate.on_transcripts(g.variants, g.transcripts).withColumn("c", coords.cdna(F.col("pos"), F.col("segs"), F.col("strand"))).where("c.offset = 0")
    claimed = F.when(F.col("qty") % 3 == 0, F.col("alt")).otherwise(F.col("ref"))
    return p.where(claimed == F.col("ref")).select(*KEYS, "qty", F.col("c.pos").alias("cpos"))


_TABLE = ", ".join(f"('{a}', '{c}', {i})" for a, codons in sequence.CODONS_OF.items() for i, c in enumerate(codons))


@query(f"""SELECT vid, tid, best, apart, coalesce(others, '') AS others FROM (
SELECT vid, tid, max(CASE WHEN r = 1 THEN codon END) AS best, max(CASE WHEN r = 1 THEN d END) AS apart, string_agg(codon, ',' ORDER BY r) FILTER (WHERE r > 1) AS others FROM (
 SELECT *, row_number() OVER (PARTITION BY vid, tid ORDER BY d, ord) AS r FROM (
  SELECT c.vid, c.tid, k.codon, k.ord, CAST(substr(k.codon, 1, 1) <> substr(codon0, 1, 1) AS INT) + CAST(substr(k.codon, 2, 1) <> substr(codon0, 2, 1) AS INT) + CAST(substr(k.codon, 3, 1) <> substr(codon0, 3, 1) AS INT) AS d
  FROM consequence c JOIN (VALUES {_TABLE}) k(aa, codon, ord) ON k.aa = c.aa_alt WHERE c.csqn IN ('Missense', 'Nonsense') AND k.codon <> codon0)) GROUP BY 1, 2)""")
def psnv_candidates(g: Genome) -> DataFrame:
    out = annotate.snv_consequence(annotate.on_transcripts(g.variants, g.transcripts)).where(F.col("csqn").isin("Missense", "Nonsense"))
    return annotate.protein_candidates(out).select(*KEYS, "best", "apart", "others")


@query("SELECT tid, count(*)::BIGINT AS n, min(i)::BIGINT AS first FROM (SELECT tid, i FROM cds, range(0, 200) r(i) WHERE i + 3 <= length(cds) // 3 AND substr(cds, 3 * i + 1, 3) IN (SELECT codon FROM aa WHERE aa = 'S') AND substr(cds, 3 * i + 7, 3) IN (SELECT codon FROM aa WHERE aa = 'T')) GROUP BY tid")
def motif_search(g: Genome) -> DataFrame:
    """Where SxT begins, x for any amino acid, by codon; stops are read through."""
    t = g.transcripts.where("length(cds) >= 9")
    aa = lambda i: sequence.codon_aa(F.substr("cds", (3 * i + 1).cast("int"), F.lit(3)))
    hits = F.filter(F.sequence(F.lit(0).cast("bigint"), F.floor(F.length("cds") / 3) - 3), lambda i: (aa(i) == "S") & (aa(i + 2) == "T"))
    return t.select("tid", hits.alias("h")).where("size(h) > 0").select("tid", F.size("h").cast("bigint").alias("n"), F.col("h")[0].alias("first"))


def _hgvs(g: Genome) -> DataFrame:
    q = F.col("qty") % 6
    p, e = F.col("pos").cast("string"), (F.col("pos") + F.col("qty") % 5).cast("string")
    text = (
        F.when(q == 0, F.concat(F.lit("g."), p, "ref", F.lit(">"), "alt")).when(q == 1, F.concat(p, F.lit("_"), e, F.lit("del")))
        .when(q == 2, F.concat(F.lit("g."), p, F.lit("_"), (F.col("pos") + 1).cast("string"), F.lit("ins"), "alt", "ref")).when(q == 3, F.concat(F.lit("g."), p, F.lit("del"), "ref", F.lit("insAC")))
        .when(q == 4, F.concat(F.lit("g."), p, F.lit("_"), e, F.lit("dup"))).otherwise(F.concat(F.lit("g."), p, F.lit("x")))
    )
    return g.variants.withColumn("hgvs", text)


@query("""SELECT vid, CASE q WHEN 0 THEN 'SNV' WHEN 1 THEN 'DEL' WHEN 2 THEN 'INS' WHEN 3 THEN 'MNV' WHEN 4 THEN 'DUP' END AS kind, CASE WHEN q < 5 THEN pos || '' END AS beg,
 CASE WHEN q IN (1, 4) THEN (pos + qty % 5) || '' WHEN q = 2 THEN (pos + 1) || '' WHEN q < 5 THEN pos || '' END AS end_pos, CASE WHEN q IN (0, 3) THEN ref WHEN q < 5 THEN '' END AS ref, CASE q WHEN 0 THEN alt WHEN 2 THEN alt || ref WHEN 3 THEN 'AC' WHEN 1 THEN '' WHEN 4 THEN '' END AS alt
FROM (SELECT *, qty % 6 AS q FROM snv)""")
def hgvs_g_parse(g: Genome) -> DataFrame:
    return _hgvs(g).select("vid", hgvs.parse_genomic(F.col("hgvs")).alias("p")).select("vid", "p.kind", "p.beg", F.col("p.end").alias("end_pos"), "p.ref", "p.alt")


@query("SELECT vid, CASE q WHEN 0 THEN pos WHEN 1 THEN pos WHEN 2 THEN 1 WHEN 3 THEN -1 END::INT AS pos, CASE q WHEN 0 THEN 0 WHEN 1 THEN qty WHEN 2 THEN -qty WHEN 3 THEN qty END::INT AS offset_bp FROM (SELECT *, qty % 5 AS q FROM snv WHERE qty > 0)")
def pos_parse(g: Genome) -> DataFrame:
    q, p, k = F.col("qty") % 5, F.col("pos").cast("string"), F.col("qty").cast("string")
    text = F.when(q == 0, p).when(q == 1, F.concat(p, F.lit("+"), k)).when(q == 2, F.concat(F.lit("-"), k)).when(q == 3, F.concat(F.lit("*"), k)).otherwise("n/a")
    return g.variants.where("qty > 0").select("vid", hgvs.parse_position(text).alias("x")).select("vid", "x.pos", F.col("x.offset").alias("offset_bp"))


_PROTEIN_FORMS = ("p.{r}{n}{a}", "p.{r}{n}{a}fs*12", "{r}{n}", "p.??", "p.{r}{n}fs", "p.{r}{n}del", "p.{r}{n}_{a}{m}delins{a}{r}", "p.{r}{n}_{a}{m}ins{a}{a}", "p.{r}{n}delins{a}", "p.{r}{n}_{a}{m}del2", "p.{r}{n}=")


@query("""SELECT vid, tid, CASE q WHEN 0 THEN 'SNV' WHEN 1 THEN 'FS' WHEN 2 THEN 'REG' WHEN 4 THEN 'FS' WHEN 5 THEN 'DEL' WHEN 6 THEN 'MNV' WHEN 7 THEN 'INS' WHEN 8 THEN 'SNV' WHEN 9 THEN 'DEL' WHEN 10 THEN 'SNV' END AS kind, CASE WHEN q <> 3 THEN aa_pos END::INT AS beg, CASE WHEN q IN (6, 7, 9) THEN aa_pos + 1 WHEN q <> 3 THEN aa_pos END::INT AS end_pos,
 CASE WHEN q <> 3 THEN aa_ref END AS beg_aa, CASE WHEN q IN (6, 7, 9) THEN aa_alt WHEN q <> 3 THEN aa_ref END AS end_aa, CASE WHEN q IN (0, 1, 4, 8, 10) THEN aa_ref WHEN q <> 3 THEN '' END AS ref, CASE WHEN q IN (0, 1, 8) THEN aa_alt WHEN q = 6 THEN aa_alt || aa_ref WHEN q = 7 THEN aa_alt || aa_alt WHEN q = 10 THEN aa_ref WHEN q <> 3 THEN '' END AS alt, CASE WHEN q = 1 THEN 12 END::INT AS stop
FROM (SELECT *, (tid + aa_pos) % 11 AS q FROM consequence WHERE csqn = 'Missense' AND aa_ref <> '*')""")
def hgvs_p_parse(g: Genome) -> DataFrame:
    x = annotate.snv_consequence(annotate.on_transcripts(g.variants, g.transcripts)).where("csqn = 'Missense' and aa_ref <> '*'")
    parts = {"r": F.col("aa_ref"), "a": F.col("aa_alt"), "n": F.col("aa_pos").cast("string"), "m": (F.col("aa_pos") + 1).cast("string")}
    made = [F.concat(*(parts[p[1]] if p[:1] == "{" else F.lit(p) for p in re.findall(r"{.}|[^{]+", form))) for form in _PROTEIN_FORMS]
    text = F.element_at(F.array(*made), ((F.col("tid") + F.col("aa_pos")) % len(made) + 1).cast("int"))
    return x.select(*KEYS, text.alias("text")).select(*KEYS, F.inline(F.array(hgvs.parse_protein(F.col("text"))))).withColumnRenamed("end", "end_pos")


@query("SELECT event_id, CASE WHEN k = 22 THEN 'chrX' WHEN k = 23 THEN 'chrY' WHEN k IN (24, 25) THEN 'chrM' WHEN k = 26 THEN 'scaffold_1' ELSE 'chr' || (k + 1) END AS chrom, CASE WHEN k = 22 THEN 'X' WHEN k = 23 THEN 'Y' WHEN k IN (24, 25) THEN 'MT' WHEN k = 26 THEN 'scaffold_1' ELSE (k + 1) || '' END AS plain FROM (SELECT event_id, event_id % 27 AS k FROM events)", bare=True)
def chrom_normalize(g: Genome) -> DataFrame:
    k = F.col("event_id") % 27
    name = F.when(k == 25, "MT").when(k == 26, "scaffold_1").when(F.col("event_id") % 2 == 0, (k + 1).cast("string")).otherwise(F.concat(F.lit("chr"), (k + 1).cast("string")))
    e = g.read("events").withColumn("c", name)
    return e.select("event_id", hgvs.normalize_chromosome(F.col("c")).alias("chrom"), hgvs.dbsnp_chromosome(F.col("c")).alias("plain"))


def _sources(g: Genome) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, s = g.read("part"), g.read("supplier")
    t = p.select(F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("source"), F.concat(F.lit("G"), F.expr("p_partkey div 4").cast("string")).alias("gene_name"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") % 3).alias("version"))
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    text = F.when(m == 0, F.concat(F.lit("g"), (k % 900).cast("string"))).when(m == 1, F.concat(F.lit("T"), (k % 3000).cast("string"))).when(m == 2, F.concat(F.lit("t"), (k % 3000).cast("string"), F.lit("."), (k % 3).cast("string"))).otherwise(F.concat(F.lit("ID"), (k % 400).cast("string")))
    idmap = s.select(F.concat(F.lit("ID"), F.col("s_suppkey").cast("string")).alias("synonym"), F.concat(F.lit("G"), (F.col("s_suppkey") % 70).cast("string")).alias("canonical"))
    return g.read("orders").select(k.alias("qid"), text.alias("tok")), t, idmap


_CASCADE = """WITH t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, 'G' || p_partkey // 4 AS gene_name, 'T' || p_partkey AS name, p_size % 3 AS version FROM part),
q AS (SELECT o_orderkey AS qid, CASE o_orderkey % 4 WHEN 0 THEN 'G' || o_orderkey % 900 WHEN 1 THEN 'T' || o_orderkey % 3000 WHEN 2 THEN 'T' || o_orderkey % 3000 || '.' || o_orderkey % 3 ELSE 'ID' || o_orderkey % 400 END AS tok FROM orders),
m AS (SELECT 'ID' || s_suppkey AS synonym, 'G' || s_suppkey % 70 AS canonical FROM supplier),
f AS (SELECT DISTINCT q.*, t.*, 1 AS way FROM q JOIN t ON tok = gene_name UNION SELECT DISTINCT q.*, t.*, 2 FROM q JOIN t ON split_part(tok, '.', 1) = name {strict} UNION SELECT DISTINCT q.*, t.*, 3 FROM q JOIN m ON tok = synonym JOIN t ON canonical = gene_name)
SELECT qid, tok, source, gene_name, name, version, way FROM (SELECT *, min(way) OVER (PARTITION BY qid, source) AS w FROM f) WHERE way = w"""


@query(_CASCADE.format(strict=""), bare=True)
def gene_lookup_cascade(g: Genome) -> DataFrame:
    return lookup.cascade(*_sources(g))


@query(_CASCADE.format(strict="AND (tok NOT LIKE '%.%' OR split_part(tok, '.', 2) = version || '')"), bare=True)
def strict_version(g: Genome) -> DataFrame:
    return lookup.cascade(*_sources(g), strict_version=True)


def _deletions(g: Genome) -> DataFrame:
    """A deletion of one to six bases at each variant."""
    return g.variants.withColumn("till", F.col("pos") + F.col("qty") % 6).where("till < len").select("vid", "contig_id", "pos", "till")


_DELETIONS = "(SELECT s.*, seq, pos + qty % 6 AS till FROM snv s JOIN contig USING (contig_id) WHERE pos + qty % 6 < length(seq))"


def _until(test: str) -> str:
    """SQL of the first j from 0 that passes the test: the first 64 are tried before all."""
    first = lambda n: f"list_position([{test} for j in range(0, {n})], true)"
    return f"(coalesce(nullif({first(64)}, 0), {first('length(seq) + 1')}) - 1)::INT"


@query(f"SELECT vid, {_until('till + 1 + j > length(seq) OR substr(seq, pos + j, 1) <> substr(seq, till + 1 + j, 1)')} AS roll FROM {_DELETIONS} d")
def del_right_align(g: Genome) -> DataFrame:
    return annotate.align_deletions(_deletions(g), g.chunks).select("vid", F.col("right").alias("roll"))


@query(f"SELECT vid, {_until('pos - 1 - j < 1 OR substr(seq, till - j, 1) <> substr(seq, pos - 1 - j, 1)')} AS roll FROM {_DELETIONS} d")
def del_left_align(g: Genome) -> DataFrame:
    return annotate.align_deletions(_deletions(g), g.chunks).select("vid", F.col("left").alias("roll"))


@query(f"""SELECT vid, t AS ins, CASE WHEN p >= n AND substr(seq, p - n + 1, n) = t THEN (CASE WHEN n = 1 THEN '' ELSE (p - n + 1) || '_' END) || p || 'dup' || t ELSE p || '_' || (p + 1) || 'ins' || t END AS id FROM (
 SELECT *, pos + k AS p, substr(ins || ins, CAST(k % n AS INT) + 1, CAST(n AS INT)) AS t FROM (
  SELECT *, {_until("pos + 1 + j > length(seq) OR CASE WHEN j < n THEN substr(ins, j + 1, 1) ELSE substr(seq, pos + 1 + j - n, 1) END <> substr(seq, pos + 1 + j, 1)")} AS k FROM (
   SELECT s.*, seq, 1 + qty % 3 AS n, substr(seq, pos, CAST(1 + qty % 3 AS INT)) AS ins FROM snv s JOIN contig USING (contig_id) WHERE pos + 4 <= length(seq))))""")
def ins_dup_detect(g: Genome) -> DataFrame:
    """An insertion, shifted right as far as it goes, that repeats the bases before it is a duplication."""
    v = genome.bases_at(g.places.where("pos + 4 <= len"), g.chunks_once, three=(0, 3), __fore=(1, 64), __back=(-63, 64))
    v = v.select("vid", "contig_id", "pos", F.substr("three", F.lit(1), (1 + F.col("qty") % 3).cast("int")).alias("ins"), "__fore", "__back")
    x = annotate.align_insertions(v, g.chunks_once, before=3)
    x = x.select("vid", "contig_id", (F.col("pos") + F.col("right")).alias("pos"), annotate.turned(F.col("ins"), F.col("right")).alias("ins"), "before")
    n, s = F.length("ins"), lambda d: (F.col("pos") + d).cast("string")
    dup = F.right("before", n) == F.col("ins")
    return x.select("vid", "ins", F.when(dup, F.concat(F.when(n == 1, "").otherwise(F.concat(s(1 - n), F.lit("_"))), s(0), F.lit("dup"), "ins")).otherwise(F.concat(s(0), F.lit("_"), s(1), F.lit("ins"), "ins")).alias("id"))


_TRIM = "(SELECT vid, pos, substr(seq, pos, 6) AS r, substr(seq, pos, 2) || alt || substr(seq, pos + 4, 2) AS a FROM snv JOIN contig USING (contig_id) WHERE pos + 6 <= length(seq))"


@query(f"""SELECT vid, substr(r, h + 1, length(r) - h - t) AS ref, substr(a, h + 1, length(a) - h - t) AS alt, h::INT AS head FROM (
 SELECT *, (SELECT min(j) FROM range(0, 6) x(j) WHERE j >= least(length(r), length(a)) - h OR substr(r, length(r) - j, 1) <> substr(a, length(a) - j, 1)) AS t FROM (
  SELECT *, (SELECT min(j) FROM range(0, 7) x(j) WHERE j >= length(a) OR substr(r, j + 1, 1) <> substr(a, j + 1, 1)) AS h FROM {_TRIM} z) y) w""")
def mnv_trim_reduce(g: Genome) -> DataFrame:
    v = g.around(six=(0, 6)).where("pos + 6 <= len")
    s = lambda d, n: F.substr("six", F.lit(d + 1), F.lit(n))
    return v.select("vid", sequence.trim(F.col("six"), F.concat(s(0, 2), "alt", s(4, 2))).alias("x")).select("vid", "x.*")


_DBSNP = "(SELECT contig_id, pos, ref, list_sort(list(DISTINCT alt)) AS alts, min('rs' || vid) AS id FROM snv WHERE qty % 7 = 0 GROUP BY 1, 2, 3)"


@query(f"SELECT s.vid, d.id FROM snv s LEFT JOIN {_DBSNP} d ON d.contig_id = s.contig_id AND d.pos = s.pos AND d.ref = s.ref AND list_contains(d.alts, s.alt)")
def dbsnp_snv(g: Genome) -> DataFrame:
    v = g.variants
    known = v.where("qty % 7 = 0").groupBy("contig_id", "pos", "ref").agg(F.collect_set("alt").alias("alts"), F.min(F.concat(F.lit("rs"), "vid")).alias("id"))
    return v.join(known, ["contig_id", "pos", "ref"], "left").select("vid", F.when(F.array_contains("alts", F.col("alt")), F.col("id")).alias("id"))


@query("SELECT s.vid, string_agg(f.name, ',' ORDER BY f.name) AS features FROM snv s LEFT JOIN (SELECT contig_id, 1 + (c_custkey * 31) % length(seq) AS fb, 1 + (c_custkey * 31) % length(seq) + c_custkey % 400 AS fe, c_name AS name FROM (SELECT *, 1 + c_custkey % n AS contig_id FROM customer, nc) JOIN contig USING (contig_id) WHERE length(seq) > 0) f ON f.contig_id = s.contig_id AND s.pos BETWEEN fb AND fe GROUP BY s.vid")
def feature_overlap(g: Genome) -> DataFrame:
    c = g.read("customer").crossJoin(F.broadcast(g.number))  # one row
    c = c.withColumn("contig_id", 1 + F.col("c_custkey") % F.col("n_contigs")).join(g.sizes, "contig_id").where("len > 0").withColumn("fb", 1 + (F.col("c_custkey") * 31) % F.col("len"))
    f = c.select("contig_id", "fb", (F.col("fb") + F.col("c_custkey") % 400).alias("fe"), F.col("c_name").alias("name"))
    hits = intervals.range_join(g.variants, f, "contig_id", ("pos", "pos"), ("fb", "fe")).groupBy("vid").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("features"))
    return g.variants.select("vid").distinct().join(hits, "vid", "left")


@query("""SELECT a.tid AS tid1, b.tid AS tid2, a.k AS codon1, (b.cpos + 2) // 3 AS codon2, min(a.g) AS gpos FROM (
 SELECT t.tid, t.contig_id, k, CASE t.strand WHEN '+' THEN gb + (3 * k - 2 + o) - cprev - 1 ELSE ge - (3 * k - 2 + o - cprev - 1) END AS g
 FROM (SELECT tid, contig_id, strand, unnest(range(1, length(cds) // 3 + 1)) AS k FROM tx JOIN (SELECT tid, cds FROM cds) USING (tid)) t, range(0, 3) r(o) JOIN segment s ON true WHERE s.tid = t.tid AND 3 * k - 2 + o BETWEEN cprev + 1 AND cprev + ge - gb + 1) a
JOIN (SELECT tid, contig_id, gb, ge, cprev, strand FROM segment) s2 ON s2.contig_id = a.contig_id AND a.g BETWEEN s2.gb AND s2.ge AND s2.tid <> a.tid
JOIN LATERAL (SELECT s2.tid AS tid, s2.cprev + CASE s2.strand WHEN '+' THEN a.g - s2.gb ELSE s2.ge - a.g END + 1 AS cpos) b ON true
JOIN cds ON cds.tid = b.tid WHERE (b.cpos + 2) // 3 <> a.k AND ((b.cpos + 2) // 3) * 3 <= length(cds.cds) GROUP BY 1, 2, 3, 4""")
def codonsearch(g: Genome) -> DataFrame:
    """Codons of other transcripts that share a base with a codon of each transcript, under another number."""
    return levels.shared_codons(g.transcripts)


@query(f"SELECT s.vid, count(t.tid)::BIGINT AS n, CASE WHEN count(t.tid) <= 5 THEN string_agg(t.tid || '', ',' ORDER BY t.tid) END AS names FROM ({SPAN}) s JOIN tx t ON t.contig_id = s.contig_id AND t.beg >= s.pos AND t.tend <= s.till GROUP BY s.vid")
def spanned_genes(g: Genome) -> DataFrame:
    spans = g.variants.withColumn("till", F.col("pos") + F.col("qty") * 20)
    hit = intervals.range_join(spans, g.transcripts, "contig_id", ("pos", "till"), ("beg", "tend"), width=200).where("beg >= pos and tend <= till")
    return hit.groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("tid")).alias("l")).select("vid", "n", F.when(F.col("n") <= 5, F.array_join("l", ",")).alias("names"))


@query("SELECT vid, CASE WHEN count(DISTINCT csqn) = 1 THEN max(csqn) ELSE 'Multi:' || string_agg(DISTINCT csqn, ',' ORDER BY csqn) END AS csqn FROM consequence GROUP BY vid")
def csqn_summary(g: Genome) -> DataFrame:
    return annotate.collapse(annotate.snv_consequence(annotate.on_transcripts(g.variants, g.transcripts)), "vid")


@query("SELECT vid, string_agg('T' || tid || chr(9) || strand || chr(9) || csqn, chr(9) || '|||' || chr(9) ORDER BY tid) AS line FROM consequence GROUP BY vid UNION ALL SELECT vid, '.' || chr(9) || '.' || chr(9) || 'no_valid_transcript_found' FROM snv WHERE vid NOT IN (SELECT vid FROM pair)")
def oneline_render(g: Genome) -> DataFrame:
    """All records of a query in one line; queries without any get their own."""
    v = g.variants
    x = annotate.snv_consequence(annotate.on_transcripts(v, g.transcripts))
    record = F.concat_ws("\t", F.concat(F.lit("T"), F.col("tid").cast("string")), "strand", "csqn")
    lines = x.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("tid", record.alias("r")))).alias("l")).select("vid", F.array_join("l.r", "\t|||\t").alias("line"))
    return v.select("vid").join(lines, "vid", "left").withColumn("line", F.coalesce("line", F.lit(".\t.\tno_valid_transcript_found")))


@query("SELECT vid, tid, elen * nex AS tlen FROM (SELECT *, row_number() OVER (PARTITION BY vid, contig_id, tid // 4 ORDER BY elen * nex DESC, tid) AS r FROM pair) WHERE r = 1")
def longest_overlap_tx(g: Genome) -> DataFrame:
    pairs = annotate.on_transcripts(g.variants, g.named.select("tid", "source", "contig_id", "gene_name", "beg", "tend", "exons"))
    return genes.longest_only(pairs).select("vid", "tid", genes.transcript_length().alias("tlen"))


@query("SELECT csqn, count(*)::BIGINT AS n, count(DISTINCT tid)::BIGINT AS n_tx FROM consequence GROUP BY csqn")
def csqn_counts(g: Genome) -> DataFrame:
    x = annotate.snv_consequence(annotate.on_transcripts(g.variants, g.transcripts))
    return x.groupBy("csqn").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tid").alias("n_tx"))


def _read(s: str) -> str:
    """SQL of all amino acids of s."""
    base = lambda k: f"(strpos('TCAG', substr({s}, 3 * i + {k}, 1)) - 1)"
    return f"array_to_string([substr('{sequence.STANDARD_CODE}', CAST(16 * {base(1)} + 4 * {base(2)} + {base(3)} + 1 AS INT), 1) for i in range(0, length({s}) // 3)], '')"


def _apart(a: str, b: str) -> str:
    """SQL of the place where two strings first differ; null if one begins with the other."""
    return f"list_position([substr({a}, CAST(i AS INT), 1) <> substr({b}, CAST(i AS INT), 1) for i in range(1, least(length({a}), length({b})) + 1)], true)"


#: Edits at every variant: the last base replaced, the new bases, and whether they go between pos and till.
_EDITS = {
    "deletion": ("pos + qty % 6", "''", "false"),
    "insertion": ("pos + 1", "substr(seq, CAST(pos + 9 AS INT), CAST(2 + qty % 3 AS INT))", "true"),
    "block": ("pos + 3", "substr(seq, CAST(pos + 7 AS INT), CAST(3 + qty % 3 AS INT))", "false"),
}


def _near_genes(g: Genome) -> DataFrame:
    """places on contigs that have transcripts; an edit of a coding sequence lies on no other."""
    return g.places.join(g.layout.select("contig_id").distinct(), "contig_id", "left_semi")


def _edits(g: Genome, kind: str) -> DataFrame:
    till, alt, between = _EDITS[kind]
    v = genome.bases_at(_near_genes(g).where("pos + 20 <= len"), g.chunks_once, after=(0, 20))
    alt = alt.replace("seq", "after").replace("pos", "1")
    v = v.select("vid", "contig_id", "pos", F.expr(till).alias("till"), F.expr(alt).alias("alt"), F.expr(between).alias("between"))
    return coding.on_coding(v, g.transcripts_once.select("tid", "contig_id", "strand", "beg", "tend", "segs", "cds", "tail"))


_READINGS = f"""made AS (SELECT *, (cbeg + 2) // 3 AS one, (cend + 2) // 3 AS last, substr(cds, 1, cbeg - 1) || alt || substr(cds, cend + 1) AS new_cds, (length(alt) - (cend - cbeg + 1)) % 3 = 0 AS level FROM edit),
prot AS (SELECT *, {_read("cds")} AS p, {_read("new_cds")} AS q, {_read("(new_cds || tail)")} AS q_on, {_read("(cds || tail)")} AS p_on FROM made),
-- both readings from the first codon touched
readings AS (SELECT *, substr(p_on, one) AS was, substr(q_on, one) AS is_, substr(p, one, last - one + 1) AS o, substr(q, one, last - one + 1 + (length(alt) - (cend - cbeg + 1)) // 3) AS w FROM prot),
shift AS (SELECT *, {_apart("was", "is_")} AS a, strpos(is_, '*') AS stop FROM readings) """


def _edit_sql(kind: str) -> str:
    till, alt, between = _EDITS[kind]
    return f""", v AS (SELECT vid, contig_id, pos, {till} AS till, {alt} AS alt FROM snv JOIN contig USING (contig_id) WHERE pos + 20 <= length(seq)),
edit0 AS (SELECT v.vid, g.tid, g.strand, CASE g.strand WHEN '+' THEN cprev + v.pos - gb + 1 ELSE cprev + ge - v.till + 1 END AS lo, CASE g.strand WHEN '+' THEN cprev + v.till - gb + 1 ELSE cprev + ge - v.pos + 1 END AS hi,
  CASE g.strand WHEN '+' THEN alt ELSE reverse(translate(alt, 'ACGT', 'TGCA')) END AS alt FROM v JOIN segment g ON g.contig_id = v.contig_id AND v.pos >= gb AND v.till <= ge),
edit AS (SELECT e.vid, e.tid, {'hi' if between == 'true' else 'lo'} AS cbeg, {'lo' if between == 'true' else 'hi'} AS cend, alt, cds, tail FROM edit0 e JOIN cds USING (tid) JOIN tail USING (tid)),
{_READINGS}"""


_SHIFTED = "CASE WHEN a IS NULL OR a = 0 OR (stop > 0 AND stop < a) THEN '(=)' ELSE substr(was, a, 1) || (one + a - 1) || substr(is_, a, 1) || 'fs*' || CASE WHEN stop > 0 THEN (stop - a + 1) || '' ELSE '?' END END"


@query(_edit_sql("deletion") + f"SELECT vid, tid, {_SHIFTED} AS change, CASE WHEN a IS NULL OR a = 0 OR (stop > 0 AND stop < a) THEN 'Synonymous' ELSE 'Frameshift' END AS csqn FROM shift WHERE NOT level")
def del_frameshift(g: Genome) -> DataFrame:
    x = _edits(g, "deletion").where("(cend - cbeg + 1) % 3 <> 0")
    return coding.protein_change(x).select(*KEYS, "change", "csqn")


_DELETED = """, cut AS (SELECT *, CASE WHEN w = '' THEN one WHEN right(o, 1) = w THEN one WHEN left(o, 1) = w THEN one + 1 END AS b, CASE WHEN w = '' THEN last WHEN right(o, 1) = w THEN last - 1 WHEN left(o, 1) = w THEN last END AS e FROM shift WHERE level),
rolled AS (SELECT *, (SELECT min(j) FROM range(0, 200) r(j) WHERE substr(p, b + j, 1) <> substr(p, e + 1 + j, 1)) AS k FROM cut)
SELECT vid, tid, CASE WHEN b IS NOT NULL THEN 'InFrameDeletion' WHEN w = '*' THEN 'Nonsense' WHEN o = w THEN 'Synonymous' ELSE 'MultiAAMissense' END AS csqn,
 CASE WHEN b IS NULL THEN CASE WHEN w = '*' THEN left(o, 1) || one || '*' ELSE left(o, 1) || one || '_' || right(o, 1) || last || 'delins' || w END
  WHEN b = e THEN substr(p, b + k, 1) || (b + k) || 'del' || substr(p, b + k, 1)
  ELSE substr(p, b + k, 1) || (b + k) || '_' || substr(p, e + k, 1) || (e + k) || 'del' || substr(p, b + k, e - b + 1) END AS change FROM rolled"""


@query(_edit_sql("deletion") + _DELETED)
def del_inframe(g: Genome) -> DataFrame:
    x = _edits(g, "deletion").where("(cend - cbeg + 1) % 3 = 0")
    return coding.protein_change(x).select(*KEYS, "csqn", "change")


_INSERTED = f""", known AS (SELECT *, level AND strpos(w, '*') = 0 AS framed FROM shift),
put AS (SELECT *, CASE WHEN o = '' THEN one - 1 WHEN left(w, 1) = o THEN one WHEN right(w, 1) = o THEN one - 1 END AS i, CASE WHEN o = '' THEN w WHEN left(w, 1) = o THEN substr(w, 2) WHEN right(w, 1) = o THEN substr(w, 1, length(w) - 1) END AS s FROM known),
rolled AS (SELECT *, (SELECT min(j) FROM range(0, 400) r(j) WHERE substr(s || substr(p, i + 1), j + 1, 1) <> substr(substr(p, i + 1) || '-', j + 1, 1)) AS k FROM put),
turned AS (SELECT *, substr(s || s, k % greatest(length(s), 1) + 1, length(s)) AS t, i + k AS j FROM rolled)
SELECT vid, tid, CASE WHEN NOT framed THEN CASE WHEN a IS NULL OR a = 0 OR (stop > 0 AND stop < a) THEN 'Synonymous' WHEN substr(is_, a, 1) = '*' THEN 'Nonsense' ELSE 'Frameshift' END WHEN i IS NOT NULL THEN 'InFrameInsertion' ELSE 'MultiAAMissense' END AS csqn,
 CASE WHEN NOT framed THEN {_SHIFTED} WHEN i IS NULL THEN o || one || 'delins' || w
  WHEN j - length(t) + 1 > 0 AND substr(p, j - length(t) + 1, length(t)) = t THEN CASE WHEN length(t) = 1 THEN '' ELSE substr(p, j - length(t) + 1, 1) || (j - length(t) + 1) || '_' END || substr(p, j, 1) || j || 'dup' || t
  ELSE substr(p, j, 1) || j || '_' || substr(p, j + 1, 1) || (j + 1) || 'ins' || t END AS change FROM turned"""


@query(_edit_sql("insertion") + _INSERTED)
def ins_coding(g: Genome) -> DataFrame:
    return coding.protein_change(_edits(g, "insertion")).select(*KEYS, "csqn", "change")


_REPLACED = f""", h AS (SELECT *, (SELECT min(j) FROM range(0, 5) r(j) WHERE j >= length(o) OR substr(o, j + 1, 1) <> substr(w, j + 1, 1)) AS h FROM shift),
t AS (SELECT *, (SELECT min(j) FROM range(0, 5) r(j) WHERE j >= length(o) - h OR substr(o, length(o) - j, 1) <> substr(w, length(w) - j, 1)) AS t FROM h),
x AS (SELECT *, substr(o, h + 1, length(o) - h - t) AS ref, substr(w, h + 1, length(w) - h - t) AS alt_aa, one + h AS b FROM t)
SELECT vid, tid, CASE WHEN NOT level THEN CASE WHEN a IS NULL OR a = 0 OR (stop > 0 AND stop < a) THEN 'Synonymous' ELSE 'Frameshift' END WHEN o = w THEN 'Synonymous' WHEN length(ref) = 1 THEN 'Missense' ELSE 'MultiAAMissense' END AS csqn,
 CASE WHEN NOT level THEN {_SHIFTED} WHEN o = w THEN '(=)' WHEN length(ref) = 1 THEN ref || b || alt_aa ELSE left(ref, 1) || b || '_' || right(ref, 1) || (last - t) || 'delins' || alt_aa END AS change FROM x"""


@query(_edit_sql("block") + _REPLACED)
def mnv_coding(g: Genome) -> DataFrame:
    return coding.protein_change(_edits(g, "block")).select(*KEYS, "csqn", "change")


@query(_edit_sql("insertion") + "SELECT vid, tid, md5(CASE WHEN strpos(v, '*') > 0 THEN substr(v, 1, strpos(v, '*')) ELSE v END) AS protein_md5 FROM (SELECT *, CASE WHEN level AND strpos(w, '*') = 0 THEN q ELSE q_on END AS v FROM shift)")
def variant_protein(g: Genome) -> DataFrame:
    return coding.protein_change(_edits(g, "insertion")).select(*KEYS, F.md5("variant_protein").alias("protein_md5"))


@query(f"""SELECT vid, tid, sum(CAST(eb >= pos AND ee <= till AS INT))::BIGINT AS whole, sum(CASE strand WHEN '+' THEN at_end ELSE at_beg END)::BIGINT AS donors, sum(CASE strand WHEN '+' THEN at_beg ELSE at_end END)::BIGINT AS acceptors,
 bool_or(CASE strand WHEN '+' THEN cds_beg ELSE cds_end END BETWEEN pos AND till) AS start, bool_or(CASE strand WHEN '+' THEN cds_end ELSE cds_beg END BETWEEN pos AND till) AS stop FROM (
 SELECT *, CAST(NOT (eb >= pos AND ee <= till) AND i > 0 AND eb BETWEEN pos - 1 AND till + 1 AS INT) AS at_beg, CAST(NOT (eb >= pos AND ee <= till) AND NOT (i > 0 AND eb BETWEEN pos - 1 AND till + 1) AND i < nex - 1 AND ee BETWEEN pos - 1 AND till + 1 AS INT) AS at_end
 FROM (SELECT s.vid, s.pos, s.till, e.* FROM ({SPAN}) s JOIN exon e ON e.contig_id = s.contig_id AND e.beg <= s.till AND e.tend >= s.pos)) GROUP BY 1, 2""")
def span_region(g: Genome) -> DataFrame:
    spans = g.variants.withColumn("till", F.col("pos") + F.col("qty") * 20)
    hit = intervals.range_join(spans, g.transcripts, "contig_id", ("pos", "till"), ("beg", "tend"), width=200)
    s = coding.span_site(F.col("pos"), F.col("till"), F.col("exons"), F.col("strand"), F.col("cds_beg"), F.col("cds_end"))
    return hit.select(*KEYS, s.alias("s")).select(*KEYS, "s.*")


@query("SELECT contig_id, tid, cdslen FROM (SELECT t.contig_id, t.tid, length(cds) AS cdslen, row_number() OVER (PARTITION BY t.contig_id, t.tid // 4 ORDER BY length(cds) DESC, t.tid) AS r FROM tx t JOIN cds USING (tid)) WHERE r = 1")
def longest_coding_per_gene(g: Genome) -> DataFrame:
    t = genes.gene_table(g.named)
    one = F.filter("transcripts", lambda x: x["tid"] == F.col("longest_coding"))[0]
    return t.select("contig_id", F.col("longest_coding").alias("tid"), one["coding"].alias("cdslen"))


_KNOWN = "SELECT contig_id, pos - 1 AS anchor, 'rs' || vid AS id, substr(seq, CAST(pos - 1 AS INT), CAST(2 + qty % 6 AS INT)) AS padded FROM snv JOIN contig USING (contig_id) WHERE qty % 3 = 0 AND pos > 1 AND pos + 10 <= length(seq)"


@query(f"""SELECT v.vid, string_agg(DISTINCT k.id, ',' ORDER BY k.id) AS ids FROM (SELECT vid, contig_id, pos, substr(seq, pos, 1 + qty % 6) AS gone FROM snv JOIN contig USING (contig_id) WHERE pos + 10 <= length(seq)) v
LEFT JOIN ({_KNOWN}) k ON k.contig_id = v.contig_id AND k.anchor = v.pos - 1 AND substr(k.padded, 2) = v.gone GROUP BY v.vid""")
def dbsnp_indel(g: Genome) -> DataFrame:
    """Known deletions stand at the base before, with that base in front of their own."""
    v = genome.bases_at(g.places.where("pos + 10 <= len"), g.chunks_once, near=(-1, 8)).withColumn("n", (F.col("qty") % 6).cast("int"))
    known = v.where("qty % 3 = 0 and pos > 1").select("contig_id", (F.col("pos") - 1).alias("anchor"), F.concat(F.lit("rs"), "vid").alias("id"), F.substr("near", F.lit(1), F.col("n") + 2).alias("padded"))
    known = known.groupBy("contig_id", "anchor", F.substr("padded", F.lit(2)).alias("gone")).agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))
    asked = v.select("vid", "contig_id", (F.col("pos") - 1).alias("anchor"), F.substr("near", F.when(F.col("pos") > 1, 2).otherwise(1), F.col("n") + 1).alias("gone"))
    # rows of one vid meet where its key is, and are one there
    return asked.join(known, ["contig_id", "anchor", "gone"], "left").dropDuplicates(["contig_id", "anchor", "gone", "vid"]).select("vid", "ids")


@query(_CASCADE.format(strict="") + " AND way = 3", bare=True)
def idmap_lookup(g: Genome) -> DataFrame:
    """What only the map of identifiers finds."""
    return lookup.cascade(*_sources(g)).where("way = 3")


@query("SELECT contig_id, beg, tend, strand, count(*)::BIGINT AS n, string_agg(tid % 3 || '', ',' ORDER BY tid % 3, tid) AS sources, min(tid) AS first_tid FROM tx GROUP BY 1, 2, 3, 4")
def tx_union_sources(g: Genome) -> DataFrame:
    """Transcripts of three sources put together; those that share their span and strand with others, once."""
    t = g.transcripts.select("tid", "contig_id", "beg", "tend", "strand")
    all_of = t.where("tid % 3 = 0").withColumn("source", F.lit(0)).unionByName(t.where("tid % 3 = 1").withColumn("source", F.lit(1))).unionByName(t.where("tid % 3 = 2").withColumn("source", F.lit(2)))
    own = F.array_join(F.transform(F.sort_array(F.collect_list("source")), lambda s: s.cast("string")), ",")
    return all_of.groupBy("contig_id", "beg", "tend", "strand").agg(F.count(F.lit(1)).alias("n"), own.alias("sources"), F.min("tid").alias("first_tid"))


#: Changes of coding sequences, told as text: the change, the same edit in SQL (first and last base replaced, new bases), by a place p of the transcript.
_CODING = {
    "snv": ("c.{p}{r}>{x}", "p", "p", "x"), "del": ("c.{p}_{e}del{d}", "p", "p + tid % 4", "''"), "ins": ("c.{p}_{q}ins{y}", "p + 1", "p", "y"), "dup": ("c.{p}_{e}dup", "p + tid % 4 + 1", "p + tid % 4", "d"), "mnv": ("c.{p}_{f}delins{y}", "p", "p + 3", "y"),
}
_PLACED = "SELECT tid, tid AS vid, strand, cds, tail, p, substr(cds, p::INT, 1) AS r0, translate(substr(cds, p::INT, 1), 'AGTC', 'GTCA') AS x, substr(cds, p::INT, (1 + tid % 4)::INT) AS d, substr(cds, (1 + (p * 5) % (length(cds) - 5))::INT, (2 + tid % 4)::INT) AS y FROM (SELECT *, 1 + (tid * 7) % (length(cds) - 8) AS p FROM cds JOIN tail USING (tid) WHERE length(cds) > 20)"


def _coding_queries(g: Genome, form: str, name: str = "T") -> DataFrame:
    """A c. change for each transcript, by its name; a fifth of those that tell a base tell a wrong one."""
    n, t = F.length("cds"), F.col("tid")
    x = g.transcripts.where("length(cds) > 20").withColumn("p", (1 + (t * 7) % (n - 8)).cast("int"))
    y = F.substr("cds", (1 + (F.col("p") * 5) % (n - 5)).cast("int"), (2 + t % 4).cast("int"))
    base = F.substr("cds", F.col("p"), F.lit(1))
    other = F.translate(base, "AGTC", "GTCA")
    parts = {"p": F.col("p").cast("string"), "q": (F.col("p") + 1).cast("string"), "e": (F.col("p") + t % 4).cast("string"), "f": (F.col("p") + 3).cast("string"), "r": F.when(t % 5 == 0, other).otherwise(base), "x": other, "y": y, "d": F.when(t % 2 == 0, F.substr("cds", F.col("p"), (1 + t % 4).cast("int"))).otherwise("")}
    text = F.concat(*(parts[w[1]] if w[0] == "{" else F.lit(w) for w in re.findall(r"{.}|[^{]+", form)))
    return x.select(t.alias("qid"), F.concat(F.lit(f"{name.lower()}"), t.cast("string"), F.lit(":"), text).alias("input")).withColumn("s", hgvs.split_identifier(F.col("input"))).select("qid", "input", "s.tok", "s.change")


def _coding_changes(g: Genome, kind: str) -> DataFrame:
    x = levels.coding_changes(levels.named(_coding_queries(g, _CODING[kind][0]), g.named, g.idmap))
    return x.select(F.col("qid").alias("vid"), "tid", "csqn", "change", "gbeg", "gend", "galt")


def _coding_sql(kind: str, then: str) -> str:
    _, beg, end, alt = _CODING[kind]
    where = "WHERE tid % 5 <> 0" if kind == "snv" else ""
    return f""", placed AS ({_PLACED}),
edit AS (SELECT vid, tid, strand, cds, tail, {beg} AS cbeg, {end} AS cend, {alt} AS alt FROM placed {where}),
{_READINGS}, changed AS ({then}),
spots AS (SELECT tid, p AS one_c, {'p + 1' if kind == 'ins' else end if kind != 'dup' else 'p + tid % 4'} AS last_c, {alt} AS own FROM placed),
ends AS (SELECT o.tid, o.own, o.strand, min(CASE o.strand WHEN '+' THEN gb + c - cprev - 1 ELSE ge - (c - cprev - 1) END) AS gbeg, max(CASE o.strand WHEN '+' THEN gb + c - cprev - 1 ELSE ge - (c - cprev - 1) END) AS gend
  FROM (SELECT spots.*, strand, unnest([one_c, last_c]) AS c FROM spots JOIN cds USING (tid)) o JOIN segment s ON s.tid = o.tid AND c BETWEEN cprev + 1 AND cprev + ge - gb + 1 GROUP BY 1, 2, 3)
SELECT vid, tid, csqn, change, gbeg, gend, CASE strand WHEN '+' THEN own ELSE reverse(translate(own, 'ACGT', 'TGCA')) END AS galt FROM changed JOIN ends USING (tid)"""


_SUBSTITUTED = "SELECT vid, tid, CASE WHEN o = w THEN 'Synonymous' WHEN w = '*' THEN 'Nonsense' ELSE 'Missense' END AS csqn, CASE WHEN o = w THEN '(=)' ELSE o || one || w END AS change FROM shift"
_SHIFT = f"SELECT vid, tid, CASE WHEN a IS NULL OR a = 0 OR (stop > 0 AND stop < a) THEN 'Synonymous' ELSE 'Frameshift' END AS csqn, {_SHIFTED} AS change FROM shift WHERE NOT level"


@query(_coding_sql("snv", _SUBSTITUTED))
def coding_snv(g: Genome) -> DataFrame:
    """c. substitutions by transcript name: to the genome and the protein; wrong reference bases go."""
    return _coding_changes(g, "snv")


def _with(sql: str) -> str:
    """SQL of _DELETED and its like, whose tables follow a comma, as one query."""
    return f"WITH {sql.lstrip(', ')}"


@query(_coding_sql("del", f"SELECT vid, tid, csqn, change FROM ({_with(_DELETED)}) UNION ALL SELECT vid, tid, csqn, change FROM ({_SHIFT})"))
def coding_deletion(g: Genome) -> DataFrame:
    return _coding_changes(g, "del")


@query(_coding_sql("ins", _with(_INSERTED)))
def coding_insertion(g: Genome) -> DataFrame:
    return _coding_changes(g, "ins")


@query(_coding_sql("dup", _with(_INSERTED)))
def coding_duplication(g: Genome) -> DataFrame:
    return _coding_changes(g, "dup")


@query(_coding_sql("mnv", _with(_REPLACED)))
def coding_block(g: Genome) -> DataFrame:
    return _coding_changes(g, "mnv")


def _protein_queries(g: Genome, form: str) -> DataFrame:
    """A p. change for each transcript, by its name; of every seventh, the amino acid named is another."""
    t = F.col("tid")
    x = g.transcripts.where("length(cds) > 20").withColumn("aa", sequence.translate_all(F.col("cds"))).withColumn("n", (1 + (t * 5) % (F.length("aa") - 4)).cast("int"))
    letter = lambda by: F.substr(F.lit("ACDEFGHIKLMNPQRSTVWY"), ((t * by) % 20 + 1).cast("int"), F.lit(1))
    own = lambda d: F.substr("aa", F.col("n") + d, F.lit(1))
    parts = {"n": F.col("n").cast("string"), "m": (F.col("n") + 1).cast("string"), "k": (F.col("n") + 2).cast("string"), "r": F.when(t % 7 == 0, F.when(own(0) == "W", "A").otherwise("W")).otherwise(own(0)), "s": own(1), "u": own(2), "x": letter(3), "y": letter(11)}
    text = F.concat(*(parts[w[1]] if w[0] == "{" else F.lit(w) for w in re.findall(r"{.}|[^{]+", form)))
    return x.select(t.alias("qid"), F.concat(F.lit("T"), t.cast("string"), F.lit(":"), text).alias("input")).withColumn("s", hgvs.split_identifier(F.col("input"))).select("qid", "input", "s.tok", "s.change")


def _protein_pairs(g: Genome, form: str) -> DataFrame:
    return levels.named(_protein_queries(g, form), g.named, g.idmap, coding_only=True)


_PROTEIN_SQL = f""", asked AS MATERIALIZED (SELECT tid, strand, cds, aa, n, substr(aa, n::INT, 1) AS r, substr('ACDEFGHIKLMNPQRSTVWY', ((tid * 3) % 20 + 1)::INT, 1) AS x, substr('ACDEFGHIKLMNPQRSTVWY', ((tid * 11) % 20 + 1)::INT, 1) AS y
 FROM (SELECT *, 1 + (tid * 5) % (length(aa) - 4) AS n FROM (SELECT tid, strand, cds, {_read("cds")} AS aa FROM cds WHERE length(cds) > 20)) WHERE tid % 7 <> 0),
firsts AS (SELECT aa, codon, n_codons FROM (SELECT aa, codon, ord, count(*) OVER (PARTITION BY aa) AS n_codons FROM (VALUES {_TABLE}) k(aa, codon, ord)) WHERE ord = 0),
base_at AS (SELECT a.tid, k, CASE s.strand WHEN '+' THEN gb + 3 * n - 2 + k - cprev - 1 ELSE ge - (3 * n - 2 + k - cprev - 1) END AS g FROM asked a JOIN segment s ON s.tid = a.tid, range(0, 9) r(k) WHERE 3 * n - 2 + k BETWEEN cprev + 1 AND cprev + ge - gb + 1),
spread AS (SELECT a.*, b.* EXCLUDE (tid) FROM asked a JOIN (SELECT tid, max(g) FILTER (WHERE k = 0) AS g0, max(g) FILTER (WHERE k = 1) AS g1, max(g) FILTER (WHERE k = 2) AS g2, max(g) FILTER (WHERE k = 3) AS g3, max(g) FILTER (WHERE k = 5) AS g5, max(g) FILTER (WHERE k = 8) AS g8 FROM base_at GROUP BY tid) b USING (tid)) """


@query(_PROTEIN_SQL + """, ranked AS (SELECT s.*, substr(cds, (3 * n - 2)::INT, 3) AS own, k.codon AS best, row_number() OVER (PARTITION BY tid ORDER BY (substr(k.codon, 1, 1) <> substr(cds, (3 * n - 2)::INT, 1))::INT + (substr(k.codon, 2, 1) <> substr(cds, (3 * n - 1)::INT, 1))::INT + (substr(k.codon, 3, 1) <> substr(cds, (3 * n)::INT, 1))::INT, ord) AS rank
 FROM spread s JOIN (VALUES """ + _TABLE + """) k(aa, codon, ord) ON k.aa = s.x AND k.codon <> substr(cds, (3 * n - 2)::INT, 3)),
top AS (SELECT *, CASE WHEN substr(own, 1, 1) <> substr(best, 1, 1) THEN 1 WHEN substr(own, 2, 1) <> substr(best, 2, 1) THEN 2 ELSE 3 END AS i, CASE WHEN substr(own, 3, 1) <> substr(best, 3, 1) THEN 3 WHEN substr(own, 2, 1) <> substr(best, 2, 1) THEN 2 ELSE 1 END AS j FROM ranked WHERE rank = 1)
SELECT tid AS qid, tid, own AS codon, best, least(CASE i WHEN 1 THEN g0 WHEN 2 THEN g1 ELSE g2 END, CASE j WHEN 1 THEN g0 WHEN 2 THEN g1 ELSE g2 END) AS vbeg, greatest(CASE i WHEN 1 THEN g0 WHEN 2 THEN g1 ELSE g2 END, CASE j WHEN 1 THEN g0 WHEN 2 THEN g1 ELSE g2 END) AS vend,
 CASE strand WHEN '+' THEN substr(own, i, j - i + 1) ELSE reverse(translate(substr(own, i, j - i + 1), 'ACGT', 'TGCA')) END AS vref, CASE strand WHEN '+' THEN substr(best, i, j - i + 1) ELSE reverse(translate(substr(best, i, j - i + 1), 'ACGT', 'TGCA')) END AS valt FROM top""")
def protein_snv(g: Genome) -> DataFrame:
    """p. substitutions by transcript name: the nearest codon and its change of the genome; wrong reference amino acids go."""
    return levels.protein_snvs(_protein_pairs(g, "p.{r}{n}{x}")).select("qid", "tid", "codon", "best", "vbeg", "vend", "vref", "valt")


@query(_PROTEIN_SQL + "SELECT tid AS qid, tid, 'DEL' AS kind, least(g0, g8) AS gbeg, greatest(g0, g8) AS gend, substr(cds, (3 * n - 2)::INT, 9) AS bases FROM spread")
def protein_deletion(g: Genome) -> DataFrame:
    """p. deletions: the codons taken out, and where they lie."""
    return levels.protein_changes(_protein_pairs(g, "p.{r}{n}_{u}{k}del")).select("qid", "tid", "kind", "gbeg", "gend", "bases")


@query(_PROTEIN_SQL + "SELECT tid AS qid, tid, 'INS' AS kind, least(g0, g5) AS gbeg, greatest(g0, g5) AS gend, a.codon || b.codon AS put, a.n_codons * b.n_codons AS n_put FROM spread JOIN firsts a ON a.aa = x JOIN firsts b ON b.aa = y")
def protein_insertion(g: Genome) -> DataFrame:
    """p. insertions: one way to write them, and how many there are."""
    return levels.protein_changes(_protein_pairs(g, "p.{r}{n}_{s}{m}ins{x}{y}")).select("qid", "tid", "kind", "gbeg", "gend", "put", "n_put")


@query(_PROTEIN_SQL + "SELECT tid AS qid, tid, 'MNV' AS kind, least(g0, g5) AS gbeg, greatest(g0, g5) AS gend, substr(cds, (3 * n - 2)::INT, 6) AS bases, a.codon || b.codon AS put, a.n_codons * b.n_codons AS n_put FROM spread JOIN firsts a ON a.aa = x JOIN firsts b ON b.aa = y")
def protein_block(g: Genome) -> DataFrame:
    return levels.protein_changes(_protein_pairs(g, "p.{r}{n}_{s}{m}delins{x}{y}")).select("qid", "tid", "kind", "gbeg", "gend", "bases", "put", "n_put")


@query(_PROTEIN_SQL + "SELECT tid AS qid, tid, 'REG' AS kind, least(g0, g8) AS gbeg, greatest(g0, g8) AS gend, substr(cds, (3 * n - 2)::INT, 9) AS bases FROM spread WHERE substr(aa, (n + 1)::INT, 1) <> '*'")
def protein_region(g: Genome) -> DataFrame:
    """Regions with a motif, x for any amino acid."""
    return levels.protein_changes(_protein_pairs(g, "p.{r}{n}_{u}{k}{r}x{u}")).select("qid", "tid", "kind", "gbeg", "gend", "bases")


@query(f"""SELECT tid, "index", codon, string_agg(DISTINCT k.id || ':' || k.aa, ',' ORDER BY k.id || ':' || k.aa) AS ids FROM (SELECT tid, 1 + tid % 8 AS "index", strand, substr(cds, CAST(3 * (1 + tid % 8) - 2 AS INT), 3) AS codon FROM cds WHERE 3 * (1 + tid % 8) <= length(cds)) c LEFT JOIN (
 SELECT b.tid AS k_tid, d.id, aa.aa FROM (SELECT s.tid, s.contig_id, s.strand, o, CASE s.strand WHEN '+' THEN gb + (3 * (1 + s.tid % 8) - 3 + o) - cprev - 1 ELSE ge - (3 * (1 + s.tid % 8) - 3 + o - cprev - 1) END AS g FROM segment s, range(1, 4) r(o) WHERE 3 * (1 + s.tid % 8) - 3 + o BETWEEN cprev + 1 AND cprev + ge - gb + 1) b
 JOIN cds USING (tid) JOIN (SELECT contig_id, pos, alt, 'rs' || vid AS id FROM snv WHERE qty % 7 = 0) d ON d.contig_id = b.contig_id AND d.pos = b.g
 JOIN aa ON aa.codon = substr(cds, CAST(3 * (1 + b.tid % 8) - 2 AS INT), CAST(o - 1 AS INT)) || CASE b.strand WHEN '+' THEN d.alt ELSE translate(d.alt, 'ACGT', 'TGCA') END || substr(substr(cds, CAST(3 * (1 + b.tid % 8) - 2 AS INT), 3), CAST(o + 1 AS INT))) k ON k.k_tid = c.tid GROUP BY 1, 2, 3""")
def codon_dbsnp(g: Genome) -> DataFrame:
    """Known single-base variants in one codon of each transcript, with the amino acid that each makes."""
    known = g.variants.where("qty % 7 = 0").select("contig_id", "pos", "alt", F.concat(F.lit("rs"), "vid").alias("id"))
    c = g.transcripts.withColumn("index", 1 + F.col("tid") % 8).where("3 * index <= length(cds)").withColumn("codon", F.substr("cds", (3 * F.col("index") - 2).cast("int"), F.lit(3)))
    return levels.codon_known(c, known)


@query("""SELECT t.tid, p, k, CASE WHEN k > 0 THEN p = size OR EXISTS (SELECT 1 FROM segment s WHERE s.tid = t.tid AND cprev + ge - gb + 1 = p) ELSE p = 1 OR EXISTS (SELECT 1 FROM segment s WHERE s.tid = t.tid AND cprev + 1 = p) END AS fits FROM (
 SELECT tid, length(cds) AS size, CASE WHEN tid % 3 = 0 THEN 1 + tid % 20 ELSE least(length(cds), c.edge + tid % 2) END AS p, CASE WHEN tid % 2 = 0 THEN 2 ELSE -2 END AS k FROM cds JOIN (SELECT tid, min(cprev + ge - gb + 1) AS edge FROM segment GROUP BY 1) c USING (tid)) t""")
def exon_boundary_check(g: Genome) -> DataFrame:
    """Whether n+k and n-k stand at a real edge of an exon."""
    t = F.col("tid")
    edge = F.array_min(F.transform("segs", lambda s: s["cprev"] + s["ge"] - s["gb"] + 1))
    x = g.transcripts.withColumn("p", F.when(t % 3 == 0, 1 + t % 20).otherwise(F.least(F.length("cds").cast("bigint"), edge + t % 2))).withColumn("k", F.when(t % 2 == 0, 2).otherwise(-2))
    return x.select("tid", "p", "k", coords.on_boundary(F.struct(F.col("p").alias("pos"), F.col("k").alias("offset")), F.col("segs"), F.col("strand")).alias("fits"))


@query("SELECT tid, CASE strand WHEN '+' THEN beg - 1000 ELSE tend END AS promoter_beg, CASE strand WHEN '+' THEN beg ELSE tend + 1000 END AS promoter_end, nex AS n_exons, cds_beg, cds_end, left(p, 1) AS first_aa, right(p, 1) AS last_aa, length(p) AS protein_len FROM (SELECT tx.*, CASE WHEN strpos(a, '*') > 0 THEN substr(a, 1, strpos(a, '*')) ELSE a END AS p FROM tx JOIN (SELECT tid, " + _read("cds") + " AS a FROM cds) USING (tid))")
def gene_summary(g: Genome) -> DataFrame:
    return levels.summary(g.transcripts)


_LONG = "SELECT *, least(pos + qty * 200, length(seq)) AS till FROM snv JOIN contig USING (contig_id)"


@query(f"SELECT s.vid, a.tid AS beg_tid, b.tid AS end_tid, (SELECT count(*) FROM tx t WHERE t.contig_id = s.contig_id AND t.beg >= s.pos AND t.tend <= s.till) AS n_spanned FROM ({_LONG}) s LEFT JOIN tx a ON a.contig_id = s.contig_id AND s.pos BETWEEN a.beg AND a.tend LEFT JOIN tx b ON b.contig_id = s.contig_id AND s.till BETWEEN b.beg AND b.tend")
def long_region_endpoints(g: Genome) -> DataFrame:
    """Regions of up to ten thousand bases by the transcripts at their two ends."""
    return levels.long_regions(g.places.withColumn("till", F.least(F.col("pos") + F.col("qty") * 200, F.col("len"))), g.layout)


_TAIL = "CASE WHEN tid % 5 = 0 THEN ';dbxref=ID:' || tid ELSE '' END || CASE WHEN tid % 3 = 0 THEN ';aliases=P' || tid ELSE '' END || ';source=S'"
_PLACE = "CASE WHEN utr IS NOT NULL THEN utr || '-UTR;' ELSE '' END || CASE WHEN part = 'intronic' THEN 'intron_between_exon_' || exon || '_and_' || (exon + 1) WHEN {coding} THEN 'cds_in_exon_' || exon ELSE 'noncoding_exon_' || exon END"


@query(f""", positions AS ({CDNA_SQL}), told AS (SELECT s.*, c.csqn, c.aa_ref, c.aa_alt, c.aa_pos, c.codon0, d.cpos AS ctext, c.cpos IS NOT NULL AS inside, c.csqn IN ('Missense', 'Nonsense', 'Synonymous') AS has_aa FROM site s JOIN consequence c USING (vid, tid) JOIN positions d USING (vid, tid)),
three AS (SELECT t.vid, t.tid, string_agg(g || '', '-' ORDER BY g) AS places FROM (SELECT t.vid, t.tid, CASE s.strand WHEN '+' THEN gb + (3 * aa_pos - 2 + o) - cprev - 1 ELSE ge - (3 * aa_pos - 2 + o - cprev - 1) END AS g FROM told t, range(0, 3) r(o) JOIN segment s ON true WHERE s.tid = t.tid AND has_aa AND 3 * aa_pos - 2 + o BETWEEN cprev + 1 AND cprev + ge - gb + 1) t GROUP BY 1, 2)
SELECT vid, concat_ws(chr(9), 'c' || contig_id || ':g.' || pos || ref || '>' || alt, 'T' || tid || '.1 (protein_coding)', 'G' || tid // 4, strand,
 contig_id || ':g.' || pos || ref || '>' || alt || '/c.' || ctext || CASE strand WHEN '+' THEN ref || '>' || alt ELSE translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') END || '/' || CASE WHEN has_aa THEN 'p.' || aa_ref || aa_pos || aa_alt ELSE '.' END,
 'inside_[' || {_PLACE.format(coding="inside")} || ']',
 'CSQN=' || csqn || CASE WHEN splice IS NOT NULL THEN ';C2=' || replace(splice, 'NextTo', 'NextToSplice') || 'OfExon' || (exon + CASE WHEN part = 'intronic' AND strand = '+' THEN 1 ELSE 0 END) || '_At_' || contig_id || ':' || CASE WHEN (splice LIKE '%Acceptor') = (strand = '+') THEN off + (ei + CASE WHEN part = 'intronic' THEN 1 ELSE 0 END) * (elen + ilen) ELSE off + ei * (elen + ilen) + elen + 1 END ELSE '' END
  || CASE codon WHEN 'CdsStart' THEN ';C2=cds_start_at_' || contig_id || ':' || pos WHEN 'CdsStop' THEN ';C2=cds_end_at_' || contig_id || ':' || pos ELSE '' END || CASE edge WHEN 'TSS' THEN ';transcription_start_at_' || contig_id || ':' || pos WHEN 'TES' THEN ';transcription_end_at_' || contig_id || ':' || pos ELSE '' END
  || CASE WHEN has_aa THEN ';codon_pos=' || places || ';ref_codon_seq=' || codon0 ELSE '' END || {_TAIL}, contig_id || '', pos || '', ref, alt) AS value FROM told LEFT JOIN three USING (vid, tid)""")
def snv_records(g: Genome) -> DataFrame:
    """Text records of single-base variants, with the columns of the sequence."""
    v = g.variants.withColumn("input", F.concat(F.lit("c"), F.col("contig_id").cast("string"), F.lit(":g."), F.col("pos").cast("string"), "ref", F.lit(">"), "alt"))
    r = records.snv_records(annotate.on_transcripts(v, g.named))
    return r.select("vid", F.struct(*records.FIELDS, "CHROM", "POS", "REF", "ALT").alias("r")).select("vid", F.concat_ws("\t", "r.*").alias("value"))
