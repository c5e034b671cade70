"""Registered queries of the region driver, genes, haplotypes and frameshifts over the derived genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coords
from ..operators import coding, genome, haplotypes, intervals, levels, records, regions
from .fixture import Genome
from .queries import query


def _inside(place: str) -> tuple[str, str]:
    """SQL of a place's exon or intron (from 0, in the genome) and of the bases from its beginning."""
    return f"(({place} - off - 1) // (elen + ilen))", f"(({place} - off - 1) % (elen + ilen))"


def _text(place: str) -> str:
    """SQL of what a transcript has at a place inside it."""
    i, w = _inside(place)
    exon = f"CASE strand WHEN '+' THEN {i} + 1 ELSE nex - {i} END"
    intron = f"CASE strand WHEN '+' THEN {i} + 1 ELSE nex - {i} - 1 END"
    utr = f"CASE WHEN {place} < cds_beg THEN CASE strand WHEN '+' THEN '5-UTR' ELSE '3-UTR' END WHEN {place} > cds_end THEN CASE strand WHEN '+' THEN '3-UTR' ELSE '5-UTR' END END"
    return f"concat_ws(';', {utr}, CASE WHEN {w} >= elen THEN 'intron_between_exon_' || ({intron}) || '_and_' || ({intron} + 1) WHEN {place} BETWEEN cds_beg AND cds_end THEN 'cds_in_exon_' || ({exon}) ELSE 'noncoding_exon_' || ({exon}) END)"


def _side(gene: str, distance: str, strand: str, upstream: bool) -> str:
    return f"{gene} || '(' || ({distance}) || CASE {strand} WHEN '{'+' if upstream else '-'}' THEN '_bp_downstream)' ELSE '_bp_upstream)' END"


def _neighbours(name: str, rows: str) -> str:
    """CTEs of the neighbours of rows (vid, contig_id, low, high): name (vid, before, after)."""
    return f"""
{name}_p AS ({rows}),
{name}_u AS (SELECT vid, {_side("'G' || tid // 4", "low - tend", "strand", True)} AS s FROM (SELECT p.vid, p.low, t.*, row_number() OVER (PARTITION BY p.vid ORDER BY t.tend DESC, t.beg, t.tid) AS r FROM {name}_p p JOIN tx t ON t.contig_id = p.contig_id AND t.tend < p.low) WHERE r = 1),
{name}_d AS (SELECT vid, {_side("'G' || tid // 4", "beg - high", "strand", False)} AS s FROM (SELECT p.vid, p.high, t.*, row_number() OVER (PARTITION BY p.vid ORDER BY t.beg, t.tid) AS r FROM {name}_p p JOIN tx t ON t.contig_id = p.contig_id AND t.beg > p.high) WHERE r = 1),
{name} AS (SELECT p.vid, coalesce(u.s, '5''-telomere(' || low || '_bp)') AS before, coalesce(d.s, '3''-telomere(' || (length(seq) - high) || '_bp)') AS after FROM {name}_p p JOIN contig USING (contig_id) LEFT JOIN {name}_u u USING (vid) LEFT JOIN {name}_d d USING (vid))"""


_BETWEEN = "'intergenic_between_' || before || '_and_' || after"


@query(f", hit AS (SELECT vid, tid, 'inside_[' || {_text('pos')} || ']' AS region FROM snv JOIN tx USING (contig_id) WHERE pos BETWEEN beg AND tend), {_neighbours('n', 'SELECT vid, contig_id, pos AS low, pos AS high FROM snv WHERE vid NOT IN (SELECT vid FROM hit)')} SELECT vid, tid, region FROM hit UNION ALL SELECT vid, NULL, 'inside_[' || {_BETWEEN} || ']' FROM n")
def genomic_region(g: Genome) -> DataFrame:
    """Every variant by all transcripts over it, or by its neighbours."""
    spans = g.places.select("vid", "contig_id", "pos", F.col("pos").alias("till"))
    told = regions.told(spans, g.named_layout, g.sizes, ranges=False)
    x = records.placed(told.pairs, F.col("pos"), F.col("till"))
    site, c = F.get("__sites", F.lit(0)), F.get("__c", F.lit(0))
    genic = F.concat(F.lit("inside_["), records.place_text(site, F.coalesce(c["offset"] == 0, F.lit(False)), F.col("strand")), F.lit("]"))
    return x.select("vid", "tid", genic.alias("region")).union(told.between.select("vid", F.lit(None).cast("bigint"), "region"))


_SPANS = "SELECT vid, contig_id, pos, least(pos + qty * qty * 10, length(seq)) AS till FROM snv JOIN contig USING (contig_id)"
_GENES = "SELECT contig_id, 'G' || tid // 4 AS gene, beg AS gb, tend AS ge FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, tid // 4 ORDER BY nex * elen DESC, tid) AS r FROM tx) WHERE r = 1"


def _spans(places: DataFrame) -> DataFrame:
    return places.select("vid", "contig_id", "pos", F.least(F.col("pos") + F.col("qty") * F.col("qty") * 10, F.col("len")).alias("till"))


_END = "SELECT s.vid, t.tid, 'T' || t.tid || '.1 (protein_coding)' AS full_name, 'G' || t.tid // 4 AS gene, {text} AS text FROM s JOIN way USING (vid) JOIN tx t ON t.contig_id = s.contig_id AND s.{place} BETWEEN t.beg AND t.tend WHERE way = 'wide'"
_NO_END = "SELECT vid, contig_id, {place} AS low, {place} AS high FROM s JOIN way USING (vid) WHERE way = 'wide' AND vid NOT IN (SELECT vid FROM {hits})"

_DRIVER = f""",
s AS ({_SPANS}), gene AS ({_GENES}),
met AS (SELECT vid, max(beg) AS mb, min(tend) AS me FROM s JOIN tx t ON t.contig_id = s.contig_id AND t.beg <= s.till AND t.tend >= s.pos GROUP BY vid),
way AS (SELECT vid, CASE WHEN mb IS NULL THEN 'between' WHEN pos = till OR mb < me THEN 'near' ELSE 'wide' END AS way FROM s LEFT JOIN met USING (vid)),
inside AS (SELECT vid, count(gene) AS n, string_agg(gene, ',' ORDER BY gb, gene) AS names FROM s LEFT JOIN gene g ON g.contig_id = s.contig_id AND gb >= pos AND ge <= till GROUP BY vid),
span AS (SELECT vid, CASE WHEN n = 0 THEN '' WHEN n <= 5 THEN '_spanning_[' || names || ']' ELSE '_spanning_[' || n || '_genes]' END AS spanning FROM inside),
{_neighbours('n', "SELECT vid, contig_id, pos AS low, till AS high FROM s")},
near AS (SELECT s.vid, 'T' || tid || '.1 (protein_coding)' AS transcript,
 CASE WHEN pos < beg THEN 'intergenic_between_' || before || '_and_' || {_side("'G' || tid // 4", 'beg - pos', 'strand', False)} ELSE {_text('pos')} END AS a,
 CASE WHEN till > tend THEN 'intergenic_between_' || {_side("'G' || tid // 4", 'till - tend', 'strand', True)} || '_and_' || after ELSE {_text('till')} END AS b
 FROM s JOIN way USING (vid) JOIN n USING (vid) JOIN tx t ON t.contig_id = s.contig_id AND t.beg <= s.till AND t.tend >= s.pos WHERE way = 'near'),
lh AS ({_END.format(text=_text('pos'), place='pos')}), rh AS ({_END.format(text=_text('till'), place='till')}),
{_neighbours('ln', _NO_END.format(place='pos', hits='lh'))}, {_neighbours('rn', _NO_END.format(place='till', hits='rh'))},
l AS (SELECT * FROM lh UNION ALL SELECT vid, NULL, NULL, NULL, {_BETWEEN} FROM ln), r AS (SELECT * FROM rh UNION ALL SELECT vid, NULL, NULL, NULL, {_BETWEEN} FROM rn),
wide AS (SELECT vid, l.tid IS NOT DISTINCT FROM r.tid AND l.tid IS NOT NULL AS same, l.tid IS NOT NULL AND r.tid IS NOT NULL AS both_ends,
 l.full_name AS lf, r.full_name AS rf, l.text AS lt, r.text AS rt, concat_ws(';', l.text, l.gene) AS ln, concat_ws(';', r.text, r.gene) AS rn FROM l JOIN r USING (vid))
SELECT vid, transcript, CASE WHEN a = b THEN 'inside_[' || a || ']' ELSE 'from_[' || a || ']_to_[' || b || ']' || spanning END AS region FROM near JOIN span USING (vid)
UNION ALL SELECT vid, CASE WHEN same THEN lf WHEN both_ends THEN lf || ',' || rf WHEN lf IS NOT NULL THEN lf || ',' WHEN rf IS NOT NULL THEN ',' || rf END,
 CASE WHEN lt = rt AND (same OR NOT both_ends) THEN 'inside_[' || lt || ']' WHEN same THEN 'from_[' || lt || ']_to_[' || rt || ']' || spanning ELSE 'from_[' || ln || ']_to_[' || rn || ']' || spanning END FROM wide JOIN span USING (vid)
UNION ALL SELECT vid, NULL, 'inside_[' || {_BETWEEN} || ']' FROM n JOIN way USING (vid) WHERE way = 'between'"""


@query(_DRIVER)
def span_driver(g: Genome) -> DataFrame:
    """Spans of all lengths by one transcript each, by both ends, or by their neighbours."""
    told = regions.told(_spans(g.places), g.named_layout, g.sizes, width=2000)
    x = records.placed(told.pairs, F.col("pos"), F.col("till"))
    text = records.between_text(x, F.get("__sites", F.lit(0)), F.get("__sites", F.lit(1)), F.get("__c", F.lit(0)), F.get("__c", F.lit(1)))
    near = x.select("vid", records.transcript_text().alias("transcript"), text.alias("region"))
    return near.union(told.wide.select("vid", "transcript", "region")).union(told.between.select("vid", F.lit(None).cast("string"), "region"))


@query(f", s AS ({_SPANS}), gene AS ({_GENES}) SELECT vid, count(gene)::BIGINT AS n_inside, CASE WHEN count(gene) <= 5 THEN coalesce(string_agg(gene, ',' ORDER BY gb, gene), '') END AS inside FROM s LEFT JOIN gene g ON g.contig_id = s.contig_id AND gb >= pos AND ge <= till GROUP BY vid")
def genes_inside(g: Genome) -> DataFrame:
    """How many genes lie in each span, and their names, by the order of ends."""
    found = intervals.contained(_spans(g.places), regions.gene_spans(g.named_layout), "contig_id", ("pos", "till"), ("gene_beg", "gene_end"), "gene_name", width=2000)
    return found.select("vid", "n_inside", F.array_join("inside", ",").alias("inside"))


_HAPLOTYPE = "substr(b, 1, 3) || translate(substr(b, 4, 1), 'AGTC', 'GTCA') || substr(b, 5, 6) || repeat('T', qty % 3) || substr(b, 11 + qty % 4)"


@query(f"SELECT vid, {_HAPLOTYPE} AS alt FROM (SELECT vid, qty::INT AS qty, substr(seq, pos, 24) AS b FROM snv JOIN contig USING (contig_id))")
def haplotype_rebuilt(g: Genome) -> DataFrame:
    """A haplotype at every variant, taken apart by alignment and put together again from its edits."""
    alt = F.expr(_HAPLOTYPE.replace("repeat('T', qty % 3)", "repeat('T', int(qty % 3))").replace("substr(b, 11 + qty % 4)", "substr(b, int(11 + qty % 4))"))
    v = genome.bases_at(g.places, g.chunks, b=(0, 24)).withColumn("ref", F.col("b")).select("vid", "pos", "ref", alt.alias("alt"))
    edits = F.transform("edits", lambda e: F.struct((F.col("pos") + e["at"]).alias("pos"), F.length(e["ref"]).alias("gone"), e["alt"].alias("alt")))
    return haplotypes.with_edits(v).select("vid", haplotypes.rebuilt(F.col("ref"), F.col("pos"), edits).alias("alt"))


def _policy(name: str, later: str) -> str:
    return f"CASE WHEN inside IS NOT NULL THEN inside || ':0' WHEN {later} THEN (before + 1) || ':' || -ahead ELSE before || ':' || behind END AS {name}"


@query(f"""SELECT vid, tid, {_policy('closer', 'behind >= ahead')}, {_policy('c_smaller', 'FALSE')}, {_policy('c_greater', 'TRUE')}, {_policy('g_smaller', "strand = '-'")}, {_policy('g_greater', "strand = '+'")} FROM (
 SELECT p.vid, p.tid, p.strand, max(CASE WHEN p.pos BETWEEN gb AND ge THEN cprev + CASE p.strand WHEN '+' THEN p.pos - gb ELSE ge - p.pos END + 1 END) AS inside,
  max(CASE WHEN p.strand = '+' AND ge < p.pos OR p.strand = '-' AND gb > p.pos THEN cprev + ge - gb + 1 END) AS before,
  min(CASE WHEN p.strand = '+' AND ge < p.pos THEN p.pos - ge WHEN p.strand = '-' AND gb > p.pos THEN gb - p.pos END) AS behind,
  min(CASE WHEN p.strand = '+' AND gb > p.pos THEN gb - p.pos WHEN p.strand = '-' AND ge < p.pos THEN p.pos - ge END) AS ahead
 FROM pair p JOIN segment s ON s.tid = p.tid WHERE p.pos BETWEEN p.cds_beg AND p.cds_end GROUP BY 1, 2, 3)""")
def intron_policies(g: Genome) -> DataFrame:
    """Positions between the ends of the coding sequence, told from the base that each policy chooses."""
    pairs = intervals.range_join(g.variants, g.transcripts, "contig_id", ("pos", "pos"), ("cds_beg", "cds_end"))
    told = lambda p: F.concat_ws(":", coords.cdna(F.col("pos"), F.col("segs"), F.col("strand"), p)["pos"].cast("string"), coords.cdna(F.col("pos"), F.col("segs"), F.col("strand"), p)["offset"].cast("string"))
    return pairs.select("vid", "tid", *(told(p).alias(p) for p in coords.POLICIES))


@query(None)
def frameshift_edits(g: Genome) -> DataFrame:
    """For every transcript the edits that explain the frameshift which the loss of one base in its fourth codon makes; tests hold the search against all edits."""
    lost = g.transcripts.withColumns({"cbeg": F.lit(11), "cend": F.lit(11), "alt": F.lit("")})
    asked = coding.protein_change(lost).where(F.col("change").contains("fs*")).select(F.col("tid").alias("qid"), F.concat(F.lit("p."), "change").alias("change"), *g.transcripts.columns)
    return levels.frameshift_candidates(asked).drop("qid")
