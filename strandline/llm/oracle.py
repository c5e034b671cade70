"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .merkle import FAN, TAMPER_EVERY
from .mix_sources import EPOCHS, SEED, SHARE, WEIGHTS, WORD
from .resampling import BUCKETS, LEAST_WORDS, LONGEST, PERCENT
from .resampling import SEED as SAMPLE_SEED
from .secret_scan import BASE, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, FURTHER

_WORDS = rf"coalesce(regexp_extract_all(text, '{WORD}'), [])"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
k AS (SELECT doc_id, s, array_to_string(ws[s + 1:s + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 19, 0))) AS s FROM w)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM later, range(0, 20) t(o)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w),
kept AS (SELECT e.doc_id, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL), '') AS text FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 3, 1) END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common_n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common_n >= 80 * (x.n + y.n - common_n)),
link AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) m USING (doc_id)
"""


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_KINDS = " UNION ALL ".join(f"SELECT {i} AS rank, '{kind}' AS kind, {group} AS grp, {least} AS least_n, string_split_regex(text, {_quote(p)}) AS parts, regexp_extract_all(text, {_quote(p)}, 0) AS hits, regexp_extract_all(text, {_quote(p)}, {group}) AS vals, doc_id, source FROM d WHERE regexp_matches(text, {_quote(p)})" for i, (kind, p, group, least) in enumerate(BASE + FURTHER))

SECRETS = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({_KINDS}),
h AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
f AS (SELECT doc_id, source, rank, kind, vals[i] AS val, coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS b, length(hits[i]) AS n FROM h WHERE length(vals[i]) >= least_n),
o AS (SELECT val, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS docs FROM f GROUP BY 1),
g AS (SELECT f.*, owners >= {EXAMPLE_OWNERS} OR (owners > 1 AND docs >= {EXAMPLE_REPOSITORIES}) AS example FROM f JOIN o USING (val)),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 coalesce(string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank) FILTER (WHERE rank < {len(BASE)}), '') AS base, string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank) AS spans,
 count(*) FILTER (WHERE NOT example) AS n_live, count(*) FILTER (WHERE example) AS n_example FROM g GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN a USING (doc_id)
"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * j + 1}, 5))::BIGINT // {32**k} % 32 + 1)::INT, 1)" for j in range(8) for k in (3, 2, 1, 0))

ARCHIVES = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM t
"""

_SEED_HEX = f"('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT"

MIX = f"""
WITH own AS (SELECT doc_id, source, len({_WORDS}) AS size, ({_SEED_HEX} + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE AS u FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM own GROUP BY 1),
wt AS (SELECT *, {list(WEIGHTS)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight, (source_size * {EPOCHS})::DOUBLE AS cap FROM per),
lv AS (SELECT *, ((SELECT sum(source_size) FROM per)::DOUBLE * {SHARE}::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM wt) - coalesce(sum(weight) OVER o, 0)) AS level FROM wt WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aim AS (SELECT source, source_size, n_rows, CASE WHEN level * weight >= cap THEN cap ELSE weight * (SELECT max(level) FROM lv WHERE level * weight < cap) END AS target FROM lv),
part AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies, CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p FROM aim),
r AS (SELECT own.*, source_size, target, copies, round(target)::BIGINT - copies::BIGINT * source_size AS wanted, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p) * least(greatest(size::DOUBLE * n_rows / source_size, 0.25::DOUBLE), 4::DOUBLE)) ELSE 'inf'::DOUBLE END AS ratio FROM own JOIN part ON own.source IS NOT DISTINCT FROM part.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ratio, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size + greatest(least(wanted - (upto - size), size), 0))::BIGINT AS taken FROM c
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters, by the column t of crc_table."""
    return f"xor(list_reduce(list_transform(range(1, strlen({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v FROM range(256) x(b)))"


def _levels(name: str, nodes: str, many: int) -> str:
    """CTEs of a tree over nodes (g, i, n, d): name_0 .. name_many, and name_run_k, the lists of digests that become one."""
    out = [f"{name}_0 AS ({nodes})"]
    for k in range(many):
        out.append(f"{name}_run_{k} AS (SELECT g, i // {FAN} AS i, max(n) AS n, list(d ORDER BY i) AS run FROM {name}_{k} GROUP BY 1, 2)")
        out.append(f"{name}_{k + 1} AS (SELECT g, i, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d FROM {name}_run_{k})")
    return ",\n".join(out)


def _way(name: str, rows: str, place: str, group: str, many: int) -> str:
    """CTEs that lead rows (folded, siblings) up a tree of _levels; the last one is name_way_many."""
    out = [f"{name}_way_0 AS ({rows})"]
    for k in range(many):
        at = f"({place} // {FAN**k} % {FAN})"
        before, after = f"array_to_string(run[1:{at}], '')", f"array_to_string(run[{at} + 2:], '')"
        out.append(f"{name}_way_{k + 1} AS (SELECT w.* EXCLUDE (folded, siblings), CASE WHEN r.n = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded, siblings || CASE WHEN r.n = 1 THEN '' ELSE {before} || {after} END AS siblings FROM {name}_way_{k} w JOIN {name}_run_{k} r ON r.g = {group} AND r.i = {place} // {FAN ** (k + 1)})")
    return ",\n".join(out)


_SOURCE_LEVELS, _ROOT_LEVELS = 6, 4  # enough for 16 million leaves a source and 65,536 sources
_told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

MANIFEST = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {" || ".join(map(_told, ("doc_id", "source", "lang", "n_chars")))} AS head, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS changed, {_crc32("doc_id::VARCHAR")} % {TAMPER_EVERY} = 0 AS tampered FROM documents, crc_table),
leaf AS (SELECT doc_id, g, sha256(head || {_told("text")}) AS leaf, CASE WHEN tampered THEN sha256(head || {_told("changed")}) ELSE sha256(head || {_told("text")}) END AS now FROM d),
put AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM leaf),
{_levels("s", "SELECT g, place AS i, n, leaf AS d FROM put", _SOURCE_LEVELS)},
subroot AS (SELECT g AS source_g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS source_place, count(*) OVER () AS n FROM s_{_SOURCE_LEVELS}),
{_levels("r", "SELECT '' AS g, source_place AS i, n, subroot AS d FROM subroot", _ROOT_LEVELS)},
{_way("s", "SELECT doc_id, g, leaf, place, now AS folded, '' AS siblings FROM put", "w.place", "w.g", _SOURCE_LEVELS)},
{_way("r", f"SELECT doc_id, leaf, subroot, source_place, folded, siblings FROM s_way_{_SOURCE_LEVELS} JOIN subroot ON g = source_g", "w.source_place", "''", _ROOT_LEVELS)}
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM r_way_{_ROOT_LEVELS}, (SELECT d AS root FROM r_{_ROOT_LEVELS})
"""

_GRAM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HEX_CRC = "list_transform(range(1, strlen(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)"
_grams = lambda table, key: " UNION ALL ".join(f"SELECT {key}, array_to_string(ws[i:i + {n - 1}], ' ') AS f FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM {table})" for n in range(1, LONGEST + 1))
_lower_words = lambda table, key: f"SELECT {key}, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GRAM_WORDS}'), []) AS ws FROM {table}"

RESAMPLE = f"""
WITH {_CRC_TABLE},
dw AS ({_lower_words("documents", "doc_id")}),
bw AS ({_lower_words("benchmark", "item_id")}),
df AS ({_grams("dw", "doc_id")}),
bf AS ({_grams("bw", "item_id")}),
every AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
hashed AS (SELECT f, xor(list_reduce({_HEX_CRC}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM every, crc_table),
dc AS (SELECT doc_id, bucket, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY 1, 2),
s AS (SELECT bucket, sum(n) AS s FROM dc GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY 1),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS big_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + {BUCKETS}) / ((s::DOUBLE + 1) * (big_t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dc JOIN gain USING (bucket) GROUP BY 1),
sc AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('{SAMPLE_SEED}:', doc_id)), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM dw LEFT JOIN w USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_words >= {LEAST_WORDS}),
drawn AS (SELECT * FROM k WHERE rank <= (SELECT floor({PERCENT} * count(*) / 100) FROM k))
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, rank::BIGINT AS rank FROM sc LEFT JOIN drawn USING (doc_id)
"""
