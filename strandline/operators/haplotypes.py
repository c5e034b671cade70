"""Haplotypes taken apart: a block substitution as the edits of its best local alignment.

The alignment has affine gaps.  Its matrix is filled by anti-diagonals for all
rows of a batch at once, as the cells of a diagonal need only the two before, and
traced back for all rows at once.  What lies outside the best local alignment is one edit
on either side, so that the edits of a row always rebuild its alternative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MATCH, MISMATCH, OPEN, EXTEND = 2, -2, -3, -1
#: Cells of matrices that a task holds at once; two alleles that have more stay one block.
CELLS = 100_000_000
#: Rows aligned at once, so that the matrices' diagonals stay in a core's cache.
ROWS = 2048
EDITS = ArrayType(StructType([StructField("at", IntegerType()), StructField("ref", StringType()), StructField("alt", StringType())]))
_STOP, _BOTH, _ALT, _REF = 0, 1, 2, 3
_ALT_ON, _REF_ON = 4, 8


def _letters(texts: list[str], pad: int) -> np.ndarray:
    size = np.array(list(map(len, texts)))
    out = np.full((len(texts), size.max()), pad, np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode(), np.uint8)
    return out


def _traced(refs: list[str], alts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the best local alignment of each pair, from the end back: i and j by (cell, row), and how many cells a row has.

    Of ends with the best score the one with the smallest i + j counts, then the
    smallest i; a cell is reached by both bases before a base of alt, and that
    before one of ref.  Rows are the last axis, so that a step works on whole runs of memory.
    """
    a, b = _letters(refs, 1).T.copy(), _letters(alts, 2).T.copy()
    rows, (m, n) = len(refs), (len(a), len(b))
    size_a, size_b = np.array(list(map(len, refs))), np.array(list(map(len, alts)))
    trace = np.zeros((m + 1, n + 1, rows), np.uint8)
    number, never = (np.int16, -20000) if m + n < 4000 else (np.int32, -(10**9))  # below what any gap comes to
    score, before, fresh = (np.zeros((m + 1, rows), number) for _ in range(3))  # of the last diagonal, the one before and this, by i
    alt_gap, ref_gap, fresh_put, fresh_cut = (np.full((m + 1, rows), never, number) for _ in range(4))
    best, end = np.zeros(rows, number), np.zeros((2, rows), np.int64)
    ragged = size_a.min() < m or size_b.min() < n
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1) + 1
        i = np.arange(lo, hi)
        here, up = slice(lo, hi), slice(lo - 1, hi - 1)
        # a base of alt alone comes from (i, j - 1), one of ref alone from (i - 1, j)
        put_open, put_on = score[here] + OPEN, alt_gap[here] + EXTEND
        cut_open, cut_on = score[up] + OPEN, ref_gap[up] + EXTEND
        put, cut = np.maximum(put_open, put_on), np.maximum(cut_open, cut_on)
        equal = (a[up] == b[d - hi : d - lo][::-1]).view(np.uint8)
        both = before[up] + (equal * number(MATCH - MISMATCH) + number(MISMATCH))
        now = np.maximum(np.maximum(both, put), np.maximum(cut, 0))
        # _BOTH before _ALT before _REF, and _STOP where nothing is left
        diagonal = now == both
        way = (_REF - (_REF - _BOTH) * diagonal.view(np.uint8) - ((now == put) & ~diagonal).view(np.uint8)) * (now != 0).view(np.uint8)
        trace[i, d - i] = way + _ALT_ON * (put_on > put_open).view(np.uint8) + _REF_ON * (cut_on > cut_open).view(np.uint8)
        inside = np.where((i[:, None] <= size_a) & (d - i[:, None] <= size_b), now, number(-1)) if ragged else now
        high = inside.max(0)
        better = np.flatnonzero(high > best)
        if len(better):
            best[better] = high[better]
            top = i[inside[:, better].argmax(0)]
            end[:, better] = top, d - top
        fresh[:], fresh_put[:], fresh_cut[:] = 0, never, never
        fresh[here], fresh_put[here], fresh_cut[here] = now, put, cut
        before, score, fresh = score, fresh, before
        alt_gap, fresh_put = fresh_put, alt_gap
        ref_gap, fresh_cut = fresh_cut, ref_gap
    return _back(trace, *end)


def _back(trace: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ways back from cells (i, j), a step of all rows at a time; a row that has ended stays where it is."""
    row = np.arange(len(i))
    state, cells, count = np.zeros(len(i), np.uint8), [(i, j)], np.ones(len(i), np.int64)
    live = (i > 0) & (j > 0)
    while live.any():
        here = trace[i, j, row]
        way = np.where(state > 0, state, here & 3)
        live = live & (way != _STOP)
        alt, ref = live & (way == _ALT), live & (way == _REF)
        state = np.where(alt & (here & _ALT_ON > 0), np.uint8(_ALT), np.where(ref & (here & _REF_ON > 0), np.uint8(_REF), np.uint8(0)))
        i, j = i - (live & ~alt), j - (live & ~ref)
        cells.append((i, j))
        count += live
        live = live & (i > 0) & (j > 0)
    return np.stack([c[0] for c in cells]), np.stack([c[1] for c in cells]), count


def align(refs: list[str], alts: list[str]) -> list[list[tuple[int, int]]]:
    """For each pair the cells (i, j) of its best local alignment, from the end back: bases before i of ref and j of alt are still to be aligned."""
    i, j, count = _traced(refs, alts)
    return [list(zip(i[:n, k].tolist(), j[:n, k].tolist(), strict=True)) for k, n in enumerate(count)]


def aligned_edits(refs: list[str], alts: list[str]) -> list[list[tuple[int, str, str]]]:
    """edits of the best local alignment of each pair, with the runs of all rows found at once."""
    i, j, count = _traced(refs, alts)
    a, b = _letters(refs, 1), _letters(alts, 2)
    row, size = np.arange(len(refs)), np.stack([list(map(len, refs)), list(map(len, alts))])
    di, dj = i[:-1] - i[1:], j[:-1] - j[1:]
    same = (di == 1) & (dj == 1) & (a[row, np.minimum(i[1:], a.shape[1] - 1)] == b[row, np.minimum(j[1:], b.shape[1] - 1)])
    kind = np.zeros((len(i) + 1, len(row)), np.int8)  # of the step behind each cell, with a row of nothing on either side
    kind[1:-1] = np.where(same, 0, 2 * di + dj)
    # step k leads from cell k + 1 to cell k; from the beginning on, rows one after the other
    starts = np.nonzero(((kind[1:-1] > 0) & (kind[1:-1] != kind[2:]))[::-1].T)
    ends = np.nonzero(((kind[1:-1] > 0) & (kind[1:-1] != kind[:-2]))[::-1].T)
    at, till = len(i) - 1 - starts[1], len(i) - 2 - ends[1]
    first, zero = count - 1, np.zeros(len(row), np.int64)
    runs = np.concatenate([
        np.stack([row, zero, zero, zero, i[first, row], j[first, row]]), np.stack([starts[0], np.arange(1, len(at) + 1), i[at, starts[0]], j[at, starts[0]], i[till, ends[0]], j[till, ends[0]]]),
        np.stack([row, zero + len(at) + 1, i[0], j[0], *size]),
    ], 1)
    runs = runs[:, (runs[2] < runs[4]) | (runs[3] < runs[5])]
    runs = runs[:, np.lexsort((runs[1], runs[0]))]
    out: list[list[tuple[int, str, str]]] = [[] for _ in refs]
    for k, p, q, s, t in runs[[0, 2, 3, 4, 5]].T.tolist():
        cut, put = refs[k][p:s], alts[k][q:t]
        if cut != put:
            out[k].append((p, cut, put))
    return out


def edits(ref: str, alt: str, cells: list[tuple[int, int]]) -> list[tuple[int, str, str]]:
    """(bases of ref before, bases taken, bases put) of an alignment, in order: runs of differing bases, insertions, deletions, and what lies before and after."""
    path = cells[::-1]
    (i, j), (p, q) = path[0], path[-1]
    runs, last = [[0, 0, i, j]], None
    for (a, b), (c, e) in zip(path, path[1:], strict=False):
        kind = None if c - a == e - b and ref[a] == alt[b] else (c - a, e - b)
        if kind and kind == last:
            runs[-1][2:] = [c, e]
        elif kind:
            runs.append([a, b, c, e])
        last = kind
    runs.append([p, q, len(ref), len(alt)])
    return [(a, ref[a:c], alt[b:e]) for a, b, c, e in runs if ref[a:c] != alt[b:e]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("at", pa.int32()), ("ref", pa.string()), ("alt", pa.string())]))
    for batch in batches:
        refs, alts = ([s.upper() for s in batch.column(c).to_pylist()] for c in ("ref", "alt"))
        found = [[(0, r, a)] if r != a else [] for r, a in zip(refs, alts, strict=True)]
        small = lambda k: refs[k] and alts[k] and len(refs[k]) * len(alts[k]) <= CELLS
        order = sorted(filter(small, range(len(refs))), key=lambda k: (len(refs[k]), len(alts[k])))
        i = 0
        while i < len(order):
            j, m, n = i, 0, 0
            while j < len(order) and j - i < ROWS:
                m, n = max(m, len(refs[order[j]])), max(n, len(alts[order[j]]))
                if j > i and (j - i + 1) * (m + 1) * (n + 1) > CELLS // 8:
                    break
                j += 1
            part = order[i:j]
            for k, e in zip(part, aligned_edits([refs[k] for k in part], [alts[k] for k in part]), strict=True):
                found[k] = e
            i = j
        ends = np.concatenate([[0], np.cumsum(list(map(len, found)), dtype=np.int32)]).astype(np.int32)
        at, ref, alt = ([e[f] for row in found for e in row] for f in range(3))
        pieces = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(ref, pa.string()), pa.array(alt, pa.string())], fields=list(kind.value_type)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=[*batch.schema.names, "edits"])


def with_edits(blocks: DataFrame) -> DataFrame:
    """blocks (ref, alt and other columns; alleles not null) with edits, in order: at (bases of ref before), ref, alt.

    Rows stay where they are, so nothing is shuffled to bring edits and blocks together.
    """
    return blocks.mapInArrow(_cut, StructType([*blocks.schema.fields, StructField("edits", EDITS)]))


def decomposed(blocks: DataFrame) -> DataFrame:
    """blocks (vid, contig_id, pos, ref, alt and other columns) with a row for each edit of each, in place of the whole: pos, till, ref, alt.

    An insertion has pos at the base after it, an empty ref, and till before pos.  Edits
    don't overlap, and together make alt of ref; equal alleles give none.
    """
    each = with_edits(blocks.where("ref is not null and alt is not null")).withColumn("__e", F.explode("edits"))
    pos = F.col("pos") + F.col("__e.at")
    return each.withColumns({"pos": pos, "ref": F.col("__e.ref"), "alt": F.col("__e.alt"), "till": pos + F.length("__e.ref") - 1}).select(*blocks.columns)


def rebuilt(ref: Column, pos: Column, edits: Column) -> Column:
    """The alternative that edits (pos, gone: bases taken, alt), in order, make of ref, which begins at pos."""
    start = F.struct(F.lit("").alias("made"), F.lit(0).alias("upto"))

    def step(state: Column, e: Column) -> Column:
        at = (e["pos"] - pos).cast("int")
        return F.struct(F.concat(state["made"], F.substr(ref, state["upto"] + 1, at - state["upto"]), e["alt"]).alias("made"), (at + e["gone"]).cast("int").alias("upto"))

    return F.aggregate(edits, start, step, lambda s: F.concat(s["made"], F.substr(ref, s["upto"] + 1, F.length(ref))))
