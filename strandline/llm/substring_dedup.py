"""Substring dedup (operator 2): every repeated window of words but its first is cut out.

Documents are dealt into blocks, which are ranges of doc_id.  A block hashes
every window of its texts with a rolling hash and sends each distinct hash once,
split over buckets of hash values; so a passage in a third of all documents
costs one entry a block.  A bucket, counting hashes across blocks, answers each
block with one bit a hash: whether an earlier block has it.  With these bits a
block knows, for every window, whether an earlier one has the same words, and
merges such windows into maximal intervals.  Texts move once, hashes once, and
the answers are an eighth of a byte a window.

Windows are taken as equal by a 64-bit hash: over n windows, n**2 / 2**65 pairs
of different ones are expected to agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

WINDOW = 20
BLOCK_BYTES = 4_000_000
_REMOVED = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascending with the hash


class _Block:
    """Words of a block's texts in the order of doc_id (null first), with distinct window hashes and the first place of each."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = table.column("doc_id")
        ids = np.asarray(self.ids.fill_null(0).to_numpy(), np.int64)
        null = np.asarray(self.ids.is_null())
        order = np.lexsort((ids, ~null))
        self.order, ids, null = order, ids[order], null[order]
        same = np.zeros(len(ids), bool)
        same[1:] = (ids[1:] == ids[:-1]) & (null[1:] == null[:-1])
        self.number = np.cumsum(~same)  # rows that share an id share a place in the order
        self.w = W.words_of(table.column("text").take(pa.array(order)))
        parts, at = [], [0]
        value, self.first = W.windows(W.word_hashes(self.w), self.w.of, window)
        self.doc = np.repeat(np.arange(len(ids)), np.diff(self.first))
        self.start = np.arange(len(value)) - self.first[self.doc]
        by = np.argsort(value, kind="stable")
        sorted_value = value[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = sorted_value[1:] != sorted_value[:-1]
        self.hashes = sorted_value[fresh]
        self.rank = np.empty(len(by), np.int64)
        self.rank[by] = np.cumsum(fresh) - 1
        # the smallest place, by (id, start), of each hash
        place = self.number[self.doc] * (1 << 32) + self.start
        least = np.minimum.reduceat(place[by], np.flatnonzero(fresh)) if len(by) else np.zeros(0, np.int64)
        self.later = place > least[self.rank] if len(by) else np.zeros(0, bool)


def _send(window: int, buckets: int):
    def of(table: pa.Table) -> pa.Table:
        b = _Block(table, window)
        bucket = _bucket(b.hashes, buckets)
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edge))
        block = table.column("block")[0].as_py()
        blobs = [_pack(b.hashes[edge[i] : edge[i + 1]]) for i in full]
        return pa.table({"block": pa.array([block] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "hashes": pa.array(blobs, pa.binary())})

    return of


def _pack(value: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte plane by byte plane: the high planes are mostly zeros, which compress away."""
    import zstandard

    step = np.diff(value, prepend=np.uint64(0))
    planes = step.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _answer(table: pa.Table) -> pa.Table:
    """For each block's hashes of one bucket, in their order, a bit: has an earlier block the same one?"""
    table = table.sort_by("block")
    parts = [_unpack(x) for x in table.column("hashes").to_pylist()]
    value = np.concatenate(parts)
    order = np.argsort(value, kind="stable")  # equal ones stay in the order of blocks
    earlier = np.zeros(len(value), bool)
    earlier[order[1:]] = value[order[1:]] == value[order[:-1]]
    edge = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(earlier[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": pa.array(np.diff(edge), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _remove(window: int):
    def of(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        if not table.num_rows:
            return schema.empty_table()
        b = _Block(table, window)
        answers = answers.sort_by("bucket")
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(answers.column("bits").to_pylist(), answers.column("n").to_pylist(), strict=True)]
        earlier = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        drop = b.later | earlier[b.rank] if len(b.rank) else b.later
        w = b.w
        at = w.of[b.doc[drop]] + b.start[drop]
        cover = np.zeros(len(w.start) + window + 1, np.int64)
        cover[: len(w.start) + 1] += np.bincount(at, minlength=len(w.start) + 1)[: len(w.start) + 1]
        cover[window:] -= np.bincount(at, minlength=len(w.start) + 1)[: len(w.start) + 1]
        gone = np.cumsum(cover)[: len(w.start)] > 0
        data, rows = w.data.tobytes(), []
        start, end = w.start.tolist(), w.end.tolist()
        for i, row in enumerate(b.order.tolist()):
            p, q = int(w.of[i]), int(w.of[i + 1])
            mine = gone[p:q]
            digest = hashlib.sha256(b" ".join([data[start[p + j] : end[p + j]] for j in np.flatnonzero(~mine).tolist()])).hexdigest()
            turn = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).tolist() if mine.any() else []
            spans = [{"start": a, "end": z} for a, z in zip(turn[::2], turn[1::2], strict=True)]
            rows.append((b.ids[row].as_py(), q - p, int(mine.sum()), digest, spans))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return of


def blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """docs with `block`, a range of doc_id with about block_bytes of text, and the bytes of all texts.

    The bounds are quantiles of ids, in which each id counts as often as its
    text has steps of a 64th of a block, begun ones too.  So long texts that stand
    together make more blocks, not longer ones, and many tiny ones don't make a
    long list; only a text longer than a block makes one of its own size.  The
    bounds are eight bytes a block; they travel with the task.
    """
    step = max(1, block_bytes // 64)
    weighed = docs.select("doc_id", F.ceil(F.octet_length("text") / step).cast("int").alias("steps")).where("doc_id is not null and steps > 0")
    found = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.ceil(F.octet_length("text") / step)).alias("s")).first()
    total, n = found["b"] or 0, max(1, -(-(found["s"] or 0) // 64))
    cuts = np.zeros(0, np.int64)
    if n > 1:
        each = weighed.select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("steps"))))
        found = each.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"]
        cuts = np.unique(np.array(found or [], np.int64))

    @F.arrow_udf("int")
    def block(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in column:
            at = np.searchsorted(cuts, np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64), "left") + 1
            yield pa.array(np.where(np.asarray(ids.is_null()), 0, at), pa.int32())

    return docs.withColumn("block", block("doc_id")), total


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and spans (word intervals cut out, end exclusive).

    A window goes if its word sequence also starts earlier: at a smaller doc_id,
    or in the same document before.  A null id counts as smaller than any; rows
    that share an id are one document's versions: the smaller start wins, and
    the same start in both is no repeat, so equal rows get equal results.  Null
    and empty texts have no words.  Other columns are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt, total = blocks(own, block_bytes)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(16, partitions, -(-total // 12_000_000))
    dealt = dealt.repartition(partitions, "block")
    sent = dealt.groupBy("block").applyInArrow(_send(window, buckets), "block int, bucket int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, n int, bits binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(window), _REMOVED)
