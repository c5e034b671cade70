"""Mixture-controlled packing (operator 5).

Each source is a queue of its documents' tokens.  Deficit round-robin fills
window after window: in each, a source is due its target share of the window's tokens,
and what a whole number of tokens leaves over is carried to the next window, so
after w windows a source has been served floor(w * its tokens a window), never a
token or more behind.  When a queue ends, its share goes to the others.  As
every source's service is known in closed form, from the totals of the queues,
each document finds the windows of its own tokens without a scan over others:
deficits cross partitions as arithmetic.

Windows follow one another in one stream, which is cut every `length` tokens, so
only the last sequence is short.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import words as W
from .shared import saved

LENGTH, WINDOW, END, WEIGHTS = 1024, 64 * 1024, 0, (3, 1, 2)
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Byte-pair ids of whole texts, as the `tokenizers` file at `path` gives them without special tokens added.

    Vocabulary, merges and added tokens are those of the file, which must be a
    byte-level one without a normalizer; a text that spells an added token gets
    that token's id.  Texts are cut before single spaces between characters that
    are no white space, where such a vocabulary's pattern always cuts; equal
    pieces of a batch are encoded once.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in file["model"]["merges"]]
        first = len(vocabulary.keys() - merged - added.keys())
        plain = file["normalizer"] is None and file["pre_tokenizer"]["type"] == "ByteLevel" and not file["pre_tokenizer"]["add_prefix_space"]
        if not plain or any(vocabulary[m] != first + i for i, m in enumerate(merged)) or any(re.search(r"\s", t) for t in added):
            raise ValueError(f"{path} is no byte-level vocabulary whose ids follow its merges")
        byte = {c: b for b, c in enumerate(self.characters())}
        table = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        self.one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=added)
        self.added = [t.encode() for t in added]
        self.wide = max([*table.values(), *added.values()]) > 65535
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def characters() -> list[str]:
        """The visible character that stands for each byte in byte-level vocabularies."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(256, 512))
        return [chr(b if b in shown else next(hidden)) for b in range(256)]

    @staticmethod
    def cuts(data: np.ndarray) -> np.ndarray:
        """Bytes that begin a piece: spaces between bytes of surely visible characters."""
        n = len(data)
        out = np.zeros(n, bool)
        if n < 3:
            return out
        plain = (data > 0x20) & (data < 0x7F)
        # a two-byte character from C3 on is no white space; others may be
        second = np.zeros(n, bool)
        second[1:] = (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        first = (data >= 0xC3) & (data < 0xE0)
        out[1:-1] = (data[1:-1] == 0x20) & (plain | second)[:-2] & (plain | first)[2:]
        return out

    def _ids(self, piece: bytes, special: bool) -> list[int]:
        text = piece.decode()
        if special and any(t in piece for t in self.added):
            return self.one.encode(text, allowed_special="all")
        return self.one.encode_ordinary(text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of the texts."""
        data, at = W.raw(texts)
        cut = self.cuts(data)
        cut[at[(at > 0) & (at < len(data))] - 1] = False  # a space that ends a text joins no next one
        start = at[:-1][np.diff(at) > 0]
        cut[start] = True
        start = np.flatnonzero(cut)
        of = np.searchsorted(start, at)
        end = np.append(start[1:], len(data))
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        keys = W.word_hashes(W.Words(data, at, start, end, of))
        unique, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        raw, known, found = data.tobytes(), self.known, []
        special = any(t in raw for t in self.added)
        if len(known) > 400_000:
            known.clear()
        for key, i in zip(unique.tolist(), where.tolist(), strict=True):
            ids = known.get(key)
            if ids is None:
                ids = known[key] = np.array(self._ids(raw[start[i] : end[i]], special), np.uint16 if not self.wide else np.uint32)
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat, first = np.concatenate(found), np.cumsum(size) - size
        count = size[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        return flat[np.repeat(first[inverse] - total[:-1], count) + np.arange(total[-1])], total[of]


class Service:
    """Tokens of each source served before window w; sources are numbers in their order.

    shares: None for the shares of the queues themselves, which then all end together.
    """

    def __init__(self, totals: list[int], window: int, shares: list[float] | None = None):
        self.totals = np.array(totals, np.int64)
        share = np.array(totals if shares is None else shares, float)
        left, time, times, served = self.totals.astype(float), 0.0, [0.0], [np.zeros(len(totals))]
        if ((share <= 0) & (left > 0)).any():
            share = np.maximum(share, share[share > 0].min(initial=1.0) * 1e-6)  # all is packed in the end
        while (left > 0).any():
            rate = np.where(left > 0, share, 0)
            rate *= window / rate.sum()
            step = (left[left > 0] / rate[left > 0]).min()
            gone = left - rate * step
            left = np.where(gone <= 1e-9 * self.totals, 0.0, gone)
            time += step
            times.append(time)
            served.append(self.totals - left)
        self.times, self.served = np.array(times), np.array(served).T
        self.windows = int(np.ceil(self.times[-1]))

    def before(self, source: int | np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of one source."""
        now = np.floor(np.interp(w, self.times, self.served[source]) + 1e-6).astype(np.int64)
        return np.where(w >= self.windows, self.totals[source], np.minimum(now, self.totals[source]))

    def window_of(self, source: int, t: np.ndarray) -> np.ndarray:
        """The window that serves token t of the source."""
        w = np.clip(np.interp(t, self.served[source], self.times).astype(np.int64), 0, max(self.windows - 1, 0))
        while (late := self.before(source, w) > t).any():
            w = w - late
        while (early := self.before(source, w + 1) <= t).any():
            w = w + early
        return w

    def place(self, source: int, w: np.ndarray) -> np.ndarray:
        """Where the source's tokens of window w begin in the stream."""
        parts = [self.before(s, w + (s < source)) for s in range(len(self.totals))]
        return np.sum(parts, axis=0) if parts else np.zeros(len(w), np.int64)


def pieces_of(service: Service, source: int, at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, size, sequence, offset) of documents of one source, whose n tokens each begin at token `at` of its queue."""
    first, last = service.window_of(source, at), service.window_of(source, at + n - 1)
    doc, w = _spread(first, last - first + 1)
    begin = service.before(source, w)
    low, high = np.maximum(begin, at[doc]), np.minimum(service.before(source, w + 1), (at + n)[doc])
    full = high > low
    doc, w, low, high, begin = doc[full], w[full], low[full], high[full], begin[full]
    place = service.place(source, w) + low - begin
    part, sequence = _spread(place // length, (place + high - low - 1) // length - place // length + 1)
    p = np.maximum(sequence * length, place[part])
    size = np.minimum((sequence + 1) * length, (place + high - low)[part]) - p
    return doc[part], (low - at[doc])[part] + p - place[part], size, sequence, p - sequence * length


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each file and process, as it takes a while to read; it remembers pieces up to a bound."""
    return Encoder(path, pattern)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of first, first + 1, ... `count` times for each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def pack(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, weights: tuple[float, ...] | None = WEIGHTS, shares: dict[str | None, float] | None = None, length: int = LENGTH, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces (PIECE): every token of every row of docs, in exactly one piece.

    A row's tokens are the ids of its text (null: none), then END.  Every window
    of the stream has the target proportions as long as the queues last:
    `weights`, given to the sources in turn by code point, null last, or the
    `shares` of named sources (others: as little as can be); with neither, those
    of the queues.  A null source is a source, and a null doc_id stays null.
    Repeated rows are packed as often as they come.  tokenizer and pattern name
    another byte-level vocabulary file and its pattern.  Other columns are
    ignored; an empty table gives no pieces.  There is one row a source on the
    driver.
    """
    if tokenizer is None or pattern is None:
        import public_tokenizers

        tokenizer, pattern = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, served = encoder(tokenizer, pattern), {}
        part = TaskContext.get().partitionId()
        for whole in batches:
            for batch in W.slices(whole):
                ids, of = coder.encode(batch.column("text"))
                n = np.diff(of) + 1
                at = np.zeros(len(n), np.int64)
                sources = batch.column("source").to_pylist()
                for i, s in enumerate(sources):
                    at[i] = served.get(s, 0)
                    served[s] = at[i] + int(n[i])
                blobs = [np.append(ids[a:b], END).astype("<u4" if coder.wide else "<u2").tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
                yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array([part] * len(n), pa.int32()), pa.array(at), pa.array(n), pa.array(blobs, pa.binary())], ["doc_id", "source", "part", "at", "n", "ids"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    tokens = saved(own.mapInArrow(encode, "doc_id bigint, source string, part int, at bigint, n bigint, ids binary"), "tokens")
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), before.alias("base"))
    queues = tokens.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").isNull(), "source").collect()
    number = {r["source"]: i for i, r in enumerate(queues)}
    share = [float(shares.get(s, 0.0)) for s in number] if shares is not None else weights and [float(weights[i % len(weights)]) for i in range(len(number))]
    service = Service([r["n"] for r in queues], window, share)
    wide = encoder(tokenizer, pattern).wide

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in PIECE.split(", ")]
        for batch in batches:
            queue = np.array([number[x] for x in batch.column("source").to_pylist()])
            base, at, n = (batch.column(c).to_numpy() for c in ("base", "at", "n"))
            for q in np.unique(queue):
                rows = np.flatnonzero(queue == q)
                doc, start, size, sequence, offset = pieces_of(service, int(q), (base + at)[rows], n[rows], length)
                rows = rows[doc]
                checks, of, ids = np.empty(len(rows), np.int64), -1, b""
                for i, (row, a, k) in enumerate(zip(rows.tolist(), start.tolist(), size.tolist(), strict=True)):
                    if row != of:
                        of, ids = row, np.frombuffer(batch.column("ids")[row].as_buffer(), "<u4" if wide else "<u2").astype("<u4")
                    checks[i] = zlib.crc32(ids[a : a + k])
                yield pa.record_batch([batch.column("doc_id").take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (start, size, checks, n[rows], sequence, offset))], names)

    placed = tokens.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    return placed.select("doc_id", "source", "base", "at", "n", "ids").mapInArrow(cut, PIECE)
