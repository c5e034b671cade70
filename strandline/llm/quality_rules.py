"""Quality rules by compression bands (operator 1).

Every whole document, and every fixed-length chunk of it, is compressed with
zstandard.  The ratio of plain to compressed bytes must lie in a band that
depends on the length: repetitive text compresses too well, random text hardly
at all, and short text can do neither.  Counting rules stand beside the bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: (bytes from which a band holds, least ratio, greatest ratio); no judgement below the first.
DOCUMENT_BANDS = ((300, 1.05, 2.8), (1000, 1.2, 3.0), (4000, 1.35, 3.3), (16000, 1.45, 3.8), (64000, 1.5, 4.2))
CHUNK_BYTES = 4096
#: For chunks, which all have CHUNK_BYTES: the last one is the text's last CHUNK_BYTES.
CHUNK_BAND = (1.15, 3.3)
#: Share of a document's bytes, each in the first chunk that has it, that may lie in chunks outside the band.
CHUNK_SHARE = 0.34
LEVEL = 3

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_COLUMNS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunk_share", pa.float64()))
SCHEMA = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,ratio:double,bad_chunk_share:double>"


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def _repeat_words(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Words of each text that stand in a 3-word window found twice or more in that text."""
    value, first = W.windows(hashes, of, 3)
    out = np.zeros(len(hashes) + 1, np.int64)
    if len(value):
        doc = np.repeat(np.arange(len(of) - 1), np.diff(first))
        order = np.lexsort((value, doc))
        v, d = value[order], doc[order]
        same = np.zeros(len(v) + 1, bool)
        same[1:-1] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
        twice = order[same[1:] | same[:-1]]
        at = of[doc[twice]] + twice - first[doc[twice]]
        cover = np.zeros(len(hashes) + 4, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 3, -1)
        np.cumsum(np.cumsum(cover)[: len(hashes)] > 0, out=out[1:])
    return out[of[1:]] - out[of[:-1]]


def rules_of(texts: pa.Array) -> pa.StructArray:
    """The columns of SCHEMA for each text; a null is an empty text, which fails."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    w = W.words_of(texts)
    n_words = w.counts.astype(np.int64)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[w.at[1:]] - total[w.at[:-1]]

    lead = (w.data & 0xC0) != 0x80  # one such byte in each code point
    repeat = _repeat_words(W.word_hashes(w), w.of)
    base_failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    data = w.data.tobytes()
    ratio, bad, dup = np.ones(len(n_words)), np.zeros(len(n_words)), np.zeros(len(n_words), np.int64)
    kept = ~base_failed
    for i, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
        text = data[a:b]
        dup[i] = _dup_lines(text)
        if not text:
            continue
        ratio[i] = len(text) / len(squeeze(text))
        band = [x for x in DOCUMENT_BANDS if len(text) >= x[0]][-1:]
        kept[i] &= all(low <= ratio[i] <= high for _, low, high in band)
        if len(text) > CHUNK_BYTES:
            outside = 0
            for j in range(0, len(text), CHUNK_BYTES):
                first = min(j, len(text) - CHUNK_BYTES)
                if not CHUNK_BAND[0] <= CHUNK_BYTES / len(squeeze(text[first : first + CHUNK_BYTES])) <= CHUNK_BAND[1]:
                    outside += min(CHUNK_BYTES, len(text) - j)
            bad[i] = outside / len(text)
            kept[i] &= bad[i] <= CHUNK_SHARE
    values = (n_words, per_text(lead & ~W._SEPARATOR[w.data]), per_text(_SYMBOLS[w.data]), dup, repeat, base_failed, kept, ratio, bad)
    return pa.StructArray.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])


def _columns(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in column:
        batch = pa.record_batch([texts], ["text"])
        parts = [rules_of(x.column(0)) for x in W.slices(batch)]
        yield pa.concat_arrays(parts) if parts else rules_of(texts)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and the columns of SCHEMA; no shuffle.

    Null and empty texts have no words and fail; null ids pass through; repeated
    rows give repeated results; texts of any length are read whole; other
    columns, whatever their names, are not touched; an empty table gives none.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), F.arrow_udf(_columns, SCHEMA)(F.col(text)).alias("q")).select("doc_id", "q.*")
