"""Target-distribution importance resampling over hashed n-grams (operator 12).

Documents are weighted by how much likelier their words, pairs and triples are
in a target set than in the corpus, by counts in hashed buckets, and drawn
without replacement by the Gumbel trick: the highest sums of a weight and
random noise that the id determines.

Texts of a batch are joined with a separator byte that no UTF-8 text holds; one
regex pass finds all words and separators, and the separators' places give the
words' documents by searchsorted, which masks n-grams that would cross two of
them.  The CRC of an n-gram comes from those of its words: appending bytes is a
linear step on a CRC, read from tables by the number of bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import numbered, saved

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 3, 42, 20, 5
_SEPARATOR = b"\xff"
#: In lower-cased UTF-8, the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ are these bytes; the last byte is the separator.
_TOKEN = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")


def _shift_tables() -> np.ndarray:
    """tables[k, j]: what byte j of a CRC adds to it after 2**k zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    first = np.stack([one, *(byte << (8 * j - 8) for j in (1, 2, 3))]).astype(np.uint32)
    out = [first]
    for _ in range(31):
        out.append(_shifted(out[-1], out[-1]))
    return np.stack(out)


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_SHIFT = _shift_tables()


def appended(crc: np.ndarray, n: np.ndarray, then: np.ndarray) -> np.ndarray:
    """CRCs of strings a + b from those of a (crc) and of b (then, of n bytes)."""
    out = crc.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero((n >> k) & 1)
        out[at] = _shifted(_SHIFT[k], out[at])
    return out ^ then


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a batch of texts, the text that each is of, and the number of words of each text."""
    data, at = W.raw(texts)
    whole = data.tobytes()
    joined = _SEPARATOR.join(whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)).lower()
    found = _TOKEN.findall(joined)
    crc = np.fromiter(map(crc32, found), np.uint32, len(found))
    size = np.fromiter(map(len, found), np.int64, len(found))
    edge = np.flatnonzero((size == 1) & (crc == crc32(_SEPARATOR)))
    place = np.arange(len(found))
    doc = np.searchsorted(edge, place)
    word = np.ones(len(found), bool)
    word[edge] = False
    spaced = appended(np.full(len(found), crc32(b" "), np.uint32), size, crc)  # a blank and the word
    gram, ends, values, docs = crc, word, [crc[word]], [doc[word]]
    for n in range(2, longest + 1):
        gram = appended(gram[:-1], size[n - 1 :] + 1, spaced[n - 1 :])
        ends = word[n - 1 :] & word[: len(gram)] & (doc[n - 1 :] == doc[: len(gram)])
        values.append(gram[ends])
        docs.append(doc[: len(gram)][ends])
    return (np.concatenate(values) % np.uint32(buckets)).astype(np.int64), np.concatenate(docs), np.bincount(doc[word], minlength=len(at) - 1)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: features of all texts by bucket, summed within tasks before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in W.slices(whole):
                total += np.bincount(features(batch.column("text"), buckets, longest)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, with one added to every count; as many numbers as there are buckets, at any size."""
    x = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    x = x.join(bucket_counts(docs, buckets=buckets, longest=longest).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_counts(target, buckets=buckets, longest=longest).withColumnRenamed("n", "t"), "bucket", "left")
    counted = saved(x.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    sums = counted.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    real = lambda c: c.cast("double")
    gain = F.floor(1000 * F.log((real(F.col("t")) + 1) * F.lit(float(sums.S + buckets)) / ((real(F.col("s")) + 1) * F.lit(float(sums.T + buckets)))))
    return np.array([r.gain for r in counted.select("bucket", gain.alias("gain")).orderBy("bucket").collect()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the gains of its features) of each row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole):
                bucket, doc, n_words = features(batch.column("text"), len(gain), longest)
                n = batch.num_rows
                weight = np.zeros(n, np.int64)
                np.add.at(weight, doc, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(np.bincount(doc, minlength=n)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_features, weight, score, rank (null if not drawn).

    Of the N rows with at least least_words words, floor(percent N / 100) with the
    highest scores are drawn, ties to the smaller id, a null id last; rows that
    share an id have the same noise, and those alike are interchangeable.  Null,
    empty and wordless texts have no features and weight 0, and are never drawn.
    Without any features in target, or in docs, all counts are those added.
    Other columns are ignored; an empty table gives no rows.  Ranks come from
    ranges of scores, so that no task holds all rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = weights(own, gains(own, target, buckets, longest), longest)
    scored = saved(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = scored.where(F.col("n_words") >= least_words).select("*", (-F.col("score")).alias("__down"), F.col("doc_id").isNull().alias("__none"))
    ranked = numbered(able, ["__down", "__none", "doc_id", "weight", "n_features"])
    rank = F.when(F.col("place") < F.floor(percent * F.col("n") / 100), F.col("place") + 1)
    few = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).select("doc_id", "n_features", "weight", "score", "rank").union(few.select("doc_id", "n_features", "weight", "score", "rank"))
