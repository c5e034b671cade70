"""Quality classifier from weak labels (operator 6).

Overlapping heuristics vote good, bad or nothing on each document.  Expectation-
maximisation over the counts of all vote patterns in the corpus estimates how
often each heuristic votes what in either class, and with that the posterior of
each pattern.  A linear scorer over hashed features learns the posteriors, and
scores every document.

The scorer is fitted with both classes weighted alike, so a score s means odds of
s / (1 - s) before the share of either class counts.  With the share g of good
documents that expectation-maximisation found, a document is more likely good
than bad from a score of 1 - g on: that is the limit, and nothing is set by hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .quality_rules import _repeat_words
from .shared import saved

#: Distinct texts that the scorer is fitted on: those with the smallest hashes.
FIT_DOCUMENTS = 6000
BITS = 15
LABELLERS = ("symbols", "repeats", "compression", "word_length", "capitals", "bare_marks", "prose")

_LETTER, _UPPER, _DIGIT, _MARK, _END = (np.zeros(256, bool) for _ in range(5))
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"#*$%&|<>!?~^_=+@\\/{}[]")] = True
_END[list(b".,;:!?")] = True


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _measures(w: W.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Shares that the heuristics judge; n_words and bytes with them."""
    import zstandard

    n, size = w.counts, np.diff(w.at)
    per_word = lambda table: (lambda c: c[w.end] - c[w.start])(np.concatenate([[0], np.cumsum(table[w.data], dtype=np.int64)]))
    letters, upper, marks = per_word(_LETTER), per_word(_UPPER), per_word(_MARK)
    words = np.maximum(n, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    inner = w.of[:-1][w.of[:-1] < len(hashes)]
    same[inner] = False
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    data, squeeze = w.data.tobytes(), zstandard.ZstdCompressor(level=1).compress
    ratio = np.array([(b - a) / len(squeeze(data[a:b])) if b > a else 1.0 for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)])
    return {
        "n": n, "size": size, "ratio": ratio, "same": _sums(same, w.of) / words, "repeat": _repeat_words(hashes, w.of) / words, "marked": _sums(marks > 0, w.of) / words,
        "bare": _sums(letters == 0, w.of) / words, "caps": _sums((upper > 1) & (upper * 2 > letters), w.of) / words, "length": _sums(w.end - w.start, w.of) / words, "distinct": np.bincount(doc[order][fresh], minlength=len(n)) / words,
    }


def votes_of(m: dict[str, np.ndarray]) -> np.ndarray:
    """A column for each of LABELLERS: 1 good, 0 bad, 2 nothing; all but the last look for one fault each."""
    some = m["n"] >= 3
    room = np.where(m["size"] >= 2000, 3.4, 2.9)
    dull = (m["n"] >= 15) & ((m["repeat"] >= 0.5) | (m["same"] >= 0.1)) | (m["n"] >= 40) & (m["n"] < 4000) & (m["distinct"] < 0.15)
    faults = [some & (m["marked"] >= 0.15), some & dull, (m["size"] >= 300) & (m["ratio"] >= room), some & (np.abs(m["length"] - 6.0) >= 6.0), some & (m["caps"] >= 0.4), some & (m["bare"] >= 0.2)]
    prose = some & (m["marked"] <= 0.05) & (m["repeat"] <= 0.2) & (m["same"] <= 0.03) & (m["caps"] <= 0.1) & (m["bare"] <= 0.06) & (np.abs(m["length"] - 6.0) <= 4.0)
    return np.stack([*(np.where(f, 0, 2) for f in faults), np.where(prose, 1, 2)], 1).astype(np.int8)


#: Steps of the measures that are features of a text, and the weight of each beside its words.
_STEPS = {"ratio": 4.0, "same": 40.0, "repeat": 20.0, "marked": 20.0, "bare": 20.0, "caps": 20.0, "length": 1.0, "distinct": 20.0}
MEASURE_WEIGHT = 0.35


def features_of(w: W.Words, hashes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features as (slot, weight, offsets): shapes of words, pairs of shapes, word endings, whose weights have length 1 by text; and steps of the measures, each with and without the step of the text's length."""
    per_word = lambda table: (lambda c: c[w.end] - c[w.start])(np.concatenate([[0], np.cumsum(table[w.data], dtype=np.int64)]))
    letters, upper, digits, marks = per_word(_LETTER), per_word(_UPPER), per_word(_DIGIT), per_word(_MARK)
    length = w.end - w.start
    first = w.of[:-1][w.of[:-1] < len(hashes)]  # words that have none before them in their text
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first] = False
    last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    shape = np.minimum(length, 31) // 4 + 8 * np.minimum(upper, 2) + 24 * (letters == 0) + 48 * np.minimum(marks, 2) + 144 * (digits > 0) + 288 * same + 576 * _END[last]
    pair = np.zeros(len(shape), np.int64)
    pair[1:] = shape[:-1] * 2048 + shape[1:]
    pair[first] = shape[first]
    ending = np.where(length > 1, w.data[np.maximum(w.end - 2, 0)].astype(np.int64), 0) * 256 + last if len(w.end) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    slot = np.concatenate([(W.mix(x.astype(np.uint64) + np.uint64(s << 40)) >> np.uint64(64 - bits)).astype(np.int64) for s, x in ((1, shape), (2, pair), (3, ending))])
    key, count = np.unique(np.concatenate([doc] * 3) << bits | slot, return_counts=True)
    owner, slot = key >> bits, key & ((1 << bits) - 1)
    weight = np.sqrt(count)
    norm = np.sqrt(np.bincount(owner, weight**2, len(w.counts)))
    m = _measures(w, hashes)
    steps = [np.minimum(m[name] * by, 200).astype(np.uint64) for name, by in _STEPS.items()]
    long = np.log2(np.maximum(m["n"], 1)).astype(np.uint64)
    more = [W.mix(x + np.uint64((j + 8) << 40) + with_length * ((long + np.uint64(1)) << np.uint64(20))) >> np.uint64(64 - bits) for j, x in enumerate(steps) for with_length in (np.uint64(0), np.uint64(1))]
    some = np.flatnonzero(w.counts > 0)
    owner, slot, weight = np.concatenate([owner, *[some] * len(more)]), np.concatenate([slot, *(x[some].astype(np.int64) for x in more)]), np.concatenate([weight / norm[owner], np.full(len(some) * len(more), MEASURE_WEIGHT)])
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    return slot[order], weight[order], np.searchsorted(owner, np.arange(len(w.counts) + 1))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """EM on vote patterns: rates[labeller, class, vote], and the share of good.

    Starts from documents without a bad vote as the good ones: the rounds then
    find which bad votes go together with others, and which are noise.
    A small prior keeps each heuristic better than chance.
    """
    good = (patterns != 0).all(1)
    posterior, n = np.where(good, 0.95, 0.05), patterns.shape[1]
    rates, share = np.full((n, 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        for c, weight in enumerate(((1 - posterior) * counts, posterior * counts)):
            for v in range(3):
                prior = (3.0 if v == c else 1.0) if v < 2 else 1.0
                rates[:, c, v] = ((patterns == v) * weight[:, None]).sum(0) + prior
            rates[:, c] /= rates[:, c].sum(1, keepdims=True)
        share = ((posterior * counts).sum() + 1) / (counts.sum() + 2)
        before, posterior = posterior, posteriors(patterns, rates, share)
        if np.abs(before - posterior).max(initial=0) < 1e-6:
            break
    return rates, float(share)


def posteriors(patterns: np.ndarray, rates: np.ndarray, share: float) -> np.ndarray:
    """Probability of good for each pattern; keeping silent counts as an outcome too."""
    odds = np.full(len(patterns), np.log(share) - np.log(1 - share))
    for j in range(patterns.shape[1]):
        odds += (np.log(rates[j, 1]) - np.log(rates[j, 0]))[patterns[:, j]]
    return 1 / (1 + np.exp(-odds))


def fit(slot: np.ndarray, weight: np.ndarray, at: np.ndarray, label: np.ndarray, bits: int = BITS, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels, both classes weighted alike, by Adagrad; the last weight is the bias."""
    w, squares = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-8)
    if not len(label):
        return w
    owner = np.repeat(np.arange(len(label)), np.diff(at))
    balance = label / max(label.sum(), 1e-9) + (1 - label) / max((1 - label).sum(), 1e-9)
    balance /= balance.sum()
    for _ in range(rounds):
        z = np.bincount(owner, weight * w[slot], len(label)) + w[-1]
        off = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        g = np.append(np.bincount(slot, weight * off[owner], 1 << bits), off.sum()) + decay * w
        squares += g * g
        w -= rate * g / np.sqrt(squares)
    return w


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(len(LABELLERS))
    for whole in batches:
        for batch in W.slices(whole):
            w = W.words_of(batch.column("text"))
            pattern = votes_of(_measures(w, W.word_hashes(w))) @ base
            yield pa.record_batch([batch.column("hash"), pa.array(pattern, pa.int32())], ["hash", "pattern"])


class Model(NamedTuple):
    weights: np.ndarray
    rates: np.ndarray
    share: float

    @property
    def limit(self) -> float:
        """The score from which a document is more likely good than bad."""
        return 1.0 - self.share


def quality_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Weights of the scorer, rates of the labellers (in the order of LABELLERS), and the share of good.

    Votes of all documents are counted by pattern, of which there are 3**7 at
    most.  The scorer is fitted on the driver, on fit_documents distinct texts at
    most, half of them of patterns that are more likely bad; their features are
    what reaches it.  Texts are known by a hash, so ids may be null or repeat,
    and copies of a text count once in the fit.
    """
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    voted = saved(own.mapInArrow(_votes, "hash bigint, pattern int"), "votes")
    found = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    code, counts = np.array([r["pattern"] for r in found], np.int64), np.array([r["n"] for r in found], float)
    patterns = code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    rates, share = estimate(patterns, counts)
    belief = dict(zip(code.tolist(), posteriors(patterns, rates, share).tolist(), strict=True))
    bad = [c for c, p in belief.items() if p < 0.5]
    halves = [voted.where(c).groupBy("hash").agg(F.min("pattern").alias("pattern")).orderBy("hash").limit(fit_documents // 2) for c in (F.col("pattern").isin(bad), ~F.col("pattern").isin(bad))]
    chosen = saved(halves[0].union(halves[1]).select(F.col("hash").alias("c_hash"), F.col("pattern").alias("c_pattern")), "chosen")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of fit_documents at most
        for whole in batches:
            keys = whole.column("hash").to_pylist()
            fresh = [i for i, h in enumerate(keys) if not (h in seen or seen.add(h))]
            for batch in W.slices(whole.take(pa.array(fresh, pa.int64()))):
                w = W.words_of(batch.column("text"))
                slot, weight, at = features_of(w, W.word_hashes(w))
                lists = [pa.LargeListArray.from_arrays(pa.array(at), pa.array(x)).cast(pa.list_(t)) for x, t in ((slot, pa.int32()), (weight, pa.float32()))]
                yield pa.record_batch([batch.column("hash"), batch.column("c_pattern"), *lists], ["hash", "pattern", "slot", "weight"])

    picked = own.join(F.broadcast(chosen), F.col("hash") == F.col("c_hash")).select("hash", "c_pattern", "text")  # fit_documents rows at most
    sample = picked.mapInArrow(features, "hash bigint, pattern int, slot array<int>, weight array<float>").dropDuplicates(["hash"]).orderBy("hash").toArrow()
    slot, weight = (sample.column(c).combine_chunks() for c in ("slot", "weight"))
    at = np.concatenate([[0], np.cumsum(np.asarray(slot.value_lengths().to_numpy(zero_copy_only=False), np.int64))])
    label = np.array([belief[p] for p in sample.column("pattern").to_pylist()])
    return Model(fit(slot.flatten().to_numpy(zero_copy_only=False).astype(np.int64), weight.flatten().to_numpy(zero_copy_only=False).astype(float), at, label), rates, share)


def score_column(weights: np.ndarray, text: str) -> Column:
    """The score of each text, in place; no shuffle."""

    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            parts = [pa.array([], pa.float64())]
            for part in W.slices(pa.record_batch([texts], ["text"])):
                w = W.words_of(part.column(0))
                slot, weight, at = features_of(w, W.word_hashes(w))
                owner = np.repeat(np.arange(len(w.counts)), np.diff(at))
                z = np.bincount(owner, weight * weights[slot], len(w.counts)) + weights[-1]
                parts.append(pa.array(np.where(w.counts > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)))
            yield pa.concat_arrays(parts)

    return F.arrow_udf(of, "double")(F.col(text).cast("string"))


def quality_classifier(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """doc_id, score, kept for each row of docs.

    Null, empty and wordless texts score 0 and are rejected; ids may be null or
    repeat; a text's score depends on the text alone, so ties and repeated rows
    are scored alike; whole texts are read.  Other columns are ignored.  An
    empty table gives no rows, and a scorer that is never used.
    """
    model = quality_model(docs, doc_id, text, **options)
    return docs.select(F.col(doc_id).alias("doc_id"), score_column(model.weights, text).alias("score")).withColumn("kept", (F.col("score") > 0) & (F.col("score") >= model.limit))
