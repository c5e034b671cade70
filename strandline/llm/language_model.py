"""A hidden Markov language model over whole words (operator 11).

Words of the training documents are emitted by STATES latent states.  Baum-Welch
passes over all training text give expected counts of emissions and transitions,
which are summed across partitions; texts are scored by the forward recursion,
scaled as it goes, which is their exact likelihood under the model.

Texts are encoded once, in blocks of a few MB, each with a dictionary of its own
(hashes of words) and its tokens as numbers into it.  The emission counts are a
table with a row a word, however many there are; in each pass a block is given
the rows of its own dictionary and returns their expected counts, so that
neither the vocabulary nor the corpus passes through the driver or one task.  Only
the counts of transitions, STATES + 2 rows, do.  Words seen RARE times or less
are emitted by each state in proportion to their counts: all together have one
expected count a state, and no row of their own in the table.  Blocks and
dictionaries are bucketed tables, so a pass shuffles only what it learns.

Within a block the recursion runs over segments of all texts at once: products
of transition and emission matrices carry a text's state over a segment, and
boundary states then start all segments side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import words as W
from .shared import bucketed, remove, saved

STATES, PASSES, HELD_OUT_OF, HELD_OUT = 8, 3, 5, 1
#: Words seen so often or less in training share their expected counts.
RARE = 8
#: Bytes of text in a block, and tokens in a segment.
BLOCK_BYTES, SEGMENT = 16_000_000, 64
#: Expected counts are summed as whole multiples of 1 / UNIT, so that the order in which partitions arrive changes nothing.
UNIT = 1 << 10
#: The smoothing of all states together is that of the base model, half a count a word.
HALF = 0.5
#: Stands for a text's end among the hashes of words.
END = np.uint64(0)
_WORD, _MOVE, _FIRST, _RARE = 0, 1, 2, 3
_BLOCK = "doc_id array<bigint>, held array<boolean>, sizes array<int>, codes binary, words array<bigint>, counts array<bigint>"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: by the crc32 of its id as text; a null id counts as empty, and is trained on."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == HELD_OUT


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts (doc_id, held, text): ids, token counts, tokens as numbers, the dictionary, and its counts in training texts."""
    squeeze = zstandard.ZstdCompressor()
    parts: list[tuple] = []
    size = 0

    def block() -> pa.RecordBatch:
        ids, held, sizes, own, codes = zip(*parts, strict=True)
        words = np.unique(np.concatenate(own))
        tokens = np.concatenate([np.searchsorted(words, w).astype(np.uint32)[c] for w, c in zip(own, codes, strict=True)])
        held, sizes = np.concatenate(held), np.concatenate(sizes)
        training = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [listed(pa.concat_arrays(ids)), listed(pa.array(held)), listed(pa.array(sizes)), pa.array([squeeze.compress(tokens)]), listed(pa.array(words.view(np.int64))), listed(pa.array(training))]
        parts.clear()
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held", "sizes", "codes", "words", "counts"])

    for whole in batches:
        for batch in W.slices(whole):
            w = W.words_of(batch.column("text"), lower=True)
            counts = w.counts
            hashes = np.full(len(w.start) + len(counts), END)
            hashes[np.arange(len(w.start)) + np.repeat(np.arange(len(counts)), counts)] = W.word_hashes(w)
            own, codes = np.unique(hashes, return_inverse=True)
            parts.append((batch.column("doc_id"), batch.column("held").to_numpy(zero_copy_only=False), (counts + 1).astype(np.int32), own, codes.astype(np.uint32)))
            size += len(w.data)
            if size >= BLOCK_BYTES:
                yield block()
                size = 0
    if parts:
        yield block()


class Model(NamedTuple):
    """start: of states; moves: from state to state; totals, rare: expected tokens, and of them rare words, of each state; tokens, kinds, rare_tokens: of the training text."""

    start: np.ndarray
    moves: np.ndarray
    totals: np.ndarray
    rare: np.ndarray
    tokens: int
    kinds: int
    rare_tokens: int

    @property
    def smoothing(self) -> float:
        return HALF / len(self.start)

    def emissions(self, c: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words by state from their counts in training and their expected ones; those of all words, and of one unknown, have the sum 1."""
        own, few = counts.copy(), c <= RARE
        own[few] = c[few, None] * (self.rare / max(self.rare_tokens, 1))
        own += self.smoothing
        own /= self.totals + self.smoothing * (self.kinds + 1)
        return own


class Segments(NamedTuple):
    """Texts cut into segments of at most SEGMENT tokens, longest segments first.

    at: first token; size; first: whether it begins a text; chain[j]: the j-th
    segments of the texts that have so many, the texts with most segments first.
    """

    at: np.ndarray
    size: np.ndarray
    first: np.ndarray
    chain: list[np.ndarray]
    texts: np.ndarray


def segments_of(sizes: np.ndarray, length: int = SEGMENT) -> Segments:
    per = -(-sizes // length)
    texts = np.argsort(-per, kind="stable")
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    doc = np.repeat(np.arange(len(sizes)), per)
    at = base[doc] + number * length
    size = np.minimum(length, sizes[doc] - number * length)
    order = np.argsort(-size, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    head = (np.cumsum(per) - per)[texts]
    many = np.searchsorted(-per[texts], -np.arange(1, (per.max() if len(per) else 0) + 1), "right")
    chain = [rank[head[:n] + j] for j, n in enumerate(many)]
    return Segments(at[order], size[order], (number == 0)[order], chain, texts)


def _active(s: Segments) -> np.ndarray:
    """How many segments have a token at each place."""
    return np.searchsorted(-s.size, -np.arange(1, (s.size.max() if len(s.size) else 0) + 1), "right")


def _carries(s: Segments, emit: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The matrix that takes the state before each segment to that after it with its tokens, scaled, and the logarithms of the scales."""
    k = len(m.start)
    carry = np.where(s.first[:, None, None], m.start[None, None, :], m.moves[None, :, :]) * emit[s.at][:, None, :]
    log = np.zeros(len(s.at))
    every = 8 if carry.dtype == np.float64 else 4  # the products of so many tokens stay above the least number
    for t, n in enumerate(_active(s)):
        if t:
            carry[:n] = (carry[:n].reshape(-1, k) @ m.moves).reshape(n, k, k) * emit[s.at[:n] + t][:, None, :]
        if t % every == every - 1:
            scale = carry[:n].sum((1, 2))
            carry[:n] /= scale[:, None, None]
            log[:n] += np.log(scale)
    return carry, log


def _entries(s: Segments, carry: np.ndarray, log: np.ndarray, k: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The state before each segment, given all tokens before it, and the log likelihood of each text."""
    before = np.zeros((len(s.at), k), carry.dtype)
    total = np.zeros(texts)
    state = np.full((texts, k), 1 / k, carry.dtype)  # a text's first matrix forgets it
    for seg in s.chain:
        n = len(seg)
        before[seg] = state[:n]
        after = np.einsum("ni,nij->nj", state[:n], carry[seg])
        scale = after.sum(1)
        state[:n] = after / scale[:, None]
        total[s.texts[:n]] += np.log(scale) + log[seg]
    return before, total


def expected(tokens: np.ndarray, sizes: np.ndarray, b: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of words by state, of moves and of first states, and the log likelihood of some texts; b: emissions of the dictionary's words.

    b may be of single precision, as the model then must be; a word's emissions
    may have any factor in common, which changes the likelihood alone.
    """
    k = len(m.start)
    s, emit = segments_of(sizes), b[tokens]
    carry, log = _carries(s, emit, m)
    before, total = _entries(s, carry, log, k, len(sizes))
    after = np.ones((len(s.at), k), b.dtype)
    for j in range(len(s.chain) - 1, 0, -1):
        seg = s.chain[j]
        back = np.einsum("nij,nj->ni", carry[seg], after[seg])
        after[s.chain[j - 1][: len(seg)]] = back / back.sum(1, keepdims=True)
    active = _active(s)
    ahead = np.zeros((len(active), len(s.at), k), b.dtype)
    state = before
    for t, n in enumerate(active):
        step = state[:n] @ m.moves
        if not t:
            step = np.where(s.first[:, None], m.start[None, :], step)
        step *= emit[s.at[:n] + t]
        state = step / step.sum(1, keepdims=True)
        ahead[t, :n] = state
    gamma = np.zeros((len(tokens), k), b.dtype)
    moves, first = np.zeros((k, k)), np.zeros(k)
    beta = after
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        g = ahead[t, :n] * beta[:n]
        gamma[s.at[:n] + t] = g / g.sum(1, keepdims=True)
        back = emit[s.at[:n] + t] * beta[:n]
        prior = ahead[t - 1, :n] if t else before
        pair = np.flatnonzero(~s.first) if not t else slice(None)
        norm = ((prior[pair] @ m.moves) * back[pair]).sum(1)
        moves += (prior[pair] / norm[:, None]).T @ back[pair]
        back = back @ m.moves.T
        beta[:n] = back / back.sum(1, keepdims=True)
    starts = np.cumsum(sizes) - sizes
    first += gamma[starts].sum(0)
    words = np.stack([np.bincount(tokens, g, len(b)) for g in np.ascontiguousarray(gamma.T)], 1)
    return words, moves * m.moves, first, float(total.sum())


def _parts(sizes: np.ndarray, most: int = 200_000) -> Iterator[slice]:
    """Runs of texts of about so many tokens; a longer text is one of its own."""
    end, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def _opened(block: pa.Table, words: pa.Table, m: Model, unit: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's row, its tokens, and of its dictionary the words' hashes, counts in training and emissions."""
    row = {c: block[c].combine_chunks().flatten() if isinstance(block[c].type, pa.ListType) else block[c][0].as_py() for c in ("doc_id", "held", "sizes", "codes", "words", "totals")}
    tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.uint32)
    c = row["totals"].to_numpy()
    counts = np.zeros((len(c), len(m.start)))
    at = words["i"].to_numpy()
    for j in range(len(m.start)):
        counts[at, j] = words[f"n{j}"].to_numpy() / unit
    return row, tokens, row["words"].to_numpy(), c, m.emissions(c, counts)


def _pass(m: Model, unit: int):
    k = len(m.start)

    def learn(block: pa.Table, words: pa.Table) -> pa.Table:
        """Expected counts of a block's training texts: of words, of moves from each state, of first states, and of rare words together."""
        row, tokens, names, c, b = _opened(block, words, m, unit)
        sizes, training = row["sizes"].to_numpy().astype(np.int64), ~row["held"].to_numpy(zero_copy_only=False)
        tokens, sizes = tokens[np.repeat(training, sizes)], sizes[training]
        found, moves, first = np.zeros_like(b), np.zeros((k, k)), np.zeros(k)
        at = np.concatenate([[0], np.cumsum(sizes)])
        # counts need no more than single precision, if no emission is near its least number
        b = (b / b.max(1, keepdims=True)).astype(np.float32)
        single = m._replace(start=m.start.astype(np.float32), moves=m.moves.astype(np.float32))
        for part in _parts(sizes):
            here, codes = np.unique(tokens[at[part.start] : at[part.stop]], return_inverse=True)
            w, x, f, _ = expected(codes, sizes[part], b[here], single)
            found[here] += w
            moves += x
            first += f
        some = np.flatnonzero(found.any(1) & (c > RARE))
        whole = np.rint(np.concatenate([found[some], moves, first[None], found[c <= RARE].sum(0)[None]]) * unit).astype(np.int64)
        kind = np.concatenate([np.full(len(some), _WORD), np.full(k, _MOVE), [_FIRST, _RARE]]).astype(np.int32)
        return pa.table({"kind": kind, "h": np.concatenate([names[some], np.arange(k), [0, 0]])} | {f"n{j}": whole[:, j] for j in range(k)})

    return learn


def _score(m: Model, unit: int):
    def score(block: pa.Table, words: pa.Table) -> pa.Table:
        row, tokens, _, c, b = _opened(block, words, m, unit)
        sizes = row["sizes"].to_numpy().astype(np.int64)
        base = np.log10((c + HALF) / (m.tokens + HALF * (m.kinds + 1)))
        at = np.concatenate([[0], np.cumsum(sizes)])
        total = np.zeros(len(sizes))
        for part in _parts(sizes):
            s = segments_of(sizes[part])
            carry, log = _carries(s, b[tokens[at[part.start] : at[part.stop]]], m)
            total[part] = _entries(s, carry, log, len(m.start), part.stop - part.start)[1]
        summed = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has a token
        return pa.table({"doc_id": row["doc_id"], "held_out": row["held"], "n_tokens": sizes, "n_known": summed((c > 0)[tokens].astype(np.int64)), "train_tokens": np.full(len(sizes), m.tokens), "base_score": summed(base[tokens]), "score": total / np.log(10)})

    return score


def language_model_scores(docs: DataFrame, states: int = STATES, passes: int = PASSES, unit: int = UNIT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z in lower case, and one end; a null, empty
    or wordless text has only its end.  base_score is a unigram model with half
    a count added to every word and to one unknown one; score is the hidden
    Markov model's, with the same half count shared by its states.  Both are log10
    probabilities, and both learn from the texts that are not held out.  Words
    count as equal by 64-bit hashes: over n words, n^2 / 2^65 false pairs are
    expected.  A null id is trained on; rows that share an id or are alike are
    texts of their own.  Other columns are ignored; an empty table gives no rows,
    and one without training texts scores by what is added.  Reruns agree:
    counts are summed as whole numbers, and first guesses come from hashes.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = bucketed(own.mapInArrow(_encode, _BLOCK).withColumn("block", F.monotonically_increasing_id()), "block", "blocks")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x")).select("block", "i", F.col("x.words").alias("h"), F.col("x.counts").alias("c"))
    words = bucketed(listed.withColumn("c", F.sum("c").over(Window.partitionBy("h"))), "h", "dictionaries")
    totals = words.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("totals"))
    packed = bucketed(blocks.drop("counts").join(totals, "block"), "block", "blocks")
    remove(spark, blocks)
    each = words.groupBy("h").agg(F.first("c").alias("c"))
    rare = F.col("c") <= RARE
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = each.agg(total("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), total(F.when(rare, F.col("c"))).alias("rare")).first()
    # a random preference of each word for some states breaks their symmetry
    lean = [0.25 + F.pmod(F.xxhash64("h", F.lit(j)), F.lit(1024)) / 1024 for j in range(states)]
    even = sum(lean[1:], lean[0])
    counts = [f"n{j}" for j in range(states)]
    table = saved(each.where(~rare).select("h", *(F.rint(F.col("c") * lean[j] / even * unit).cast("long").alias(counts[j]) for j in range(states))), "emissions")

    def model(start: np.ndarray, moves: np.ndarray, scarce: np.ndarray) -> Model:
        totals = table.agg(*(total(n).alias(n) for n in counts)).first()
        smooth = lambda x: (x + 1 / states) / (x.sum(-1, keepdims=True) + 1)
        return Model(smooth(start), smooth(moves), np.array(totals) / unit + scarce, scarce, sums.n, sums.v, sums.rare)

    def with_words(run, schema: str) -> DataFrame:
        given = words.where(~rare).join(table.hint("shuffle_hash"), "h").select("block", "i", *counts)
        return packed.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, schema)

    m = model(np.zeros(states), np.eye(states) * 4 * states, np.full(states, sums.rare / states))
    for _ in range(passes):
        found = with_words(_pass(m, unit), "kind int, h bigint, " + ", ".join(f"{n} bigint" for n in counts)).groupBy("kind", "h").agg(*(F.sum(n).alias(n) for n in counts))
        found = saved(found, "expected")
        told = {(r.kind, r.h): np.array(r[2:]) / unit for r in found.where(F.col("kind") != _WORD).collect()}
        remove(spark, table)
        table = found.where(F.col("kind") == _WORD).drop("kind")
        none = np.zeros(states)
        m = model(told.get((_FIRST, 0), none), np.stack([told.get((_MOVE, j), none) for j in range(states)]), told.get((_RARE, 0), none))
    return with_words(_score(m, unit), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
