"""Language model, resampling and Merkle manifest against step-by-step versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import language_model, merkle, resampling, shared
from strandline.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, place int, n string, block string, weight int, g string, word string"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    one, two = [f"a{i}" for i in range(30)], [f"Bé{i}" for i in range(30)]
    speak = lambda w, n: " ".join(rng.choice(w) for _ in range(n))
    texts = [None, "", " \n", "Word", "x\x00y Z-z 9", speak(one, 700), "q" * 70_000 + " end"] + [speak(rng.choice((one, two)), rng.randrange(1, 80)) for _ in range(60)]
    out = [(i * 3, t, ["en", None][i % 2], ["hot", "hot", None, "b", "é", ""][i % 6], [None, i][i % 2], 1, "2", "3", 4, "5", "6") for i, t in enumerate(texts)]
    return [*out, out[9], out[10][:1] + ("Other Text",) + out[10][2:], (None, texts[12], *out[1][2:]), (None,) * 11]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tally(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_numbered_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), rng.choice([None, *range(40)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "h string, v int, i int")
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {r: (k, len(mine)) for h in "ab" for mine in [sorted((r for r in rows if r[0] == h), key=key)] for k, r in enumerate(mine)}
    assert {(r.h, r.v, r.i): (r.place, r.n) for r in shared.numbered(df, ["v", "i"], "h").collect()} == want
    assert {(r.h, r.v, r.i): r.place for r in shared.numbered(df, ["v", "i"]).collect()} == {r: k for k, r in enumerate(sorted(rows, key=key))}
    assert shared.numbered(df.limit(0), ["v"], "h").count() == 0


def brute_markov(texts, training, lean, states, passes):
    """Baum-Welch and forward recursion one token at a time, for texts as lists of tokens."""
    counts = collections.Counter(t for x, yes in zip(texts, training, strict=True) if yes for t in x)
    n, v = sum(counts.values()), len(counts)
    d, rare = 0.5 / states, {t for x in texts for t in x if counts[t] <= language_model.RARE}
    n_rare = sum(counts[t] for t in rare)
    c = {t: counts[t] * (1 / states if t in rare else lean[t] / lean[t].sum()) * np.ones(states) for x in texts for t in x}
    start, moves = np.zeros(states), np.eye(states) * 4 * states
    for k in range(passes + 1):
        totals = sum(c.values(), np.zeros(states))
        scarce = sum((c[t] for t in rare), np.zeros(states))
        b = {t: ((counts[t] / max(n_rare, 1) * scarce if t in rare else x) + d) / (totals + d * (v + 1)) for t, x in c.items()}
        pi, a = (start + 1 / states) / (start.sum() + 1), (moves + 1 / states) / (moves.sum(1, keepdims=True) + 1)
        if k == passes:
            break
        c, start, moves = {t: np.zeros(states) for t in c}, np.zeros(states), np.zeros((states, states))
        for x in (x for x, yes in zip(texts, training, strict=True) if yes):
            ahead = []
            for i, t in enumerate(x):
                p = (ahead[-1] @ a if i else pi) * b[t]
                ahead.append(p / p.sum())
            back = np.ones(states)
            for i in range(len(x) - 1, -1, -1):
                g = ahead[i] * back
                c[x[i]] = c[x[i]] + g / g.sum()
                if i:
                    pair = ahead[i - 1][:, None] * a * (b[x[i]] * back)[None, :]
                    moves += pair / pair.sum()
                    back = a @ (b[x[i]] * back)
                    back /= back.sum()
                else:
                    start += g / g.sum()
    out = []
    for x in texts:
        score, state = 0.0, None
        for t in x:
            p = (pi if state is None else state @ a) * b[t]
            score, state = score + math.log10(p.sum()), p / p.sum()
        out.append((sum(counts[t] > 0 for t in x), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in x), score))
    return out


@pytest.mark.parametrize(("states", "passes", "unit"), [(8, 3, 1 << 22), (3, 1, 1 << 22), (8, 3, language_model.UNIT)])
def test_language_model(spark, docs, rows, states, passes, unit):
    texts = [[*WORD.findall(lower(r[1])), ""] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    kinds = sorted({t for x in texts for t in x} - {""})
    hashes = {t: int(h) for t, h in zip(kinds, W.word_hashes(W.words_of(pa.array(kinds))).view(np.int64), strict=True)} | {"": 0}
    table = spark.createDataFrame(list(hashes.items()), "word string, h bigint").select("word", *((0.25 + F.pmod(F.xxhash64("h", F.lit(j)), F.lit(1024)) / 1024).alias(f"l{j}") for j in range(states)))
    lean = {r[0]: np.array(r[1:]) for r in table.collect()}
    want = sorted((-1 if r[0] is None else r[0], h, len(x), *w) for r, h, x, w in zip(rows, held, texts, brute_markov(texts, [not h for h in held], lean, states, passes), strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.language_model_scores(docs, states, passes, unit).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5 if unit > 1 << 20 else 2e-3)
    held_gain = sum(g[6] - g[5] for g in got if g[1] and g[2] > 20)
    assert passes == 1 or held_gain > 0


def test_language_model_of_few_texts(spark, none):
    assert language_model.language_model_scores(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = language_model.language_model_scores(spark.createDataFrame([(held, "a b")], "doc_id int, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9


def test_segments_keep_likelihoods():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 300, 64, 65, 2])
    tokens, b = rng.integers(0, 9, sizes.sum()), rng.random((9, 3))
    m = language_model.Model(np.array([0.2, 0.3, 0.5]), np.array([[0.8, 0.1, 0.1], [0.3, 0.3, 0.4], [0.1, 0.2, 0.7]]), np.ones(3), np.ones(3), 1, 1, 1)
    words, moves, first, total = language_model.expected(tokens, sizes, b, m)
    assert np.allclose(words.sum(1), np.bincount(tokens, minlength=9)) and np.isclose(moves.sum(), (sizes - 1).sum()) and np.isclose(first.sum(), len(sizes))
    want, at = 0.0, 0
    for n in sizes:
        p = m.start * b[tokens[at]]
        for t in tokens[at + 1 : at + n]:
            p = (p @ m.moves) * b[t]
        want, at = want + math.log(p.sum()), at + n
    assert np.isclose(total, want)


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def test_features_of_a_batch(rows):
    texts = [r[1] for r in rows] + ["ÿ" * 40, "a" * 1000 + " b", "é-É"]
    bucket, doc, n_words = resampling.features(pa.array(texts, pa.string()))
    want = sorted((i, g) for i, t in enumerate(texts) for g in grams(t)[0])
    assert sorted(zip(doc.tolist(), bucket.tolist(), strict=True)) == want and n_words.tolist() == [grams(t)[1] for t in texts]


def test_resampling(spark, docs, rows, none):
    bench = [(0, "a1 a2 a3 a4"), (1, None), (2, "Bé1 other words")]
    target = spark.createDataFrame(bench, "item_id int, text string")
    s, t = (collections.Counter(g for x in texts for g in grams(x)[0]) for texts in ([r[1] for r in rows], [b[1] for b in bench]))
    gain = lambda g: math.floor(1000 * math.log((t[g] + 1) * (s.total() + 10_000.0) / ((s[g] + 1) * (t.total() + 10_000.0))))
    scored = []
    for r in rows:
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        g, n = grams(r[1])
        weight = sum(map(gain, g))
        scored.append((r[0], len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for percent in (5, 60):
        drawn = able[: percent * len(able) // 100]
        want = collections.Counter((*x[:4], k + 1) for k, x in enumerate(drawn))
        want += collections.Counter((*x[:4], None) for x in scored) - collections.Counter((*x[:4], None) for x in drawn)
        assert tally(resampling.resample(docs, target, percent), "doc_id", "n_features", "weight", "score", "rank") == want
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(docs, target.limit(0)).where("rank is not null").count() == 5 * len(able) // 100


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_way(levels, at):
    for below in levels[:-1]:
        run = at // 16 * 16
        yield "".join(below[run:at]), "".join(below[at + 1 : run + 16])
        at //= 16


def brute_manifest(rows):
    told = lambda *xs: H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in xs))
    each = collections.defaultdict(list)
    for i, text, lang, source, n_chars, *_ in rows:
        leaf = told(i, source, lang, n_chars, text)
        tampered = zlib.crc32(str("" if i is None else i).encode()) % 5 == 0
        each[source].append((i is not None, i or 0, leaf, i, told(i, source, lang, n_chars, None if text is None else lower(text)) if tampered else None))
    order = sorted(each, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(each[s], key=lambda x: x[:3]), brute_tree([x[2] for x in sorted(each[s], key=lambda x: x[:3])])) for s in order}
    top = brute_tree([trees[s][1][-1][0] for s in order])
    for k, s in enumerate(order):
        mine, levels = trees[s]
        for at, (*_, leaf, i, now) in enumerate(mine):
            way = [*brute_way(levels, at), *brute_way(top, k)]
            d, path = now or leaf, []
            for level, (a, b) in enumerate(way):
                path.append((level, d))
                d = H(a, d, b)
            yield (i, leaf, levels[-1][0], top[-1][0], H(*(x for step in way for x in step)), d, d == top[-1][0]), [*path, (len(way), d)] if now else None


def test_manifest(spark, docs, rows, none):
    columns = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    got = merkle.merkle(docs)
    assert tally(got, *columns) == collections.Counter(x for x, _ in brute_manifest(rows))
    nodes = tally(merkle.versions(got), "doc_id", "level", "digest")
    assert nodes == collections.Counter((x[0], *p) for x, path in brute_manifest(rows) if path for p in path)
    assert merkle.merkle(none).count() == 0


def test_manifest_of_many_leaves(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 40}" if i % 3 else "hot", i) for i in range(1500)] + [(9000, "lone", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = merkle.merkle(docs)
    assert tally(got, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == collections.Counter(x for x, _ in brute_manifest(rows))
    own = merkle.versions(got).where("doc_id = 9").orderBy("level").collect()  # in the hot source: 500 leaves, 2 blocks, 1 root; its place is 1 of 42
    assert [r["index"] for r in own] == [3, 0, 0, 1, 0, 0] or zlib.crc32(b"9") % 5


def test_tampering_of_ones_own(docs, rows):
    got = merkle.merkle(docs, tampered=F.col("doc_id") == 15, changed_text=F.lit("other"))
    assert [r["doc_id"] for r in got.where("not verified").collect()] == [15] and got.where("copies is not null").count() == 1
