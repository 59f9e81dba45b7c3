import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sonograin.llm import language_model as lm


def toks(t):
    return [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x] + [""]


def corpus():
    r = random.Random(8)
    langs = [[f"{p}{i}" for i in range(60)] for p in ("en", "de", "Fr")]
    rows = [(i, " ".join(r.choice(langs[i % 3])[: 2 + r.randint(0, 5)] for _ in range(r.randint(0, 80)))) for i in range(300)]
    return rows + [(1000, None), (1001, ""), (None, "en1 never-seen"), rows[3]]


def test_base_scores_and_gain(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    got = lm.scores(docs, states=4, rounds=6, own=40, buckets=16, common=60).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(x for i, t in rows if not held(i) for x in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks(t)), 6)) for i, t in rows)
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    out = [x for x in got if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out) + 0.1 * sum(x.n_tokens for x in out)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = {"first": norm(rng.random(2), 0), "move": norm(rng.random((2, 2)), 1), "emit": norm(rng.random((3, 2)), 0)}
    texts = [np.array(x) for x in ([0, 1, 2, 1], [2], [1, 1])]
    (group,) = lm._grouped(enumerate(texts))
    logs, _ = lm._forward(m, group, False)
    for (_, s), got in zip(group, logs):
        p = 0.0
        for path in np.ndindex(*[2] * len(s)):
            q = m["first"][path[0]] * m["emit"][s[0], path[0]]
            for t in range(1, len(s)):
                q *= m["move"][path[t - 1], path[t]] * m["emit"][s[t], path[t]]
            p += q
        assert abs(math.log10(p) - got) < 1e-9


def test_rounds_never_lower_the_training_likelihood(spark):
    enc = spark.createDataFrame([(False, bytearray(np.random.default_rng(i).integers(0, 5, 30).astype(np.uint16).tobytes())) for i in range(20)], "held_out boolean, symbols binary")
    seqs = [np.frombuffer(bytes(r.symbols), np.uint16).astype(int) for r in enc.collect()]
    (group,) = lm._grouped(enumerate(seqs))
    like = [lm._forward(lm.train(enc, 3, 5, np.ones(5), k), group, False)[0].sum() for k in (0, 1, 3)]
    assert like[0] < like[1] < like[2]


def plain_expected(m, s):
    """Forward and backward over one whole text, place by place."""
    states = len(m["first"])
    f, scale = [], []
    for t, x in enumerate(s):
        a = (m["first"] if t == 0 else f[-1] @ m["move"]) * m["emit"][x]
        scale.append(a.sum())
        f.append(a / a.sum())
    first, move, emit, b = None, np.zeros((states, states)), np.zeros_like(m["emit"]), np.ones(states)
    for t in range(len(s) - 1, -1, -1):
        first = f[t] * b
        emit[s[t]] += first
        if t:
            later = b * m["emit"][s[t]] / scale[t]
            move += np.outer(f[t - 1], later) * m["move"]
            b = m["move"] @ later
    return first, move, emit


@pytest.mark.parametrize("piece", [1, 2, 7, 512])
def test_expected_counts_are_those_of_whole_texts(piece):
    rng = np.random.default_rng(3)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = {"first": norm(rng.random(3), 0), "move": norm(rng.random((3, 3)) ** 4, 1), "emit": norm(rng.random((6, 3)) ** 3, 0)}
    texts = [rng.integers(0, 6, n) for n in (1, 2, 3, 1700, 14, 513, 512, 1, 40)]
    first, move, emit = lm.expected_counts(m, texts, piece)
    want = [sum(x) for x in zip(*(plain_expected(m, s) for s in texts))]
    for got, w in zip((first, move * m["move"], emit), want):
        assert np.allclose(got, w, rtol=1e-8, atol=1e-8)


def test_scores_against_a_plain_model(spark):
    """score() rebuilt from nothing but the documented model: counts, classes, plain Baum-Welch, plain forward sums."""
    rows = corpus() + [(5001, " ".join(f"en{i % 7}" for i in range(1300)))]
    states, rounds, own, buckets = 3, 2, 12, 8
    got = {(x.doc_id, x.n_tokens): x.score for x in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), states=states, rounds=rounds, own=own, buckets=buckets, common=20).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(x for i, t in rows if not held(i) for x in toks(t))
    mine = [t for _, t in sorted((-n, t.encode()) for t, n in c.items())][:own]
    symbol = lambda x: mine.index(x.encode()) if x.encode() in mine else own + zlib.crc32(x.encode()) % buckets
    totals, kinds = np.zeros(own + buckets), Counter()
    for t, n in c.items():
        totals[symbol(t)] += n
        kinds[symbol(t)] += 1
    m = lm._start(states, own + buckets, totals)
    for _ in range(rounds):
        f, v, e = (sum(x) for x in zip(*(plain_expected(m, [symbol(x) for x in toks(t)]) for i, t in rows if not held(i))))
        f, v, e = f + 0.1, v + 0.1, e + 0.02
        m = {"first": f / f.sum(), "move": v / v.sum(axis=1, keepdims=True), "emit": e / e.sum(axis=0)}
    for i, t in rows:
        a, log = m["first"], 0.0
        for k, x in enumerate(toks(t)):
            a = (a if k == 0 else a @ m["move"]) * m["emit"][symbol(x)]
            log += math.log10(a.sum())
            a = a / a.sum()
            if symbol(x) >= own:
                log += math.log10((c[x] + 0.5) / (totals[symbol(x)] + 0.5 * (kinds[symbol(x)] + 1)))
        assert abs(got[i, len(toks(t))] - log) < 1e-6 * max(1, abs(log)), i


def test_probabilities_of_one_text_length_sum_to_one(spark):
    """Over every token that can stand alone, the unknown share counted, and the end, the model's chances of one symbol sum to 1."""
    rows = [(i, w) for i, w in enumerate(["a", "a", "b", "c", "d", "e", "f", "a b", "b c d"] * 3)]
    held = [j for j in range(10_000_000, 10_000_400) if zlib.crc32(str(j).encode()) % 5 == 1]
    known = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split()})
    probe = list(zip(held, [*known, "never-seen"]))
    got = {x.doc_id: x for x in lm.scores(spark.createDataFrame(rows + probe + [(held[-1], "")], "doc_id long, text string"), states=1, rounds=2, own=2, buckets=1, common=3).collect()}
    end = 10 ** got[held[-1]].score  # one state: a text of a word and the end has the product of both chances
    assert abs(sum(10 ** got[i].score / end for i, _ in probe) + end - 1) < 1e-9


def test_most_frequent_breaks_ties_by_token(spark):
    r = random.Random(6)
    rows = [(f"t{i:03}".encode(), r.choice([1, 1, 1, 2, 2, 9, 500])) for i in range(200)]
    counts = spark.createDataFrame([(bytearray(t), c) for t, c in rows], "token binary, c long")
    for k in (1, 5, 60, 150, 199, 200, 500):
        assert sorted((bytes(x.token), x.c) for x in lm.most_frequent(counts, k).collect()) == sorted(sorted(rows, key=lambda x: (-x[1], x[0]))[:k])
    assert lm.most_frequent(counts.limit(0), 5).count() == 0


def test_empty(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    i = next(j for j in range(100) if zlib.crc32(str(j).encode()) % 5 == 1)
    (row,) = lm.scores(spark.createDataFrame([(i, "only held out")], "doc_id long, text string")).collect()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.base_score == 0
