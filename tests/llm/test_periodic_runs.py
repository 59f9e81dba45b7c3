import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonograin.llm import queries, runs


def brute(w, least=24, times=3):
    """Every maximal stretch of every period whose smallest period it is, by the failure function."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                s, fail, k = w[i : j + q], [-1], -1
                for x in s:
                    while k >= 0 and s[k] != x:
                        k = fail[k]
                    k += 1
                    fail.append(k)
                if size - fail[size] == q:
                    out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(r, many):
    w = []
    while len(w) < many:
        base = [r.randrange(r.choice([2, 3, 30])) for _ in range(r.randrange(1, r.choice([3, 10, 40])))]
        w += base * r.choice([1, 1, 2, 3, 5, 12]) + base[: r.randrange(len(base) + 1)]
    return w


def test_runs_against_brute_force():
    r = random.Random(4)
    for _ in range(400):
        w = words_of(r, r.choice([10, 30, 100, 300]))
        for least, times in ((24, 3), (7, 3), (50, 4), (1, 3)):
            assert runs.find_runs(np.array(w), least, times) == brute(w, least, times)


def test_work_stays_near_linear():
    assert runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 100_000:  # the word with the most runs for its length, but for a constant
        a, b = b, b + a
    assert len(runs.find_runs(np.array(b))) < len(b)
    passage = list(range(500))
    assert runs.find_runs(np.array((passage + [-1]) * 300)) == [(0, 300 * 501, 501)]  # k-grams with 300 places each
    far = [x for i in range(300) for x in [*passage, *range(10**6 + 600 * i, 10**6 + 600 * i + 600)]]
    assert runs.find_runs(np.array(far)) == []


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    docs = [(i, " ".join(map(str, words_of(r, r.choice([5, 60, 200]))))) for i in range(150)] + [(200, None), (201, " \n"), (202, "x y " * 30), (7, "ab " * 40), (7, "ab " * 40), (None, "b c " * 20), (204, "loop\t" * 90_000)]
    spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, h string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, queries.op13_periodic_runs(spark, str(tmp_path)).collect()))
    want = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in docs:
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        w = looped(i, w) if i is not None else w
        found = [(0, len(w), 1)] if i == 204 else brute(w)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if found else None
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append(f"Row(doc_id={i}, n_runs={len(found)}, start={best[0]}, length={best[1]}, period={best[2]}, exponent_milli={milli}, runs_sha256='{sha(''.join(f'{a},{b},{c}' + chr(10) for a, b, c in found))}', collapsed_sha256='{sha(text)}')")
    assert got == sorted(want)


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, 5), (1, "a b " * 20, 5), (None, None, 5)], "doc_id long, text string, collapsed int")
    out = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()]
    assert sorted(out, key=str) == [(1, [(0, 40, 2)], "a b"), (1, [(0, 40, 2)], "a b"), (None, [], "")]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert runs.periodic_runs(spark.createDataFrame([("k", "z " * 9)], "doc_id string, text string"), 9).head().runs[0].length == 9
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat(cast(X'61FF20' as string), 30)").alias("text"))
    assert runs.periodic_runs(broken).select(F.hex(F.col("collapsed").cast("binary")).alias("h")).head().h == "61FF"
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, 24, 2)


def test_texts_of_a_batch_share_no_runs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a " * 12) for i in range(50)], "doc_id long, text string").coalesce(1)
    assert all(r.runs == [] for r in runs.periodic_runs(docs).collect())
