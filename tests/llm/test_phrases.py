import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sonograin.llm import phrases
from sonograin.llm.phrases import _merged, multikey_quicksort


def brute(docs, least, share, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[(lang or "und", tuple(w[i : i + m]))] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(g, w[i : i + m]) for (g, w), b in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * b >= share * f[(g, w[i : i + m])]}
    rows = defaultdict(list)
    for (g, w), a in found.items():
        if (g, w) not in gone:
            score, k, left, right = min((2000000 * a // (f[(g, w[:k])] + f[(g, w[k:])]), k, f[(g, w[:k])], f[(g, w[k:])]) for k in range(1, len(w)))
            rows[g].append((-score, -a, " ".join(w).encode(), left, right, k))
    return sorted((g, i + 1, p.decode(), -a, left, right, k, n[g], -s) for g, x in rows.items() for i, (s, a, p, left, right, k) in enumerate(sorted(x)[:top]))


def mined(docs, *args):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.k, r.n, r.score) for r in phrases.collocations(docs, *args).collect())


def test_quicksort_of_suffixes():
    r = random.Random(1)
    for n, kinds in ((0, 2), (1, 2), (300, 1), (500, 2), (2000, 5), (3000, 200)):
        keys = np.array([[r.randrange(kinds) for _ in range(4)] for _ in range(n)], np.int64).reshape(n, 4)
        for row in keys:
            row[r.randrange(1, 7) :] = -1  # most suffixes end early
        for counted in (0, 1):
            k = keys[np.argsort(keys[:, 0], kind="stable")] if counted else keys
            order, begins = multikey_quicksort(k, counted)
            assert [tuple(x) for x in k[order].tolist()] == sorted(map(tuple, k.tolist()))
            sizes = np.diff(begins, append=n)
            assert {tuple(k[order[b]].tolist()): int(s) for b, s in zip(begins, sizes)} == Counter(map(tuple, k.tolist()))


def test_partitions_meet_over_batches():
    import pyarrow as pa

    r = random.Random(2)
    rows = sorted((r.randrange(6), (w3 := r.randrange(4)) << 32 | (r.randrange(3) if w3 else 0), r.randrange(1, 4)) for _ in range(500))
    want = Counter()
    for k1, k2, n in rows:
        for key in {(k1, 0), (k1, k2 >> 32 << 32), (k1, k2)}:
            want[key] += n
    for size in (1, 3, 50, 999):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=["k1", "k2", "n"]) for i in range(0, len(rows), size)]
        for heavy in ([], [2, 3]):
            got = [tuple(x.values()) for b in _merged(heavy, 40)(iter(batches)) for x in b.to_pylist()]
            assert len(got) == len(set(got)) and {(a, b): n for a, b, n in got} == {k: n for k, n in want.items() if n >= 40 or k[0] in heavy}


def texts(r, many):
    words = [f"w{i}" for i in range(12)] + ["Ünd", "ÜND", "x y", "a\x01b", "a"]
    out = []
    for _ in range(many):
        t = "".join(r.choice([" ", " ", " ", "\t", ". ", "\n", "; "]) + r.choice([r.choice(words), "of the", "w1 w2 w3", "Not Only But Also"]) for _ in range(r.randrange(80)))
        out.append((r.choice(["en", "en", "en", "de", None, "und"]), t))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    docs = texts(r, 120) + [("en", None), ("fr", ""), ("fr", "word")] + [("de", "one and the same text, one and the same")] * 40
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "lang string, text string, id int, word string").repartition(3)
    for block, heavy in ((1 << 20, 1024), (200, 20)):  # one block a task; many blocks and several heavy pairs
        monkeypatch.setattr(phrases, "BLOCK", block)
        monkeypatch.setattr(phrases, "HEAVY", heavy)
        for least, share, top in ((30, 80, 2000), (5, 80, 2000), (3, 60, 7)):
            assert mined(df, least, share, top) == brute(docs, least, share, top)


def test_ties_and_edges(spark):
    # all of one score and count: the order is that of the bytes of phrases, not of their words
    docs = [("en", f"{a} {b}.") for a in ("a", "a\x01", "a!", "é", "z") for b in ("x", "x\x02y") for _ in range(3)]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert mined(df, 3, 80, 4) == brute(docs, 3, 80, 4)
    assert mined(df, 99, 80, 4) == [] and mined(df.limit(0), 3, 80, 4) == []
    long = [("en", "so far so good " * 60_000)]
    assert mined(spark.createDataFrame(long, "lang string, text string")) == brute(long, 30, 80, 2000)
    broken = spark.range(40).select(F.lit("en").alias("lang"), F.expr("cast(X'61FF2062' as string)").alias("text"))
    assert mined(broken)[0][2] == "a� b"


def test_exact_scores_beyond_64_bits(spark):
    big = 9 * 10**18
    found = spark.createDataFrame([(0 << 32 | 1, 0, big)], "k1 long, k2 long, a long")
    frequent = spark.createDataFrame([(0, "en", "p", big), (1, "en", "q", big + 12345)], "id long, lang string, word string, f long")
    out = phrases._ranked(found, frequent, spark.createDataFrame([("en", big)], "lang string, n long"), 80, 10).head()
    assert (out.phrase, out.score) == ("p q", 2000000 * big // (2 * big + 12345))
