import hashlib
import random
import re

import pytest

from sonograin.llm.decontaminate import clean_documents, contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    doc, hit, ids = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(doc) - n + 1):
                if doc[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    ids.add(item)
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(doc)


def cases():
    r = random.Random(5)
    vocab = ["a", "b", "É", "été", "the", "of", "x1"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(13, 40))) for i in range(6)] + [(100, "one, TWO three"), (101, ""), (102, None), (103, "solo"), (104, "a a a a a a a a a a a a a a a a"), (0, text(14))]
    docs = [(0, None), (1, ""), (2, "..."), (3, "One two THREE!"), (4, "a " * 50), (5, "Solo")]
    for i in range(6, 60):
        body = text(r.randint(0, 60))
        if r.random() < 0.6:
            k, t = r.choice(items)
            w = (t or "").split()
            s = r.randint(0, max(0, len(w) - 13))
            body += "\n" + " ".join(w[s : s + r.randint(11, 30)]).upper().replace("É", "É") + ". " + text(r.randint(0, 20))
        docs.append((i, body))
    return items, docs + [docs[3]]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small):
    items, docs = cases()
    items = items[:6] if small else items
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(rows) == sorted((i, *brute(t, items)) for i, t in set(docs))
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert all(sum(s.to - s["from"] for s in spans[r[0]]) == r[2] for r in rows)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x", 3), (None, "solo", "y", 4), (None, "solo", "y", 4)], "doc_id long, text string, item_id string, h long")
    assert [r.n_hit for r in contamination(docs, items).collect()] == [0, 0]
    one = spark.createDataFrame([(None, "solo")], "item_id long, text string")
    kept = clean_documents(docs, one)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b", "x", 3)]


@pytest.mark.parametrize("period", [1, 2, 5])
def test_repeated_words_and_the_shuffled_join(spark, period):
    phrase = " ".join(f"w{i}" for i in range(period))
    items = [(i, f"{phrase} " * (300 // period)) for i in range(3)] + [(7, "head " + f"{phrase} " * 20 + "tail")]
    docs = [(1, f"{phrase} " * (3000 // period)), (2, f"own words {phrase} " + f"{phrase} " * (60 // period) + "own end"), (3, "nothing here")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(tuple(r)[:6] for r in contamination(d, i, broadcast_bytes=b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans").collect()) for b in (1 << 20, 0)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 2, 3]
    assert got[0][0][1:4] == (3000 // period * period, 3000 // period * period, 4)
    assert got[0][1] == (2, *brute(docs[1][1], items)) and got[0][2] == (3, *brute(docs[2][1], items))


def test_twenty_thousand_equal_words(spark):
    docs = spark.createDataFrame([(1, "same " * 20_000)], "doc_id long, text string")
    items = spark.createDataFrame([(i, "same " * 300) for i in range(3)], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.n_items, [tuple(s) for s in r.spans]) for r in contamination(docs, items).collect()] == [(20_000, 20_000, 3, [(0, 20_000)])]


def test_the_sieve_of_few_bits_loses_nothing(spark):
    from sonograin.llm import decontaminate

    items, docs = cases()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept, decontaminate.CELLS = decontaminate.CELLS, 4
    try:
        got = sorted(tuple(r) for r in contamination(d, i).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    finally:
        decontaminate.CELLS = kept
    assert got == sorted((x, *brute(t, items)) for x, t in set(docs))
