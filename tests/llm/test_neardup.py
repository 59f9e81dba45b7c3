import random
from itertools import combinations

import xxhash

from sonograin.llm.neardup import TRIPLES, components, links, near_duplicates, one_of_each


def brute_fp(text):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    root = dict(enumerate(range(len(fps))))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[find(j)] = find(i)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def corpus():
    r = random.Random(4)
    rows = [(900, None), (901, ""), (902, " \t "), (903, "É a"), (904, "é a"), (905, "One"), (906, "one")]
    base = " ".join(f"w{i}" for i in range(150))
    for i in range(120):
        w = base.split()
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(150)] = f"x{r.randrange(40)}"
        rows.append((i * 3, " ".join(w)))
    rows += [(1000 + i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 30)))) for i in range(80)]
    return rows + [rows[8], (None, rows[9][1]), (None, "lonely words only here now")]


def test_every_four_positions_hold_a_triple():
    assert all(any(set(t) <= set(q) for t in TRIPLES) for q in combinations(range(8), 4))


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    fps = [brute_fp(t) for _, t in rows]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps)))
    for hot in (512, 5):
        got = [(str(x.doc_id), x.fingerprint, str(x.component_id)) for x in near_duplicates(docs, hot=hot).collect()]
        assert sorted(got) == want
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    named = sorted(x.doc_id for x in kept.collect() if x.doc_id is not None)
    assert named == sorted({int(c) for _, _, c in want if c != "None"}) and kept.count() == len({c for _, _, c in want})


def test_links_are_all_close_pairs(spark):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(30)} | {0}
    fps |= {x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for x in list(fps) for _ in range(4)}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(x.a, x.b) for x in links(spark.createDataFrame([(sign(x),) for x in fps], "fp long")).collect()}
    assert got == {tuple(sorted((sign(a), sign(b)))) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4}


def test_components_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    assert {(x.node, x.root) for x in components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
