import random
from itertools import combinations

import pytest

from sonograin.llm.neardup import TRIPLES, links


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def least_in_component(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_every_four_positions_hold_two_triples():
    assert all(sum(set(t) <= set(q) for t in TRIPLES) >= 2 for q in combinations(range(8), 4))


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_crowded_lists_keep_components(spark, bits):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(30)} | {0}
    fps |= {x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for x in list(fps) for _ in range(5)}
    fps = sorted(map(signed, fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long").coalesce(2)
    want = {(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
    assert {(x.a, x.b) for x in links(df, bits).collect()} == want
    for hot in (3, 1):
        got = {(x.a, x.b) for x in links(df, bits, hot).collect()}
        assert got <= want and least_in_component(fps, got) == least_in_component(fps, want)
