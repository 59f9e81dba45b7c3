import random
from itertools import combinations

from sonograin.llm.neardup import links, near_duplicates, roots


def near_copies(n):
    """One text of 600 words and n copies, each with a word or two of its own."""
    r = random.Random(8)
    base, rows = [f"w{i}" for i in range(600)], []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(600)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def joined_rows(spark, work):
    """Most rows that one join makes while ``work`` runs, by Spark's own metrics."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(j) for j in range(metrics.size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_rows_of_joins_grow_with_near_copies_not_with_their_pairs(spark):
    made = {}
    for n in (150, 600):
        docs = spark.createDataFrame(near_copies(n), "doc_id long, text string")
        made[n] = joined_rows(spark, lambda docs=docs: near_duplicates(docs).collect())
    assert 0 < made[600] <= 8 * made[150] and made[600] <= 41 * 600, made  # 40 lists each


def test_roots_are_components_of_all_links(spark):
    r = random.Random(12)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    fps = {r.getrandbits(64) for _ in range(20)}
    for x in list(fps)[:4]:  # dense groups, with strings of entries that lead away from them
        fps |= {flip(x, r.randint(1, 4)) for _ in range(50)}
        for _ in range(12):
            x = flip(x, r.randint(3, 5))
            fps.add(x)
    fps = sorted(map(sign, fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for bits, hot in ((4, 512), (4, 3), (3, 1), (2, 512)):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        near = [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits]
        for a, b in near:
            root[max(find(a), find(b))] = min(find(a), find(b))
        want = {x: find(x) for x in {x for pair in near for x in pair}}
        got = [(x.node, x.root) for x in roots(df, bits, hot).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert {(x.a, x.b) for x in links(df, 2).collect()} == set(near)
