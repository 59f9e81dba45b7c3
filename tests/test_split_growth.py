from sonograin.operators import identity


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


def merged_rows(n):
    """One subject with n objects of two rows each, every seventh event shared with the next object and every eleventh with a row of the subject's own."""
    rows = [(o, 0, o) for o in range(1, n + 1) for _ in range(2)]
    rows += [(o + 1, 0, o) for o in range(7, n, 7)] + [(o, 0, None) for o in range(11, n, 11)]
    return [*rows, (None, 0, 5), (None, 0, 6), (1, 3, 5), (1, None, 5)]


def test_splits_of_one_subject_do_not_multiply_its_rows(spark):
    rows = merged_rows(400)
    frame = spark.createDataFrame(rows, "event long, artist long, before_merge long")
    splits = spark.createDataFrame([(0, o) for o in range(1, 401, 2)], "subject long, object long")
    found = []
    most = joined_rows(spark, lambda: found.extend(part.collect() for part in identity.split(frame, "artist", splits, "event")))
    held = {}
    for event, artist, before in rows:
        held.setdefault((artist, event), set()).add(before)
    want = {o for (artist, event), them in held.items() if artist == 0 and event is not None and len(them) > 1 for o in them if o is not None and o % 2}
    assert sorted((r.subject, r.object) for r in found[1]) == [(0, o) for o in sorted(want)] and want
    undone = [(e, o, None) if a == 0 and o is not None and o % 2 and o not in want else (e, a, o) for e, a, o in rows]
    assert sorted(map(str, (tuple(r) for r in found[0]))) == sorted(map(str, undone))
    assert 0 < most <= len(rows), most
