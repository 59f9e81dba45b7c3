import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sonograin.llm import sharding
from sonograin.llm.chat import formatted
from sonograin.llm.mixing import mixed_documents, mixture
from sonograin.llm.sharding import shards


def targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mixture(spark):
    r = random.Random(2)
    rows = [(i, None if i % 97 == 0 else "w " * r.choice([0, 1, 5, 5, 5, 60, 400]), None if i % 11 == 0 else f"s{min(9, int(r.expovariate(0.4)))}", 1.0) for i in range(3000)]
    rows += rows[:4] + [(None, "a b", "s1", 0.0), (None, "a b", "s1", 0.0), (70000, "a b c", "É", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = [x.asDict() for x in mixture(docs).collect()]
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken, biggest = targets(sizes), Counter(), Counter()
    assert len(got) == len(rows)
    for x in got:
        assert abs(x["target"] - want[x["source"]]) < 1e-6 and x["source_size"] == sizes[x["source"]] and 0 <= x["copies"] <= 2
        taken[x["source"]] += x["taken"]
        biggest[x["source"]] = max(biggest[x["source"]], x["size"])
    assert all(abs(taken[s] - want[s]) <= 2 * biggest[s] for s in sizes)
    again = [x.asDict() for x in mixture(docs.repartition(7)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = Counter((x.doc_id, x.text, x.source) for x in mixed.collect())
    by = defaultdict(int)
    for x in got:
        by[x["doc_id"], x["source"], x["size"]] += x["copies"]
    for (i, t, s), n in counts.items():
        assert by[i, s, len((t or "").split())] == n
    assert sum(counts.values()) == sum(x["copies"] for x in got)
    assert mixture(docs.limit(0)).count() == 0


def test_shards(spark):
    rows = [(i, "x" * (i % 50) if i % 9 else None, i) for i in range(4000)] + [(5, "xxxxx", 5), (None, "é", 0)]
    got = shards(spark.createDataFrame(rows, "doc_id long, text string, shard long")).collect()
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
        assert x.grown_shard in (x.shard, 24) and x.law == "key"
    assert sorted(slots) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) < 2 * min(map(len, slots.values())) and 80 < sum(x.grown_shard == 24 for x in got) < 260
    assert shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_slots_of_rows_that_repeat_one_document(spark, monkeypatch):
    """Two documents make up most rows, one id has many texts; with and without stretches and broadcasts the slots are gapless and stay."""
    rows = [(7, "same")] * 900 + [(None, None)] * 700 + [(8, f"text {i}") for i in range(400)] + [(i, "") for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    seen = []
    for stretch, most in ((65_536, 1_000_000), (64, 1_000_000), (64, 1)):
        monkeypatch.setattr(sharding, "STRETCH", stretch)
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", most)
        got = shards(docs).collect()
        slots = defaultdict(list)
        for x in got:
            slots[x.shard].append(x.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
        assert len({(x.doc_id, x.shard, x.grown_shard) for x in got}) == 103  # 7, null, 8 and 100 to 199
        seen.append(sorted(map(str, got)))
    assert seen[0] == seen[1] == seen[2]


def test_weights_move_rows_only_within_their_subtree(spark):
    tree = [[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]]
    heavier = [[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 3.0]]]
    docs = spark.createDataFrame([(i, "") for i in range(4000)], "doc_id long, text string")
    a, b = ({x.doc_id: x.shard for x in shards(docs, t).collect()} for t in (tree, heavier))
    assert all(a[i] == b[i] or b[i] >= 4 for i in a) and sum(b[i] == 7 for i in b) > 1.5 * sum(a[i] == 7 for i in a)


def test_chat(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    convs = {1: turns[:1], 2: turns[:2], 3: turns, 4: turns, 5: [("user", "other")], 6: turns[1:], 7: [("user", "hi"), ("assistant", "hell")], 8: [("user", "hi"), ("user", "hello")]}
    rows = [(c, t * 2, r, x, "n") for c, ts in convs.items() for t, (r, x) in enumerate(ts)] + [(None, 0, "user", "lost", "n"), (5, 0, "user", "other", "n")]
    got = {x.conv_id: x for x in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string")).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8] and got[3].n_copies == 2 and got[5].n_turns == 2
    assert got[3].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nmore\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_texts_forge_no_turns(spark):
    real = [("user", "hi"), ("assistant", "a\\|b")]
    forged = [[("user", "hi\n<|end|>\n<|assistant|>\na\\|b")], [("user|>\nhi\n<|end|>\n<|assistant", "a\\|b")], [("user", "hi"), ("assistant", "a\\\\|b")]]
    rows = [(c, t, r, x) for c, ts in enumerate([real, *forged]) for t, (r, x) in enumerate(ts)]
    got = {x.conv_id: x.rendered for x in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 4 == len(set(got.values())) and got[0].count("<|end|>") == 2 and got[1].count("<|end|>") == 1


def test_mixture_of_string_ids_in_any_order(spark):
    rows = [(f"id-{i}" if i % 50 else None, "w " * (i % 4), f"host{i % 700}") for i in range(3000)] + [("id-1", "w ", "host1")] * 3
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = [x.asDict() for x in mixture(docs).collect()]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets(sizes)
    assert len(got) == len(rows) and all(abs(x["target"] - want[x["source"]]) < 1e-6 for x in got)
    assert sorted(map(str, got)) == sorted(str(x.asDict()) for x in mixture(docs.repartition(5)).collect())
    extra = docs.withColumn("more", F.monotonically_increasing_id())
    a, b = (sorted(map(str, mixed_documents(x).collect())) for x in (extra, extra.repartition(5)))
    assert a == b


def test_a_rack_grows_by_rows_of_its_own_only(spark):
    rack = lambda *leaves: sharding.Node(4.0, leaves)
    four = (1.0, 1.0, 1.0, 1.0)
    old = [[rack(*four), rack(*four)], [rack(*four), rack(*four)]]
    new = [[rack(*four), rack(*four)], [rack(*four, sharding.Leaf(1.0, 16)), rack(*four)]]
    docs = spark.createDataFrame([(i, "") for i in range(6000)], "doc_id long, text string")
    a, b = ({x.doc_id: x.shard for x in shards(docs, t).collect()} for t in (old, new))
    moved = {i for i in a if a[i] != b[i]}
    assert all(b[i] == 16 and 8 <= a[i] < 12 for i in moved) and 200 < len(moved) < 400


def test_placement_against_a_plain_descent(spark):
    """The shard is that of a plain descent over the same draws."""
    tree = [[[1.0, 2.0], [3.0]], [[0.0, 1.0], [1.0, 1.0, 0.5]]]
    names = [f"{a}{b}" for a in ("/0", "/1") for b in ("", "/0", "/1", "/0/0", "/0/1", "/1/0", "/1/1", "/1/2")]
    keys = spark.range(300).select(F.col("id").cast("string").alias("k"))
    draws = {r.k: r for r in keys.select("k", *(F.pmod(F.xxhash64("k", F.lit(n)), F.lit(1 << 52)).alias(n) for n in names)).collect()}
    weight = lambda x: x if isinstance(x, float) else sum(map(weight, x))
    leaves = lambda x: 1 if isinstance(x, float) else sum(map(leaves, x))

    def descend(k, node, path, at):
        if isinstance(node, float):
            return at
        best = min((i for i, c in enumerate(node) if weight(c) > 0), key=lambda i: -math.log((draws[k][f"{path}/{i}"] + 0.5) / 2**52) / weight(node[i]))
        return descend(k, node[best], f"{path}/{best}", at + sum(map(leaves, node[:best])))

    got = {r.k: r.s for r in keys.select("k", sharding.shard_of(F.col("k"), tree).alias("s")).collect()}
    assert got == {k: descend(k, tree, "", 0) for k in draws}
