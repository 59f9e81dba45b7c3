"""corpus_pipeline.run against the brute forces of its stages, one after another."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import test_decontaminate
import test_mix_shard_chat
import test_neardup
import test_quality

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def corpus():
    r = random.Random(77)
    docs, labels = [], []
    bench = [(f"b{i}", " ".join(f"exam{i}q{j}" for j in range(30))) for i in range(3)]
    for i in range(1500):
        bad = i % 12 == 0
        w = [f"word{r.randrange(3000)}" for _ in range(r.randint(55, 75))]
        for k in range(len(w)):
            if r.random() < (0.6 if bad else 0.02):
                w[k] = r.choice(["#", "|x|", "LOUD"])
        docs.append((i, " ".join(w), "en", r.choice(["a", "a", "a", "b", "É", None]), 1))
        labels.append((i, int(not bad), 0))
    base = docs[1][1]
    docs += [(2000 + i, base, "en", "a", 2) for i in range(40)]  # exact copies
    docs += [(2100 + i, docs[2][1] + " " + bench[i % 3][1], "en", "b", 3) for i in range(6)]  # contaminated
    docs += [(2200, None, "en", "a", 4), (2201, "", None, None, 4), (2202, "short text", "en", "b", 4), (None, docs[7][1] + " own", "en", "c", 5), docs[9]]
    return docs, labels, bench


def wanted(docs, labels, bench):
    """Rows that each stage leaves, as lists of documents."""
    quality_of = dict((i, q) for i, q, _ in labels)
    measured = []
    for d in docs:
        n, chars, symbols, dup, rep, failed = test_quality.brute(d[1])
        lines = [x for x in (d[1] or "").split("\n") if x.strip()]
        caps = sum("A" <= c <= "Z" for c in d[1] or "")
        measured.append((failed, {"symbols": symbols / max(1, chars), "duplicate_lines": dup / max(1, len(lines)), "repeated_words": rep / max(1, n), "capitals": caps / max(1, chars), "long_words": chars / max(1, n) / 40}))
    strata = {d[2] or "" for d, m in zip(docs, measured) if not m[0] and quality_of.get(d[0])}
    cutoffs = test_quality.plain_cutoffs({s: [m[1] for d, m in zip(docs, measured) if (d[2] or "") == s and not m[0] and quality_of.get(d[0])] for s in strata})
    docs = [d for d, m in zip(docs, measured) if not m[0] and all(v <= cutoffs.get((d[2] or "", r), 9) for r, v in m[1].items())]
    stages = [docs]
    fps = [test_neardup.brute_fp(d[1]) for d in docs]
    least = {}
    # components named by their position, so that null ids are told apart
    for d, c in zip(docs, test_neardup.brute_components(list(range(len(docs))), fps)):
        least[c] = min(least.get(c, d), d, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    docs = list(least.values())
    stages.append(docs)
    docs = [d for d in docs if not test_decontaminate.brute(d[1], bench)[-1]]
    stages.append(docs)
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += len(d[1].split())
    targets, mixed = test_mix_shard_chat.targets(sizes), []
    for s in sizes:
        offset = int(hashlib.md5(f"mix:{s or ''}".encode()).hexdigest()[:8], 16) / 4294967296.0
        each = targets[s] / sizes[s]
        order = sorted((len(d[1].split()), hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest()[:3], d[0] is not None, d[0] or 0, d) for d in docs if d[3] == s)
        for n, (*_, d) in enumerate(order, 1):
            mixed += [d] * min(2, math.floor(n * each + offset) - math.floor((n - 1) * each + offset))
    return [*stages, mixed]


def test_run_against_brute_force(spark, tmp_path):
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = wanted(docs, labels, bench)
    assert [len(docs), *map(len, want[:3])] == sorted([len(docs), *map(len, want[:3])], reverse=True) and len(set(map(len, want))) == 4
    key = lambda d: (str(d[0]), len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode()))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want):
        kept = stage(spark, now, str(tmp_path))
        assert kept.columns == now.columns, name
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, rows)), name
        kept.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted(map(key, want[-1]))
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
        assert x.grown_shard in (x.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent
    assert [len(os.listdir(p)) for p in shared.glob("**/pipeline-*")] == [1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_neardup", "decontamination", "mixing", "sharding"]
