"""Columns named like helpers, map columns with repeated rows, and bytes that are not UTF-8."""

from pyspark.sql import functions as F

import corpus_pipeline
from sonograin.llm import language_model, licenses, lines, mixing, neardup, token_counts

HELPERS = ["_id", "_h", "_s", "_copies", "_rows", "_own", "_n", "_gone", "_d", "_k", "_o", "_stays", "__id", "hash", "rows", "r", "f", "copies", "a.b"]


def hostile(spark, texts):
    """Documents with a column for every helper name and a map column; each text comes twice, with other values."""
    docs = spark.createDataFrame([(i, t, "en", "web", len(t), v) for i, t in enumerate(texts) for v in (1, 2)], "doc_id long, text string, lang string, source string, n_chars long, v int")
    return docs.select("*", *(F.col("v").alias(n) for n in HELPERS), F.create_map(F.lit("k"), F.col("v")).alias("tags"))


def values(rows):
    """What every row says in its helper columns and its map is what its v says."""
    for r in rows:
        assert {r[n] for n in HELPERS} == {r.v} and r.tags == {"k": r.v}
    return [(r.doc_id, r.v) for r in rows]


def test_helper_names_and_maps_keep_their_values(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(4)]
    docs = hostile(spark, texts)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = values(mixed.collect())
    want = mixing.mixture(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    assert {i: sum(1 for d, _ in got if d == i) for i in range(4)} == {r.doc_id: r.n for r in want}
    one = neardup.one_of_each(docs)
    assert one.columns == docs.columns and sorted(values(one.collect())) == [(i, 1) for i in range(4)]
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns and sorted(values(kept.collect())) == [(i, v) for i in range(4) for v in (1, 2)]


def test_stages_take_such_columns(spark, tmp_path):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)]
    docs = hostile(spark, texts).drop("a.b")  # not a name that Parquet tables have
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", " ".join(f"w0x{k}" for k in range(20)))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert all(r._own == r.v and r._n == r.v and r.tags == {"k": r.v} for r in rows)
    assert {r.doc_id for r in rows} <= set(range(1, 6)) and len(rows) > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_broken_bytes(spark):
    mend = lambda t: F.expr(t).cast("string").alias("text")
    broken = spark.range(3).select(F.col("id").alias("doc_id"), mend("cast(concat(X'61FF20E28262', X'20', cast(repeat('under the mit license ', 3) as binary)) as string)"))
    whole = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("a� �b "), F.expr("repeat('under the mit license ', 3)")).alias("text"))
    for run in (token_counts.section_tokens, licenses.scan, lambda d: neardup.near_duplicates(d).select("doc_id", "fingerprint", "component_id"), language_model.scores):
        assert sorted(map(str, run(broken).collect())) == sorted(map(str, run(whole).collect()))
