"""One thin query per training-text operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, language_model, licenses, lines, mixing, neardup, phrases, quality, runs, sharding, token_counts


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = lines.deletions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", "n_runs", F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op4_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    vocabulary = path("byte_bpe_50k.json")
    both = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("text").alias("decoded_sha256"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_loops(table(spark, sf_dir, "documents"))).withColumn("g", runs.greatest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "g.start", "g.length", "g.period", F.expr("1000 * g.length div g.period").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_line_dedup, op3_token_counts, op4_simhash_neardup, op5_lm_scoring, op6_sharding, op7_license_scan, op8_quality_rules, op9_chat_formatting, op10_mixing, op11_phrases, op12_bpe, op13_periodic_runs)
}
#: Where DuckDB can express the whole result.  The others are held against brute force in tests/llm.
ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op2_line_dedup": lines.ORACLE, "op9_chat_formatting": chat.ORACLE, "op10_mixing": mixing.ORACLE, "op11_phrases": phrases.ORACLE}
