"""Quality rules whose cutoffs are certified together on labelled documents.

A rule rejects a document when a measured ratio exceeds a cutoff.  The cutoffs of all rules stand on one ladder of steps, from
the mildest to the strictest; what a step rejects, every later step rejects too.  For a stratum and a step the labelled good
documents give k that some rule rejects falsely, among n; the step is certified if P(Binomial(n, risk) <= k) is small enough.
That is the exact (Clopper-Pearson) test of "false rejection rate of all rules together above risk".

Along the ladder of a stratum the steps are tested in a fixed sequence, stopping at the first that fails, which needs no further
correction.  Over strata delta is shared by Holm's procedure: m strata start with delta / m each, and one whose whole ladder
is certified hands its share on to the others.  So with confidence 1 - delta no stratum's good documents are rejected at a rate
above risk; with risk and delta of 0.05, some 86 flawless labels in each of four strata are enough.  A stratum with too few
labels certifies nothing there and rejects by the base rules only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_tokens, cut, running

#: Rule name -> the ratio it looks at, in columns of ``measures``; a document fails above the certified cutoff.
RULES = {
    "symbols": "n_symbols / greatest(1, word_chars)",
    "duplicate_lines": "n_dup_lines / greatest(1, n_lines)",
    "repeated_words": "n_repeat_words / greatest(1, n_words)",
    "capitals": "n_capitals / greatest(1, word_chars)",
    "long_words": "word_chars / greatest(1, n_words) / 40",
}
#: Where the ladder of each rule ends: about what published filters of web text reject, so that no amount of labels makes a rule stricter.
STRICTEST = {"symbols": 0.05, "duplicate_lines": 0.3, "repeated_words": 0.2, "capitals": 0.2, "long_words": 0.25}
#: The first cutoff of every rule and the number of steps to the last, of equal ratios.
MILDEST, STEPS = 0.9, 16
LADDER = {r: [round(MILDEST * (end / MILDEST) ** (i / (STEPS - 1)), 4) for i in range(STEPS)] for r, end in STRICTEST.items()}
RISK, DELTA = 0.05, 0.05
#: Cutoffs of up to this many strata are broadcast; beyond, a stratum's rows are dealt to SALTS tasks.
BROADCAST_STRATA, SALTS = 10_000, 64


def _repeat_words(most: int) -> Column:
    """Words inside 3-word windows that occur twice or more.

    A window's hash keeps its high bits and gives the low 24 to its position, so one sort of longs brings equal windows
    together.  Neighbours with equal high bits are compared by their words.  In a document where different windows turn out
    to have equal bits, or with over ``most`` words, the windows themselves are sorted with their positions.
    """
    union = "named_struct('n', 0L, 'end', 0), (s, i) -> named_struct('n', s.n + i + 3 - greatest(s.end, i), 'end', i + 3)"
    alike = "sorted[i].g = sorted[i - 1].g"
    return F.expr(f"""
      case when size(w) < 3 then 0L
      when size(w) >= {most} or exists(near, p -> p.b is not null and slice(w, cast(p.a & 16777215 as int) + 1, 3) != slice(w, cast(p.b & 16777215 as int) + 1, 3)) then
        aggregate(array_sort(flatten(transform(
          array(sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('g', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i)))),
          sorted -> transform(filter(sequence(0, size(sorted) - 1), i -> (i > 0 and {alike}) or (i + 1 < size(sorted) and {alike.replace('[i]', '[i + 1]').replace('[i - 1]', '[i]')})), i -> sorted[i].i)))), {union}).n
      else aggregate(array_sort(transform(near, p -> cast(p.a & 16777215 as int))), {union}).n end
    """)


def measures(docs: DataFrame, stratum: str = "lang", hash_bits: int = 40, most: int = 1 << 24) -> DataFrame:
    """Per row of docs: doc_id, stratum and counts of its whole text; null texts count as empty, a null stratum as ''.

    hash_bits (up to 40) and most choose a way to compare windows, not the result.
    """
    mask = -(1 << (64 - hash_bits))
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), text.alias("text"), blank_tokens(F.col("text")).alias("w"), F.xxhash64("text").alias("text_hash"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        "doc_id", "stratum", "text_hash", "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"), F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"), lines.alias("lines"),
        F.expr(f"if(size(w) < 3 or size(w) >= {most}, array(), sort_array(transform(slice(w, 1, greatest(0, size(w) - 2)), (x, i) -> (xxhash64(x, get(w, i + 1), get(w, i + 2)) & {mask}L) | i)))").alias("sorted"),
    )
    d = d.select(
        "*", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"""filter(transform(sorted, (x, i) -> if(((x ^ get(sorted, i - 1)) & {mask}L) = 0 or ((x ^ get(sorted, i + 1)) & {mask}L) = 0,
          named_struct('a', x, 'b', if(((x ^ get(sorted, i + 1)) & {mask}L) = 0, get(sorted, i + 1), null)), null)), p -> p is not null)""").alias("near"),
    ).drop("lines", "sorted")
    d = d.select("*", _repeat_words(most).alias("n_repeat_words")).drop("w", "near")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _log_tail(n: str, k: str, p: str) -> str:
    """SQL: ln P(Binomial(n, p) <= k), the k + 1 terms summed in the log domain; 0 where k exceeds the mean, where the test can't pass."""
    lt = f"(s.lt + ln(({n} - i + 1) / i) + ln({p}) - ln(1 - {p}))"
    return (
        f"if({k} > {n} * {p}, 0D, aggregate(if({k} = 0, cast(array() as array<bigint>), sequence(1L, {k})), named_struct('lt', {n} * ln(1 - {p}), 'sum', {n} * ln(1 - {p})), "
        f"(s, i) -> named_struct('lt', {lt}, 'sum', greatest(s.sum, {lt}) + log1p(exp(-abs(s.sum - {lt}))))).sum)"
    )


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: those of the strictest certified step, where there is one.

    labels: doc_id, quality (1 good); a document with several labels is good if any says so; null labels don't count.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    held = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    # the first step at which a rule rejects the document; STEPS if none does
    first = F.least(*(F.expr(f"size(filter(array({', '.join(f'{c}D' for c in LADDER[r])}), c -> c >= {e}))") for r, e in RULES.items()))
    counts = held.select("stratum", first.alias("first")).groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col("first") <= i).alias(f"k{i}") for i in range(STEPS)))
    # more rejections never give a smaller p, so those of a stratum rise along its ladder
    tested = cut(counts.select("stratum", F.array(*(F.expr(_log_tail("n", f"k{i}", f"{risk!r}D")) for i in range(STEPS))).alias("ps")))
    ranked = running(tested.select("stratum", F.element_at("ps", -1).alias("worst")), ["worst", "stratum"], before="1")
    strata = tested.agg(F.count("*").alias("m"))  # one row
    # how many strata come before the first, by their last p, that Holm's procedure stops at; all if it stops nowhere
    whole = ranked.crossJoin(F.broadcast(strata)).agg(F.coalesce(F.min(F.when(F.col("worst") > F.log(F.lit(delta) / (F.col("m") - F.col("before"))), F.col("before"))), F.max("m")).alias("done"), F.max("m").alias("m"))
    level = F.log(F.lit(delta) / F.greatest(F.lit(1), F.col("m") - F.col("done")))
    sure = tested.crossJoin(F.broadcast(whole)).select("stratum", F.size(F.filter("ps", lambda p: p <= level)).alias("steps"))
    at = F.array(*(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(LADDER[r][i]).alias("cutoff")) for r in RULES)) for i in range(STEPS)))
    return sure.where("steps > 0").select("stratum", F.inline(F.element_at(at, F.col("steps"))))


def _with_cutoffs(measured: DataFrame, cutoffs: DataFrame, limit: int = BROADCAST_STRATA) -> DataFrame:
    """measured with its stratum's cutoffs; a stratum may hold most rows, so rows are never gathered by stratum alone."""
    if len(cutoffs.select("stratum").take(limit + 1)) <= limit:
        return measured.join(F.broadcast(cutoffs), "stratum", "left")
    dealt = cutoffs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["stratum", "_salt"], "left").drop("_salt")


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: doc_id, the measures, base_failed, failed_rules, kept.

    Empty and null texts have no words and fail the base rules.  Repeated rows are judged alike, each on its own.
    Without labels only the base rules reject.  Empty documents give no rows.  Whole texts of any length are measured; other
    columns, of whatever names, are ignored.
    """
    measured = cut(measures(docs, stratum))
    cutoffs = certified_cutoffs(measured, labels, risk, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    judged = _with_cutoffs(measured, cut(cutoffs))
    failed = F.array_compact(F.array(*(F.when(F.expr(e) > F.try_element_at("cutoffs", F.lit(r)), F.lit(r)) for r, e in RULES.items())))
    return judged.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("cutoffs")


def good_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """The rows of docs that are kept, with their columns and repeats; a row is found again by doc_id, text and stratum."""
    judged = verdicts(docs, labels, stratum, **how)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("stratum").alias("_s"), F.col("text_hash").alias("_h")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_h"]) & (F.coalesce(docs[stratum], F.lit("")) == gone["_s"])
    return docs.join(gone, same, "left_anti").select(docs.columns)
