"""Periodic runs of words by seed and extend along diagonals.

A run of period q and length L is a stretch where words q apart agree: L - q matches on the diagonal of lag q, so at least
max(MIN_LENGTH, MIN_TIMES * q) - q.  K-grams are indexed at k = 16, 32, 64, ...; the level of k finds the lags below k that no
level before has looked for.  With 24 and 3 as least length and number of periods, every run of such a lag has k matches or more, the
guaranteed overlap, so a pair of equal k-grams lies q apart in it.

Only neighbouring occurrences of a k-gram are paired, a number of pairs linear in the words.  This loses no run: were there
an occurrence between two that lie q < k apart in a run, two periods would meet over a stretch as long as both together, their
greatest common divisor would be a period too, and q not the smallest.  For the same reason a lag found this way is the
smallest period of its stretch.  A table of the furthest match on each lag keeps a stretch from being extended again.

K-grams are named by doubling: the name of 2h words is the number of the pair of names of h words, and words that begin no
repeated h words drop out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_tokens

MIN_LENGTH, MIN_TIMES = 24, 3
#: Bytes of text that are looked at together.
SLICE = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _names(keys: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys at ascending places: names by place (-1 where the key is alone), the places of repeated keys in groups, and their names."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    name = np.cumsum(new) - 1
    repeated = np.bincount(name)[name] > 1 if len(name) else new
    places, names, by_place = at[order[repeated]], name[repeated], np.full(size, -1, np.int64)
    by_place[places] = names
    return by_place, places, names


def _reach(ids: np.ndarray, x: int, lag: int, step: int) -> int:
    """The first place from x on in direction ``step`` whose word differs from the one ``lag`` later, or the end."""
    block = 64
    while 0 <= x < len(ids) - lag:
        many = min(block, len(ids) - lag - x) if step > 0 else min(block, x + 1)
        there = slice(x, x + many) if step > 0 else slice(x - many + 1, x + 1)
        differ = ids[there] != ids[there.start + lag : there.stop + lag]
        if differ.any():
            return x + int(differ.argmax()) if step > 0 else x - int(differ[::-1].argmax())
        x, block = x + step * many, 2 * block
    return x


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.  ids: a number for each word; texts that share none may follow each other."""
    n, found = len(ids), []
    name, places, names = _names(ids, np.arange(n), n)
    h, least = 1, 1
    # the most matches that runs of any lag are sure to have, as a power of two
    while 2 * h <= min(max(min_length - q, (min_times - 1) * q) for q in range(1, min_length + 1)):
        h, places, names, name = 2 * h, *_doubled(name, places, h, n)
    while len(places):
        lags = places[1:] - places[:-1]
        at = np.flatnonzero((names[1:] == names[:-1]) & (lags >= least) & (lags < h))
        furthest: dict[int, int] = {}
        for lag, x in sorted(zip(lags[at].tolist(), places[at].tolist())):
            if x < furthest.get(lag, 0):
                continue
            first, end = _reach(ids, x - 1, lag, -1) + 1, _reach(ids, x + h, lag, 1)
            furthest[lag] = end
            if end - first + lag >= max(min_length, min_times * lag):
                found.append((first, end - first + lag, lag))
        least, h, places, names, name = h, 2 * h, *_doubled(name, places, h, n)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _doubled(name: np.ndarray, places: np.ndarray, h: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.sort(places)
    at = at[at + h < n]
    at = at[name[at + h] >= 0]
    by_place, places, names = _names(name[at] * np.int64(n) + name[at + h], at, n)
    return places, names, by_place


def _searcher(min_length: int, min_times: int):
    def flush(texts: list[list[bytes]], ids: list[int]):
        """Runs and the kept words of each text."""
        ends = np.cumsum([len(w) for w in texts], dtype=np.int64)
        runs: list[list[dict]] = [[] for _ in texts]
        gone = np.zeros(len(ids) + 1, np.int64)
        for start, length, period in find_runs(np.array(ids, np.int64), min_length, min_times):
            k = int(np.searchsorted(ends, start, side="right"))
            runs[k].append({"start": start - int(ends[k]) + len(texts[k]), "length": length, "period": period})
            gone[start + period] += 1
            gone[start + length] -= 1
        dropped, kept = np.cumsum(gone) > 0, []
        for words, end, r in zip(texts, ends.tolist(), runs):
            kept.append(b" ".join([w for w, d in zip(words, dropped[end - len(words) : end].tolist()) if not d] if r else words))
        return runs, kept

    def search(batches):
        for batch in batches:
            texts, ids, runs, kept, held = [], [], [], [], 0
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()  # at bytes 09-0D and 20
                known: dict[bytes, int] = {}
                base = len(ids)  # so that texts share no numbers
                ids += [known.setdefault(w, base + len(known)) for w in words]
                texts.append(words)
                held += len(text or b"")
                if held > SLICE:
                    a, b = flush(texts, ids)
                    runs, kept, texts, ids, held = runs + a, kept + b, [], [], 0
            a, b = flush(texts, ids)
            n = [len(r) for r in runs + a]
            flat = [x for r in runs + a for x in r]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(kept + b, pa.binary())], names=["doc_id", "runs", "collapsed"])

    return search


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> DataFrame:
    """One row per row of docs: doc_id, runs (start, length and period in words, by start and period) and collapsed (the text without repeats).

    Words are what stands between bytes 09-0D and 20.  A run has ``min_length`` words and ``min_times`` (three or more) of its smallest period
    and cannot be made longer.  Of each run the first period stays; the words that stay are joined by one blank.  Null and
    blank texts have no runs and an empty result; bytes that are not UTF-8 are kept as they are.  Repeated rows stay, an
    empty table gives no rows, a text of any length is one row's work, other columns are ignored.
    """
    if min_times < 3 or min_length < 1:
        raise ValueError("min_times must be three or more and min_length positive")
    d = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = d.mapInArrow(_searcher(min_length, min_times), f"doc_id {dict(d.dtypes)['doc_id']}, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def greatest_run(runs: Column) -> Column:
    """Of runs by start and period the first one with the greatest exact length / period; null without runs."""
    none = F.lit(None).cast(RUNS[len("array<") : -1])
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32 of its id goes round in circles from some word on; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, blank_tokens(F.col("text"))))
    d = d.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    looped = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))
