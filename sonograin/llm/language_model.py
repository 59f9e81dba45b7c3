"""A hidden Markov language model over all documents.

Tokens are blank-delimited words, A-Z lower-cased, and one end per text.  The ``own`` most frequent training tokens are
symbols of the model themselves; every other token, known or not, is drawn from one of ``buckets`` symbols by its crc32
and then from that symbol's tokens by smoothed counts, so that the model's probabilities over all tokens (with one share
for unknown ones) sum to 1.  Its size is fixed by parameters while the counts behind it cover the whole corpus.

Training: word counts by a grouped sum; then Baum-Welch rounds in which every partition runs the scaled forward and
backward recursions over its whole texts and the expected counts are summed by Spark.  To run many places of a long text at
once, it is looked at in pieces: a first pass finds what each piece does to any state distribution (a matrix of states by
states), the product of these gives the exact forward and backward vectors at every piece's ends, and a second pass runs all
pieces from there.  The counts are those of the unbroken text.  Scoring: the scaled forward recursion
gives the exact likelihood of each text's symbols; the counts of rarer tokens come by a shuffled join, since they grow
with the corpus, and those of the ``common`` most frequent ones from a broadcast dictionary of that fixed size.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import cut, running, shared_dir, valid_text

STATES, ROUNDS, OWN, BUCKETS, COMMON = 5, 5, 4096, 4096, 65536
#: Places of a text that training runs one after another; the results don't depend on it.
PIECE = 512
#: Tokens worked on at once; a text of more is a group of its own.
GROUP = 300_000
END = b""
FOLDS, HELD_OUT = 5, 1


def tokens_of(text) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only, as wanted; no word is empty, so the end can be."""
    return [*(text or "").encode().lower().split(), END]


def _count_batches(batches):
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(tokens_of(text))
            if len(counts) > 200_000:
                yield out()
                counts.clear()
    if counts:
        yield out()


def held_out(doc_id, folds: int = FOLDS, fold: int = HELD_OUT):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds)) == fold


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c over all whole texts of docs."""
    return docs.select(valid_text()).mapInArrow(_count_batches, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class _Ids(dict):
    """token -> rank among the common tokens, or -1; nothing is added."""

    def __missing__(self, token):
        return -1


def _encoder(common, buckets: int):
    """common: (tokens by rank, log10(c + 0.5) by rank, number of them that are symbols themselves), a broadcast value."""

    def run(batches):
        names, logs, n_own = common.value
        ids_of = _Ids(zip(names, range(len(names)))).__getitem__
        symbol = np.array([i if i < n_own else n_own + zlib.crc32(t) % buckets for i, t in enumerate(names)] or [0], np.uint16)
        logs = np.append(logs, 0.0)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # a few texts at a time keep the worker small
                batch = whole.slice(at, 256)
                each = [tokens_of(t) for t in batch.column("text").to_pylist()]
                tokens = [t for x in each for t in x]
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                starts = np.cumsum(sizes) - sizes
                ids = np.fromiter(map(ids_of, tokens), np.int64, len(tokens))
                rare = np.flatnonzero(ids < 0)
                symbols = symbol[ids]
                rare_tokens = [tokens[i] for i in rare]
                symbols[rare] = np.fromiter((n_own + zlib.crc32(t) % buckets for t in rare_tokens), np.int64, len(rare))
                found = logs[ids]
                middle = np.where(ids >= n_own, found, 0.0)
                cuts = np.append(np.searchsorted(rare, starts), len(rare))
                arrays = [
                    pa.array(sizes), pa.array(np.add.reduceat(found, starts)), pa.array(np.add.reduceat(middle, starts)),
                    pa.array([symbols[a : a + n].tobytes() for a, n in zip(starts, sizes)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rare_tokens, pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], names=["doc_id", "held_out", "n_tokens", "common_log", "middle_log", "symbols", "rare"])

    return run


def _start(states: int, n: int, totals: np.ndarray) -> dict:
    """The same start in every run: sticky states whose emissions are the symbol counts, shaken."""
    shaken = (totals[:, None] + 0.5) * np.exp(0.7 * np.random.default_rng(17).standard_normal((n, states)))
    move = np.full((states, states), 0.08 / max(1, states - 1))
    np.fill_diagonal(move, 0.92 if states > 1 else 1.0)
    return {"first": np.full(states, 1 / states), "move": move, "emit": shaken / shaken.sum(axis=0)}


def _grouped(sequences, size_of=lambda x: len(x[1]), most: int = GROUP):
    """Groups of sequences (index, symbols) of bounded size, each from the longest to the shortest; a longer one is a group of its own."""
    group, size = [], 0
    for x in sequences:
        if group and size + size_of(x) > most:
            yield sorted(group, key=lambda x: -len(x[1]))
            group, size = [], 0
        group.append(x)
        size += size_of(x)
    if group:
        yield sorted(group, key=lambda x: -len(x[1]))


def _by_place(group):
    """The group's symbols place by place: at place t those of the texts with more than t symbols, longest first."""
    lengths = np.array([len(s) for _, s in group])
    flat = np.concatenate([s for _, s in group])
    starts = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    return flat, starts, active


def _forward(model, group, keep: bool, enters=None):
    """log10 likelihood of each text; with keep the scaled state probabilities, scales and symbols of each place.

    enters: a state distribution for the first place of each text instead of the model's.
    """
    flat, starts, active = _by_place(group)
    logs, kept, a, ones = np.zeros(len(group)), [], None, np.ones(len(model["first"]))
    for t, n in enumerate(active):
        seen = flat[starts[:n] + t]
        a = ((model["first"] if enters is None else enters) if a is None else a[:n] @ model["move"]) * model["emit"][seen]
        scale = a @ ones
        a /= scale[:, None]
        logs[:n] += np.log10(scale)
        if keep:
            kept.append((a, scale, seen))
    return logs, kept


def _effects(model, pieces) -> np.ndarray:
    """For each piece the matrix that takes a distribution over the state at its first place to one at the next piece's, up to a factor.

    pieces: (index, symbols) from the longest to the shortest; the matrices are by index.
    """
    states = len(model["first"])
    flat, starts, active = _by_place(pieces)
    a = np.tile(np.eye(states), (len(pieces), 1, 1))
    for t, n in enumerate(active):
        if t:
            a[:n] = (a[:n].reshape(-1, states) @ model["move"]).reshape(n, states, states)
        a[:n] *= model["emit"][flat[starts[:n] + t]][:, None, :]
        if t % 8 == 7:  # far from the least number that a double holds
            a[:n] /= a[:n].max(axis=(1, 2), keepdims=True)
    out = np.empty_like(a)
    out[[i for i, _ in pieces]] = a @ model["move"]
    return out / out.max(axis=(1, 2), keepdims=True)


def _ends(effects: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state distribution that enters each piece of one text, and for each piece the chance, up to a factor, of all that follows it by the state entered next."""
    enters, follows = np.empty(effects.shape[:2]), np.ones(effects.shape[:2])
    enters[0] = first
    for p in range(1, len(effects)):
        enters[p] = enters[p - 1] @ effects[p - 1]
        enters[p] /= enters[p].sum()
    for p in range(len(effects) - 2, -1, -1):
        follows[p] = effects[p + 1] @ follows[p + 1]
        follows[p] /= follows[p].sum()
    return enters, follows


def expected_counts(model, texts: list[np.ndarray], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts by state, moves (still to be multiplied by the model's) and emissions over whole texts."""
    states, n = len(model["first"]), len(model["emit"])
    first, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((n, states))
    pieces = [(k, s[at : at + piece]) for k, s in enumerate(texts) for at in range(0, len(s), piece)]
    begins = np.array([p == 0 or pieces[p][0] != pieces[p - 1][0] for p in range(len(pieces))])
    enters, follows = np.tile(model["first"], (len(pieces), 1)), np.ones((len(pieces), states))
    bounds = np.append(np.flatnonzero(begins), len(pieces))
    broken = [range(a, z) for a, z in zip(bounds, bounds[1:]) if z - a > 1]
    effects = np.empty((len(pieces), states, states))
    for group in _grouped((p for r in broken for p in ((q, pieces[q][1]) for q in r))):
        index = [p for p, _ in group]
        effects[index] = _effects(model, [(k, s) for k, (_, s) in enumerate(group)])
    for r in broken:
        enters[r.start : r.stop], follows[r.start : r.stop] = _ends(effects[r.start : r.stop], model["first"])
    last_a, first_b = np.zeros((len(pieces), states)), np.zeros((len(pieces), states))
    for group in _grouped((p, s) for p, (_, s) in enumerate(pieces)):
        index = np.array([p for p, _ in group])
        _, kept = _forward(model, group, True, enters[index])
        back, seen_all, weight_all = None, [], []
        for t in range(len(kept) - 1, -1, -1):
            a, scale, seen = kept[t]
            b = np.empty_like(a)
            done = 0
            if back is not None:
                later = back * model["emit"][kept[t + 1][2]] / kept[t + 1][1][:, None]
                done = len(later)
                b[:done] = later @ model["move"].T
                move += a[:done].T @ later
            if done < len(a):  # pieces that end here
                tail = follows[index[done : len(a)]] @ model["move"].T
                b[done:] = tail / (a[done:] * tail).sum(axis=1, keepdims=True)
                last_a[index[done : len(a)]] = a[done:]
            seen_all.append(seen)
            weight_all.append(a * b)
            back = b
        first_b[index] = back * model["emit"][kept[0][2]] / kept[0][1][:, None]
        starts = begins[index]
        first += weight_all[-1][starts].sum(axis=0)
        seen_all, weight_all = np.concatenate(seen_all), np.concatenate(weight_all)
        for s in range(states):
            emit[:, s] += np.bincount(seen_all, weights=weight_all[:, s], minlength=n)
    over = np.flatnonzero(~begins)
    move += last_a[over - 1].T @ first_b[over]
    return first, move, emit


def _expected(model_of, piece: int):
    def run(batches):
        model = model_of.value
        sums = None
        texts = ((0, np.frombuffer(s, np.uint16)) for b in batches for s in b.column("symbols").to_pylist())
        for group in _grouped(texts):
            found = expected_counts(model, [s for _, s in group], piece)
            sums = found if sums is None else [x + y for x, y in zip(sums, found)]
        if sums is not None:
            first, move, emit = sums
            values = np.concatenate([first, (move * model["move"]).ravel(), emit.ravel()])
            some = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(values[some], pa.float64())], names=["place", "v"])

    return run


def _scorer(model_of):
    """The log likelihood of the symbols, less the log size of the class that each token is drawn from."""

    def run(batches):
        model, share = model_of.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            texts = batch.column("symbols").to_pylist()
            # texts of like length run together
            whole = ((i, np.frombuffer(texts[i], np.uint16)) for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])))
            for group in _grouped(whole):
                logs, _ = _forward(model, group, False)
                out[[i for i, _ in group]] += logs - np.array([share[s].sum() for _, s in group])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "symbols"), pa.array(out, pa.float64())], names=[*(c for c in batch.schema.names if c != "symbols"), "hmm_log"])

    return run


def train(encoded: DataFrame, states: int, n_symbols: int, totals: np.ndarray, rounds: int = ROUNDS, piece: int = PIECE) -> dict:
    """Baum-Welch on the whole texts of encoded that aren't held out; what comes to the driver is the model, states * (n_symbols + states + 1) numbers."""
    sc = encoded.sparkSession.sparkContext
    model = _start(states, n_symbols, totals)
    for _ in range(rounds):
        sent = sc.broadcast(model)
        sums = np.zeros(states + states * states + n_symbols * states)
        counts = encoded.where("not held_out").select("symbols").mapInArrow(_expected(sent, piece), "place long, v double").groupBy("place").agg(F.sum("v").alias("v"))
        got = counts.toPandas()
        sums[got["place"].to_numpy()] = got["v"].to_numpy()
        first, move, emit = sums[:states] + 0.1, sums[states : states + states**2].reshape(states, states) + 0.1, sums[states + states**2 :].reshape(n_symbols, states) + 0.02
        model = {"first": first / first.sum(), "move": move / move.sum(axis=1, keepdims=True), "emit": emit / emit.sum(axis=0)}
        sent.unpersist()
    return model


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of counts (token, c) with the greatest c, the smaller tokens first where c is equal.

    Some hundreds of classes of c, by eighths of a power of two, tell from which one on the rows can lie; only those are sorted.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 504 rows at most
    least, seen = 0, 0
    for least, n in sizes:
        seen += n
        if seen >= most:
            break
    if seen <= most:
        return counts.where(level >= least)
    ranked = running(counts.where(level >= least), [F.desc("c"), F.col("token")], _before="1")
    return ranked.where(F.col("_before") < most).drop("_before")


def scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, own: int = OWN, buckets: int = BUCKETS, common: int = COMMON) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty ones, of one end.  Rows whose crc32(doc_id as text) leaves 1 by 5 are held out of training; a null
    doc_id counts as ''.  Repeated rows are texts of their own, in training too.  Without training rows every token has
    the base probability 1 and the model's emissions are even.  An empty table gives no rows.  A text of any length is
    trained on and scored as one sequence; a task holds its symbols, two bytes a token.  Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    marked = docs.select("doc_id", held_out("doc_id").alias("held_out"), valid_text())
    counts = cut(token_counts(marked.where("not held_out")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, common).toPandas().sort_values(["c", "token"], ascending=[False, True])  # at most ``common`` rows
    names = [bytes(t) for t in top["token"]]
    n_own = min(own, len(names))
    sent = spark.sparkContext.broadcast((names, np.log10(top["c"].to_numpy(dtype=float) + 0.5), n_own))
    path = f"{shared_dir(spark)}/symbols-{uuid.uuid4().hex}"
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, common_log double, middle_log double, symbols binary, rare array<binary>"
    marked.mapInArrow(_encoder(sent, buckets), schema).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    encoded = spark.read.parquet(path)

    mine = spark.createDataFrame([(t,) for t in names[:n_own]], "token binary")  # at most ``own`` rows
    drawn = counts.join(F.broadcast(mine), "token", "left_anti").groupBy((F.pmod(F.crc32("token"), F.lit(buckets)) + n_own).alias("symbol")).agg(F.sum("c").alias("nb"), F.count("*").alias("vb"))
    totals, share = np.zeros(n_own + buckets), np.zeros(n_own + buckets)
    totals[:n_own] = top["c"].to_numpy()[:n_own]
    share[n_own:] = math.log10(0.5)  # a class without known tokens
    for r in drawn.collect():  # at most ``buckets`` rows
        totals[r.symbol] = r.nb
        share[r.symbol] = math.log10(r.nb + 0.5 * (r.vb + 1))
    model = train(encoded, states, n_own + buckets, totals, rounds) if n else _start(states, n_own + buckets, totals)

    # log10(c + 0.5) of the rare tokens, by a shuffled join on the token
    rare = encoded.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.count("c").alias("rare_known"), F.count("*").alias("n_rare"))
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "common_log", "middle_log", "symbols").mapInArrow(
        _scorer(spark.sparkContext.broadcast((model, share))), f"row long, doc_id {kind}, held_out boolean, n_tokens long, common_log double, middle_log double, hmm_log double"
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = scored.join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - zero("n_rare") + zero("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("common_log") + zero("rare_log") - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (F.col("hmm_log") + F.col("middle_log") + zero("rare_log")).alias("score"),
    )
