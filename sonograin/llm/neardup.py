"""SimHash near-duplicates by an inverted index of positional bytes.

Fingerprints that differ in at most ``bits`` <= 4 of 64 bits differ in at most so many of their 8 bytes, so they share at
least 8 - bits positional bytes.  A posting list of one positional byte holds a 256th of the corpus, too much to pair; the
index therefore lists triples of positional bytes, chosen such that any 4 of the 8 positions contain two of them.  A list
of one entry goes.  Each meeting of a pair in a list tells of the positions that it shares; the tally of a pair is the number of different ones over
all its meetings.  Pairs below the guaranteed tally go (nearly all chance meetings share 3 bytes only), the rest are
verified by counting differing bits.

The links within a group of near copies grow with the square of its size, components need few of them.  So each entry is
first compared with two entries of each of its lists, at most 80 in all; components of these links are labels, and only
entries of different labels are paired.  A list of one label only goes: all its entries are linked already.  Two entries of
different labels still meet in every list that they share, so the guarantee holds for them as it stands.

Equal fingerprints are one entry of the index.  A list with more than ``hot`` entries is split by each further position, so
that lists of four bytes keep short at 256 times the corpus.  What is still crowded is a dense cluster and is not paired:
two fingerprints differ in at most 4 bits exactly if some value differs in at most 2 bits from both, so each entry of such
a list is listed under the values around it and linked to the least entry there.  That costs a fixed number of rows per
entry; links are true and components whole, whatever ``hot`` is.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LEAST, cut, own_prefix, spread_join, valid_text

SHINGLE, SEED, BITS = 4, 42, 4
HOT = 512


def _covering_triples() -> list[tuple[int, ...]]:
    """Triples of byte positions such that each set of 4 positions contains two of them; greedy, always the same."""
    need, found = {q: 2 for q in combinations(range(8), 4)}, []
    while any(need.values()):
        rest = [t for t in combinations(range(8), 3) if t not in found]
        best = max(rest, key=lambda t: (sum(n > 0 for q, n in need.items() if set(t) <= set(q)), [-x for x in t]))
        found.append(best)
        need = {q: max(0, n - (set(best) <= set(q))) for q, n in need.items()}
    return found


TRIPLES = _covering_triples()
QUADS = list(combinations(range(8), 4))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number; bytes.lower() and bytes.split() know ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - size + 1)
    first, last = (ends - lengths)[:n].tolist(), ends[min(size, len(words)) - 1 :][:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64, n).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches):
    for batch in batches:
        prints = [fingerprint(t.encode()) if t else 0 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(prints, pa.int64())], names=[*(c for c in batch.schema.names if c != "text"), "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp per row of docs; null and empty texts have fingerprint 0, bytes that are not UTF-8 count as U+FFFD."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), valid_text())
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(_fingerprint_batches, f"doc_id {kind}, text_hash long, fp long")


def _positions(places) -> int:
    return sum(1 << x for x in places)


def _list_key(places) -> str:
    """SQL: the bytes of fp at these positions, below the set of positions."""
    parts = " | ".join(f"(({f'shiftright(fp, {8 * b})' if b else 'fp'} & 255L) << {8 * j})" for j, b in enumerate(places))
    return f"{_positions(places) << 32}L | {parts}"


def _index(prints: DataFrame) -> DataFrame:
    """fp, key: the lists of each distinct fp of prints."""
    # fingerprints are small, but each makes many entries: they are kept in as many partitions as a shuffle has
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.select("fp").repartition(spread, "fp").distinct().select("fp", F.explode(F.array(*(F.expr(_list_key(t)) for t in TRIPLES))).alias("key"))


def _mixed(index: DataFrame) -> DataFrame:
    """The entries (fp, label, key) of lists with more than one label, with the list's size n and two of its labels, first and last in an order that differs from list to list."""
    order = F.expr("label ^ xxhash64(key)")
    lists = index.groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where("first != last")
    lists = cut(lists.select("key", *(F.expr(f"{c} ^ xxhash64(key)").alias(c) for c in ("first", "last")), "n"))
    return spread_join(index, lists, ["key"], lists.select("key", "n"), ["fp"], sized=False)


def _meetings(index: DataFrame) -> DataFrame:
    """a < b, their labels la != lb, shared: the positions of every list in which the two meet."""
    a, b = (index.select("key", F.col("fp").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))).select("a", "b", "la", "lb", F.shiftright(a["key"], 32).alias("shared"))


def _labelled_links(index: DataFrame, bits: int, hot: int) -> DataFrame:
    """Distinct (a, b, la, lb), a < b, of entries (fp, label, key): pairs at most ``bits`` apart whose labels differ; all of them but in crowded lists, where there are enough to join the labels."""
    index = cut(_mixed(index).drop("first", "last"))
    met, dense = _meetings(index.where(F.col("n") <= hot)), None
    crowded = index.where(F.col("n") > hot)
    if crowded.take(1):
        finer = F.array_compact(F.array(*(F.expr(f"if((shiftright(key, 32) & ~{_positions(q)}L) = 0, {_list_key(q)}, null)") for q in QUADS)))
        split = cut(_mixed(crowded.select("fp", "label", F.explode(finer).alias("key")).distinct()))
        met, dense = met.unionByName(_meetings(split.where(F.col("n") <= hot))), split.where(F.col("n") > hot)
    tallied = met.groupBy("a", "b", "la", "lb").agg(F.expr("bit_count(bit_or(shared))").alias("tally")).where(F.col("tally") >= 8 - bits)
    found = tallied.where(F.expr("bit_count(a ^ b)") <= bits).select("a", "b", "la", "lb")
    if dense is None or not dense.take(1):
        return found
    return found.unionByName(_dense_links(dense.select("fp", "label").distinct(), bits)).distinct()


def _checked(bits: int) -> None:
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees up to 4 bits")


def links(prints: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Distinct (a, b), a < b, among the distinct fp of prints: pairs at most ``bits`` apart; all of them but in crowded lists, where there are enough to keep components.

    They grow with the square of a group of near copies; ``roots`` gives the components without them.
    """
    _checked(bits)
    return _labelled_links(_index(prints).withColumn("label", F.col("fp")), bits, hot).select("a", "b")


def roots(prints: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """node, root for every fp of prints that is linked to another: root is the least fp of its component.

    The components of ``links``, from the links of each entry to two of each list and those between their components.
    """
    _checked(bits)
    entries = cut(_mixed(_index(prints).withColumn("label", F.col("fp"))).select("fp", "key", "first", "last"))
    near = entries.select("fp", F.explode(F.expr(f"filter(array(first, last), x -> x != fp and bit_count(fp ^ x) <= {int(bits)})")).alias("to"))
    stars = cut(components(near.select(F.least("fp", "to").alias("a"), F.greatest("fp", "to").alias("b"))))
    labels = stars.select(F.col("node").alias("fp"), F.col("root").alias("label"))
    labelled = cut(entries.select("fp", "key").join(labels, "fp", "left").select("fp", "key", F.coalesce("label", "fp").alias("label")))
    between = _labelled_links(labelled, bits, hot).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    joined = cut(components(between))
    higher = joined.select(F.col("node").alias("label"), F.col("root").alias("least"))
    members = labels.groupBy("label").agg(F.count("*").alias("n"))
    placed = spread_join(labels, higher, ["label"], members, ["fp"], "left").select(F.col("fp").alias("node"), F.coalesce("least", "label").alias("root"))
    return placed.unionByName(joined.join(stars, "node", "left_anti"))


def _dense_links(entries: DataFrame, bits: int) -> DataFrame:
    """Links (a, b, la, lb) that join the labels of entries (fp, label) as all links would.

    Entries a and b are linked exactly if a value is at most bits // 2 bits from one and at most bits - bits // 2 from the
    other.  All entries around a value are linked to the least of those at most bits // 2 from it, each link being a true one.
    """
    small, large = bits // 2, bits - bits // 2
    # the values with up to two bits set, made in the row: 2081 at most
    masks = ["array(0L)", "transform(sequence(0, 63), i -> shiftleft(1L, i))", "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"]
    each = ", ".join(f"transform({m}, x -> named_struct('mask', x, 'near', {'true' if size <= small else 'false'}))" for size, m in enumerate(masks[: large + 1]))
    around = entries.select("fp", "label", F.expr(f"inline(concat({each}))")).select(F.struct("fp", "label").alias("e"), "near", F.expr("fp ^ mask").alias("point"))
    labels = F.min("e.label") != F.max("e.label")
    centre = around.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("e"))).alias("c"), F.count("*").alias("n"), labels.alias("mixed")).where("mixed and c is not null")
    met = spread_join(around.select("e", "point"), centre.select("point", "c"), ["point"], centre.select("point", "n"), ["e"], sized=False)
    pairs = met.where("c.label != e.label").select(F.least("c", "e").alias("x"), F.greatest("c", "e").alias("y"))
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of edges (a, b): root is the least node of the component.

    Large-star and small-star rounds shorten all paths to the least neighbour until the edges are stars; every round is
    two aggregations and joins, and its result is stored in the shared folder.
    """
    e = cut(edges.select("a", "b").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        per = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        edges, digest, most = per.agg(F.count("*"), F.sum("h"), F.max("n")).first()
        if (edges, digest) == seen or not edges:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        seen = edges, digest
        # hubs are dealt to many tasks where there are any
        join = spread_join if most >= LEAST else lambda rows, side, keys, *_: rows.join(side, keys)
        least = per.select("a", F.least("a", "m").alias("m"), "n")
        large = join(both.where("b > a"), least.select("a", "m"), ["a"], least.select("a", "n"), ["b"]).select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        met = join(large, down.select("b", "m"), ["b"], down.select("b", "n"), ["a"])
        small = met.select(F.col("m").alias("a"), "b").unionByName(met.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        e = cut(small.where("a < b").distinct())


def near_duplicates(docs: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fp, fingerprint (16 hex digits), component_id, root (the component's least fp).

    Fingerprints at most ``bits`` bits apart are linked; component_id is the smallest doc_id reachable.  Null, empty and
    blank texts have fingerprint 0 and are linked like any other.  Repeated rows each get their row; null doc_ids never
    name a component, and one of null doc_ids only has the id null.  An empty table gives no rows; texts of any length are
    fingerprinted whole; other columns of docs are ignored.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    found = roots(classes, bits, hot)
    rooted = cut(classes.join(found, classes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    placed = spread_join(rooted.select("fp", "root"), named.select("root", "component_id"), ["root"], named.select("root", "n"), ["fp"])
    out = spread_join(prints, placed, ["fp"], classes.select("fp", "n"), ["doc_id", "text_hash"], sized=False)
    return out.select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay, with their columns: of each component the one with the smallest doc_id, then text hash."""
    found, p = cut(near_duplicates(docs, **how)), own_prefix(docs)
    of = {k: f"{p}{k}" for k in ("id", "hash", "rows", "stays", "others")}
    # by root: two components can have the same smallest doc_id, and those of null doc_ids have none
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("s")
    ).select(F.col("s.doc_id").alias("doc_id"), F.col("s.text_hash").alias("text_hash")).distinct()
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias(of["rows"]))
    chosen = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash"))
    stay = cut(rows.alias("r").join(first.alias("f"), chosen, "left").select(F.col("r.doc_id").alias(of["id"]), F.col("r.text_hash").alias(of["hash"]), of["rows"], F.col("f.text_hash").isNotNull().alias(of["stays"])))
    same = lambda k: docs["doc_id"].eqNullSafe(k[of["id"]]) & (F.xxhash64(docs["text"]) == k[of["hash"]])
    stays, many = F.col(of["stays"]), F.col(of["rows"]) > 1
    gone = stay.where(~stays | many)
    kept = docs.join(gone, same(gone), "left_anti")
    repeated = stay.where(stays & many)
    if repeated.take(1):  # of rows alike in doc_id and text the one with the least other values, as JSON, since maps have no order
        rest = docs.join(repeated, same(repeated), "left_semi")
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        values = F.struct(*(F.col(f"`{c}`") for c in others)) if others else None
        rest = rest.groupBy("doc_id", "text").agg(F.min_by(values, F.to_json(values)).alias(of["others"])).select("doc_id", "text", f"{of['others']}.*") if others else rest.distinct()
        kept = kept.unionByName(rest.select(*(f"`{c}`" for c in docs.columns)))
    return kept
