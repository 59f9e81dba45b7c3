"""Phrase collocations by multikey three-way quicksort of suffix pointers to a depth of four words.

Blocks of documents are stored as numbers of words, with a word list of their own each.  Words that occur too seldom for any
phrase are abandoned for the whole corpus first and end suffixes; the others get one number each.  In every block, pointers to
suffixes are sorted by multikey quicksort, and the sizes of its equal partitions are counts, so copies and frequent phrases leave a block as
one row each.  These rows are routed by their two leading words to one place, where equal partitions of all blocks meet
in order, their sizes add up, and partitions that are too small are abandoned.  Leading pairs with a large share of
all rows are routed by the next words too, and their partial sizes are added up afterwards.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import SALTS, cut, discard, running, shared_dir, spread_join

MIN_COUNT, LEAST_SHARE, TOP, DEPTH = 30, 80, 2000, 4
#: Words of a block; a leading pair with over a HEAVY-th of all rows is heavy, so fewer than HEAVY are; rows of an Arrow batch.
BLOCK, HEAVY, BATCH = 1 << 20, 1024, 1 << 16
#: Marks of the punctuation and line ends between pieces.
_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_LOW = 0xFFFFFFFF


class _Numbers(dict):
    """Numbers of the words of one language within a block, in order of appearance."""

    def __init__(self, words: list):
        super().__init__({b".": -1})
        self.words = words

    def __missing__(self, word):
        self[word] = len(self.words)
        self.words.append(word)
        return self[word]


def _block(block: int, ids: list[int], words: list, langs: list):
    at = np.array(ids, np.int32)
    pair = (at[:-1] >= 0) & (at[1:] >= 0)
    keys, n = np.unique(at[:-1][pair].astype(np.int64) << 32 | at[1:][pair], return_counts=True)
    many = n * HEAVY > n.sum()
    heavy = [{"lang": langs[k >> 32], "a": words[k >> 32], "b": words[k & _LOW], "n": m} for k, m in zip(keys[many].tolist(), n[many].tolist())]
    listed = [{"lang": g, "word": w, "n": m} for g, w, m in zip(langs, words, np.bincount(at[at >= 0], minlength=len(words)).tolist())]
    text, long = pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], long),
            pa.array([at.astype("<i4").tobytes()], pa.binary()),
            pa.array([listed], pa.list_(pa.struct([("lang", text), ("word", text), ("n", long)]))),
            pa.array([heavy], pa.list_(pa.struct([("lang", text), ("a", text), ("b", text), ("n", long)]))),
        ],
        names=["block", "ids", "words", "heavy"],
    )


def _blocks(batches):
    """Blocks of about BLOCK words: number, numbers of words (-1 ends a piece), word list with counts, and leading pairs with a large share."""
    number, ids, words, langs, of = TaskContext.get().partitionId() << 32, [], [], [], {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, text = lang.as_py(), text.as_py()
            numbers = of.setdefault(lang, _Numbers(words))
            ids += map(numbers.__getitem__, _PIECE_END.sub(b" . ", text.lower()).split())
            ids.append(-1)
            langs += [lang] * (len(words) - len(langs))
            if len(ids) >= BLOCK:
                yield _block(number, ids, words, langs)
                number, ids, words, langs, of = number + 1, [], [], [], {}
    if ids:
        yield _block(number, ids, words, langs)


def multikey_quicksort(keys: np.ndarray, counted: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by ``keys`` (a row a suffix, a column a depth, -1 after the end): their order and where each equal partition begins.

    All partitions of a round are split at once into less, equal and greater around a pivot each; equal ones go one key
    deeper, and those of one suffix or at full depth are done.  ``counted``: keys by which the rows stand in order already.
    """
    n, depth_end = keys.shape
    order, begins = np.arange(n), np.zeros(n, bool)
    if counted and n:
        begins[1:] = (keys[1:, :counted] != keys[:-1, :counted]).any(axis=1)
        begins[0] = True
    begins[:1] = True
    start = np.flatnonzero(begins)
    size, depth = np.diff(start, append=n), np.full(len(start), counted)
    while True:
        open_ = (size > 1) & (depth < depth_end)
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            return order, np.flatnonzero(begins)
        base = np.cumsum(size) - size
        part = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(part)) + (start - base)[part]
        key = keys[order[at], depth[part]]
        low, mid, high = key[base], key[base + size // 2], key[base + size - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))  # the median of three
        less, greater = key < pivot[part], key > pivot[part]
        n_less, n_greater = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(greater, base, dtype=np.int64)
        n_equal = size - n_less - n_greater
        # where each suffix goes: after those of its class that come before it in its partition
        rank = lambda mask: (c := np.cumsum(mask)) - mask - (c - mask)[base][part]
        to = np.where(less, rank(less), np.where(greater, (n_less + n_equal)[part] + rank(greater), n_less[part] + rank(~(less | greater))))
        moved = order[at]
        order[start[part] + to] = moved
        ended = pivot < 0  # equal suffixes that have ended are equal to full depth
        start = np.concatenate([start, start + n_less, start + n_less + n_equal])
        size = np.concatenate([n_less, n_equal, n_greater])
        depth = np.concatenate([depth, np.where(ended, depth_end, depth + 1), depth])
        begins[start[size > 0]] = True


def _suffixes(batches):
    """Of each block (ids, and the numbers that its words have in the corpus) the equal partitions of suffixes: k1, k2 and their size."""
    for batch in batches:
        for raw, numbered in zip(batch.column(0), batch.column(1)):
            at = np.frombuffer(raw.as_py(), "<i4")
            table = np.full(int(at.max(initial=0)) + 2, -1, np.int32)  # the last entry is for -1
            pairs = numbered.values
            table[pairs.field("at").to_numpy()] = pairs.field("id").to_numpy()
            ids = np.concatenate([table[at], np.full(DEPTH, -1, np.int32)])
            keys = np.stack([ids[d : len(ids) - DEPTH + d] for d in range(DEPTH)], axis=1)
            for d in range(1, DEPTH):
                keys[keys[:, d - 1] < 0, d] = -1
            keys = keys[keys[:, 1] >= 0]
            keys = keys[np.argsort(keys[:, 0], kind="stable")]  # within the block too by leading word first
            order, begins = multikey_quicksort(keys, 1)
            sizes = np.diff(begins, append=len(keys))
            keys = keys[order[begins]]
            w1, w2, w3, w4 = keys.T.astype(np.int64)
            k1, k2 = w1 << 32 | w2, (w3 + 1) << 32 | (w4 + 1)
            for a in range(0, len(k1), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + BATCH]) for x in (k1, k2, sizes)], names=["k1", "k2", "n"])


def _merged(heavy: list[int], least: int):
    """Sizes of partitions at each depth, from rows in order of k1 and k2; small ones are abandoned unless others may hold more of them."""
    of_many = np.array(sorted(heavy), np.int64)

    def emit(k1, k2, n, deep):
        keep = (n >= least) | np.isin(k1, of_many)
        if deep:
            keep &= (k2 & (_LOW if deep == 4 else ~_LOW)) != 0
        return k1[keep], k2[keep], n[keep]

    def run(batches):
        open_: dict[int, tuple] = {}  # by depth the last partition, which may go on
        for batch in batches:
            k1, k2, n = (x.to_numpy() for x in batch.columns)
            if not len(k1):
                continue
            for deep, mask in ((0, 0), (3, ~_LOW), (4, -1)):
                a, b, c = k1, k2 & mask, n
                if deep in open_:
                    a, b, c = (np.concatenate([x, y]) for x, y in zip(open_[deep], (a, b, c)))
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                a, b, c = a[first], b[first], np.add.reduceat(c, first)
                open_[deep] = (a[-1:], b[-1:], c[-1:])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in emit(a[:-1], b[:-1], c[:-1], deep)], names=["k1", "k2", "n"])
        for deep, last in open_.items():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in emit(*last, deep)], names=["k1", "k2", "n"])

    return run


def _key(words: list[Column]) -> tuple[Column, Column]:
    """k1 and k2 of a phrase by the numbers of its words; those of one word are its number and -1."""
    if len(words) == 1:
        return words[0], F.lit(-1).cast("long")
    k1 = F.shiftleft(words[0], 32).bitwiseOR(words[1])
    third, fourth = (words[d] + 1 if len(words) > d else F.lit(0).cast("long") for d in (2, 3))
    return k1, F.shiftleft(third, 32).bitwiseOR(fourth)


def _words() -> list[Column]:
    """The numbers of a phrase's words; words it lacks are -1."""
    low = F.lit(_LOW)
    return [F.shiftright("k1", 32), F.col("k1").bitwiseAND(low), F.shiftright("k2", 32) - 1, F.col("k2").bitwiseAND(low) - 1]


def _parts(of) -> Column:
    """For phrases of each length the array that ``of`` makes from the list of their words."""
    w = _words()
    return F.when(F.col("k2") == 0, F.array(*of(w[:2]))).when(w[3] < 0, F.array(*of(w[:3]))).otherwise(F.array(*of(w)))


def _cuts(words: list[Column]) -> list[Column]:
    out = []
    for k in range(1, len(words)):
        (l1, l2), (r1, r2) = _key(words[:k]), _key(words[k:])
        out.append(F.struct(F.lit(k).alias("k"), l1.alias("l1"), l2.alias("l2"), r1.alias("r1"), r2.alias("r2")))
    return out


def _inner(words: list[Column]) -> list[Column]:
    """Keys of the shorter phrases of two words or more inside a phrase."""
    m = len(words)
    keys = [_key(words[i : i + size]) for size in range(2, m) for i in range(m - size + 1)]
    return [F.struct(a.alias("i1"), b.alias("i2")) for a, b in keys]


def _salted_top(rows: DataFrame, order: list[Column], top: int, name: str, rank) -> DataFrame:
    """rows whose rank in order is at most ``top`` among a 64th of their language's; those of the whole language are among them."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)))
    return salted.withColumn(name, rank.over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col(name) <= top).drop("salt", name)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, share: int = LEAST_SHARE, top: int = TOP) -> DataFrame:
    """Per lang its first ``top`` phrases: lang, rank (from 1), phrase, words, a, l, r, k, n, score.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?]`` and at bytes 0A-0D into pieces, these at blanks and tabs into words.  Candidates are
    phrases of two to four words of one piece with a >= min_count; cut after k words they score floor(2000000 a / (l + r)), l and
    r the counts of both parts; the least cut counts, in a tie the shortest first part.  Candidates inside a longer one that
    occurs ``share`` percent as often go.  Order: score and a descending, phrase ascending by bytes.

    Null lang is ``und``; null and empty texts have no words, bytes that are not UTF-8 count as U+FFFD; repeated rows count each.
    A table without candidates gives no rows; a text of any length is numbered whole; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.make_valid_utf8(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))
    made = d.mapInArrow(_blocks, "block long, ids binary, words array<struct<lang:string,word:string,n:long>>, heavy array<struct<lang:string,a:string,b:string,n:long>>")
    folder = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"
    made.write.parquet(folder)
    blocks = spark.read.parquet(folder)

    listed = blocks.select("block", F.posexplode("words").alias("at", "w")).select("block", "at", "w.lang", "w.word", "w.n")
    sizes = cut(listed.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = listed.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    number = F.when(F.col("id") < 1 << 31, F.col("id").cast("long")).otherwise(F.raise_error(F.lit("two numbers of words must fit a long")))
    frequent = cut(running(frequent, [F.col("lang"), F.col("word")], id="1").withColumn("id", number))
    # a word has one row a block here, so none is heavy
    numbered = listed.select("block", "at", "lang", "word").join(frequent.select("lang", "word", "id"), ["lang", "word"])
    numbered = numbered.groupBy("block").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "id")).alias("numbered"))  # a block's word list
    rows = blocks.select("block", "ids").join(numbered, "block").select("ids", "numbered").mapInArrow(_suffixes, "k1 long, k2 long, n long")

    # a pair over a HEAVY-th of all pairs is over that in some block, so fewer than HEAVY rows are fetched here
    pairs = blocks.select(F.inline("heavy")).groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    total = blocks.select(F.inline("words")).agg(F.sum("n").alias("all"))
    name = lambda c: frequent.select("lang", F.col("word").alias(c), F.col("id").alias(f"{c}_id"))
    heavy = [r[0] for r in pairs.crossJoin(F.broadcast(total)).where(F.col("n") * HEAVY > F.col("all")).join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"]).select(_key([F.col("a_id"), F.col("b_id")])[0]).collect()]

    further = F.when(F.col("k1").isin(heavy), F.col("k2")) if heavy else F.lit(None).cast("long")
    counts = rows.repartition("k1", further).sortWithinPartitions("k1", "k2").mapInArrow(_merged(heavy, min_count), "k1 long, k2 long, n long")
    found = cut(counts.groupBy("k1", "k2").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count))
    discard(spark, folder)
    return _ranked(found, frequent, sizes, share, top)


def _ranked(found: DataFrame, frequent: DataFrame, sizes: DataFrame, share: int, top: int) -> DataFrame:
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    every = cut(found.unionByName(frequent.select(F.col("id").alias("k1"), F.lit(-1).cast("long").alias("k2"), F.col("f").alias("a"))))
    cuts = found.select("k1", "k2", "a", F.inline(_parts(_cuts)))
    for side in "lr":
        keys = [f"{side}1", f"{side}2"]
        cuts = spread_join(cuts, every.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), F.col("a").alias(side)), keys, cuts.groupBy(*keys).agg(F.count("*").alias("n")), ["k1", "k2", "k"])
    scores = cuts.select("k1", "k2", "a", "k", "l", "r", (exact("a") * 2000000).alias("x"), (exact("l") + exact("r")).alias("y")).withColumn("score", F.expr("x div y"))
    best = scores.groupBy("k1", "k2", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("k1", "k2", "a", "b.*")
    longer = found.where("k2 <> 0").select("a", F.inline(_parts(_inner))).groupBy("i1", "i2").agg(F.max("a").alias("longer"))
    inside = best.join(longer, (best["k1"] == longer["i1"]) & (best["k2"] == longer["i2"]), "left")
    kept = inside.where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * share)).withColumn("w1", _words()[0])
    named = spread_join(kept, frequent.select(F.col("id").alias("w1"), "lang"), ["w1"], kept.groupBy("w1").agg(F.count("*").alias("n")), ["k1", "k2"])
    by_counts = [F.desc("score"), F.desc("a")]
    first = cut(_salted_top(named.select("k1", "k2", "lang", "a", "k", "l", "r", "score"), by_counts, top, "rank", F.rank()))
    words = first.select("k1", "k2", F.posexplode(F.array(*_words())).alias("at", "id")).join(frequent.select("id", "word"), "id")
    words = words.groupBy("k1", "k2").agg(F.expr("transform(array_sort(collect_list(struct(at, word))), x -> x.word)").alias("words"))
    phrases = first.join(words, ["k1", "k2"]).withColumn("phrase", F.array_join("words", " "))
    order = [*by_counts, F.col("phrase")]
    ranked = _salted_top(phrases, order, top, "rank", F.row_number()).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "k", "n", "score")


ORACLE = """
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
split as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from split where len(w) > 0),
grams as (select lang, m, w[i:i + m - 1] as g, w, i from places, (select unnest([1, 2, 3, 4]) as m) where i + m - 1 <= len(w)),
f as (select lang, m, g, count(*) as f from grams group by all having count(*) >= 30),
sizes as (select lang, count(*) as n from places group by 1),
cuts as (select c.lang, c.m, c.g, c.f as a, k, g[1:k] as lg, g[k + 1:m] as rg from f c, (select unnest([1, 2, 3]) as k) where m > 1 and k < m),
scored as (select cuts.lang, cuts.m, cuts.g, a, k, l.f as l, r.f as r, (2000000 * a::hugeint) // (l.f + r.f) as score
  from cuts join f l on l.lang = cuts.lang and l.g = lg join f r on r.lang = cuts.lang and r.g = rg),
best as (select *, row_number() over (partition by lang, g order by score, k) as nr from scored),
inner_ as (select lang, g[i:i + s - 1] as g, max(f) as longer from f, (select unnest([2, 3]) as s), (select unnest([1, 2, 3]) as i) where m > 2 and s < m and i + s - 1 <= m group by all),
kept as (select b.*, array_to_string(b.g, ' ') as phrase from best b left join inner_ i on i.lang = b.lang and i.g = b.g where nr = 1 and (longer is null or 100 * longer < 80 * a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join sizes using (lang) where rank <= 2000
"""
