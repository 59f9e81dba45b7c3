"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; a document of a source expects target / source words copies.  In the order of
size and doc_id the expected copies are prefix-summed within the source, one offset drawn from the source's name is added,
and a document is emitted once for each integer its interval crosses.  The order by size keeps the words taken near the
target whatever the sizes are.

Since all documents of a source expect the same number of copies e, the prefix sum is e times the rank.  The rank is built
from counts of blocks: the rows of one source and size whose doc_ids' MD5 begin alike.  The counts are summed along the
sorted blocks over many tasks; a window holds one block only, so a source with a third of all rows is spread over many
tasks.  Sources are numbered and shared out over sorted ranges too, so there may be as many of them as hosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import BLANK_GAP, cut, own_prefix, running, spread_join

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Hexadecimal digits that name a block: 4096 blocks.
DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for (source, size) rows; one row per source, nulls last.

    Sources by code point weigh ``weights``, repeating.  Targets share ``share`` of all words by weight; none exceeds
    ``most`` times its source's words.  Resharing an excess by weight until none is left gives min(limit, level * weight)
    for one level: sources reach their limits in the order of limit / weight, so prefix sums in that order find it.
    A source without words gets 0; so does every source if there are no words.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(per, [F.col("source").asc_nulls_last()], i="1")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", most * F.col("source_size")).withColumn("reach", F.col("limit") / F.col("weight"))
    ranked = running(ranked, [F.col("reach"), F.col("i")], limits="limit", weights="weight")
    total = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))  # one row
    # the first source that keeps below its limit sets the level; for later ones it would only sink
    rest = (share * F.col("words") - F.col("limits")) / (F.col("all_weights") - F.col("weights"))
    level = ranked.crossJoin(F.broadcast(total)).select(rest.alias("level"), "reach").where("level <= reach").agg(F.max("level").alias("level"))  # one row
    return ranked.crossJoin(F.broadcast(level)).select("source", "source_size", F.least("limit", F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, source, size, source_size, target, copies, taken.

    Null texts have size 0.  Repeated rows are documents of their own.  Rows with equal source, size, doc_id and text
    hash are interchangeable, so reruns give the same rows.  doc_id may be of any type that is sorted and cast to text.  An
    empty table gives no rows; texts of any length are counted whole; other columns, of whatever names, are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(BLANK_GAP.replace("[", "[^"))), F.lit(0)).cast("long")
    block = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, DIGITS)
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # a null source is a source too
    rows = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", named.alias("key"), size.alias("size"), block.alias("block")))
    cells = cut(running(rows.groupBy("key", "source", "size", "block").agg(F.count("*").alias("n")), [F.col("key"), F.col("size"), F.col("block")], upto="n"))
    targets = source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    starts = cells.groupBy("key", "source").agg(F.min("upto").alias("start"), F.count("*").alias("n")).alias("s")
    sources = cut(starts.join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("key", "start", "n", "source_size", "target"))
    blocks = spread_join(cells.select("key", "size", "block", "upto"), sources.drop("n"), ["key"], sources.select("key", "n"), ["size", "block"])
    blocks = blocks.select("key", "size", "block", (F.col("upto") - F.col("start")).alias("before"), "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("key", "size", "block").orderBy("doc_id", "text_hash"))
    placed = rows.withColumn("rank", rank).join(blocks, ["key", "size", "block"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    at = F.col("before") + F.col("rank")
    copies = F.floor(at * each + offset) - F.floor((at - 1) * each + offset)
    out = placed.withColumn("copies", F.least(copies, F.lit(int(most)) if most == int(most) else copies))
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns."""
    p = own_prefix(docs)
    of = {k: f"{p}{k}" for k in ("id", "hash", "source", "copies", "rows", "own", "n")}
    taken = mixture(docs, **how).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    taken = cut(taken.toDF(*(of[k] for k in ("id", "hash", "source", "copies", "rows"))))
    same = docs["doc_id"].eqNullSafe(taken[of["id"]]) & (F.xxhash64(docs["text"]) == taken[of["hash"]]) & docs["source"].eqNullSafe(taken[of["source"]])
    joined, copies, rows = docs.join(taken, same), F.col(of["copies"]), F.col(of["rows"])
    own = copies
    if taken.where(rows > 1).take(1):  # repeated rows share their copies out: the first ones, by their other columns, get the remainder
        others = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text", "source")]
        nth = F.row_number().over(Window.partitionBy(of["id"], of["hash"], of["source"]).orderBy(F.to_json(F.struct(*others)) if others else F.lit(1))) - 1
        own = F.floor(copies / rows) + F.when(nth < copies % rows, 1).otherwise(0)
    counted = joined.withColumn(of["own"], own)
    return counted.select(*(f"`{c}`" for c in docs.columns), F.explode(F.array_repeat(F.lit(0), F.col(of["own"]).cast("int"))).alias(of["n"])).drop(of["n"])


ORACLE = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select *, [5, 2, 1][cast(i % 3 as bigint) + 1] as weight, 2.0 * source_size as cap from s),
r as (select *, cap / weight as reach from w),
l as (select *, (1.5 * sum(source_size) over () - coalesce(sum(cap) over (order by reach, i rows between unbounded preceding and 1 preceding), 0))
     / (sum(weight) over () - coalesce(sum(weight) over (order by reach, i rows between unbounded preceding and 1 preceding), 0)) as lev from r),
t as (select source, source_size, cast(least(cap, coalesce((select max(lev) from l where lev <= reach), 'infinity'::double) * weight) as double) as target from l),
p as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as each, row_number() over (partition by d.source order by size, substr(md5(cast(doc_id as varchar)), 1, 3), doc_id) as n,
     cast(('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8)) as bigint) / 4294967296.0 as u from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(size * least(2, floor(n * each + u) - floor((n - 1) * each + u)) as bigint) as taken from p
"""
