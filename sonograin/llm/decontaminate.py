"""Benchmark decontamination by winnowed word k-grams.

Every window of ``span`` consecutive item words holds ``span - k + 1`` k-grams; the one with the smallest hash is its
fingerprint.  The rule depends on the words of the window alone, so any window that a document shares with an item
carries the same fingerprint on both sides, and a join of fingerprints misses no shared window; of equal hashes the
rightmost is taken.  A joined pair is then extended word by word over all windows that hold the k-gram, and only equal
windows count.  Fingerprints whose surrounding words are equal are joined once: those of a document with the runs of places
where they stand, those of items with the set of items, so that texts that repeat a word or a phrase don't multiply.

Documents are winnowed lazily: a sieve of bounded size over the items' fingerprints first drops the k-grams that no item
can have, and only the rest are held against the minimum of their windows.  The sieve loses nothing; it only spares work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import alnum_words, cut, spread_join

SPAN = 13
GRAM = 5
#: The sieve lists at most so many cells, whatever the benchmark's size.
CELLS = 1 << 16
#: The items' fingerprints with their words are broadcast up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20


def _gram_hashes(words: str, k: int) -> Column:
    """A hash for the k words from each position on; the last k - 1 entries cover fewer words."""
    later = "".join(f", get({words}, i + {j})" for j in range(1, k))
    return F.expr(f"transform({words}, (x, i) -> xxhash64(x{later}))")


def _is_minimum(i: str, span: int, k: int) -> str:
    """SQL: position i has the least hash, the rightmost of equal ones, of one of the windows that hold it."""
    w = span - k + 1
    if w == 1:
        return f"{i} <= size(words) - {k}"
    return (
        f"{i} <= size(words) - {k} and exists(sequence(greatest(0, {i} - {w - 1}), least({i}, size(words) - {span})), "
        f"j -> array_min(slice(hashes, j + 1, {w})) >= hashes[{i}] and coalesce(array_min(slice(hashes, {i} + 2, j + {w - 1} - {i})) > hashes[{i}], true))"
    )


def _fingerprint(i: str, span: int, k: int) -> str:
    """SQL: the fingerprint at i with the words of all windows around it."""
    first = f"greatest(0, {i} - {span - k})"
    return f"named_struct('span', {span}, 'h', hashes[{i}], 'at', {first}, 'off', {i} - {first}, 'ctx', slice(words, {first} + 1, least(size(words), {i} + {span}) - {first}))"


def _fingerprints(span: int, k: int) -> Column:
    chosen = f"filter(sequence(0, size(words) - 1), i -> {_is_minimum('i', span, k)})"
    return F.expr(f"if(size(words) >= {span}, transform({chosen}, i -> {_fingerprint('i', span, k)}), array())")


def item_fingerprints(items: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(span, h, item_id, off, ctx) of the items' windows; an item of n < span words is one window of n words."""
    words = items.select("item_id", alnum_words(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    long = words.where(F.size("words") >= span).withColumn("hashes", _gram_hashes("words", k)).select("item_id", F.inline(_fingerprints(span, k)))
    short = words.where(F.size("words") < span).select("item_id", F.size("words").alias("span"), F.lit(0).alias("off"), F.col("words").alias("ctx"))
    whole = [F.when(F.size("ctx") == n, F.xxhash64(*(F.get("ctx", F.lit(j)) for j in range(n)))) for n in range(1, span)]
    return long.select("item_id", "span", "h", "off", "ctx").unionByName(short.select("item_id", "span", F.coalesce(*whole).alias("h"), "off", "ctx"))


def _sieve(prints: DataFrame, n: int) -> str:
    """SQL test on a hash h that all fingerprints pass: its low bits are among theirs.  At most CELLS numbers are collected and listed."""
    bits = 20 if n <= CELLS // 2 else CELLS.bit_length() - 1
    cells = prints.select(F.col("h").bitwiseAND((1 << bits) - 1).alias("c")).distinct().toLocalIterator()
    return f"(h & {(1 << bits) - 1}L) in ({', '.join(f'{r.c}L' for r in cells)})"


def _runs(c: str) -> str:
    """SQL: the runs of consecutive numbers in the sorted array c."""
    first, last = f"filter({c}, (p, i) -> i = 0 or {c}[i - 1] < p - 1)", f"filter({c}, (p, i) -> i = size({c}) - 1 or {c}[i + 1] > p + 1)"
    return f"zip_with({first}, {last}, (a, z) -> named_struct('a', a, 'z', z))"


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM, per_mille: int = 50, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated, spans.

    docs: doc_id, text; items: item_id, text; other columns, of whatever names, are ignored.  A document is contaminated if
    at least ``per_mille`` thousandths of its words are hit.  Null and empty texts have no words and are clean.  Rows that
    repeat both doc_id and text are one document; two texts under one doc_id are two.  Repeated items count once by
    item_id; a null item_id hits words but is not counted or listed.  Empty documents give no rows, empty items rows without
    hits.  Texts of any length are taken whole; work and memory of one are in proportion to its words.
    """
    prints = item_fingerprints(items, span, k).groupBy("span", "h", "off", "ctx").agg(F.collect_set("item_id").alias("items"))
    prints = cut(prints)
    weight = F.octet_length(F.array_join("ctx", "")) + 24 * F.size("ctx") + F.octet_length(F.array_join(F.col("items").cast("array<string>"), "")) + 24 * F.size("items")
    n, weight = prints.agg(F.count("*"), F.coalesce(F.sum(weight.cast("long")), F.lit(0))).first()
    shorter = sorted(r.span for r in prints.where(F.col("span") < span).select("span").distinct().collect())  # at most span - 1 numbers
    stage = docs.select("doc_id", F.xxhash64("text").alias("_t"), alnum_words(F.col("text")).alias("words"))
    found = []
    if n:
        sieve = _sieve(prints, n)
        for s, g in [(span, k), *((x, x) for x in shorter)]:
            hashes = f"hashes{s}"
            maybe = F.expr(f"array_compact(transform({hashes}, (h, i) -> if({sieve}, i, null)))")
            stage = stage.withColumn(hashes, _gram_hashes("words", g)).withColumn(f"maybe{s}", maybe)
            sure = f"filter(maybe{s}, i -> size(words) >= {s} and {_is_minimum('i', s, g)})"
            found.append(f"transform({sure}, i -> {_fingerprint('i', s, g)})".replace("hashes[", f"{hashes}[").replace("slice(hashes,", f"slice({hashes},"))
    here = F.expr("concat(" + ", ".join(found) + ")") if found else F.expr("cast(array() as array<struct<span:int,h:bigint,at:int,off:int,ctx:array<string>>>)")
    each = stage.select("doc_id", "_t", F.size("words").cast("long").alias("n_words"), here.alias("here"))
    each = each.select("doc_id", "_t", "n_words", F.explode_outer("here").alias("c")).select("doc_id", "_t", "n_words", "c.*")
    small = weight <= broadcast_bytes
    if small:  # what passed the sieve by chance goes at once; a row without fingerprint stays for the document
        heads = prints.select("span", "h").distinct().withColumn("_there", F.lit(True))
        each = each.join(F.broadcast(heads), ["span", "h"], "left")
        each = each.select("doc_id", "_t", "n_words", *(F.when(F.col("_there"), F.col(c)).alias(c) for c in ("span", "h", "at", "off", "ctx")))
    each = each.groupBy("doc_id", "_t", "span", "h", "off", "ctx").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("at")).alias("ats"))
    side = prints.select("span", "h", F.col("off").alias("_off"), F.col("ctx").alias("_ctx"), "items")
    if small:
        joined = each.join(F.broadcast(side), ["span", "h"], "left")
    else:
        each = cut(each)
        printed, bare = each.where("h is not null"), each.where("h is null")
        counted = printed.groupBy("span", "h").agg(F.count("*").alias("n"))
        joined = spread_join(printed, side, ["span", "h"], counted, ["doc_id", "_t"], "left").unionByName(bare, allowMissingColumns=True)
    starts = (
        "filter(sequence(0, greatest(0, size(_ctx) - span)), a -> a + off - _off >= 0 and a + off - _off + span <= size(ctx) "
        "and slice(ctx, a + off - _off + 1, span) = slice(_ctx, a + 1, span))"
    )
    met = joined.select("doc_id", "_t", "n_words", "span", "items", (F.col("off") - F.col("_off")).alias("shift"), F.expr(_runs("ats")).alias("runs"), F.when(F.col("_ctx").isNotNull(), F.expr(starts)).alias("starts"))
    windows = "flatten(transform(starts, x -> transform(runs, r -> named_struct('item', cast(null as string), 'from', r.a + x + shift, 'to', r.z + x + shift + span))))"
    named = "transform(items, x -> named_struct('item', cast(x as string), 'from', cast(null as int), 'to', cast(null as int)))"
    rows = met.select("doc_id", "_t", "n_words", F.explode_outer(F.expr(f"if(size(starts) > 0, concat({windows}, {named}), null)")).alias("w")).select("doc_id", "_t", "n_words", "w.*")
    before = F.max("to").over(Window.partitionBy("doc_id", "_t").orderBy(F.col("from").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("opens", F.col("from") > F.coalesce("before", F.lit(-1)))
    out = rows.groupBy("doc_id", "_t").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("item")).alias("item_ids"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("to") - F.greatest("from", F.coalesce("before", F.lit(0))))), F.lit(0)).alias("n_hit"),
        F.array_sort(F.collect_set(F.when(F.col("opens"), F.col("from")))).alias("opened"), F.array_sort(F.collect_set(F.when(F.col("opens"), F.col("before")))).alias("closed"), F.max("to").alias("last"),
    )
    spans = F.expr("if(last is null, array(), zip_with(opened, concat(closed, array(last)), (a, z) -> named_struct('from', a, 'to', z)))")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 1000 >= F.col("n_words") * per_mille)).alias("contaminated"), spans.alias("spans"), "_t",
    )


def clean_documents(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns and repeats."""
    bad = contamination(docs, items, **how).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("_t").alias("_h")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["_h"]), "left_anti").select(docs.columns)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
ij as (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as j from i where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[j:j + n - 1], ' ') as g from ij),
ds as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from iw) where len(w) >= n),
dw as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g from ds),
h as (select doc_id, item_id, n, s from dw join iw using (n, g)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
