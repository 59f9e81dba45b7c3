"""Line dedup: repeated runs of lines by a suffix array over line-ID sequences.

Lines with a word get a position within their document and an ID by text.  Prefix doubling ranks the suffixes by their
first 1, 2, 4, ... lines: the rank at 2h is the number of suffixes before it in the order of the rank at h and of the rank
at h of the suffix h lines later.  Suffixes with a rank of their own are settled and leave; most do at once, and the rest
shrinks every round.  The classes of equal ranks are sorted over many tasks, and frequent lines are dealt to many.

A run of lines counts when it has ``min_words`` words.  Looked at are the shortest such run that starts at each line and the
shortest that ends at each line, two a line at most; two suffixes have a
longest common prefix of at least l lines exactly if they agree in the ranks of 2^t lines at their start and at l - 2^t,
with 2^t the greatest power up to l.  These classes are the suffix array's intervals of common prefixes of l lines; in each the earliest
suffix in document order keeps its run, all later runs are deleted.  Neighbouring and overlapping runs merge into the
maximal ones that are reported.  Any longer run is the union of the shortest run from its first line and the shortest runs to
those of its lines that reach ``min_words`` words inside it, so no maximal repeat loses a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import BLANK_GAP, cut, own_prefix, running, spread_join

MIN_WORDS = 20


def _numbered(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, dk, pos, line, h1, h2, l, m: the lines with a word; l: lines of the shortest run from here with min_words words, null at the end.

    Runs of l + 1 to m lines from here are the shortest ones with min_words words to their last lines.
    """
    gap = BLANK_GAP.replace("\\", "\\\\")
    full = f"filter(transform(split(coalesce(text, ''), '\\n'), (x, i) -> named_struct('p', i, 'c', size(array_remove(split(x, '{gap}'), '')), 'x', x)), s -> s.c > 0)"
    # n: lines that without the first of them have too few words
    reach = f"aggregate(slice(f, i + 1, {min_words}), named_struct('s', 0, 'l', 0, 'n', 0), (a, y) -> named_struct('s', a.s + y.c, 'l', a.l + if(a.s >= {min_words}, 0, 1), 'n', a.n + if(a.s + y.c - s.c < {min_words}, 1, 0)), a -> if(a.s >= {min_words}, named_struct('l', a.l, 'm', greatest(a.l, a.n)), null))"
    each = f"transform(f, (s, i) -> named_struct('pos', i, 'line', s.p, 'h1', xxhash64(s.x), 'h2', xxhash64(1, s.x), 'lm', {reach}))"
    # f is bound by a lambda over a one-element array, so that the lines are split once and not for every use
    return docs.select("doc_id", F.xxhash64("text").alias("dk"), F.expr(f"inline(flatten(transform(array({full}), f -> {each})))")).select("doc_id", "dk", "pos", "line", "h1", "h2", "lm.l", "lm.m")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """Suffixes whose first line occurs again, with their rank r among all by that line's ID: how many suffixes have a smaller one."""
    cells = running(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")), [F.col("h1"), F.col("h2")], r="n").where("n > 1")
    return spread_join(lines, cells.select("h1", "h2", "r"), ["h1", "h2"], cells.select("h1", "h2", "n"), ["doc_id", "pos"]).select("doc_id", "dk", "pos", "l", "m", "r")


def _shifted(rows: DataFrame, by, name: str, ranked: DataFrame) -> DataFrame:
    """rows joined with the rank, in ranked, of the suffix ``by`` lines later in the same document."""
    later = ranked.select(F.col("doc_id").alias("_d"), F.col("dk").alias("_k"), F.col("pos").alias("_p"), F.col("r").alias(name))
    return rows.join(later, rows["doc_id"].eqNullSafe(later["_d"]) & (rows["dk"] == later["_k"]) & (rows["pos"] + by == later["_p"])).drop("_d", "_k", "_p")


def _later_copies(runs: DataFrame) -> DataFrame:
    """Of runs (doc_id, dk, pos, l, r, r2) equal in l, r and r2 all but the earliest, with that one (first) and the size n of the interval."""
    at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "dk", "pos")
    runs = cut(runs)
    first = runs.groupBy("l", "r", "r2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = spread_join(runs, first, ["l", "r", "r2"], first.drop("first"), ["doc_id", "dk", "pos"])
    return met.where(at != F.col("first")).select("doc_id", "dk", "pos", "l", "first", "n")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The runs to delete: doc_id, dk, pos, l (lines), first (the kept copy's n, doc_id, dk, pos) and n (copies in all), by position among the lines with a word."""
    # a row that repeats doc_id and text is the same document again
    ranked, h, found = cut(_first_ranks(cut(_numbered(docs, min_words))).dropDuplicates(["doc_id", "dk", "pos"])), 1, None
    while True:
        low, high = F.greatest(F.col("l"), F.lit(h)), F.least(F.col("m"), F.lit(2 * h - 1))
        mine = ranked.where(F.col("l").isNotNull() & (low <= high)).select("doc_id", "dk", "pos", F.explode(F.sequence(low, high)).alias("l"), "r")
        whole = mine.where(F.col("l") == h).withColumn("r2", F.col("r"))
        runs = whole if h == 1 else whole.unionByName(_shifted(mine.where(F.col("l") > h), F.col("l") - h, "r2", ranked))
        copies = _later_copies(runs)
        found = copies if found is None else found.unionByName(copies)
        if 2 * h > min_words or not ranked.take(1):
            return found
        pairs = _shifted(ranked, F.lit(h), "r2", ranked)
        pairs = cut(pairs)
        cells = running(pairs.groupBy("r", "r2").agg(F.count("*").alias("n")), [F.col("r"), F.col("r2")], next="n").where("n > 1")
        ranked = cut(spread_join(pairs, cells.select("r", "r2", "next"), ["r", "r2"], cells.select("r", "r2", "n"), ["doc_id", "dk", "pos"]).select("doc_id", "dk", "pos", "l", "m", F.col("next").alias("r")))
        h *= 2


def matched_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, dk, pos, n_lines, first_doc_id, first_dk, first_pos, n_copies: the repeated runs to delete, each with the kept lines that it equals.

    Overlapping and neighbouring runs that repeat the same lines of one earlier place are one.  pos counts the lines with a
    word; n_copies is the size of the greatest interval of equal runs in it.  A document's runs are what one window holds.
    """
    found = repeated_runs(docs, min_words).select("doc_id", "dk", "pos", "l", F.col("first.doc_id").alias("first_doc_id"), F.col("first.dk").alias("first_dk"), (F.col("first.pos") - F.col("pos")).alias("shift"), "n").distinct()
    along = ["doc_id", "dk", "first_doc_id", "first_dk", "shift"]
    before = F.max(F.col("pos") + F.col("l")).over(Window.partitionBy(*along).orderBy("pos", "l").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("pos") > before, F.lit(True)).cast("int")
    runs = found.withColumn("opens", opens).withColumn("run", F.sum("opens").over(Window.partitionBy(*along).orderBy("pos", "l").rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*along, "run").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("l")).alias("end"), F.max("n").alias("n_copies"))
    return out.select("doc_id", "dk", "pos", (F.col("end") - F.col("pos")).alias("n_lines"), "first_doc_id", "first_dk", (F.col("pos") + F.col("shift")).alias("first_pos"), "n_copies")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, dk, n_lines (with a word), n_deleted, n_runs, deleted (numbers of the deleted lines, from 0, all lines counted).

    Rows that repeat both doc_id and text are one document and fare alike; two texts under one doc_id are two.  Null and
    blank texts have no lines.  The earliest copy, by doc_id (null last), hash of the text and position, stays.  Lines are compared as they
    stand, blank lines are passed over.  An empty table gives no rows; a text of any length is split once, in one row.  Other
    columns, of whatever names, are ignored.
    """
    gone = repeated_runs(docs, min_words).select("doc_id", "dk", F.explode(F.sequence("pos", F.col("pos") + F.col("l") - 1)).alias("pos")).groupBy("doc_id", "dk").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    g = gone.select(F.col("doc_id").alias("_d"), F.col("dk").alias("_k"), "gone")
    full = F.array_compact(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(x.rlike("[^\\x20\\x09-\\x0D]"), i)))
    each = docs.select("doc_id", F.xxhash64("text").alias("dk"), full.alias("full"))
    out = each.join(g, each["doc_id"].eqNullSafe(g["_d"]) & (each["dk"] == g["_k"]), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    runs_of = F.expr("size(filter(gone, (p, i) -> i = 0 or gone[i - 1] < p - 1))")
    return out.select("doc_id", "dk", F.size("full").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_deleted"), runs_of.cast("long").alias("n_runs"), F.expr("transform(gone, p -> full[p])").alias("deleted"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with their columns, their texts without the later copies of repeated runs; repeated rows stay."""
    p = own_prefix(docs)
    gone = deletions(docs, min_words).where("n_deleted > 0").select(F.col("doc_id").alias(f"{p}d"), F.col("dk").alias(f"{p}k"), F.col("deleted").alias(f"{p}gone")).distinct()
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[f"{p}d"]) & (F.xxhash64(docs["text"]) == gone[f"{p}k"]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(f"{p}gone", i)), "\n")
    return joined.select(*(F.when(F.col(f"{p}gone").isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns))


ORACLE = """
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, unnest(ls) as line, unnest(range(0, len(ls))) as nr from t),
c as (select doc_id, line, nr, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words from e),
f as (select *, row_number() over (partition by doc_id order by nr) - 1 as pos from c where words > 0),
cum as (select *, sum(words) over (partition by doc_id order by pos) as upto from f),
l as (select a.doc_id, a.pos, b.pos - a.pos + 1 as l from cum a join cum b on a.doc_id = b.doc_id and b.pos between a.pos and a.pos + 19 and b.upto - a.upto + a.words >= 20
  and (b.upto - b.words - a.upto + a.words < 20 or b.upto - a.upto < 20)),
r as (select l.doc_id, l.pos, l.l, string_agg(f.line, chr(10) order by f.pos) as body from l join f on f.doc_id = l.doc_id and f.pos between l.pos and l.pos + l.l - 1 group by all),
later as (select *, row_number() over (partition by l, body order by doc_id, pos) as copy from r),
gone as (select distinct doc_id, unnest(range(pos, pos + l)) as pos from later where copy > 1),
g as (select doc_id, pos, f.nr, row_number() over (partition by doc_id order by pos) as i from gone join f using (doc_id, pos)),
s as (select doc_id, count(*) as n_deleted, count(distinct pos - i) as n_runs, string_agg(cast(nr as varchar), ',' order by nr) as deleted from g group by doc_id)
select t.doc_id, (select count(*) from f where f.doc_id = t.doc_id) as n_lines, coalesce(n_deleted, 0) as n_deleted, coalesce(n_runs, 0) as n_runs, coalesce(deleted, '') as deleted
from t left join s using (doc_id)
"""
