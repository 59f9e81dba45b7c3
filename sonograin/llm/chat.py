"""Chat formatting after collapsing cumulative snapshots.

Some loggers write a conversation again after every turn, so that one log holds all its prefixes.  Each turn gets a rolling
hash of the turns up to it; a conversation whose last hash is found inside a longer one is its snapshot.  An anti-join
drops snapshots; of equal conversations the smallest conv_id stays.  What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, at, role, text, h1, h2: 128 bits over the turns 1..at of the conversation, in order of turn, role and text.

    Each turn's hash covers its place, so the sum of them is a hash of the sequence and needs no string of all turns.
    Null roles and texts count as empty; repeated rows are turns of their own.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("conv_id").isNotNull())
    t = t.withColumn("at", F.row_number().over(in_order))
    running = in_order.rowsBetween(Window.unboundedPreceding, 0)
    part = lambda salt: F.xxhash64(F.lit(salt), "at", "role", "text").cast("decimal(20,0)")
    whole = lambda c: F.pmod(F.sum(c).over(running), F.lit("18446744073709551616").cast("decimal(21,0)"))
    return t.withColumn("h1", whole(part(1))).withColumn("h2", whole(part(2)))


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with rolling hashes, conv_id and n_turns of the conversations that stay, with the number that they absorbed by being equal)."""
    rolled = rolling_hashes(turns)
    prefixes = rolled.select("at", "h1", "h2", "conv_id")
    ends = rolled.groupBy("conv_id").agg(F.max(F.struct("at", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    # one row per distinct whole conversation: copies collapse before anything is joined
    whole = ends.groupBy("at", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inside = prefixes.join(ends.select("conv_id", F.col("at").alias("last")), "conv_id").where("at < last").select("at", "h1", "h2").distinct()
    return rolled, whole.join(inside, ["at", "h1", "h2"], "left_anti").select("conv_id", F.col("at").alias("n_turns"), "n_copies")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: each maximal conversation once, as '<|role|>' lines, the text and an '<|end|>' line per turn.

    So that no text can forge a turn, a backslash is put before each backslash and each '|' of a role, and before each
    backslash of a text and between '<' and '|' there; different conversations are rendered differently.

    turns: conv_id, turn, role, text; other columns are ignored.  Rows without conv_id belong to no conversation and are left out.  A conversation is
    rendered to one string and so must fit a row.  An empty table gives no rows.
    """
    rolled, kept = maximal_conversations(turns)
    escaped = lambda c, mark, safe: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit(safe))
    said = F.concat(F.lit("<|"), escaped("role", "|", "\\|"), F.lit("|>\n"), escaped("text", "<|", "<\\|"), F.lit("\n<|end|>\n"))
    each = rolled.select("conv_id", "at", said.alias("said")).join(kept.select("conv_id"), "conv_id", "left_semi")
    text = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("turns"))
    return text.join(kept, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.col("turns.said"), "").alias("rendered"))


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth from t),
p as (select conv_id, nth, string_agg('<|' || replace(replace(role, '\', '\\'), '|', '\|') || '|>' || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || chr(10) || '<|end|>' || chr(10), '') over (partition by conv_id order by nth) as said,
             sum(1) over (partition by conv_id) as n from o),
w as (select said, nth, min(conv_id) as conv_id, count(*) as n_copies from p where nth = n group by said, nth)
select conv_id, cast(nth as bigint) as n_turns, n_copies, said as rendered from w
where not exists (select 1 from p where p.said = w.said and p.nth = w.nth and p.n > w.nth)
"""
