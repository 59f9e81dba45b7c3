"""Artist eras: windows in which an artist mattered, and the intervals they form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import capped_ratio, local_time, month_index, month_label, window_start


SALTS = 16


@dataclass(frozen=True)
class EraRules:
    # fixed defaults
    maximum_rank: int = 20
    minimum_consecutive: int = 2
    minimum_change: int = -12
    minimum_share: float = 0.02
    minimum_rolling: int = 12
    minimum_window: int = 3
    rolling_windows: int = 4
    window_months: int = 3


def era_windows(events: DataFrame, rules: EraRules = EraRules(), tz: str = "America/Chicago") -> DataFrame:
    """One row per artist and window with rolling plays: the components, is_qualified and strength.

    An artist without plays in the last ``rolling_windows`` windows can't qualify and adds nothing to shares or the ranks
    of others, so only windows that a play reaches are made: each (artist, window) count is dealt to the windows it rolls
    into.  The work follows the plays, not artists times windows.
    """
    r = rules
    month = month_index(local_time(F.col("instant_ms"), tz))
    counted = events.where(F.col("event_status").isin("current", "unresolved")).groupBy("artist_id", window_start(month, r.window_months).alias("m")).agg(F.count("*").alias("n"))
    ends = counted.agg(F.min("m").alias("m0"), F.max("m").alias("m1"))  # one row
    placed = counted.crossJoin(F.broadcast(ends)).select("artist_id", ((F.col("m") - F.col("m0")) / r.window_months).cast("int").alias("i"), ((F.col("m1") - F.col("m0")) / r.window_months).cast("int").alias("last"), "m0", "n")
    reached = placed.select("artist_id", "m0", "last", "n", F.posexplode(F.sequence("i", F.col("i") + r.rolling_windows - 1)).alias("k", "i")).where("i <= last")
    w = reached.groupBy("artist_id", "i", "m0").agg(F.sum("n").alias("rolling"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("plays"))
    own = Window.partitionBy("artist_id").orderBy("i")
    whole = w.groupBy("i").agg(F.sum("rolling").alias("all_rolling"))  # a row a calendar window
    # ranks go by the distinct numbers of plays, which are few; artists take theirs by a join dealt to SALTS tasks a number
    levels = w.groupBy("i", "rolling").agg(F.count("*").alias("artists")).withColumn("rank", F.dense_rank().over(Window.partitionBy("i").orderBy(F.desc("rolling")))).drop("artists")
    levels = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    w = w.join(F.broadcast(whole), "i").withColumn("share", F.col("rolling") / F.col("all_rolling"))
    w = w.withColumn("salt", F.pmod(F.xxhash64("artist_id"), F.lit(SALTS)).cast("int")).join(levels, ["i", "rolling", "salt"])
    earlier = F.sum("rolling").over(own.rangeBetween(-r.rolling_windows, -r.rolling_windows))
    w = w.withColumn("baseline", F.when(F.col("i") >= 2 * r.rolling_windows - 1, F.coalesce(earlier, F.lit(0))))
    active = (F.col("plays") >= r.minimum_window) & (F.col("rolling") >= r.minimum_rolling)
    w = w.withColumn("active", active).withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("artist_id", "active").orderBy("i")))
    w = w.withColumn("consecutive", F.when(F.col("active"), F.row_number().over(Window.partitionBy("artist_id", "active", "island").orderBy("i"))).otherwise(0))
    change = F.col("rolling") - F.col("baseline")
    gates = active & (F.col("share") >= r.minimum_share) & (F.col("rank") <= r.maximum_rank) & (F.col("consecutive") >= r.minimum_consecutive) & F.coalesce(change >= r.minimum_change, F.lit(True))
    parts = [
        capped_ratio(F.col("plays"), r.minimum_window), capped_ratio(F.col("rolling"), r.minimum_rolling), capped_ratio(F.col("share"), r.minimum_share),
        capped_ratio(r.maximum_rank + 1 - F.col("rank"), r.maximum_rank), capped_ratio(F.col("consecutive"), r.minimum_consecutive),
    ]
    five = sum(parts[1:], parts[0])
    strength = F.when(change.isNull(), five / 5).otherwise((five + capped_ratio(change - r.minimum_change, r.minimum_rolling)) / 6)
    start = F.col("m0") + F.col("i") * r.window_months
    return w.select("artist_id", F.col("i").alias("window_index"), start.alias("start_month"), month_label(start).alias("window_start"), "plays", "rolling", "share", "rank", "consecutive", "baseline", gates.alias("is_qualified"), strength.alias("strength"))


def era_intervals(windows: DataFrame, window_months: int = 3) -> DataFrame:
    """Runs of qualified windows: artist_id, window_start, window_end_exclusive, play_count, share, strength, peak_start, evidence."""
    q = windows.where("is_qualified")
    q = q.withColumn("island", F.col("window_index") - F.row_number().over(Window.partitionBy("artist_id").orderBy("window_index")))
    peak = F.max_by("start_month", F.struct("strength", "rolling", -F.col("start_month")))
    evidence = F.array_sort(F.collect_list(F.struct("window_index", "window_start", "plays", "rolling", "share", "rank", "strength")))
    out = q.groupBy("artist_id", "island").agg(
        F.min("start_month").alias("first"), F.max("start_month").alias("last"), F.sum("plays").alias("play_count"), F.avg("share").alias("share"), F.max("strength").alias("strength"), peak.alias("peak"), evidence.alias("evidence")
    )
    end = F.col("last") + window_months
    return out.select("artist_id", F.col("first").alias("start_month"), end.alias("end_month"), month_label(F.col("first")).alias("window_start"), month_label(end).alias("window_end_exclusive"), "play_count", "share", "strength", month_label(F.col("peak")).alias("peak_start"), "evidence")
