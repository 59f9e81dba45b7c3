"""Rediscovery after an absence, and dormancy or abandonment as of an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import DAY_MS, capped_ratio, local_time, month_index


def by_day(events: DataFrame, *entity: str) -> DataFrame:
    """entity, day, first (instant_ms, event_id), last_ms, n: the plays of a day; a window over an entity's days holds a row a day, however many plays there are."""
    return events.groupBy(*entity, F.floor(F.col("instant_ms") / DAY_MS).alias("day")).agg(F.min(F.struct("instant_ms", "event_id")).alias("first"), F.max("instant_ms").alias("last_ms"), F.count("*").alias("n"))


def rediscoveries(events: DataFrame, eras: DataFrame, scope: str = "artist", absence_days: int = 180, prior_plays: int = 5, return_plays: int = 1, return_days: int = 30, persistence_plays: int = 2, persistence_days: int = 90, tz: str = "America/Chicago") -> DataFrame:
    """Returns of an artist or track after ``absence_days``: gap_days, counts, persistence, the related era and the class.

    A return is the first play of its day, so gaps and counts come from whole days, but for the two days in which the spans
    after the return end; of these the plays themselves are counted, for the few returns there are.
    """
    entity = F.col("artist_id" if scope == "artist" else "track_id")
    e = events.where(F.col("event_status").isin("current", "unresolved")).select(entity.alias("entity_id"), "artist_id", "event_id", "instant_ms")
    observed = e.agg(F.max("instant_ms").alias("observed"))  # one row
    along = Window.partitionBy("entity_id", "artist_id").orderBy("day")
    back, stay, far = return_days * DAY_MS, persistence_days * DAY_MS, return_days + persistence_days
    d = by_day(e, "entity_id", "artist_id")
    over = lambda a, z: F.coalesce(F.sum("n").over(along.rangeBetween(a, z)), F.lit(0))
    d = d.select(
        "*", F.lag("last_ms").over(along).alias("prior_ms"), F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("prior_play_count"),
        over(0, return_days - 1).alias("near"), over(return_days + 1, far - 1).alias("later"),
    )
    d = d.where((F.col("first.instant_ms") - F.col("prior_ms") >= absence_days * DAY_MS) & (F.col("prior_play_count") >= prior_plays)).select("entity_id", "artist_id", "day", "first.*", "prior_ms", "prior_play_count", "near", "later")
    ends = d.select("entity_id", "artist_id", F.col("instant_ms").alias("at"), F.explode(F.array(F.col("day") + return_days, F.col("day") + far)).alias("day"))
    plays = e.select("entity_id", "artist_id", F.col("instant_ms").alias("played"), F.floor(F.col("instant_ms") / DAY_MS).alias("day"))
    since = F.col("played") - F.col("at")
    edges = ends.join(plays, ["entity_id", "artist_id", "day"]).groupBy("entity_id", "artist_id", F.col("at").alias("instant_ms")).agg(
        F.count_if(since < back).alias("near_edge"), F.count_if((since >= back) & (since < back + stay)).alias("later_edge")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    e = d.join(edges, ["entity_id", "artist_id", "instant_ms"], "left").select(
        "entity_id", "artist_id", "event_id", "instant_ms", "prior_ms", "prior_play_count", (F.col("near") + zero("near_edge")).alias("return_intensity"), (F.col("later") + zero("later_edge")).alias("persistence_play_count")
    )
    e = e.where(F.col("return_intensity") >= return_plays).crossJoin(F.broadcast(observed))
    end = F.col("instant_ms") + back + stay
    e = e.withColumn("persistence", F.when(F.col("observed") < end, "open").when(F.col("persistence_play_count") >= persistence_plays, "persistent").otherwise("not_persistent"))
    e = e.withColumn("month", month_index(local_time(F.col("instant_ms"), tz))).withColumn("horizon", month_index(local_time(end, tz)))
    era = eras.select(F.col("artist_id").alias("_a"), F.col("start_month").alias("era_start"), F.col("end_month").alias("era_end"))
    near = ((F.col("era_start") <= F.col("month")) & (F.col("month") < F.col("era_end"))) | F.col("era_start").between(F.col("month"), F.col("horizon"))
    matched = e.join(era, (e["artist_id"] == era["_a"]) & near, "left")
    first = matched.groupBy(*e.columns).agg(F.min("era_start").alias("era_start"))
    kind = F.when(F.col("era_start") >= F.col("month"), "return_beginning_new_era").when(F.col("persistence") == "persistent", "sustained_rediscovery").otherwise("one_off_return")
    return first.select(
        "entity_id", "event_id", "instant_ms", "prior_ms", ((F.col("instant_ms") - F.col("prior_ms")) / float(DAY_MS)).alias("gap_days"), "prior_play_count", "return_intensity", "persistence_play_count",
        "persistence", (F.col("observed") >= F.col("instant_ms") + back).alias("return_window_complete"), "era_start", kind.alias("classification"),
    )


def abandonments(events: DataFrame, as_of_ms: int | None = None, gap_days: int = 90, dormancy_days: int = 180, cadence_days: int = 180, likely_days: int = 365, cadence_plays: int = 3, historical_plays: int = 5, observation_days: int = 365) -> DataFrame:
    """Artists that mattered and have been silent: their last active period, confidence and status as of an instant (by default the last event; a later one is an error)."""
    e = events.where(F.col("event_status").isin("current", "unresolved")).select("artist_id", "event_id", "instant_ms")
    if as_of_ms is not None:
        late = F.raise_error(F.lit("as of an instant after the last event")).cast("boolean")
        latest = e.agg(F.max("instant_ms").alias("last"))  # one row
        e = e.crossJoin(F.broadcast(latest)).where(F.when(F.col("last") < as_of_ms, late).otherwise(F.col("instant_ms") <= as_of_ms)).drop("last")
    end = e.agg(F.max("instant_ms").alias("observed")) if as_of_ms is None else None
    days = by_day(e, "artist_id")
    along = Window.partitionBy("artist_id").orderBy("day")
    whole = Window.partitionBy("artist_id")
    split = F.when(F.col("first.instant_ms") - F.lag("last_ms").over(along) > gap_days * DAY_MS, 1).otherwise(0)
    days = days.withColumn("split", split).withColumn("since", F.max("last_ms").over(whole) - cadence_days * DAY_MS)
    days = days.withColumn("period", F.sum("split").over(along)).withColumn("whole", F.col("day") > F.floor(F.col("since") / DAY_MS))
    periods = days.groupBy("artist_id", "period").agg(F.min("first.instant_ms").alias("start_ms"), F.max("last_ms").alias("end_ms"), F.sum("n").alias("n"), F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("cadence"))
    a = periods.groupBy("artist_id").agg(F.sum("n").alias("historical_play_count"), F.sum("cadence").alias("cadence"), F.count("*").alias("active_period_count"), F.max_by(F.struct("start_ms", "end_ms", "n"), "period").alias("p"))
    # of the day in which the cadence span begins the plays themselves are counted
    begins = days.where("day = floor(since / 86400000)").select("artist_id", "day", "since")
    plays = e.select("artist_id", "instant_ms", F.floor(F.col("instant_ms") / DAY_MS).alias("day"))
    edge = begins.join(plays, ["artist_id", "day"]).groupBy("artist_id").agg(F.count_if(F.col("instant_ms") >= F.col("since")).alias("edge"))
    a = a.join(edge, "artist_id", "left").withColumn("cadence_play_count", F.col("cadence") + F.coalesce("edge", F.lit(0)))
    a = a.crossJoin(F.broadcast(end)) if as_of_ms is None else a.withColumn("observed", F.lit(as_of_ms))
    silent = (F.col("observed") - F.col("p.end_ms")) / float(DAY_MS)
    a = a.withColumn("absence_days", silent).where((F.col("historical_play_count") >= historical_plays) & (F.col("absence_days") >= dormancy_days) & (F.col("cadence_play_count") >= cadence_plays))
    score = (capped_ratio(F.col("historical_play_count"), 2 * historical_plays) + capped_ratio(F.col("cadence_play_count"), 2 * cadence_plays) + capped_ratio(F.col("absence_days"), observation_days)) / 3
    gone = (F.col("absence_days") >= likely_days) & (F.col("absence_days") >= observation_days)
    return a.select(
        "artist_id", "absence_days", "active_period_count", "historical_play_count", "cadence_play_count", (F.col("cadence_play_count") * 30 / float(cadence_days)).alias("cadence_per_30_days"),
        F.col("p.start_ms").alias("period_start_ms"), F.col("p.end_ms").alias("last_listen_ms"), F.col("p.n").alias("period_play_count"), score.alias("confidence"), F.when(gone, "likely_abandoned_as_of").otherwise("dormant").alias("status"),
    )
