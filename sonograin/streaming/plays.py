"""Streaming forms: de-duplicated appends, daily volume and active periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(stream: DataFrame, time: str, keys: list[str], delay: str = "5 minutes") -> DataFrame:
    """Each key once; repeats within ``delay`` of the watermark are dropped and their state is forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_volume(stream: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("play_count")).select(F.col("window.start").alias("day"), "play_count")


def active_periods(stream: DataFrame, time: str, entity: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Sessions per entity; an event exactly ``gap`` after the one before stays in its session."""
    return stream.withWatermark(time, delay).groupBy(entity, F.session_window(time, gap)).agg(F.count("*").alias("play_count")).select(entity, F.col("session_window.start").alias("start"), "play_count")


def paired(plays: DataFrame, scrobbles: DataFrame, window_ms: int = 30_000, delay: str = "1 hour") -> DataFrame:
    """play_id, scrobble_id, delta_ms of plays and scrobbles of one listener, artist and title whose starts are at most window_ms apart; both are streams.

    plays and scrobbles: record_id, listener, artist_key, track_key and start, a timestamp.  Each side is kept until the other's
    watermark has passed it by the window, so state is bounded by ``delay`` and the window and not by the history.  Rows later than
    the watermark are dropped and counted (``late_rows``); rows without match text never pair.
    """
    side = lambda r, name: r.withWatermark("start", delay).select(*(F.col(c).alias(f"{name}_{c}") for c in ("record_id", "listener", "artist_key", "track_key", "start")))
    p, s = side(plays, "play"), side(scrobbles, "scrobble")
    same = [F.col(f"play_{c}") == F.col(f"scrobble_{c}") for c in ("listener", "artist_key", "track_key")]
    near = F.expr(f"scrobble_start >= play_start - interval {window_ms} milliseconds and scrobble_start <= play_start + interval {window_ms} milliseconds")
    met = p.join(s, [*same, near])
    return met.select(F.col("play_record_id").alias("play_id"), F.col("scrobble_record_id").alias("scrobble_id"), (F.unix_millis("scrobble_start") - F.unix_millis("play_start")).alias("delta_ms"))


def late_rows(query) -> int:
    """Rows that a finished or running query has dropped because they came after the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
