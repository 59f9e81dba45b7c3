"""The order in which results are handed out, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = {
    "base": ["instant_ms", "event_id"],
    "eras": ["start_month", "artist_id"],
    "rediscoveries": ["instant_ms", "entity_id"],
    "abandonments": ["-absence_days", "artist_id"],
}


def ordered(rows: DataFrame, analysis: str) -> DataFrame:
    return rows.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in ORDERS[analysis]))
