"""Match text: the form in which names are compared."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space in the sense of Unicode's White_Space and the byte order mark.
_SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def blank(c: Column) -> Column:
    """Nothing but white space, or null."""
    return F.coalesce(c.rlike(f"^{_SPACE}*$"), F.lit(True))


def match_text(c: Column) -> Column:
    """NFC, lower case, one form of 'feat', punctuation and symbols taken out, single blanks; null when nothing is left."""
    t = F.lower(nfc(c))
    t = F.regexp_replace(t, "(?<![A-Za-z0-9_])(?:featuring|feat|ft)\\.?(?![A-Za-z0-9_])", " feat ")
    t = F.regexp_replace(t, "[\\p{P}\\p{S}]", "")
    t = F.trim(F.regexp_replace(t, f"{_SPACE}+", " "))
    return F.when(t != "", t)


def with_match_text(rows: DataFrame, **names: str) -> DataFrame:
    """rows with, for each name, the match text of the given column; every distinct spelling is normalized once."""
    spelled = rows.select(F.explode(F.array_compact(F.array(*(F.col(c) for c in names.values())))).alias("_raw")).distinct()
    known = spelled.select("_raw", match_text(F.col("_raw")).alias("_key"))
    for name, c in names.items():
        rows = rows.join(known.select(F.col("_raw").alias(f"_{name}"), F.col("_key").alias(name)), F.col(c) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return rows
