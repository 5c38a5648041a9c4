"""Fuzzy search over weighted fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators.resolution import common_subsequence


def _likeness(wanted: str):
    @F.pandas_udf(DoubleType())
    def score(values: pd.Series) -> pd.Series:
        """The best likeness, 0 to 1, of the words wanted to a window of as many words of the value."""
        words = wanted.lower().split()

        def one(value: str | None) -> float:
            have = (value or "").lower().split()
            if not have or not words:
                return 0.0
            best = 0.0
            for k in range(max(1, len(have) - len(words) + 1)):
                part, whole = " ".join(have[k : k + len(words)]), " ".join(words)
                best = max(best, 2 * common_subsequence(part, whole) / (len(part) + len(whole)))
            return best

        distinct = {v: one(v) for v in values.unique()}
        return values.map(distinct)

    return score


def search(rows: DataFrame, wanted: str, weights: dict[str, float], key: str, least: float = 0.4) -> DataFrame:
    """``key, score`` of the rows whose weighted likeness to the words wanted is at least ``least``, best first."""
    likeness = _likeness(wanted)
    score = sum((likeness(F.coalesce(F.col(f).cast("string"), F.lit(""))) * w for f, w in weights.items()), F.lit(0.0))
    return rows.select(key, F.round(score, 6).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), key)
