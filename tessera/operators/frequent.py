"""The most frequent values of a log of any size, from small summaries by the hour.

A summary keeps an hour's ``keep`` most frequent values with their counts, and the count of the next one: no value that
was left out occurs more often in that hour. Summaries are made once for each hour and added up for any span of time: a
value's count is at least the sum of what the hours tell, and at most that and the bounds of the hours that don't. Values
that may be among the first are counted again in the log, and there only in hours that left them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_folder


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts).cast("timestamp"))


def summaries(log: DataFrame, ts: str, value: str, order: str, keep: int) -> DataFrame:
    """``hour, value, n, first, bound`` of each hour's most frequent values; one row of null value has the hour's bound.

    ``first`` is the least ``order`` of the value in the hour. Rows without a value count for none.
    """
    counts = log.where(F.col(value).isNotNull()).groupBy(hour_of(ts).alias("hour"), F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("n"), "first", "value"))
    ranked = counts.withColumn("place", place).where(F.col("place") <= keep + 1)
    kept = ranked.where(F.col("place") <= keep).select("hour", "value", "n", "first", F.lit(None).cast("long").alias("bound"))
    over = ranked.where(F.col("place") == keep + 1).select("hour", F.lit(None).cast(counts.schema["value"].dataType).alias("value"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(counts.schema["first"].dataType).alias("first"), F.col("n").alias("bound"))
    return kept.unionByName(over)


def candidates(told: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """``value, n, first, most`` of the values that may be among the first ``k``, and whether no value outside can be.

    ``n`` counts the hours that tell of the value, ``most`` is what it can be at the most.
    """
    bounds = told.where("value IS NULL").select("hour", "bound")
    rows = told.where("value IS NOT NULL").drop("bound").join(bounds, "hour", "left")
    total = bounds.agg(F.coalesce(F.sum("bound"), F.lit(0)).alias("all")).first()["all"]
    summed = rows.groupBy("value").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.coalesce(F.sum("bound"), F.lit(0)).alias("own"))
    summed = summed.withColumn("most", F.col("n") + F.lit(total) - F.col("own")).drop("own")
    first = summed.orderBy(F.desc("n")).limit(k).agg(F.count("*").alias("many"), F.min("n").alias("least")).first()
    least = first["least"] if first["many"] == k else 0
    return summed.where(F.col("most") >= least), total < least or not total


def most_frequent(told: DataFrame, log: DataFrame, ts: str, value: str, order: str, k: int) -> DataFrame:
    """``value, n`` of the ``k`` most frequent values, exactly; equals in the order in which they came first.

    ``told`` are the summaries of the hours of ``log``. The log is read only if some value that counts was left out of an
    hour, or if the summaries are too short to rule other values out: then all values are counted.
    """
    shared_folder(told.sparkSession)
    found, sure = candidates(told, k)
    if sure:
        found = found.checkpoint()
        exact = found.select("value", "n", "first")
        if not found.where("most > n").isEmpty():
            rows = log.select(hour_of(ts).alias("hour"), F.col(value).alias("value"), F.col(order).alias("first"))
            missed = rows.join(found.select("value"), "value", "left_semi").join(told.where("value IS NOT NULL").select("hour", "value"), ["hour", "value"], "left_anti")
            exact = exact.unionByName(missed.groupBy("value").agg(F.count("*").alias("n"), F.min("first").alias("first")))
    else:
        exact = log.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    summed = exact.groupBy("value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return summed.orderBy(F.desc("n"), "first").limit(k).select("value", "n")
