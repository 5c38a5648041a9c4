"""As-of joins: of dated versions, the one that held when it was asked for; and answers from several such tables in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo


def as_of(requests: DataFrame, versions: DataFrame, key: str, at: str, since: str, values: list[str], bucket: int = 30 * 86400) -> DataFrame:
    """Requests with the ``values`` and ``since`` of the last version of their ``key`` that began at or before ``at``.

    Time is cut into buckets of so many seconds, and a key's rows are sorted within each alone, so a key that has most
    of all rows is the work of many tasks. What a bucket begins with is the last version of the buckets before it, found
    among one row for each key and bucket. Of versions of the same time the greatest holds. Requests without a version,
    a key or a time have nulls. Of the versions only these columns are read; the requests keep all of theirs.
    """
    told = F.struct(F.col(since).cast("timestamp").alias(since), *values)
    known = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("__key"), F.col(since).cast("timestamp").alias("__at"), told.alias("__told"))
    known = known.groupBy("__key", "__at").agg(F.max("__told").alias("__told"))
    asked = requests.withColumns({"__key": F.col(key), "__at": F.col(at).cast("timestamp")})
    number = F.floor(F.unix_timestamp("__at") / bucket).alias("__bucket")
    known, asked = known.select("*", number), asked.select("*", number)
    lasts = known.groupBy("__key", "__bucket").agg(F.max_by("__told", "__at").alias("__last"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    wanted = asked.where("__key IS NOT NULL AND __bucket IS NOT NULL").select("__key", "__bucket").distinct()
    begun = wanted.join(lasts, ["__key", "__bucket"], "full").withColumn("__begun", F.last("__last", ignorenulls=True).over(before)).select("__key", "__bucket", "__begun")
    both = asked.withColumn("__asks", F.lit(True)).unionByName(known.withColumn("__asks", F.lit(False)), allowMissingColumns=True)
    here = Window.partitionBy("__key", "__bucket").orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__here", F.last("__told", ignorenulls=True).over(here)).where("__asks").join(begun, ["__key", "__bucket"], "left")
    found = found.withColumn("__found", F.when(F.col("__key").isNotNull() & F.col("__at").isNotNull(), F.coalesce("__here", "__begun")))
    return found.select(*[F.col(c) for c in requests.columns], *[F.col(f"__found.{c}").alias(c) for c in (since, *values)])


def stops_as_of(requests: DataFrame, cache: DataFrame, service: DataFrame, static: DataFrame, at: str, days: int, limit: Column | None = None) -> DataFrame:
    """Requests with ``lat, lon, answered_by``: of the cache where it was not older than so many days, else of the
    service as it was then, else of the list that never changes, else ``none``.

    ``requests`` has ``stop`` and ``at``; ``cache`` and ``service`` have stop, since, lat, lon; ``static`` has stop, lat,
    lon, of which the first in order of place counts where a stop is listed twice. Points outside the region (or outside
    ``limit``, an expression over lat and lon) count only from the list.
    """
    inside = F.coalesce(geo.in_region(F.col("lat"), F.col("lon")) if limit is None else limit, F.lit(False))
    rows = requests
    for name, versions in (("cache", cache), ("service", service)):
        own = versions.where(inside).select("stop", "since", F.col("lat").alias(f"__{name}_lat"), F.col("lon").alias(f"__{name}_lon"))
        rows = as_of(rows, own, "stop", at, "since", [f"__{name}_lat", f"__{name}_lon"]).withColumnRenamed("since", f"__{name}_since")
    listed = static.groupBy("stop").agg(F.min(F.struct("lat", "lon")).alias("__listed"))
    rows = rows.join(listed, "stop", "left")
    fresh = F.col("__cache_since").isNotNull() & (F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp("__cache_since") < days * 86400)
    by = F.when(fresh, "cache").when(F.col("__service_since").isNotNull(), "service").when(F.col("__listed").isNotNull(), "static").otherwise("none")
    rows = rows.withColumn("answered_by", by)
    for c in ("lat", "lon"):
        rows = rows.withColumn(c, F.when(by == "cache", F.col(f"__cache_{c}")).when(by == "service", F.col(f"__service_{c}")).when(by == "static", F.col(f"__listed.{c}")))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])
