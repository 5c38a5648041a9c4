"""Lookups in tiers, caches as tables, and what is still to be looked up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.blank import has_number
from tessera.sources.versions import Versions


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: where a table is written to again and again, the last write holds. Added up before rows move."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def geocode(records: DataFrame, by_name: DataFrame, by_address: DataFrame, centroids: DataFrame) -> DataFrame:
    """``lat, lon, geocode_method`` for records by tiers: their own, by name, by address, by the zip's centroid.

    ``by_name``: name_key, n_lat, n_lon, ord (the last of a name holds). ``by_address``: address_key, a_lat, a_lon (null:
    known not to be found). ``centroids``: zip, z_lat, z_lon. Points outside the region count only from the centroids.
    """
    names = latest(by_name, "name_key", "ord").drop("ord")
    out = records.withColumn("name_key", F.lower(F.trim("name"))).withColumn("address_key", F.lower(F.trim("address")))
    out = out.join(names, "name_key", "left").join(by_address.withColumn("cached", F.lit(True)), "address_key", "left").join(centroids, "zip", "left")
    own, named, addressed = (has_number(F.col(a)) & has_number(F.col(b)) for a, b in (("lat", "lon"), ("n_lat", "n_lon"), ("a_lat", "a_lon")))
    named = named & F.coalesce(geo.in_region(F.col("n_lat"), F.col("n_lon")), F.lit(False))
    addressed = addressed & F.coalesce(geo.in_region(F.col("a_lat"), F.col("a_lon")), F.lit(False))
    method = F.when(own, "existing").when(named, "name").when(addressed, "address").when(F.col("z_lat").isNotNull(), "zip_centroid").otherwise("none")
    out = out.withColumn("geocode_method", method).withColumn("cache_state", F.when(F.col("cached").isNull(), "miss").when(F.col("a_lat").isNull(), "negative").otherwise("hit"))
    for c in ("lat", "lon"):
        chosen = F.when(F.col("geocode_method") == "existing", F.col(c)).when(F.col("geocode_method") == "name", F.col(f"n_{c}")).when(F.col("geocode_method") == "address", F.col(f"a_{c}"))
        out = out.withColumn(f"__{c}", chosen.otherwise(F.col(f"z_{c}")))
    return out.drop("lat", "lon").withColumnsRenamed({"__lat": "lat", "__lon": "lon"}).drop("n_lat", "n_lon", "a_lat", "a_lon", "z_lat", "z_lon", "cached", "name_key", "address_key")


def by_prefix(rows: DataFrame, table: DataFrame, key: str, value: str, prefix: int = 3) -> DataFrame:
    """``value`` of the whole key, else of its first characters; ``table``: key, value."""
    whole = table.select(F.col("key").alias(key), F.col("value").alias("__whole"))
    short = table.where(F.length("key") == prefix).select(F.col("key").alias("__prefix"), F.col("value").alias("__short"))
    out = rows.withColumn("__prefix", F.substring(key, 1, prefix)).join(whole, key, "left").join(short, "__prefix", "left")
    return out.withColumn(value, F.coalesce("__whole", "__short")).drop("__prefix", "__whole", "__short")


def with_cache(rows: DataFrame, cache: DataFrame, key: str, fetched: str, now: Column, seconds: int) -> DataFrame:
    """Rows joined to a cache of ``key`` (one row each): ``cache_state`` is hit, stale or miss."""
    known = cache.withColumn("__known", F.lit(True))
    age = now.cast("timestamp").cast("long") - F.col(fetched).cast("timestamp").cast("long")
    return rows.join(known, key, "left").withColumn("cache_state", F.when(F.col("__known").isNull(), "miss").when(age < seconds, "hit").otherwise("stale")).drop("__known")


def todo(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows that the cache has nothing of."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def refreshed(rows: DataFrame, cache: Versions, key: str, fetch: Callable[[DataFrame], DataFrame]) -> None:
    """Put what ``fetch`` (distinct keys to rows of the cache) finds for the keys that the cache has nothing of into it."""
    cache.upsert(fetch(todo(rows.select(key).where(F.col(key).isNotNull()).distinct(), cache.read(), key)))


def answered(rows: DataFrame, cache: Versions, key: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with the cache's columns of their key, and ``cache_state``: a hit if the cache had it before, or a miss.

    Misses are fetched once for each key and stay in the cache, so a run that is ended and begun again asks only for the rest.
    """
    before = cache.number()
    refreshed(rows, cache, key, fetch)
    now, known = cache.read(), cache.read(before).select(key, F.lit("hit").alias("cache_state"))
    return rows.join(now, key, "left").join(known, key, "left").fillna("miss", ["cache_state"])


def shared_by_first(rows: DataFrame, key: Column, order: str, values: list[str]) -> DataFrame:
    """Every row gets the ``values`` of the first row of its key: what a cache by that key makes of a sequential run."""
    keyed = rows.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(*[F.min_by(v, order).alias(v) for v in values])
    return keyed.drop(*values).join(first, "__key").drop("__key")


def enrich_by_url(records: DataFrame, pages: DataFrame, url_key: Column, page_key: Column, value: str) -> DataFrame:
    """``value`` of a page for every record of the same address, where the record has none."""
    found = pages.groupBy(page_key.alias("__url")).agg(F.min(value).alias("__value"))
    out = records.withColumn("__url", url_key).join(found, "__url", "left")
    return out.withColumn(value, F.when(F.length(value) > 0, F.col(value)).otherwise(F.col("__value"))).drop("__url", "__value")


def by_cell(rows: DataFrame, fetched: DataFrame, at: tuple[str, str], of: tuple[str, str], value: str, places: int = 1) -> DataFrame:
    """Rows with the ``value`` that was fetched for their coordinates rounded to ``places``; the least of several, null
    without one."""
    told = fetched.groupBy(*[geo.half_up(F.col(c) * 10**places).cast("long").alias(k) for c, k in zip(of, ("__y", "__x"), strict=True)]).agg(F.min(value).alias(value))
    keyed = rows.withColumns({k: geo.half_up(F.col(c) * 10**places).cast("long") for c, k in zip(at, ("__y", "__x"), strict=True)})
    return keyed.join(told, ["__y", "__x"], "left").drop("__y", "__x")
