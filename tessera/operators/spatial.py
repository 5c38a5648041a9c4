"""Joins by distance as equi-joins on grid cells with the exact distance as residual."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import EARTH_M, haversine_m
from tessera.session import shared_folder

#: Metres of a degree of latitude, and the latitude up to which a grid's width is enough.
_DEGREE_M = EARTH_M * math.pi / 180


def _cells(lat: Column, lon: Column, radius_m: float, top_lat: float, around: bool) -> Column:
    """The cell of a point, or with ``around`` it and its eight neighbours. Cells are at least the radius high and wide."""
    high = radius_m / _DEGREE_M * 1.001
    wide = high / max(0.01, math.cos(math.radians(top_lat)))
    row, col = F.floor(lat / high), F.floor(lon / wide)
    if not around:
        return F.array(F.struct(row.alias("r"), col.alias("c")))
    return F.array(*[F.struct((row + i).alias("r"), (col + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def within(left: DataFrame, right: DataFrame, radius_m: float, left_at: tuple[str, str], right_at: tuple[str, str], top_lat: float = 75.0) -> DataFrame:
    """Pairs of rows at most ``radius_m`` apart, with ``distance_m``.

    The side with fewer rows per place (``right``) is put in its own cell and its neighbours' eight; the join is a hash
    or sort-merge join on the cell, never a cross join. Rows without coordinates match nothing. ``top_lat`` bounds the
    latitudes in the data.
    """
    a = left.withColumn("__cell", F.explode(_cells(F.col(left_at[0]), F.col(left_at[1]), radius_m, top_lat, False)))
    b = right.withColumn("__cell", F.explode(_cells(F.col(right_at[0]), F.col(right_at[1]), radius_m, top_lat, True)))
    pairs = a.join(b, "__cell").drop("__cell")
    distance = haversine_m(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    return pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m)


#: A cell of more than so many times ``k`` points is divided in four, down to cells of the radius by 2 to the ``DEPTH``.
CROWD, DEPTH = 4, 12
#: Bounds of distances to cells allow for rounding and for the curve of the earth within a cell: a part, and metres.
SLACK, SLACK_M = 1e-5, 0.01


def _bounds(lat: Column, lon: Column, r: Column, c: Column, high: float, wide: float) -> tuple[Column, Column]:
    """No point of the cell is nearer, and none is farther."""
    south, west = r * F.lit(high), c * F.lit(wide)
    north, east = south + F.lit(high), west + F.lit(wide)
    near = haversine_m(lat, lon, F.greatest(south, F.least(north, lat)), F.greatest(west, F.least(east, lon)))
    far = F.greatest(*[haversine_m(lat, lon, y, x) for y in (south, north) for x in (west, east)])
    return near * (1 - SLACK) - SLACK_M, far * (1 + SLACK) + SLACK_M


def nearest_candidates(left: DataFrame, right: DataFrame, k: int, radius_m: float, right_id: str, left_at: tuple[str, str], right_at: tuple[str, str], top_lat: float = 75.0) -> DataFrame:
    """The distinct places of ``left`` (``__lat, __lon``), each with rows of ``right`` among which its ``k`` nearest are.

    Cells are at first as large as the radius. Where one has many points it is divided in four, again and again, so that
    points end in leaves of about ``CROWD`` times ``k``. Every place begins with the cells around it. In each round, the
    cells' counts and farthest corners tell a distance within which it has ``k`` points; cells that begin beyond it are
    dropped, and what is left is divided. So a place meets the points of a few leaves, however many a crowded spot has.
    Of points at the very same spot only the ``k`` of least id can count; the others are left out before all else.
    """
    high = radius_m / _DEGREE_M * 1.001
    wide = high / max(0.01, math.cos(math.radians(top_lat)))
    spot = Window.partitionBy(*right_at).orderBy(right_id)
    points = right.where(F.col(right_at[0]).isNotNull() & F.col(right_at[1]).isNotNull()).withColumn("__n", F.row_number().over(spot)).where(F.col("__n") <= k).drop("__n")
    fine = 1 << DEPTH
    points = points.withColumns({"__fr": F.floor(F.col(right_at[0]) / high * fine), "__fc": F.floor(F.col(right_at[1]) / wide * fine)})
    shared_folder(left.sparkSession)
    inside = points.checkpoint()
    at = left.where(F.col(left_at[0]).isNotNull() & F.col(left_at[1]).isNotNull()).select(F.col(left_at[0]).cast("double").alias("__lat"), F.col(left_at[1]).cast("double").alias("__lon")).distinct()
    cell = F.explode(_cells(F.col("__lat"), F.col("__lon"), radius_m, top_lat, True))
    frontier = at.withColumn("__cell", cell).select("__lat", "__lon", F.col("__cell.r").alias("__r"), F.col("__cell.c").alias("__c"))
    found = []
    for level in range(DEPTH + 1):
        own = [F.shiftright(f"__f{x}", DEPTH - level).alias(f"__{x}") for x in "rc"]
        placed = inside.select("*", *own)
        counts = placed.groupBy("__r", "__c").agg(F.count("*").alias("__n")).withColumn("__leaf", (F.col("__n") <= CROWD * k) | F.lit(level == DEPTH))
        counts = counts.checkpoint()
        frontier = frontier.join(counts, ["__r", "__c"])
        near, far = _bounds(F.col("__lat"), F.col("__lon"), F.col("__r"), F.col("__c"), high / (1 << level), wide / (1 << level))
        nearer = Window.partitionBy("__lat", "__lon").orderBy("__far").rowsBetween(Window.unboundedPreceding, 0)
        frontier = frontier.withColumns({"__near": near, "__far": far}).withColumn("__upto", F.sum("__n").over(nearer))
        reach = F.min(F.when(F.col("__upto") >= k, F.col("__far"))).over(Window.partitionBy("__lat", "__lon"))
        frontier = frontier.withColumn("__reach", F.least(F.lit(radius_m), reach)).where(F.col("__near") <= F.col("__reach"))
        frontier = frontier.select("__lat", "__lon", "__r", "__c", "__leaf")
        split = not counts.where("NOT __leaf").isEmpty()
        if split:
            frontier = frontier.checkpoint()
        leaves = frontier.where("__leaf").drop("__leaf")
        found.append(leaves.join(placed, ["__r", "__c"]).drop("__r", "__c", "__fr", "__fc"))
        if not split:
            break
        crowded = counts.where("NOT __leaf").select("__r", "__c")
        inside = placed.join(crowded, ["__r", "__c"], "left_semi").drop("__r", "__c").checkpoint()
        both = F.array(*[F.struct((F.col("__r") * 2 + i).alias("r"), (F.col("__c") * 2 + j).alias("c")) for i in (0, 1) for j in (0, 1)])
        frontier = frontier.where("NOT __leaf").select("__lat", "__lon", F.explode(both).alias("__cell")).select("__lat", "__lon", F.col("__cell.r").alias("__r"), F.col("__cell.c").alias("__c"))
    return reduce(DataFrame.union, found)


def nearest(left: DataFrame, right: DataFrame, k: int, radius_m: float, left_id: str, right_id: str, left_at: tuple[str, str], right_at: tuple[str, str], top_lat: float = 75.0) -> DataFrame:
    """The ``k`` nearest rows of ``right`` within ``radius_m`` of each row of ``left``, with ``distance_m`` and ``rank``."""
    near = nearest_candidates(left, right, k, radius_m, right_id, left_at, right_at, top_lat)
    near = near.withColumn("distance_m", haversine_m(F.col("__lat"), F.col("__lon"), F.col(right_at[0]), F.col(right_at[1]))).where(F.col("distance_m") <= radius_m)
    here = Window.partitionBy("__lat", "__lon").orderBy("distance_m", right_id)
    near = near.withColumn("__n", F.row_number().over(here)).where(F.col("__n") <= k).drop("__n")
    pairs = left.join(near, (left[left_at[0]].cast("double") == near["__lat"]) & (left[left_at[1]].cast("double") == near["__lon"])).drop("__lat", "__lon")
    order = Window.partitionBy(left_id).orderBy("distance_m", right_id)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
