"""Places near points of the globe, met on cells whose width follows the latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from vestigo.functions.numbers import rnd
from vestigo.session import stash

#: Mean radius of the earth in km.
EARTH_KM = 6371.0088
#: Places that share a cell with a place, on average, above which the search begins at half the radius; halvings at most.
CROWD, HALVINGS = 8, 10


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance of two points given in degrees."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


class Cells:
    """Bands of latitude as high as the radius, each cut into whole cells around the globe.

    A band's cells are so wide that two points of it and its neighbours within the radius are at most one
    cell apart, whatever their latitudes there; near the poles a band is one cell.
    """

    def __init__(self, radius_km: float):
        if not 0 < radius_km < math.pi * EARTH_KM / 4:
            raise ValueError("the radius must be positive and below an eighth of the globe's girth")
        self.angle = radius_km / EARTH_KM
        self.height = math.degrees(self.angle)

    def band(self, lat: Column) -> Column:
        return F.floor(lat / self.height).cast("int")

    def cells_around(self, band: Column) -> Column:
        """Number of cells in a band."""
        reach = F.greatest(F.abs((band - 1) * self.height), F.abs((band + 2) * self.height))
        narrow = F.when(reach < 90.0, F.cos(F.radians(reach))).otherwise(0.0)
        sine = F.lit(math.sin(self.angle / 2))
        width = F.when(sine < narrow, 2 * F.asin(F.least(F.lit(1.0), sine / narrow)))
        return F.coalesce(F.greatest(F.lit(1), F.floor(2 * math.pi / width).cast("int")), F.lit(1))

    def cell(self, lon: Column, around: Column) -> Column:
        turn = F.pmod(lon + 180.0, F.lit(360.0)) / 360.0
        return F.least(around - 1, F.floor(turn * around).cast("int"))

    def own(self, rows: DataFrame, lat: str, lon: str) -> DataFrame:
        """Adds the cell of each row: _band, _cell."""
        banded = rows.withColumn("_band", self.band(F.col(lat)))
        return banded.withColumn("_cell", self.cell(F.col(lon), self.cells_around(F.col("_band"))))

    def around(self, rows: DataFrame, lat: str, lon: str) -> DataFrame:
        """Each row once for every cell that may hold something within the radius: its own and those around."""
        own = self.band(F.col(lat))
        banded = rows.withColumn("_band", F.explode(F.sequence(own - 1, own + 1)))
        cut = banded.withColumn("_n", self.cells_around(F.col("_band")))
        here = self.cell(F.col(lon), F.col("_n"))
        near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(here + d, F.col("_n"))))
        return cut.withColumn("_cell", F.explode(near)).drop("_n")


def nearest_places(points: DataFrame, places: DataFrame, radius_km: float = 50.0) -> DataFrame:
    """Nearest place of each point within the radius, the smallest place_id on a tie; points without one
    or without a position keep nulls. Cells meet across their borders and across the date line.

    `points`: point_id, latitude, longitude; `places`: place_id, name, latitude, longitude. Where places
    are dense, the search begins at a smaller radius and goes on for points that found none.
    """
    known = lambda rows: rows.where(F.col("latitude").between(-90.0, 90.0) & F.col("longitude").between(-360.0, 360.0))
    asked = known(points).select("point_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).where(F.col("point_id").isNotNull())
    # Of places at one spot only the first can be the nearest.
    there = known(places).groupBy("latitude", "longitude").agg(F.min_by(F.struct("place_id", "name"), F.struct("place_id")).alias("_p"))
    there = stash(there.select("_p.*", "latitude", "longitude"), "places")
    best = None
    for radius in reversed(search_radii(there, radius_km)):
        cells = Cells(radius)
        met = cells.around(asked, "_lat", "_lon").join(cells.own(there, "latitude", "longitude"), ["_band", "_cell"])
        met = met.withColumn("_km", great_circle_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude")))
        # Short of an inner radius by more than the rounding of ties, so whatever ties with a place found is found.
        limit = radius if radius == radius_km else radius - 0.001
        found = (
            met.where(F.col("_km") <= limit)
            .groupBy("point_id")
            .agg(F.min_by(F.struct("place_id", "name", "_km"), F.struct(rnd(F.col("_km"), 6), "place_id")).alias("b"))
        )
        if radius != radius_km:
            found = stash(found, "near-places")
            asked = asked.join(found, "point_id", "left_anti")
        best = found if best is None else best.unionByName(found)
    return points.join(best, "point_id", "left").select(
        "point_id", "latitude", "longitude", F.col("b.place_id").alias("place_id"), F.col("b.name").alias("place"), rnd(F.col("b._km"), 3).alias("distance_km")
    )


def search_radii(places: DataFrame, radius_km: float) -> list[float]:
    """The radius and its halves, down to where a place shares its cell with few others. A point that finds
    a place within a smaller radius needs no larger one, so dense places are not all compared."""
    radii = [radius_km]
    while len(radii) <= HALVINGS:
        shared = Cells(radii[-1]).own(places.select("latitude", "longitude"), "latitude", "longitude").groupBy("_band", "_cell").count()
        crowd = shared.agg((F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).alias("n")).first().n
        if crowd is None or crowd <= CROWD:
            break
        radii.append(radii[-1] / 2)
    return radii
