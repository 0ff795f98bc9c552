"""Geometry on a sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS


def metres(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance, null if any coordinate is; arguments are columns or names."""
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def mode_of_speed(kmh: Column) -> Column:
    """Transport mode of an average speed; a cut-off itself belongs to the slower mode."""
    return F.when(kmh > 140, "flying").when(kmh > 25, "driving").when(kmh > 7, "cycling").otherwise("walking")


def radius_join(left: DataFrame, right: DataFrame, radius: float, right_names: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of left and right rows (both with lat, lon) at most radius metres apart and equal in `keys`, with the distance as metres.

    Both sides are put in latitude bands and, inside a band, longitude cells of the radius's size at the band's
    widest latitude; right rows are copied to neighbouring cells, so it is an equi-join with a residual filter.
    right_names renames right columns, lat and lon among them.
    """
    step = radius / 111_000.0
    band = lambda lat: F.floor(lat / step)
    # the widest cell needed in a band is at its pole-side edge (bands next to it included)
    edge = lambda b: F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), (F.abs(b) + 2) * step))))
    lon_cell = lambda lon, b: F.floor(lon / (step / edge(b)))
    l = left.withColumn("cell_b", band(F.col("lat"))).withColumn("cell_l", lon_cell(F.col("lon"), F.col("cell_b")))  # noqa: E741
    r = right.withColumn("cell_b", F.explode(F.array(*[band(F.col("lat")) + i for i in (-1, 0, 1)])))
    r = r.withColumn("cell_l", F.explode(F.array(*[lon_cell(F.col("lon"), F.col("cell_b")) + i for i in (-1, 0, 1)])))
    r = r.select("cell_b", "cell_l", *[F.col(c).alias(right_names.get(c, c)) for c in right.columns])
    on = [*keys, "cell_b", "cell_l"]
    distance = metres("lat", "lon", right_names["lat"], right_names["lon"])
    return l.join(r, on).withColumn("metres", distance).where(F.col("metres") <= radius).drop("cell_b", "cell_l")
