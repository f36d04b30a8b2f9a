"""Positions on the globe: cells, zones, coordinates, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def cell(coordinate, offset: float, size: float) -> Column:
    """Index of the grid row or column that holds a coordinate."""
    return F.floor((_col(coordinate) + F.lit(float(offset))) / F.lit(float(size))).cast("bigint")


def lat_cell(latitude="latitude", size: float = 2.5) -> Column:
    return cell(latitude, 90.0, size)


def lon_cell(longitude="longitude", size: float = 2.5) -> Column:
    return cell(longitude, 180.0, size)


def on_globe(latitude="latitude", longitude="longitude") -> Column:
    return _col(latitude).between(-90.0, 90.0) & _col(longitude).between(-180.0, 180.0)


def _padded(number: Column, width: int = 3) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def cell_code(row, column, prefix: str = "G") -> Column:
    """Region code of a cell given by its indices."""
    return F.concat(F.lit(prefix), _padded(_col(row)), F.lit("_"), _padded(_col(column)))


def grid_code(latitude="latitude", longitude="longitude", size: float = 2.5,
              prefix: str = "G") -> Column:
    """Region code such as ``G028_144``; null off the globe."""
    code = cell_code(lat_cell(latitude, size), lon_cell(longitude, size), prefix)
    return F.when(on_globe(latitude, longitude), code)


def cell_center(index: Column, offset: float, size: float) -> Column:
    return (index + F.lit(0.5)) * F.lit(float(size)) - F.lit(float(offset))


def cells_on_globe(size: float) -> int:
    """The most regions a grid of this size can have."""
    return (int(180 / size) + 1) * (int(360 / size) + 1)


def tectonic_zone(latitude="latitude", longitude="longitude") -> Column:
    """Coarse tectonic zone; the first box that holds the point wins."""
    lat, lon = _col(latitude), _col(longitude)
    mid = lat.between(-60.0, 60.0)
    return (
        F.when((lon.between(-180.0, -60.0) | lon.between(120.0, 180.0)) & mid,
               "Pacific_Ring_of_Fire")
        .when(lon.between(0.0, 60.0) & lat.between(30.0, 50.0), "Mediterranean_Alpine")
        .when(lon.between(-45.0, -10.0) & mid, "Mid_Atlantic_Ridge")
        .otherwise("Other")
    )


def cartesian(latitude="latitude", longitude="longitude",
              radius: float = EARTH_KM) -> tuple[Column, Column, Column]:
    """x, y and z of a surface point, in the unit of ``radius``."""
    lat, lon = F.radians(_col(latitude)), F.radians(_col(longitude))
    r = F.lit(float(radius))
    return r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance of two points given in degrees."""
    lat1, lon1, lat2, lon2 = (_col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / F.lit(2.0))
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / F.lit(2.0))
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - a)))
