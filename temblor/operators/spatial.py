"""Regions, densities, centroids and scaling of positions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.operators.quantiles import exact_quantiles, fixed, scalars

# A region dimension is broadcast only below this many cells (some 10 MB).
MAX_BROADCAST_CELLS = 300_000


def attach(df: DataFrame, dim: DataFrame, on: list[str], most_rows: int | None = None) -> DataFrame:
    """Left join of a dimension; broadcast only where its size has a bound."""
    if most_rows is not None and most_rows <= MAX_BROADCAST_CELLS:
        dim = F.broadcast(dim)
    return df.join(dim, on, "left")


def add_grid(df: DataFrame, size: float = 2.5, prefix: str = "G") -> DataFrame:
    """Cell indices, region code and cell centre of every event."""
    lat, lon = geo.lat_cell(size=size), geo.lon_cell(size=size)
    return df.withColumns({
        "lat_cell": lat, "lon_cell": lon,
        "region_code": geo.grid_code(size=size, prefix=prefix),
        "region_lat_center": geo.cell_center(lat, 90.0, size),
        "region_lon_center": geo.cell_center(lon, 180.0, size),
    })


def add_cells(df: DataFrame, size: float = 2.5) -> DataFrame:
    """Cell indices only, for grouping; events off the globe are left out."""
    return df.where(geo.on_globe()).withColumns({"lat_cell": geo.lat_cell(size=size), "lon_cell": geo.lon_cell(size=size)})


def describe_cells(cells: DataFrame, size: float = 2.5, prefix: str = "G") -> DataFrame:
    """Code and centre of cells, added after grouping, once per cell."""
    return cells.withColumns({
        "region_code": geo.cell_code("lat_cell", "lon_cell", prefix),
        "region_lat_center": geo.cell_center(F.col("lat_cell"), 90.0, size),
        "region_lon_center": geo.cell_center(F.col("lon_cell"), 180.0, size)})


def region_dimension(df: DataFrame, size: float = 2.5) -> DataFrame:
    """Distinct cells with a dense id in (lat_cell, lon_cell) order.

    The numbering window sees one row per cell, at most ``cells_on_globe``.
    """
    cells = add_cells(df.select("latitude", "longitude"), size).select("lat_cell", "lon_cell").distinct()
    order = Window.orderBy("lat_cell", "lon_cell")
    return describe_cells(cells, size).withColumns({
        "region_key": F.concat_ws("_", "lat_cell", "lon_cell"),
        "region_id": F.row_number().over(order).cast("bigint")})


def add_region_ids(df: DataFrame, size: float = 2.5) -> DataFrame:
    dim = region_dimension(df, size).select("lat_cell", "lon_cell", "region_key", "region_id")
    return attach(add_grid(df, size), dim, ["lat_cell", "lon_cell"], geo.cells_on_globe(size))


def spherical_centroid(df: DataFrame, keys: list[str] = (), eps: float = 1e-9) -> DataFrame:
    """Direction of the mean unit vector; the plain mean where it vanishes."""
    x, y, z = geo.cartesian(radius=1.0)
    mean = df.groupBy(*keys).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"),
                                 F.avg("latitude").alias("_lat"), F.avg("longitude").alias("_lon"))
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    flat = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return mean.select(
        *keys,
        F.when(norm < eps, F.col("_lat")).otherwise(F.degrees(F.atan2("z", flat))).alias("centroid_latitude"),
        F.when(norm < eps, F.col("_lon")).otherwise(F.degrees(F.atan2("y", "x"))).alias("centroid_longitude"))


def geo_scale(df: DataFrame, eps: float = 1e-9) -> DataFrame:
    """One row: spread of distances to the centroid in km, at least 1."""
    center = fixed(spherical_centroid(df))
    far = df.select(geo.haversine_km("latitude", "longitude", center["centroid_latitude"],
                                     center["centroid_longitude"]).alias("d"))
    spread = far.agg(F.stddev_pop("d").alias("s"), F.avg("d").alias("m"))
    value = F.when(F.col("s") < eps, F.col("m")).otherwise(F.col("s"))
    return spread.select(F.greatest(value, F.lit(1.0)).alias("geo_scale_km"))


def cell_stats(df: DataFrame, size: float = 2.5) -> DataFrame:
    lat, lon = geo.lat_cell(size=size), geo.lon_cell(size=size)
    grouped = df.groupBy(lat.alias("lat_cell"), lon.alias("lon_cell")).agg(
        F.count(F.lit(1)).alias("event_count"), F.avg("mag").alias("mean_mag"),
        F.max("mag").alias("max_mag"), F.avg("depth").alias("mean_depth"))
    return grouped.select(
        F.concat_ws("_", "lat_cell", "lon_cell").alias("grid_id"), "lat_cell", "lon_cell",
        geo.cell_center(F.col("lat_cell"), 90.0, size).alias("grid_lat_center"),
        geo.cell_center(F.col("lon_cell"), 180.0, size).alias("grid_lon_center"),
        "event_count", "mean_mag", "max_mag", "mean_depth")


def hotspots(df: DataFrame, size: float = 2.5, share: float = 0.95) -> DataFrame:
    """Cells with statistics; hot ones reach the given quantile of counts."""
    cells = cell_stats(df, size)
    limit = scalars(exact_quantiles(cells, ["event_count"], [share]))["event_count"][0]
    return cells.withColumn("is_hotspot", F.col("event_count") >= limit)


def hotspot_flag(df: DataFrame, cells: DataFrame, size: float = 2.5,
                 name: str = "is_hotspot") -> DataFrame:
    """Mark events whose ``size`` cell id is among the hot cells."""
    hot = (cells.where("is_hotspot").select(F.col("grid_id").alias("_cell"), F.lit(True).alias("_hot"))
           .distinct())
    key = F.concat_ws("_", geo.lat_cell(size=size), geo.lon_cell(size=size))
    joined = attach(df.withColumn("_cell", key), hot, ["_cell"], geo.cells_on_globe(size))
    return joined.withColumn(name, F.coalesce("_hot", F.lit(False))).drop("_cell", "_hot")


def seismicity_density(df: DataFrame, bins: int = 99) -> DataFrame:
    """Events in the same cell of an equal-width grid over the extent, per 100.

    Cells are open on the left, so the smallest coordinate falls outside and
    counts 1, as do its row and column.
    """
    box = fixed(df.agg(F.min("latitude").alias("lat0"), F.max("latitude").alias("lat1"),
                         F.min("longitude").alias("lon0"), F.max("longitude").alias("lon1")))

    def slot(value, low, high):
        return F.ceil((value - low) / ((high - low) / F.lit(float(bins)))).cast("bigint")

    placed = df.withColumns({"_row": slot(F.col("latitude"), box["lat0"], box["lat1"]),
                             "_col": slot(F.col("longitude"), box["lon0"], box["lon1"])})
    counts = placed.groupBy("_row", "_col").agg(F.count(F.lit(1)).alias("_n"))
    joined = attach(placed, counts, ["_row", "_col"], (bins + 1) ** 2)
    outside = (F.col("_row") < 1) | (F.col("_col") < 1)
    found = F.when(outside | F.col("_n").isNull(), F.lit(1.0)).otherwise(F.col("_n").cast("double"))
    return (joined.withColumn("seismicity_density_100km", found / F.lit(100.0))
            .drop("_row", "_col", "_n"))


def hex_density(df: DataFrame, grid: int = 100) -> DataFrame:
    """Counts per hexagon of a lattice with ``grid`` columns over the extent.

    A hexagonal lattice is two shifted rectangular ones; a point goes to the
    nearer of its two candidate centres.
    """
    rows = int(grid / math.sqrt(3))
    box = fixed(df.agg(F.min("longitude").alias("x0"), F.max("longitude").alias("x1"),
                         F.min("latitude").alias("y0"), F.max("latitude").alias("y1")))
    x = (F.col("longitude") - box["x0"]) / ((box["x1"] - box["x0"]) / F.lit(float(grid)))
    y = (F.col("latitude") - box["y0"]) / ((box["y1"] - box["y0"]) / F.lit(float(rows)))
    scaled = df.select(x.alias("x"), y.alias("y"))
    half = F.lit(0.5)
    near = scaled.withColumns({
        "i1": F.floor(F.col("x") + half), "j1": F.floor(F.col("y") + half),
        "i2": F.floor("x"), "j2": F.floor("y")})
    dx1, dy1 = F.col("x") - F.col("i1"), F.col("y") - F.col("j1")
    dx2, dy2 = F.col("x") - F.col("i2") - half, F.col("y") - F.col("j2") - half
    first = dx1 * dx1 + F.lit(3.0) * dy1 * dy1 < dx2 * dx2 + F.lit(3.0) * dy2 * dy2
    hexagon = near.select(
        F.when(first, F.col("i1").cast("double")).otherwise(F.col("i2") + half).alias("hex_x"),
        F.when(first, F.col("j1").cast("double")).otherwise(F.col("j2") + half).alias("hex_y"))
    return (hexagon.groupBy("hex_x", "hex_y").agg(F.count(F.lit(1)).alias("event_count"))
            .withColumn("log10_count", F.log10(F.col("event_count").cast("double"))))


def minmax_scale(df: DataFrame, columns: list[str], suffix: str = "_normalized") -> DataFrame:
    """Scale columns to 0..1; a constant column becomes 0."""
    limits = fixed(df.agg(*[F.min(c).alias(f"{c}_lo") for c in columns],
                            *[F.max(c).alias(f"{c}_hi") for c in columns]))
    out = {}
    for c in columns:
        low, width = limits[f"{c}_lo"], limits[f"{c}_hi"] - limits[f"{c}_lo"]
        out[c + suffix] = F.when(width == 0, F.lit(0.0)).otherwise((F.col(c) - low) / width)
    return df.withColumns(out)


def extent(df: DataFrame) -> DataFrame:
    box = df.agg(F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
                 F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"))
    return box.withColumn("area_deg2", (F.col("lat_max") - F.col("lat_min"))
                          * (F.col("lon_max") - F.col("lon_min")))
