"""Regions, zones, distances, bins and risk levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.functions import bins, geo
from temblor.functions import scalars as fn
from temblor.operators import cleaning, spatial
from temblor.operators.patterns import quantile_bins as quantile_bins_op
from temblor.registered import register
from temblor.sources.catalog import catalog

# Grid columns as SQL, for the checks.
GRID = """
grid as (select *, cast(floor((latitude + 90)/25e-1) as bigint) as lat_cell,
                cast(floor((longitude + 180)/25e-1) as bigint) as lon_cell,
                printf('G%03d_%03d', cast(floor((latitude + 90)/25e-1) as bigint),
                       cast(floor((longitude + 180)/25e-1) as bigint)) as region_code,
                (floor((latitude + 90)/25e-1) + 5e-1)*25e-1 - 90 as region_lat_center,
                (floor((longitude + 180)/25e-1) + 5e-1)*25e-1 - 180 as region_lon_center
         from eq)"""


def r6(column, name):
    return F.round(column, 6).alias(name)


@register("grid_code", GRID + """
select id, case when seq % 13 <> 0 then region_code end as region_code, lat_cell, lon_cell,
       region_lat_center, region_lon_center from grid""")
def grid_code(spark, sf_dir):
    """Every 13th latitude is moved off the globe and gets no code."""
    grid = spatial.add_grid(catalog(spark, sf_dir))
    moved = F.when(F.col("seq") % 13 == 0, F.lit(95.0)).otherwise(F.col("latitude"))
    return grid.select("id", geo.grid_code(moved, "longitude").alias("region_code"), "lat_cell",
                       "lon_cell", "region_lat_center", "region_lon_center")


@register("region_lookup", GRID + """,
dim as (select distinct region_code, lat_cell, lon_cell from grid),
ids as (select *, row_number() over (order by lat_cell, lon_cell) as region_id from dim)
select id, concat(ids.lat_cell, '_', ids.lon_cell) as region_key, ids.region_id
from grid join ids using (region_code)""")
def region_lookup(spark, sf_dir):
    return spatial.add_region_ids(catalog(spark, sf_dir)).select("id", "region_key", "region_id")


@register("coarse_grid", """
select floor(latitude/10)*10 as lat_grid, floor(longitude/10)*10 as lon_grid, count(*) as n
from eq group by 1, 2""")
def coarse_grid(spark, sf_dir):
    lat, lon = F.floor(F.col("latitude") / 10) * F.lit(10.0), F.floor(F.col("longitude") / 10) * F.lit(10.0)
    return (catalog(spark, sf_dir).groupBy(lat.alias("lat_grid"), lon.alias("lon_grid"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("tectonic_zone", """
select id, case
  when (longitude between -180 and -60 or longitude between 120 and 180) and latitude between -60 and 60
    then 'Pacific_Ring_of_Fire'
  when longitude between 0 and 60 and latitude between 30 and 50 then 'Mediterranean_Alpine'
  when longitude between -45 and -10 and latitude between -60 and 60 then 'Mid_Atlantic_Ridge'
  else 'Other' end as zone from eq""")
def tectonic_zone(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", geo.tectonic_zone().alias("zone"))


@register("to_cartesian", """
select id, round(6371*cos(radians(latitude))*cos(radians(longitude)), 6) as x,
       round(6371*cos(radians(latitude))*sin(radians(longitude)), 6) as y,
       round(6371*sin(radians(latitude)), 6) as z from eq""")
def to_cartesian(spark, sf_dir):
    x, y, z = geo.cartesian()
    return catalog(spark, sf_dir).select("id", r6(x, "x"), r6(y, "y"), r6(z, "z"))




def haversine_sql(lat1, lon1, lat2, lon2):
    a = (f"(pow(sin((radians({lat2}) - radians({lat1}))/2), 2) + cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin((radians({lon2}) - radians({lon1}))/2), 2))")
    return f"(2*6371e0*atan2(sqrt({a}), sqrt(greatest(0e0, 1e0 - {a}))))"


@register("haversine", f"""
select id, round({haversine_sql('latitude', 'longitude', '10e0', '20e0')}, 6) as km from eq""")
def haversine(spark, sf_dir):
    km = geo.haversine_km("latitude", "longitude", F.lit(10.0), F.lit(20.0))
    return catalog(spark, sf_dir).select("id", r6(km, "km"))


CENTROID = """
u as (select *, cos(radians(latitude))*cos(radians(longitude)) as x,
             cos(radians(latitude))*sin(radians(longitude)) as y, sin(radians(latitude)) as z from eq)"""


@register("spherical_centroid", CENTROID + """
select net, round(degrees(atan2(avg(z), sqrt(avg(x)*avg(x) + avg(y)*avg(y)))), 6) as centroid_latitude,
       round(degrees(atan2(avg(y), avg(x))), 6) as centroid_longitude from u group by net""")
def spherical_centroid(spark, sf_dir):
    found = spatial.spherical_centroid(catalog(spark, sf_dir), ["net"])
    return found.select("net", r6("centroid_latitude", "centroid_latitude"),
                        r6("centroid_longitude", "centroid_longitude"))


@register("geo_scale", CENTROID + f""",
c as (select degrees(atan2(avg(z), sqrt(avg(x)*avg(x) + avg(y)*avg(y)))) as clat,
             degrees(atan2(avg(y), avg(x))) as clon from u)
select round(greatest(stddev_pop({haversine_sql('latitude', 'longitude', 'clat', 'clon')}), 1e0), 6)
       as geo_scale_km from eq, c""")
def geo_scale(spark, sf_dir):
    return spatial.geo_scale(catalog(spark, sf_dir)).select(r6("geo_scale_km", "geo_scale_km"))


HOTSPOTS = """
cells as (select concat(cast(floor((latitude + 90)/25e-1) as bigint), '_',
                        cast(floor((longitude + 180)/25e-1) as bigint)) as grid_id,
                 count(*) as event_count, avg(mag) as mean_mag, max(mag) as max_mag,
                 avg(depth) as mean_depth from eq group by 1),
hot as (select *, event_count >= (select quantile_cont(event_count, 0.95) from cells) as is_hotspot
        from cells)"""


@register("hotspots", HOTSPOTS + """
select grid_id, event_count, round(mean_mag, 6) as mean_mag, max_mag, round(mean_depth, 6) as mean_depth,
       is_hotspot from hot""")
def hotspots(spark, sf_dir):
    cells = spatial.hotspots(catalog(spark, sf_dir))
    return cells.select("grid_id", "event_count", r6("mean_mag", "mean_mag"), "max_mag",
                        r6("mean_depth", "mean_depth"), "is_hotspot")


@register("hotspot_flag", HOTSPOTS + """
select id, concat(cast(floor((latitude + 90)/25e-1) as bigint), '_',
                  cast(floor((longitude + 180)/25e-1) as bigint))
           in (select grid_id from hot where is_hotspot) as is_hotspot from eq""")
def hotspot_flag(spark, sf_dir):
    events = catalog(spark, sf_dir)
    return spatial.hotspot_flag(events, spatial.hotspots(events)).select("id", "is_hotspot")


@register("seismicity_density", """
b as (select min(latitude) a0, max(latitude) a1, min(longitude) o0, max(longitude) o1 from eq),
p as (select id, ceil((latitude - a0)/((a1 - a0)/99e0)) as r, ceil((longitude - o0)/((o1 - o0)/99e0)) as c
      from eq, b)
select id, (case when r < 1 or c < 1 then 1 else count(*) over (partition by r, c) end)/1e2
       as seismicity_density_100km from p""")
def seismicity_density(spark, sf_dir):
    return spatial.seismicity_density(catalog(spark, sf_dir)).select("id", "seismicity_density_100km")


@register("hex_density", """
b as (select min(latitude) y0, max(latitude) y1, min(longitude) x0, max(longitude) x1 from eq),
p as (select (longitude - x0)/((x1 - x0)/100e0) as x, (latitude - y0)/((y1 - y0)/57e0) as y from eq, b),
d as (select *, pow(x - floor(x + 5e-1), 2) + 3*pow(y - floor(y + 5e-1), 2) as d1,
             pow(x - floor(x) - 5e-1, 2) + 3*pow(y - floor(y) - 5e-1, 2) as d2 from p)
select case when d1 < d2 then floor(x + 5e-1) else floor(x) + 5e-1 end as hex_x,
       case when d1 < d2 then floor(y + 5e-1) else floor(y) + 5e-1 end as hex_y,
       count(*) as event_count, round(log10(count(*)), 6) as log10_count
from d group by 1, 2""")
def hex_density(spark, sf_dir):
    return spatial.hex_density(catalog(spark, sf_dir)).select(
        "hex_x", "hex_y", "event_count", r6("log10_count", "log10_count"))


@register("minmax_scale", """
select id, round((latitude - min(latitude) over ())/(max(latitude) over () - min(latitude) over ()), 6) as latitude,
       round((longitude - min(longitude) over ())/(max(longitude) over () - min(longitude) over ()), 6) as longitude
from eq""")
def minmax_scale(spark, sf_dir):
    scaled = spatial.minmax_scale(catalog(spark, sf_dir), ["latitude", "longitude"])
    return scaled.select("id", r6("latitude_normalized", "latitude"),
                         r6("longitude_normalized", "longitude"))


@register("spatial_extent", """
select min(latitude) as lat_min, max(latitude) as lat_max, min(longitude) as lon_min,
       max(longitude) as lon_max,
       round((max(latitude) - min(latitude))*(max(longitude) - min(longitude)), 6) as area_deg2 from eq""")
def spatial_extent(spark, sf_dir):
    return spatial.extent(catalog(spark, sf_dir)).withColumn("area_deg2", F.round("area_deg2", 6))


@register("calendar_features", """
select id, year("time")::bigint as year, month("time")::bigint as month, day("time")::bigint as day,
       (isodow("time") - 1)::bigint as day_of_week, dayofyear("time")::bigint as day_of_year,
       hour("time")::bigint as hour,
       case when month("time") in (12, 1, 2) then 'Winter' when month("time") <= 5 then 'Spring'
            when month("time") <= 8 then 'Summer' else 'Autumn' end as season,
       case when hour("time") < 6 then 'Night' when hour("time") < 12 then 'Morning'
            when hour("time") < 18 then 'Afternoon' else 'Evening' end as time_of_day,
       datediff('day', timestamp '2000-01-01', "time")::bigint as days_since_2000 from eq""")
def calendar_features(spark, sf_dir):
    events = catalog(spark, sf_dir)
    whole = {"year": F.year, "month": F.month, "day": F.day, "day_of_week": F.weekday,
             "day_of_year": F.dayofyear, "hour": F.hour}
    return events.select("id", *[f("time").cast("bigint").alias(n) for n, f in whole.items()],
                         fn.season(F.month("time")).alias("season"),
                         fn.time_of_day(F.hour("time")).alias("time_of_day"),
                         fn.days_since_2000("time").alias("days_since_2000"))


@register("cyclic_time", """
select id, round(sin(2*pi()*month("time")/12e0), 6) as month_sin, round(cos(2*pi()*month("time")/12e0), 6) as month_cos,
       round(sin(2*pi()*hour("time")/24e0), 6) as hour_sin, round(cos(2*pi()*hour("time")/24e0), 6) as hour_cos
from eq""")
def cyclic_time(spark, sf_dir):
    month_sin, month_cos = fn.cyclic(F.month("time"), 12)
    hour_sin, hour_cos = fn.cyclic(F.hour("time"), 24)
    return catalog(spark, sf_dir).select("id", r6(month_sin, "month_sin"), r6(month_cos, "month_cos"),
                                         r6(hour_sin, "hour_sin"), r6(hour_cos, "hour_cos"))


@register("log_and_flags", """
select id, """ + ", ".join(
    f"round(ln(1 + greatest(coalesce({c}, 0)::double, 0)), 6) as {c}_log1p"
    for c in ("depth", "sig", "rms", "nst", "dmin")) + """,
       (mmi is not null)::bigint as has_mmi, (felt is not null)::bigint as has_felt,
       (cdi is not null)::bigint as has_cdi, (gap is null)::bigint as gap_missing,
       (nst is null)::bigint as nst_missing, 6371 - depth as distance_from_center from eq""")
def log_and_flags(spark, sf_dir):
    logs = [r6(fn.log1p_clipped(c), f"{c}_log1p") for c in ("depth", "sig", "rms", "nst", "dmin")]
    has = [fn.flag(F.col(c).isNotNull()).alias(f"has_{c}") for c in ("mmi", "felt", "cdi")]
    gone = [fn.flag(F.col(c).isNull()).alias(f"{c}_missing") for c in ("gap", "nst")]
    center = F.lit(geo.EARTH_KM) - F.coalesce("depth", F.lit(0.0))
    return catalog(spark, sf_dir).select("id", *logs, *has, *gone, center.alias("distance_from_center"))


@register("bands", """
select id, case when depth <= 70 then 'shallow' when depth <= 300 then 'intermediate' else 'deep' end as depth_band,
       case when mag <= 2 then 'micro_minor' when mag <= 4 then 'light' when mag <= 5 then 'moderate'
            when mag <= 6 then 'strong' when mag <= 7 then 'major' else 'great' end as mag_band,
       case when seq % 17 = 0 then 'Unknown' when depth < 70 then 'Shallow' when depth < 300 then 'Intermediate'
            else 'Deep' end as depth_class,
       case when mag < 55e-1 then 'Moderate' when mag < 6 then 'Strong' when mag < 7 then 'Major'
            else 'Great' end as mag_class from eq""")
def bands(spark, sf_dir):
    """Both closing sides of the binner; depth is null in one row of 17."""
    gap = F.when(F.col("seq") % 17 != 0, F.col("depth"))
    return catalog(spark, sf_dir).select("id", bins.depth_band().alias("depth_band"),
                                         bins.mag_band().alias("mag_band"),
                                         bins.depth_class(gap).alias("depth_class"),
                                         bins.mag_class().alias("mag_class"))


TOKEN = """
case when mag >= 0 and mag < 3 then 'M0_3' when mag >= 3 and mag < 45e-1 then 'M3_4_5'
     when mag >= 45e-1 and mag < 6 then 'M4_5_6' when mag >= 6 and mag < 105e-1 then 'M6_plus' else 'M_unknown' end
|| '_' || case when depth >= 0 and depth < 70 then 'shallow' when depth >= 70 and depth < 300 then 'intermediate'
     when depth >= 300 and depth < 800 then 'deep' else 'depth_unknown' end"""


@register("event_token", f"select id, {TOKEN} as token from (select id, mag, depth*125e-2 as depth from eq)")
def event_token(spark, sf_dir):
    """Depths are stretched so that some leave the last bin."""
    return catalog(spark, sf_dir).select(
        "id", bins.event_token("mag", F.col("depth") * 1.25).alias("token"))


@register("scale_counts", """
select 'mag' as scale, case when mag <= 0 or mag > 10 then null when mag <= 2 then 'Micro (<2)'
       when mag <= 3 then 'Minor (2-3)' when mag <= 4 then 'Light (3-4)' when mag <= 5 then 'Moderate (4-5)'
       else 'Strong (≥5)' end as label, count(*) as n from eq group by 2
union all
select 'depth', case when depth <= 0 or depth > 1000 then null when depth <= 10 then 'Shallow (<10km)'
       when depth <= 35 then 'Intermediate (10-35km)' when depth <= 70 then 'Medium (35-70km)'
       when depth <= 300 then 'Deep (70-300km)' else 'Very Deep (>300km)' end, count(*) from eq group by 2""")
def scale_counts(spark, sf_dir):
    events = catalog(spark, sf_dir)
    labels = F.explode(F.array(
        F.struct(F.lit("mag").alias("scale"), bins.bin_column("mag", *bins.MAG_SCALE).alias("label")),
        F.struct(F.lit("depth").alias("scale"), bins.bin_column("depth", *bins.DEPTH_SCALE).alias("label"))))
    return (events.select(labels.alias("b")).groupBy("b.scale", "b.label")
            .agg(F.count(F.lit(1)).alias("n")))


@register("quantile_bins", """
q as (select quantile_cont(gap, 1/3e0) a, quantile_cont(gap, 2/3e0) b, quantile_cont(rms, 1/3e0) c,
             quantile_cont(rms, 2/3e0) d from eq)
select id, case when gap <= a then 'gap_q1' when gap <= b then 'gap_q2' when gap > b then 'gap_q3' end as gap_bin,
       case when rms <= c then 'rms_q1' when rms <= d then 'rms_q2' when rms > d then 'rms_q3' end as rms_bin,
       'tsunami_q1' as tsunami_bin
from eq, q""")
def quantile_bins(spark, sf_dir):
    """The quantiles of ``tsunami`` coincide, so all its rows share one bin."""
    events = catalog(spark, sf_dir).withColumn("tsunami", cleaning.zero_one("tsunami"))
    return quantile_bins_op(events, ["gap", "rms", "tsunami"]).select(
        "id", "gap_bin", "rms_bin", "tsunami_bin")


@register("data_quality", """
select id, case when nst >= 20 and gap <= 90 then 'High' when nst >= 10 and gap <= 180 then 'Medium'
                else 'Low' end as data_quality, (coalesce(tsunami, 0) = 1)::bigint as has_tsunami from eq""")
def data_quality(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", fn.data_quality().alias("data_quality"),
                                         fn.flag(F.col("tsunami") == 1).alias("has_tsunami"))


@register("risk_levels", """
s as (select id, 1/(1 + exp(-(mag - 3))) as p from eq)
select id, round(p, 6) as p, case when p >= 7e-1 then 'HIGH' when p >= 4e-1 then 'MEDIUM' else 'LOW' end as risk,
       case when p >= 5e-1 then 'CRITICAL' when p >= 2e-1 then 'HIGH' when p >= 1e-1 then 'MEDIUM' else 'LOW' end
         as major_risk,
       case when p >= least(95e-2, 35e-2 + 18e-2) then 'high' when p >= 35e-2 then 'medium' else 'low' end as alert
from s""")
def risk_levels(spark, sf_dir):
    scored = catalog(spark, sf_dir).select("id", fn.sigmoid(F.col("mag") - 3).alias("p"))
    return scored.select("id", r6("p", "p"), fn.level("p", fn.RISK_LEVELS).alias("risk"),
                         fn.level("p", fn.MAJOR_RISK_LEVELS).alias("major_risk"),
                         fn.alert_level(F.col("p"), 0.35).alias("alert"))


@register("m5_probability", """
select id, round(1/(1 + exp(-(depth - 300)/100))*(1/(1 + exp(-(mag - 5)))), 6) as m5_probability from eq""")
def m5_probability(spark, sf_dir):
    quake = fn.sigmoid((F.col("depth") - 300) / 100)
    return catalog(spark, sf_dir).select("id", r6(fn.major_probability(quake, "mag"), "m5_probability"))
