"""Feature tables and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.operators import cleaning, features, spatial
from temblor.registered import register
from temblor.registered.ranges import SEQUENCES
from temblor.registered.spatial import GRID, r6
from temblor.registered.temporal import INTERPOLATED, shifted
from temblor.schemas import MAG_FEATURES, TIME_FEATURES
from temblor.sources.catalog import catalog

W = "over (partition by region_code order by us, seq)"


#: What the feature table takes from the catalog.
FEATURE_SOURCE = ["id", "seq", "time", "latitude", "longitude", "mag", "depth", "sig", "mmi", "cdi", "felt"]


def _features(spark, sf_dir):
    return features.sequence_features(catalog(spark, sf_dir).select(*FEATURE_SOURCE))


HALF_GRID = GRID.replace("25e-1", "5e-1").replace("'G%03d_%03d'", "'R%03d_%03d'")

SEQUENCE_FEATURES = f"""{HALF_GRID},{SEQUENCES},{INTERPOLATED},
fo as (select a.seq, max(b.mag) as m from eq a join eq b
       on b.us >= a.us and b.us <= a.us + floor(greatest(pow(10, 5e-1*a.mag - 1)*1e6, 1)) and b.mag > a.mag group by 1),
bx as (select min(latitude) a0, max(latitude) a1, min(longitude) o0, max(longitude) o1 from eq),
pl as (select id, ceil((latitude - a0)/((a1 - a0)/99e0)) as r, ceil((longitude - o0)/((o1 - o0)/99e0)) as c from eq, bx),
de as (select id, (case when r < 1 or c < 1 then 1 else count(*) over (partition by r, c) end)/1e2
              as seismicity_density_100km from pl),
g as (select *, coalesce((us - lag(us) {W})/1e6, 0) as gap_s from grid)
select g.id, g.us, g.mag, g.depth, g.sig, g.region_code, (fo.m is not null)::bigint as is_aftershock,
       coalesce(fo.m, g.mag) as mainshock_mag, seismicity_density_100km,
       round(log10(1 + coalesce(sum(pow(10, 15e-1*g.mag)) over
         (partition by region_code order by g.us, g.seq rows between 20 preceding and 1 preceding), 0)), 6) as log_stress,
       sequence_id, seq_position, is_seq_mainshock, seq_mainshock_mag, seq_length, time_since_seq_start_sec,
       gap_s as time_since_last_event,
       coalesce((g.us - max(case when g.mag >= 5 then g.us end) over (partition by region_code order by g.us
         range between unbounded preceding and 1 preceding))//1000000, 31536000) as time_since_last_M5,
       """ + ", ".join(f"lag(gap_s, {i}, 0) over (partition by region_code order by g.us, g.seq) as interval_lag{i}"
                       for i in range(1, 6)) + """,
       latitude, longitude, coalesce(mmi, 0) as mmi, coalesce(cdi, 0) as cdi, coalesce(felt, 0) as felt, regional_b_value,
       (lead(g.us) over (partition by region_code order by g.us, g.seq) - g.us)/1e6 as target_time_to_next,
       lead(g.mag) over (partition by region_code order by g.us, g.seq) as target_next_mag
from g join stats using (id) join bi using (id) join de using (id) left join fo on fo.seq = g.seq"""


@register("sequence_features", SEQUENCE_FEATURES)
def sequence_features(spark, sf_dir):
    """The full feature table in one check."""
    columns = list(dict.fromkeys([*TIME_FEATURES, *MAG_FEATURES, "target_time_to_next", "target_next_mag"]))
    columns = [c for c in columns if c not in ("coulomb_stress_proxy", "regional_b_value")]
    return _features(spark, sf_dir).select(
        "id", F.unix_micros("time").alias("us"), *columns,
        r6(F.log10(F.lit(1.0) + F.col("coulomb_stress_proxy")), "log_stress"), r6("regional_b_value", "regional_b_value"))


REGIONAL_FEATURES = """
m as (select median(rms) rms, median(gap) gap, median(dmin) dmin, cast(trunc(median(nst)) as bigint) nst,
             cast(trunc(median(sig)) as bigint) sig from eq),
e as (select eq.* replace (coalesce(eq.rms, m.rms) as rms, coalesce(eq.gap, m.gap) as gap,
             coalesce(eq.dmin, m.dmin) as dmin, coalesce(eq.nst, m.nst) as nst, coalesce(eq.sig, m.sig) as sig),
             floor(latitude/10)*10 as lat_grid, floor(longitude/10)*10 as lon_grid from eq, m),
h as (select a.seq, count(*) n, avg(b.mag) hm, max(b.mag) x, max(b.us) last_us from eq a join eq b
      on b.us < a.us and b.us >= a.us - 2592000000000
         and b.latitude between a.latitude - 1 and a.latitude + 1
         and b.longitude between a.longitude - 1 and a.longitude + 1 group by 1),
ar as (select lat_grid, lon_grid, avg(mag) am, stddev_samp(mag) sd, count(*) an from e group by 1, 2),
yr as (select year("time") as y, lat_grid, lon_grid, count(*) yn from e group by 1, 2, 3)
select e.id, e.us, mag, case when mag < 55e-1 then 'Moderate' when mag < 6 then 'Strong' when mag < 7 then 'Major' else 'Great' end as mag_class,
       latitude, longitude, round((latitude - min(latitude) over ())/(max(latitude) over () - min(latitude) over ()), 6) as latitude_normalized,
       round((longitude - min(longitude) over ())/(max(longitude) over () - min(longitude) over ()), 6) as longitude_normalized,
       depth, case when depth < 70 then 'Shallow' when depth < 300 then 'Intermediate' else 'Deep' end as depth_class,
       case when (longitude between -180 and -60 or longitude between 120 and 180) and latitude between -60 and 60
              then 'Pacific_Ring_of_Fire'
            when longitude between 0 and 60 and latitude between 30 and 50 then 'Mediterranean_Alpine'
            when longitude between -45 and -10 and latitude between -60 and 60 then 'Mid_Atlantic_Ridge' else 'Other' end as tectonic_zone,
       e.lat_grid, e.lon_grid, year("time")::bigint as year, dayofyear("time")::bigint as day_of_year,
       case when month("time") in (12, 1, 2) then 'Winter' when month("time") <= 5 then 'Spring'
            when month("time") <= 8 then 'Summer' else 'Autumn' end as season,
       coalesce(n, 0) as hist_count_30d, round(coalesce(hm, 0) + 1.2345678e-8, 6) as hist_mag_mean_30d,
       coalesce(x, 0) as hist_mag_max_30d, coalesce((e.us - last_us)//86400000000, 9999) as days_since_last,
       rms, gap, dmin, nst, sig, status, net, (coalesce(tsunami, 0) = 1)::bigint as has_tsunami,
       case when nst >= 20 and gap <= 90 then 'High' when nst >= 10 and gap <= 180 then 'Medium' else 'Low' end as data_quality,
       round(am + 1.2345678e-8, 6) as region_mag_mean, round(sd, 6) as region_mag_std, an as region_event_count,
       yn as yearly_region_count, place, type
from e left join h using (seq) join ar on ar.lat_grid = e.lat_grid and ar.lon_grid = e.lon_grid
     join yr on yr.lat_grid = e.lat_grid and yr.lon_grid = e.lon_grid and yr.y = year(e."time")"""


@register("regional_features", REGIONAL_FEATURES)
def regional_features(spark, sf_dir):
    """Calendar, zone, history and quality columns of every event."""
    out = features.regional_features(catalog(spark, sf_dir))
    same = ["id", "mag", "mag_class", "latitude", "longitude", "depth", "depth_class", "tectonic_zone", "lat_grid",
            "lon_grid", "season", "hist_count_30d", "hist_mag_max_30d", "days_since_last", "rms", "gap", "dmin", "nst",
            "sig", "status", "net", "has_tsunami", "data_quality", "region_event_count", "yearly_region_count", "place",
            "type"]
    return out.select(*same, F.unix_micros("time").alias("us"), F.col("year").cast("bigint").alias("year"),
                      F.col("day_of_year").cast("bigint").alias("day_of_year"), shifted("hist_mag_mean_30d"),
                      shifted("region_mag_mean"), r6("region_mag_std", "region_mag_std"),
                      r6("latitude_normalized", "latitude_normalized"), r6("longitude_normalized", "longitude_normalized"))


@register("engineered_fields", GRID + """,
dim as (select *, row_number() over (order by lat_cell, lon_cell) as region_id
        from (select distinct region_code, lat_cell, lon_cell from grid))
select id, year("time")::bigint as year, hour("time")::bigint as hour, region_id,
       round(ln(1 + coalesce(sig, 0)), 6) as sig_log1p, (dmin is null)::bigint as dmin_missing,
       case when depth <= 70 then 'shallow' when depth <= 300 then 'intermediate' else 'deep' end as depth_band,
       round(sin(2*pi()*month("time")/12e0), 6) as month_sin
from grid join dim using (region_code)""")
def engineered_fields(spark, sf_dir):
    out = features.engineered(catalog(spark, sf_dir))
    return out.select("id", "year", "hour", "region_id", r6("sig_log1p", "sig_log1p"), "dmin_missing", "depth_band",
                      r6("month_sin", "month_sin"))


_LAGS = ["mag", "depth", "gap", "nst", "rms"]


def _lookback_sql():
    lags = {c: [f"lag({c}, {i}) over w" for i in range(7, -1, -1)] for c in [*_LAGS, "h"]}
    flat = ", ".join(f"{x}::double as {c}_{i}" for c, xs in lags.items() for i, x in enumerate(xs))
    names = ", ".join(f"round({c}_{i} + 1.2345678e-8, 6)" for c in [*_LAGS, "h"] for i in range(8))

    def mean(c):
        return "(" + " + ".join(f"{c}_{i}" for i in range(8)) + ")/8"

    def spread(c):
        return "sqrt((" + " + ".join(f"pow({c}_{i} - {mean(c)}, 2)" for i in range(8)) + ")/8)"

    return f"""
m as (select median(gap) gap, median(rms) rms, cast(trunc(median(nst)) as bigint) nst from eq),
e as (select id, us, seq, mag, depth, coalesce(eq.gap, m.gap) gap, coalesce(eq.nst, m.nst) nst,
             coalesce(eq.rms, m.rms) rms, coalesce((us - lag(us) over (order by us, seq))/3600e6, 0) as h from eq, m),
l as (select id, {flat}, lead(mag) over w as next_mag, (lead(us) over w - us)/3600e6 as next_hours,
             lag(seq, 7) over w as first_seq, lead(us) over w as target_us from e window w as (order by us, seq))
select id, array_to_string([{names}, round({mean('mag')} + 1.2345678e-8, 6), round({spread('mag')} + 1.2345678e-8, 6), round({mean('depth')} + 1.2345678e-8, 6),
       round({mean('h')} + 1.2345678e-8, 6), round({spread('h')} + 1.2345678e-8, 6)]::decimal(18, 6)[], ',') as features, next_mag,
       next_hours, target_us from l where first_seq is not null and next_mag is not null"""


@register("lookback_matrix", _lookback_sql())
def lookback_matrix(spark, sf_dir):
    events = cleaning.median_fill(catalog(spark, sf_dir))
    out = features.lookback_matrix(events)
    numbers = F.transform("features", lambda x: F.round(x + F.lit(1.2345678e-8), 6).cast("decimal(18,6)").cast("string"))
    return out.select("id", F.array_join(numbers, ",").alias("features"), "next_mag", "next_hours",
                      F.unix_micros("target_time").alias("target_us"))


@register("sequence_windows", GRID + f""",
l as (select id, mag as target, """ + ", ".join(
    f"lag(mag, {i}) {W} as m{i}, lag(depth, {i}) {W} as d{i}" for i in range(1, 6)) + """ from grid)
select id, target, concat_ws(';', """ + ", ".join(
    f"concat_ws(',', m{i}::decimal(18,4), d{i}::decimal(18,4))" for i in range(5, 0, -1)) + """) as "window"
from l where m5 is not null""")
def sequence_windows(spark, sf_dir):
    grid = spatial.add_grid(catalog(spark, sf_dir))
    out = features.sequence_windows(grid, ["mag", "depth"], "mag")
    row = F.transform("window", lambda r: F.array_join(F.transform(r, lambda x: x.cast("decimal(18,4)").cast("string")), ","))
    return out.select("id", "target", F.array_join(row, ";").alias("window"))


@register("ordered_split", """
i as (select id, row_number() over (order by us, seq) - 1 as i, count(*) over () as n from eq)
select id, case when i < floor(n*8e-1) then 'train' when i < floor(n*8e-1) + floor(n*1e-1) then 'val' else 'test' end as split,
       case when i < least(greatest(floor(n*8e-1), 10), n - 5) then 'train' else 'test' end as two_way from i""")
def ordered_split(spark, sf_dir):
    three = features.ordered_split(catalog(spark, sf_dir))
    two = features.train_test_split(three.withColumnRenamed("split", "three"))
    return two.select("id", F.col("three").alias("split"), F.col("split").alias("two_way"))


@register("standardize", """
i as (select *, row_number() over (order by us, seq) - 1 as i, count(*) over () as n from eq),
s as (select avg(mag) mm, stddev_pop(mag) ms, avg(depth) dm, stddev_pop(depth) ds from i where i < floor(n*8e-1))
select id, round((mag - mm)/ms, 8) as mag, round((depth - dm)/ds, 8) as depth from i, s""")
def standardize(spark, sf_dir):
    split = features.ordered_split(catalog(spark, sf_dir))
    out = features.standardize(split, ["mag", "depth"], F.col("split") == "train")
    return out.select("id", F.round("mag_std", 8).alias("mag"), F.round("depth_std", 8).alias("depth"))


#: Columns of the feature table that are no input of the time model.
_BESIDE = [c for c in MAG_FEATURES if c not in TIME_FEATURES]
_TIME_COLUMNS = [c for c in [*TIME_FEATURES, *_BESIDE] if c not in ("coulomb_stress_proxy", "regional_b_value")]


@register("time_dataset", f"""{SEQUENCE_FEATURES.replace("select g.id, g.us", ", td as (select g.id, g.us")})
select id, us, {", ".join(_TIME_COLUMNS)}, log_stress, regional_b_value,
       (target_time_to_next <= 604800)::bigint as target_quake_in_7days
from td where target_time_to_next is not null""")
def time_dataset(spark, sf_dir):
    """All 21 columns and the label, and the rest of the feature table, so that every step of it shows."""
    data = features.time_dataset(_features(spark, sf_dir), _BESIDE)
    return data.select("id", F.unix_micros("time").alias("us"), *_TIME_COLUMNS,
                       r6(F.log10(F.lit(1.0) + F.col("coulomb_stress_proxy")), "log_stress"),
                       r6("regional_b_value", "regional_b_value"), "target_quake_in_7days")


@register("mag_dataset", HALF_GRID + f""",
t as (select *, lead(mag) {W} as target_next_mag from grid)
select id, region_code, mag, depth, coalesce(mmi, 0) as mmi, coalesce(felt, 0) as felt, target_next_mag
from t where target_next_mag is not null""")
def mag_dataset(spark, sf_dir):
    data = features.mag_dataset(_features(spark, sf_dir))
    return data.select("id", "region_code", "mag", "depth", "mmi", "felt", "target_next_mag")


@register("region_encode", GRID + """
select id, region_code, dense_rank() over (order by region_code) - 1 as region_encoded from grid""")
def region_encode(spark, sf_dir):
    grid = spatial.add_grid(catalog(spark, sf_dir))
    return features.region_encode(grid, features.region_codes(grid)).select("id", "region_code", "region_encoded")
