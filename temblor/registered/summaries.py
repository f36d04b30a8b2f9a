"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.functions.scalars import normalize_mag_type
from temblor.operators import cleaning, summary, temporal
from temblor.registered import register
from temblor.registered.spatial import GRID, r6
from temblor.registered.temporal import DAYS
from temblor.sources.catalog import catalog, raw_catalog

NUM = ["mag", "depth", "sig", "gap", "rms", "nst", "dmin"]


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _shifted(df, *columns):
    """Round after a small fixed shift: means of decimals often lie exactly
    between two roundings, where engines differ."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(1.2345678e-8), 6) for c in columns})


def _iso(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@register("dataset_overview", GRID + """
select (select count(*) from ev) as input_rows, count(*) as analysis_rows,
       round(count(*)/(select count(*) from ev), 6) as analysis_share,
       strftime(min("time"), '%Y-%m-%dT%H:%M:%S.%f') as time_min,
       strftime(max("time"), '%Y-%m-%dT%H:%M:%S.%f') as time_max,
       count(distinct region_code) as distinct_regions from grid""")
def dataset_overview(spark, sf_dir):
    out = summary.dataset_overview(raw_catalog(spark, sf_dir), catalog(spark, sf_dir))
    return out.withColumns({"time_min": _iso("time_min"), "time_max": _iso("time_max"),
                            "analysis_share": F.round("analysis_share", 6)})


@register("numeric_summary", "a as (select 1)\n" + " union all ".join(f"""
select '{c}' as feature, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
       min({c})::double as min, round(quantile_cont({c}, 0.1), 6) as p10, round(quantile_cont({c}, 0.25), 6) as p25,
       round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75,
       round(quantile_cont({c}, 0.9), 6) as p90, max({c})::double as max,
       round(1 - count({c})/count(*), 6) as missing_ratio from eq""" for c in NUM))
def numeric_summary(spark, sf_dir):
    return _rounded(summary.numeric_summary(catalog(spark, sf_dir)), "mean", "std", "p10", "p25", "p50", "p75",
                    "p90", "missing_ratio")


_ALL = {"id": 0, "seq": 1, "latitude": 1, "longitude": 1, "depth": 1, "mag": 1, "magType": 0, "sig": 1, "gap": 1,
        "rms": 1, "nst": 1, "dmin": 1, "tsunami": 1, "mmi": 1, "cdi": 1, "felt": 1, "status": 0, "type": 0,
        "net": 0, "place": 0}


@register("feature_overview", "a as (select 1)\n" + " union all ".join(f"""
select '{c}' as feature, round(1 - count("{c}")/count(*), 6) as missing_ratio,
       {f'round(avg("{c}"), 6)' if n else 'null::double'} as mean,
       {f'round(stddev_samp("{c}"), 6)' if n else 'null::double'} as std from eq""" for c, n in _ALL.items()))
def feature_overview(spark, sf_dir):
    return _rounded(summary.feature_overview(catalog(spark, sf_dir)), "missing_ratio", "mean", "std")


@register("yearly_summary", """
select year("time")::bigint as year, count(*) as event_count, round(avg(mag), 6) as mag_mean, max(mag) as mag_max,
       round(avg(depth), 6) as depth_mean from eq group by 1""")
def yearly_summary(spark, sf_dir):
    return _rounded(summary.yearly_summary(catalog(spark, sf_dir)), "mag_mean", "depth_mean")


@register("monthly_summary", """
select year("time")::bigint as year, month("time")::bigint as month, count(*) as event_count,
       round(avg(mag), 6) as mag_mean from eq group by 1, 2""")
def monthly_summary(spark, sf_dir):
    return _rounded(summary.monthly_summary(catalog(spark, sf_dir)), "mag_mean")


@register("month_pivot", "select year(\"time\")::bigint as year, " + ", ".join(
    f"count(*) filter (month(\"time\") = {m}) as m{m}" for m in range(1, 13)) + " from eq group by 1")
def month_pivot(spark, sf_dir):
    return summary.month_pivot(summary.monthly_summary(catalog(spark, sf_dir)))


@register("region_share", GRID + """
select region_code, region_lat_center, region_lon_center, count(*) as event_count, round(avg(mag), 6) as mag_mean,
       max(mag) as mag_max, round(avg(depth), 6) as depth_mean, round(avg(sig), 6) as sig_mean,
       round(avg(least(greatest(coalesce(tsunami, 0), 0), 1)), 6) as tsunami_rate,
       round(count(*)/sum(count(*)) over (), 6) as event_share
from grid group by 1, 2, 3""")
def region_share(spark, sf_dir):
    events = catalog(spark, sf_dir).withColumn("tsunami", cleaning.zero_one("tsunami"))
    return _rounded(summary.region_share(events).drop("lat_cell", "lon_cell"), "mag_mean", "depth_mean", "sig_mean", "tsunami_rate", "event_share")


@register("region_profile", GRID + """,
base as (select region_code, lat_cell, lon_cell, count(*) as event_count, avg(mag) as mag_mean,
  quantile_cont(mag, 0.9) as mag_p90, max(mag) as mag_max, avg(depth) as depth_mean,
  quantile_cont(depth, 0.9) as depth_p90, avg(sig) as sig_mean, count(distinct year("time")) as active_years,
  strftime(min("time"), '%Y-%m-%dT%H:%M:%S.%f') as first_time, strftime(max("time"), '%Y-%m-%dT%H:%M:%S.%f') as last_time,
  avg((depth <= 70)::int) as shallow_ratio, avg((depth > 70 and depth <= 300)::int) as intermediate_ratio,
  avg((depth > 300)::int) as deep_ratio, avg((mag >= 5)::int) as major_quake_ratio,
  avg((felt is not null)::int) as has_felt_ratio, avg((mmi is not null)::int) as has_mmi_ratio
  from grid group by 1, 2, 3),
lab as (select region_code, net, count(*) as n from grid group by 1, 2),
dom as (select region_code, arg_min(net, (-n, net)) as dominant_net, max(n) as dn, count(*) as net_count from lab group by 1)
select region_code, lat_cell, lon_cell, event_count, round(mag_mean + 1.2345678e-8, 6) as mag_mean, round(mag_p90 + 1.2345678e-8, 6) as mag_p90, mag_max,
  round(depth_mean + 1.2345678e-8, 6) as depth_mean, round(depth_p90 + 1.2345678e-8, 6) as depth_p90, round(sig_mean + 1.2345678e-8, 6) as sig_mean, active_years,
  first_time, last_time, round(shallow_ratio + 1.2345678e-8, 6) as shallow_ratio, round(intermediate_ratio + 1.2345678e-8, 6) as intermediate_ratio,
  round(deep_ratio + 1.2345678e-8, 6) as deep_ratio, round(major_quake_ratio + 1.2345678e-8, 6) as major_quake_ratio,
  round(has_felt_ratio + 1.2345678e-8, 6) as has_felt_ratio, round(has_mmi_ratio + 1.2345678e-8, 6) as has_mmi_ratio, dominant_net, net_count,
  round(dn/event_count + 1.2345678e-8, 6) as dominant_net_share, round(ln(1 + event_count) + 1.2345678e-8, 6) as event_count_log1p,
  row_number() over (order by event_count desc, region_code) as region_rank_by_count
from base join dom using (region_code)""")
def region_profile(spark, sf_dir):
    """The network stands in for the event cluster as the label of an event."""
    out = summary.region_profile(catalog(spark, sf_dir), "net")
    out = out.drop("tsunami_rate", "region_lat_center", "region_lon_center")
    return _shifted(out.withColumns({"first_time": _iso("first_time"), "last_time": _iso("last_time")}),
                    "mag_mean", "mag_p90", "depth_mean", "depth_p90", "sig_mean", "shallow_ratio",
                    "intermediate_ratio", "deep_ratio", "major_quake_ratio", "has_felt_ratio", "has_mmi_ratio",
                    "dominant_net_share", "event_count_log1p")


def _stats_sql(used):
    return f"""count(*) as total_events, coalesce(round(avg({used('mag')}), 1), 0) as avg_mag,
       coalesce(round(max({used('mag')}), 1), 0) as max_mag, coalesce(round(min({used('mag')}), 1), 0) as min_mag,
       coalesce(round(avg({used('depth')}), 1), 0) as avg_depth,
       count(*) filter (mag < 3) as "mag_0-3", count(*) filter (mag >= 3 and mag < 5) as "mag_3-5",
       count(*) filter (mag >= 5 and mag < 7) as "mag_5-7", count(*) filter (mag >= 7) as "mag_7+",
       count(*) filter (depth < 50) as "depth_0-50km", count(*) filter (depth >= 50 and depth < 100) as "depth_50-100km",
       count(*) filter (depth >= 100 and depth < 300) as "depth_100-300km", count(*) filter (depth >= 300) as "depth_300km+",
       concat_ws(',', """ + ", ".join(f"count(*) filter (month(\"time\") = {m})" for m in range(1, 13)) + ") as month_counts"


def _joined(df):
    return df.withColumn("month_counts", F.array_join(F.col("month_counts").cast("array<string>"), ","))


@register("year_stats", "select year(\"time\")::bigint as year, "
          + _stats_sql(lambda c: f"case when {c} > 0 then {c} end") + " from ev group by 1")
def year_stats(spark, sf_dir):
    return _joined(summary.year_stats(raw_catalog(spark, sf_dir)))


@register("all_time_stats", "select " + _stats_sql(lambda c: c) + " from ev")
def all_time_stats(spark, sf_dir):
    return _joined(summary.year_stats(raw_catalog(spark, sf_dir), positive_only=False, by_year=False))


@register("top_places", "select place, count(*) as n from ev group by 1 order by n desc, place nulls first limit 10")
def top_places(spark, sf_dir):
    return summary.top_k(raw_catalog(spark, sf_dir), "place", 10)


@register("top_strong", "select id, mag, place from eq order by mag desc, us, seq limit 10")
def top_strong(spark, sf_dir):
    return summary.top_events(catalog(spark, sf_dir), 10).select("id", "mag", "place")


def _corr_sql(source, columns=NUM):
    cells = [f"select '{a}' as a, '{b}' as b, " + ("1e0 as r" if a == b else f"corr({a}, {b}) as r from {source}")
             for a in columns for b in columns]
    return " union all ".join(cells)


MEDIAN_FILLED = """
m as (select """ + ", ".join(f"median({c}) as {c}" for c in NUM) + """ from eq),
f as (select """ + ", ".join(f"coalesce(eq.{c}, m.{c})::double as {c}" for c in NUM) + """ from eq, m)"""


@register("corr_pearson", MEDIAN_FILLED + f"""
select a, b, round(r, 6) as r from ({_corr_sql('f')})""")
def corr_pearson(spark, sf_dir):
    return _rounded(summary.corr_matrix(catalog(spark, sf_dir), fill="median"), "r")


RANKED = """
s as (select mag, depth, rms, gap from eq where mag is not null and depth is not null and rms is not null and gap is not null),
k as (select """ + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2e0 as {c}"
    for c in ("mag", "depth", "rms", "gap")) + " from s)"


@register("corr_spearman", RANKED + f"""
select a, b, round(r, 6) as r from ({_corr_sql('k', ['mag', 'depth', 'rms', 'gap'])})""")
def corr_spearman(spark, sf_dir):
    return _rounded(summary.corr_matrix(catalog(spark, sf_dir), ["mag", "depth", "rms", "gap"], "spearman"), "r")


@register("top_correlations", MEDIAN_FILLED + f"""
select a, b, round(r, 6) as r from ({_corr_sql('f')}) where a < b order by abs(r) desc, a, b limit 5""")
def top_correlations(spark, sf_dir):
    return _rounded(summary.top_correlations(summary.corr_matrix(catalog(spark, sf_dir), fill="median")), "r")


@register("linear_fit", """
select round(regr_slope(mag, depth), 9) as slope, round(regr_intercept(mag, depth), 6) as intercept from eq""")
def linear_fit(spark, sf_dir):
    fit = summary.linear_fit(catalog(spark, sf_dir), "depth", "mag")
    return fit.select(F.round("slope", 9).alias("slope"), r6("intercept", "intercept"))


@register("gutenberg_richter", """
l as (select min(mag) as lo, max(mag) as hi from eq),
e as (select lo, cast(ceil((hi + 5e-1 - lo)/5e-1) as bigint) as edges from l),
c as (select least(cast(floor((mag - lo)/5e-1) as bigint), edges - 2) as i, lo, count(*) as n
      from eq, e where mag <= lo + (edges - 1)*5e-1 group by 1, 2)
select round(regr_slope(ln(n), lo + (i + 5e-1)*5e-1), 6) as slope,
       round(regr_intercept(ln(n), lo + (i + 5e-1)*5e-1), 6) as intercept,
       round(corr(ln(n), lo + (i + 5e-1)*5e-1), 6) as r, count(*) as bins from c""")
def gutenberg_richter(spark, sf_dir):
    return _rounded(summary.frequency_magnitude(catalog(spark, sf_dir)), "slope", "intercept", "r")


@register("exceedance", """
select mag, cast(sum(count(*)) over (order by mag desc) as bigint) as at_least from eq group by mag""")
def exceedance(spark, sf_dir):
    return summary.exceedance(catalog(spark, sf_dir))


@register("mag_stats", """
select min(mag) as mag_min, max(mag) as mag_max, round(avg(mag), 6) as mag_mean, round(median(mag), 6) as mag_median,
       round(stddev_samp(mag), 6) as mag_std, count(*) filter (mag >= 4) as at_least_4,
       count(*) filter (mag >= 5) as at_least_5, count(*) filter (mag >= 6) as at_least_6 from eq""")
def mag_stats(spark, sf_dir):
    return _rounded(summary.mag_stats(catalog(spark, sf_dir)), "mag_mean", "mag_median", "mag_std")


@register("histogram", """
l as (select min(depth) as lo, max(depth) as hi from eq),
b as (select least(cast(floor((depth - lo)/((hi - lo)/50e0)) as bigint), 49) as bucket from eq, l)
select bucket, count(*) as n, round(lo + bucket*((hi - lo)/50e0), 6) as low,
       round(lo + (bucket + 1)*((hi - lo)/50e0), 6) as high from b, l group by bucket, lo, hi""")
def histogram(spark, sf_dir):
    return _rounded(summary.histogram(catalog(spark, sf_dir), "depth", 50), "low", "high")


@register("group_mode", GRID + """,
c as (select region_code, "magType" as v, count(*) as n from grid group by 1, 2)
select region_code, v as "top_magType", n as mode_count from
  (select *, row_number() over (partition by region_code order by n desc, v nulls last) as r from c) where r = 1""")
def group_mode(spark, sf_dir):
    from temblor.operators.spatial import add_grid

    return summary.group_mode(add_grid(catalog(spark, sf_dir)), ["region_code"], "magType")


@register("category_share", """
select case when "magType" is null then 'unknown' when "magType" = ' ML ' then 'ml' when "magType" = 'mb_lg' then 'mblg'
            when "magType" = 'ml(texnet)' then 'ml' else "magType" end as mag_type, count(*) as n,
       round(100e0*count(*)/(select count(*) from eq), 6) as percent from eq group by 1""")
def category_share(spark, sf_dir):
    typed = catalog(spark, sf_dir).withColumn("mag_type", normalize_mag_type("magType"))
    return _rounded(summary.category_share(typed, "mag_type"), "percent")


@register("concentration", GRID + """,
c as (select region_code, count(*) as n from grid group by 1),
r as (select n, row_number() over (order by n desc, region_code) as k from c)
select ks.k::bigint as k, round(sum(n) filter (r.k <= ks.k)/sum(n), 6) as share
from r, (values (5), (10), (20)) ks(k) group by 1""")
def concentration(spark, sf_dir):
    return _rounded(summary.concentration(catalog(spark, sf_dir), (5, 10, 20)), "share")


@register("peak_periods", """
m as (select date_trunc('month', "time")::date as period, count(*) as n from eq group by 1)
select (select strftime(period, '%Y-%m-%d') from m order by n desc, period limit 1) as peak_period, max(n) as peak_count,
       (select strftime(period, '%Y-%m-%d') from m order by n, period limit 1) as low_period, min(n) as low_count,
       round(avg(n), 6) as mean_count from m""")
def peak_periods(spark, sf_dir):
    found = summary.peak_periods(temporal.resample(catalog(spark, sf_dir), "month"), "period")
    return found.withColumns({"peak_period": F.date_format("peak_period", "yyyy-MM-dd"),
                              "low_period": F.date_format("low_period", "yyyy-MM-dd"),
                              "mean_count": F.round("mean_count", 6)})


@register("class_balance", DAYS + """,
y as (select coalesce(max((max_mag >= 65e-1)::bigint) over (order by day rows between 1 following and 7 following), 0)
      as label from d)
select count(*) as total, count(*) filter (label = 1) as positive, count(*) filter (label = 0) as negative,
       round(avg(label), 6) as positive_ratio, round(1 - avg(label), 6) as negative_ratio,
       round(count(*) filter (label = 0)/nullif(count(*) filter (label = 1), 0), 6) as positive_weight from y""")
def class_balance(spark, sf_dir):
    labels = temporal.future_label(temporal.daily_agg(catalog(spark, sf_dir)), 6.5, 7)
    return _rounded(summary.class_balance(labels), "positive_ratio", "negative_ratio", "positive_weight")
