"""Windows along time and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.operators import features, spatial, temporal
from temblor.registered import register
from temblor.registered.spatial import GRID, r6
from temblor.sources.catalog import catalog, read_table


def _grid(spark, sf_dir):
    return spatial.add_grid(catalog(spark, sf_dir))


def shifted(c):
    """Round after a small fixed shift, away from exact halves."""
    return F.round(F.col(c) + F.lit(1.2345678e-8), 6).alias(c)


W = "over (partition by region_code order by us, seq)"
ALL = "over (order by us, seq)"


@register("since_prev", GRID + f"""
select id, coalesce((us - lag(us) {W})/1e6, 0) as region_s, coalesce((us - lag(us) {ALL})/1e6, 0) as catalog_s
from grid""")
def since_prev(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    region = temporal.since_prev(grid, name="region_s")
    return temporal.since_prev(region, [], "catalog_s").select("id", "region_s", "catalog_s")


@register("interval_lags", GRID + f""",
d as (select *, coalesce((us - lag(us) {W})/1e6, 0) as gap_s from grid)
select id, """ + ", ".join(f"lag(gap_s, {i}, 0) {W} as interval_lag{i}" for i in range(1, 6)) + " from d")
def interval_lags(spark, sf_dir):
    return temporal.interval_lags(_grid(spark, sf_dir)).select(
        "id", *[f"interval_lag{i}" for i in range(1, 6)])


@register("stress_proxy", GRID + """
select id, round(log10(1 + coalesce(sum(pow(10, 15e-1*mag)) over
  (partition by region_code order by us, seq rows between 20 preceding and 1 preceding), 0)), 6) as log_stress,
  round(log10(1 + coalesce(sum(pow(10, 15e-1*mag)) over
  (order by us, seq rows between 20 preceding and 1 preceding), 0)), 6) as log_stress_all
from grid""")
def stress_proxy(spark, sf_dir):
    grid = _grid(spark, sf_dir)

    def log(name):
        return r6(F.log10(F.lit(1.0) + F.col("coulomb_stress_proxy")), name)

    region = temporal.stress_proxy(grid).select("*", log("log_stress")).drop("coulomb_stress_proxy")
    return temporal.stress_proxy(region, keys=[]).select("id", "log_stress", log("log_stress_all"))


BVALUE = """
w as (select id, us, seq, row_number() over (order by us, seq) - 1 as pos,
        count(*) over f as rows_seen, count(case when mag >= 3 then 1 end) over f as n,
        avg(case when mag >= 3 then mag end) over f as mean_mag, min(case when mag >= 3 then mag end) over f as min_mag
      from eq window f as (order by us, seq rows between 10000 preceding and current row)),
b as (select *, case when rows_seen >= 50 and n >= 20 and mean_mag - min_mag > 1e-12
                     then log10(exp(1e0))/(mean_mag - min_mag) else 1 end as b_value from w)"""


@register("b_value", BVALUE + " select id, round(b_value, 6) as b_value from b")
def b_value(spark, sf_dir):
    return temporal.b_value(catalog(spark, sf_dir)).select("id", r6("b_value", "b_value"))


INTERPOLATED = BVALUE + """,
t as (select count(*) as total, least(count(*), 1000) as k from b),
i as (select range as i, case when range = k - 1 then total - 1
             else cast(floor(range*((total - 1)/(k - 1))) as bigint) end as pos
      from t, range(1000) where range < k),
s as (select b.pos, b_value from i join b using (pos)),
f as (select b.id, b.pos,
             last_value(s.pos ignore nulls) over (order by b.pos rows between unbounded preceding and current row) as x0,
             last_value(s.b_value ignore nulls) over (order by b.pos rows between unbounded preceding and current row) as y0,
             first_value(s.pos ignore nulls) over (order by b.pos rows between current row and unbounded following) as x1,
             first_value(s.b_value ignore nulls) over (order by b.pos rows between current row and unbounded following) as y1
      from b left join s using (pos)),
bi as (select id, round(case when x1 = x0 then y0 else y0 + (y1 - y0)*(pos - x0)/(x1 - x0) end, 6) as regional_b_value
       from f)"""


@register("b_value_interp", INTERPOLATED + " select * from bi")
def b_value_interp(spark, sf_dir):
    return temporal.b_value_interpolated(catalog(spark, sf_dir)).select(
        "id", r6("regional_b_value", "regional_b_value"))


@register("next_targets", GRID + f"""
select id, (lead(us) {W} - us)/1e6 as target_time_to_next, lead(mag) {W} as target_next_mag,
       (lead(mag) {W} >= 5)::bigint as target_next_mag_binary from grid""")
def next_targets(spark, sf_dir):
    return temporal.next_targets(_grid(spark, sf_dir)).select(
        "id", "target_time_to_next", "target_next_mag", "target_next_mag_binary")


@register("next_targets_legacy", f"""
select id, coalesce((lead(us) {ALL} - us)/1e6, 0) as target_time_to_next,
       coalesce(lead(mag) {ALL}, mag) as target_next_mag,
       (coalesce(lead(mag) {ALL}, mag) >= 5)::bigint as target_next_mag_binary from eq""")
def next_targets_legacy(spark, sf_dir):
    return temporal.next_targets(catalog(spark, sf_dir), [], legacy_tail=True).select(
        "id", "target_time_to_next", "target_next_mag", "target_next_mag_binary")


DAYS = """
d0 as (select cast("time" as date) as day, count(*)::double as n, avg(mag) as m, max(mag) as x,
              stddev_samp(mag) as s, avg(depth) as p from eq group by 1),
cal as (select cast(unnest(generate_series((select min(day) from d0)::timestamp, (select max(day) from d0)::timestamp,
               interval 1 day)) as date) as day),
d as (select day, coalesce(n, 0) as event_count, coalesce(m, 0) as mean_mag, coalesce(x, 0) as max_mag,
             coalesce(s, 0) as std_mag, coalesce(p, 0) as mean_depth from cal left join d0 using (day))"""


def _text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@register("daily_agg", DAYS + """
select strftime(day, '%Y-%m-%d') as day, event_count, round(mean_mag, 6) as mean_mag, max_mag,
       round(std_mag, 6) as std_mag, round(mean_depth, 6) as mean_depth from d""")
def daily_agg(spark, sf_dir):
    daily = temporal.daily_agg(catalog(spark, sf_dir))
    return _text(daily, "day").withColumns({c: F.round(c, 6) for c in ("mean_mag", "std_mag", "mean_depth")})


def _frame(n):
    return f"over (order by day rows between {n - 1} preceding and current row)"


DAILY_FEATURES = DAYS + """,
df as (select day, event_count, max_mag, """ + ", ".join(
    f"sum(event_count) {_frame(n)} as count_{n}d" for n in (3, 7, 14, 30, 60)) + f""",
  avg(mean_mag) {_frame(7)} as mean_mag_7d, max(max_mag) {_frame(7)} as max_mag_7d,
  coalesce(stddev_samp(mean_mag) {_frame(7)}, 0) as std_mag_7d, avg(mean_depth) {_frame(14)} as mean_depth_14d
  from d)"""


@register("daily_features", DAILY_FEATURES + """
select strftime(day, '%Y-%m-%d') as day, count_3d, count_7d, count_14d, count_30d, count_60d,
       round(mean_mag_7d + 1.2345678e-8, 6) as mean_mag_7d, max_mag_7d, round(std_mag_7d + 1.2345678e-8, 6) as std_mag_7d,
       round(mean_depth_14d + 1.2345678e-8, 6) as mean_depth_14d,
       round((count_7d/7)/(count_30d/30 + 1e-12) + 1.2345678e-8, 6) as rate_ratio_7_30,
       round(count_30d/30 - count_7d/7 + 1.2345678e-8, 6) as silence_score,
       round(count_3d/3 - count_14d/14 + 1.2345678e-8, 6) as activity_change_3_14,
       round(mean_mag_7d*mean_mag_7d*(count_7d + 1) + 1.2345678e-8, 6) as energy_proxy_7d from df""")
def daily_features(spark, sf_dir):
    out = _text(temporal.daily_features(temporal.daily_agg(catalog(spark, sf_dir))), "day")
    exact = ["count_3d", "count_7d", "count_14d", "count_30d", "count_60d", "max_mag_7d"]
    rounded = ["mean_mag_7d", "std_mag_7d", "mean_depth_14d", "rate_ratio_7_30", "silence_score",
               "activity_change_3_14", "energy_proxy_7d"]
    return out.select("day", *exact, *[shifted(c) for c in rounded])


@register("future_label", DAYS + """
select strftime(day, '%Y-%m-%d') as day, coalesce(max((max_mag >= 65e-1)::bigint) over
       (order by day rows between 1 following and 7 following), 0) as label from d""")
def future_label(spark, sf_dir):
    labeled = temporal.future_label(temporal.daily_agg(catalog(spark, sf_dir)), 6.5, 7)
    return _text(labeled, "day").select("day", "label")


@register("quiet_periods", DAYS + """,
q as (select day, max_mag, avg(event_count) over (order by day rows between 14 preceding and 1 preceding) as qr,
        avg(event_count) over (order by day rows between 59 preceding and 15 preceding) as br,
        row_number() over (order by day) - 1 as i from d)
select strftime(day, '%Y-%m-%d') as major_day, max_mag as major_mag,
       strftime(day - interval 14 day, '%Y-%m-%d') as quiet_start, strftime(day - interval 1 day, '%Y-%m-%d') as quiet_end,
       round(qr, 6) as quiet_rate, round(br, 6) as baseline_rate, round(qr/(br + 1e-12), 6) as quiet_to_baseline_ratio,
       qr/(br + 1e-12) <= 7e-1 as is_quiet_period
from q where max_mag >= 65e-1 and i >= 59""")
def quiet_periods(spark, sf_dir):
    out = _text(temporal.quiet_periods(temporal.daily_agg(catalog(spark, sf_dir))),
                "major_day", "quiet_start", "quiet_end")
    return out.withColumns({c: F.round(c, 6) for c in ("quiet_rate", "baseline_rate", "quiet_to_baseline_ratio")})


@register("monthly_series", """
m as (select date_trunc('month', "time")::date as period, count(*) as n, avg(mag) as mag_mean from eq group by 1)
select strftime(period, '%Y-%m-%d') as period, n as event_count, round(mag_mean, 6) as mag_mean from m""")
def monthly_series(spark, sf_dir):
    series = temporal.resample(catalog(spark, sf_dir), "month")
    return _text(series, "period").withColumn("mag_mean", F.round("mag_mean", 6))


def _filled(unit, where):
    return f"""
m as (select date_trunc('{unit}', "time")::date as period, count(*) as n from eq where {where} group by 1),
cal as (select cast(unnest(generate_series((select min(period) from m)::timestamp,
        (select max(period) from m)::timestamp, interval 1 {unit})) as date) as period)
select strftime(period, '%Y-%m-%d') as period, coalesce(n, 0) as event_count from cal left join m using (period)"""


@register("monthly_filled", _filled("month", "mag >= 5"))
def monthly_filled(spark, sf_dir):
    """Months without a large event show 0."""
    majors = catalog(spark, sf_dir).where(F.col("mag") >= 5)
    return _text(temporal.resample(majors, "month", fill=True), "period").select("period", "event_count")


@register("yearly_filled", _filled("year", "mag >= 65e-1"))
def yearly_filled(spark, sf_dir):
    majors = catalog(spark, sf_dir).where(F.col("mag") >= 6.5)
    return _text(temporal.resample(majors, "year", fill=True), "period").select("period", "event_count")


@register("centered_ma", """
m as (select date_trunc('month', "time")::date as period, count(*) as n from eq group by 1)
select strftime(period, '%Y-%m-%d') as period, case when count(*) over f = 6 then round(avg(n) over f, 6) end as centered_mean
from m window f as (order by period rows between 3 preceding and 2 following)""")
def centered_ma(spark, sf_dir):
    series = temporal.centered_mean(temporal.resample(catalog(spark, sf_dir), "month"))
    return _text(series, "period").select("period", r6("centered_mean", "centered_mean"))


@register("region_order", """
select concat('R', lpad(cast(floor((latitude + 90)/5e-1)::bigint as varchar), 3, '0'), '_',
              lpad(cast(floor((longitude + 180)/5e-1)::bigint as varchar), 3, '0')) as region_code, id,
       coalesce(mmi, 0) as mmi, coalesce(cdi, 0) as cdi, coalesce(felt, 0) as felt from eq""")
def region_order(spark, sf_dir):
    from temblor.functions.geo import grid_code
    from temblor.operators.cleaning import zero_fill

    coded = zero_fill(catalog(spark, sf_dir)).withColumn("region_code", grid_code(size=0.5, prefix="R"))
    return features.layout(coded).select("region_code", "id", "mmi", "cdi", "felt")


@register("union_sources", """
u as (select 'events' as source, "time", mag from eq
      union all select 'orders', o_orderdate, o_totalprice/1e5 from orders)
select source, year("time")::bigint as year, count(*) as n, round(avg(mag), 6) as mag_mean from u group by 1, 2""")
def union_sources(spark, sf_dir):
    """Orders stand in as a second event source of several years."""
    events = catalog(spark, sf_dir).select(F.lit("events").alias("source"), "time", "mag")
    orders = read_table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("source"), F.col("o_orderdate").cast("timestamp").alias("time"),
        (F.col("o_totalprice") / 1e5).alias("mag"))
    both = events.unionByName(orders)
    return (both.groupBy("source", F.year("time").cast("bigint").alias("year"))
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mag"), "mag_mean")))
