"""Intervals, trailing windows, calendars and targets along time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temblor.operators.ordered import Ordered, chunked, over_rows, row_index, trailing_blocks
from temblor.session import materialize

EPS = 1e-12


def _seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def since_prev(df: DataFrame | Ordered, keys: list[str] = ("region_code",),
               name: str = "time_since_last_event", rows_per_chunk: int | None = None) -> DataFrame:
    """Seconds since the event before in the group; 0 for the first."""
    def make(w):
        return {name: F.coalesce(_seconds_between(F.col("time"), F.lag("time").over(w)), F.lit(0.0))}
    return over_rows(df, list(keys), 1, 0, make, rows_per_chunk=rows_per_chunk)


def _gap(w, back: int) -> Column:
    """Gap between the rows ``back`` and ``back + 1`` before; 0 where there is none."""
    return F.coalesce(_seconds_between(F.lag("time", back).over(w), F.lag("time", back + 1).over(w)),
                      F.lit(0.0))


def interval_lags(df: DataFrame | Ordered, n: int = 5, keys: list[str] = ("region_code",),
                  rows_per_chunk: int | None = None) -> DataFrame:
    """Gaps of the 1 to ``n`` rows before, 0 where there is no such gap."""
    def make(w):
        return {f"interval_lag{i}": _gap(w, i) for i in range(1, n + 1)}
    return over_rows(df, list(keys), n + 1, 0, make, rows_per_chunk=rows_per_chunk)


def stress_proxy(df: DataFrame | Ordered, rows: int = 20, keys: list[str] = ("region_code",),
                 rows_per_chunk: int | None = None) -> DataFrame:
    """Sum of 10^(1.5 mag) over the ``rows`` events before."""
    def make(w):
        total = F.sum(F.pow(F.lit(10.0), F.lit(1.5) * F.col("mag"))).over(w.rowsBetween(-rows, -1))
        return {"coulomb_stress_proxy": F.coalesce(total, F.lit(0.0))}
    return over_rows(df, list(keys), rows, 0, make, rows_per_chunk=rows_per_chunk)


def next_targets(df: DataFrame | Ordered, keys: list[str] = ("region_code",), legacy_tail: bool = False,
                 mag_min: float = 5.0, rows_per_chunk: int | None = None) -> DataFrame:
    """Seconds to the next event, its magnitude and whether it is large.

    The last event of a group has no target; ``legacy_tail`` gives it time 0
    and its own magnitude.
    """
    def make(w):
        gap = _seconds_between(F.lead("time").over(w), F.col("time"))
        mag = F.lead("mag").over(w)
        if legacy_tail:
            gap, mag = F.coalesce(gap, F.lit(0.0)), F.coalesce(mag, F.col("mag"))
        return {"target_time_to_next": gap, "target_next_mag": mag,
                "target_next_mag_binary": (mag >= mag_min).cast("bigint")}
    return over_rows(df, list(keys), 0, 1, make, rows_per_chunk=rows_per_chunk)


def sequence_timing(df: DataFrame | Ordered, keys: list[str] = ("region_code",), lags: int = 5, rows: int = 20,
                    rows_per_chunk: int | None = None) -> DataFrame:
    """Interval, lag, stress and target columns from one shared window."""
    def make(w):
        stress = F.sum(F.pow(F.lit(10.0), F.lit(1.5) * F.col("mag"))).over(w.rowsBetween(-rows, -1))
        return {
            "time_since_last_event": _gap(w, 0),
            **{f"interval_lag{i}": _gap(w, i) for i in range(1, lags + 1)},
            "coulomb_stress_proxy": F.coalesce(stress, F.lit(0.0)),
            "target_time_to_next": _seconds_between(F.lead("time").over(w), F.col("time")),
            "target_next_mag": F.lead("mag").over(w),
        }
    return over_rows(df, list(keys), max(rows, lags + 1), 1, make, rows_per_chunk=rows_per_chunk)


def b_value(df: DataFrame | Ordered, rows: int = 10_000, mag_min: float = 3.0, keys: list[str] = (),
            rows_per_chunk: int | None = None) -> DataFrame:
    """Trailing b-value over the current and the ``rows`` events before.

    1 with fewer than 50 events, fewer than 20 of at least ``mag_min``, or no
    spread among those.
    """
    valid = F.col("mag") >= mag_min
    found = trailing_blocks(df, list(keys), rows + 1, {
        "_rows": ("sum", F.lit(1).cast("bigint")),
        "_n": ("sum", F.when(valid, F.lit(1).cast("bigint"))),
        "_sum": ("sum", F.when(valid, F.col("mag"))),
        "_min": ("min", F.when(valid, F.col("mag"))),
    }, rows_per_chunk=rows_per_chunk)
    return found.withColumn("b_value", _b_of_totals()).drop("_rows", "_n", "_sum", "_min")


def _b_of_totals() -> Column:
    """From ``_rows`` and from count, sum and least magnitude of those that count."""
    spread = F.col("_sum") / F.col("_n") - F.col("_min")
    enough = (F.col("_rows") >= 50) & (F.col("_n") >= 20) & (spread > EPS)
    return F.when(enough, F.lit(math.log10(math.e)) / spread).otherwise(F.lit(1.0))


def b_value_interpolated(df: DataFrame | Ordered, samples: int = 1000, rows: int = 10_000, mag_min: float = 3.0,
                         rows_per_chunk: int | None = None) -> DataFrame:
    """b-value at evenly spaced rows with straight lines between them.

    Rows are numbered once; each gives its magnitude to the at most ``samples``
    anchors whose trailing rows it is among, ``samples * rows`` shares in all
    that are added up before they move. The lines between anchors are broadcast.
    """
    data = chunked(df, rows_per_chunk=rows_per_chunk)
    placed = materialize(row_index(data, name="_pos"))
    total = placed.count()
    count = min(samples, total)
    if count < 2:
        valued = b_value(placed.drop("_pos"), rows, mag_min, rows_per_chunk=rows_per_chunk)
        return valued.withColumnRenamed("b_value", "regional_b_value")
    step = (total - 1) / (count - 1)

    def anchor(i):
        return F.floor(i * F.lit(step)).cast("bigint")

    near = F.floor(F.col("_pos") / F.lit(step)).cast("bigint")
    segment = F.when(anchor(near + 1) <= F.col("_pos"), near + 1).otherwise(near)
    segment = F.least(segment, F.lit(count - 2).cast("bigint"))
    numbered = placed.withColumn("_segment", segment)
    # The last anchor is the last row, also where rounding would miss it.
    spot = F.when(F.col("_i") == count - 1, F.lit(total - 1)).otherwise(anchor(F.col("_i")))
    around = F.sequence(near, F.least(F.floor((F.col("_pos") + F.lit(rows)) / F.lit(step)).cast("bigint") + 1,
                                      F.lit(count - 1).cast("bigint")))
    valid = F.col("mag") >= mag_min
    anchors = (placed.select("_pos", "mag", F.explode(around).alias("_i")).withColumn("_at", spot)
               .where((F.col("_pos") <= F.col("_at")) & (F.col("_at") <= F.col("_pos") + F.lit(rows)))
               .groupBy("_i", F.col("_at").alias("_pos")).agg(
                   F.count(F.lit(1)).alias("_rows"), F.count_if(valid).alias("_n"),
                   F.sum(F.when(valid, F.col("mag"))).alias("_sum"), F.min(F.when(valid, F.col("mag"))).alias("_min"))
               .select("_i", "_pos", _b_of_totals().alias("b_value")))
    anchors = materialize(anchors)
    left = anchors.select(F.col("_i").alias("_segment"), F.col("_pos").alias("_x0"), F.col("b_value").alias("_y0"))
    right = anchors.select((F.col("_i") - 1).alias("_segment"), F.col("_pos").alias("_x1"),
                           F.col("b_value").alias("_y1"))
    lines = F.broadcast(left.join(right, "_segment"))
    share = (F.col("_pos") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * share
    return (numbered.join(lines, "_segment").withColumn("regional_b_value", line)
            .drop("_segment", "_pos", "_x0", "_y0", "_x1", "_y1"))


# --- calendars -------------------------------------------------------------
# Daily and coarser series have one row per calendar step (36,525 a century),
# so their windows may run unpartitioned.

def _calendar(series: DataFrame, step: str, column: str) -> DataFrame:
    limits = series.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return limits.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(column))


def resample(df: DataFrame, unit: str = "month", fill: bool = False, time: str = "time") -> DataFrame:
    """Count and mean magnitude per calendar ``unit``; ``fill`` adds empty ones."""
    series = df.groupBy(F.trunc(F.to_date(time), unit).alias("period")).agg(
        F.count(F.lit(1)).alias("event_count"), F.avg("mag").alias("mag_mean"))
    if not fill:
        return series
    full = _calendar(series, {"month": "1 month", "year": "1 year"}[unit], "period")
    return (full.join(F.broadcast(series), "period", "left")
            .withColumn("event_count", F.coalesce("event_count", F.lit(0).cast("bigint"))))


def daily_agg(df: DataFrame, time: str = "time") -> DataFrame:
    """One row per calendar day between the first and the last event."""
    daily = df.groupBy(F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("event_count"), F.avg("mag").alias("mean_mag"),
        F.max("mag").alias("max_mag"), F.stddev_samp("mag").alias("std_mag"),
        F.avg("depth").alias("mean_depth"))
    full = _calendar(daily, "1 day", "day").join(F.broadcast(daily), "day", "left")
    return full.na.fill(0.0)


def _days(before: int, after: int) -> Window:
    return Window.orderBy("day").rowsBetween(-before, after)


def daily_features(daily: DataFrame) -> DataFrame:
    """Trailing counts, means and derived activity scores per day."""
    out = daily.withColumns({f"count_{n}d": F.sum("event_count").over(_days(n - 1, 0))
                             for n in (3, 7, 14, 30, 60)})
    out = out.withColumns({
        "mean_mag_7d": F.avg("mean_mag").over(_days(6, 0)),
        "max_mag_7d": F.max("max_mag").over(_days(6, 0)),
        "std_mag_7d": F.coalesce(F.stddev_samp("mean_mag").over(_days(6, 0)), F.lit(0.0)),
        "mean_depth_14d": F.avg("mean_depth").over(_days(13, 0)),
    })
    week, month = F.col("count_7d") / F.lit(7.0), F.col("count_30d") / F.lit(30.0)
    return out.withColumns({
        "rate_ratio_7_30": week / (month + F.lit(EPS)),
        "silence_score": month - week,
        "activity_change_3_14": F.col("count_3d") / F.lit(3.0) - F.col("count_14d") / F.lit(14.0),
        "energy_proxy_7d": F.col("mean_mag_7d") * F.col("mean_mag_7d") * (F.col("count_7d") + F.lit(1.0)),
    })


def future_label(daily: DataFrame, mag_min: float, days: int, name: str = "label") -> DataFrame:
    """1 when a day with at least ``mag_min`` is among the next ``days``."""
    major = (F.col("max_mag") >= mag_min).cast("bigint")
    ahead = F.max(major).over(Window.orderBy("day").rowsBetween(1, days))
    return daily.withColumn(name, F.coalesce(ahead, F.lit(0).cast("bigint")))


def quiet_periods(daily: DataFrame, mag_min: float = 6.5, quiet: int = 14, base: int = 45,
                  ratio: float = 0.7) -> DataFrame:
    """Event rate just before each major day against the time before that."""
    order = Window.orderBy("day")
    rated = daily.withColumns({
        "quiet_rate": F.avg("event_count").over(order.rowsBetween(-quiet, -1)),
        "baseline_rate": F.avg("event_count").over(order.rowsBetween(-quiet - base, -quiet - 1)),
        "_history": F.count(F.lit(1)).over(order.rowsBetween(-quiet - base, -1)),
    })
    major = rated.where((F.col("max_mag") >= mag_min) & (F.col("_history") == quiet + base))
    share = F.col("quiet_rate") / (F.col("baseline_rate") + F.lit(EPS))
    return major.select(
        F.col("day").alias("major_day"), F.col("max_mag").alias("major_mag"),
        F.date_sub("day", quiet).alias("quiet_start"), F.date_sub("day", 1).alias("quiet_end"),
        "quiet_rate", "baseline_rate", share.alias("quiet_to_baseline_ratio"),
        (share <= ratio).alias("is_quiet_period"))


def centered_mean(series: DataFrame, column: str = "event_count", order: str = "period",
                  window: int = 6) -> DataFrame:
    """Centred moving mean; null where the frame is cut off."""
    before, after = window // 2, window - window // 2 - 1
    frame = Window.orderBy(order).rowsBetween(-before, after)
    full = F.count(F.lit(1)).over(frame) == window
    return series.withColumn("centered_mean", F.when(full, F.avg(column).over(frame)))
