"""Feature tables, lookback windows, splits and scaling for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temblor.functions import bins, geo
from temblor.functions import scalars as fn
from temblor.operators import rangejoin, sequences, temporal
from temblor.operators.cleaning import median_fill, zero_fill
from temblor.operators.ordered import over_rows, row_index
from temblor.operators.quantiles import fixed, scalars
from temblor.operators.spatial import add_region_ids, attach, minmax_scale, seismicity_density
from temblor.schemas import MAG_FEATURES, TIME_FEATURES, require_columns
from temblor.session import materialize

WEEK_S = 7 * 86_400


def add_region_stats(df: DataFrame, size: float = 10.0) -> DataFrame:
    """Magnitude mean, spread and count of the region, and its yearly count."""
    placed = df.withColumns({
        "lat_grid": F.floor(F.col("latitude") / size) * F.lit(size),
        "lon_grid": F.floor(F.col("longitude") / size) * F.lit(size),
        "_year": F.year("time")})
    cell = ["lat_grid", "lon_grid"]
    stats = placed.groupBy(*cell).agg(
        F.avg("mag").alias("region_mag_mean"), F.stddev_samp("mag").alias("region_mag_std"),
        F.count(F.lit(1)).alias("region_event_count"))
    yearly = placed.groupBy(*cell, "_year").agg(F.count(F.lit(1)).alias("yearly_region_count"))
    cells = geo.cells_on_globe(size)
    return attach(attach(placed, stats, cell, cells), yearly, [*cell, "_year"], 200 * cells).drop("_year")


def event_columns(df: DataFrame) -> DataFrame:
    """Calendar, cyclic, log, flag and band columns."""
    month_sin, month_cos = fn.cyclic(F.month("time"), 12)
    hour_sin, hour_cos = fn.cyclic(F.hour("time"), 24)
    return df.withColumns({
        "year": F.year("time").cast("bigint"), "month": F.month("time").cast("bigint"),
        "hour": F.hour("time").cast("bigint"),
        "month_sin": month_sin, "month_cos": month_cos, "hour_sin": hour_sin, "hour_cos": hour_cos,
        **{f"{c}_log1p": fn.log1p_clipped(c) for c in ("depth", "sig", "rms", "nst", "dmin")},
        **{f"has_{c}": fn.flag(F.col(c).isNotNull()) for c in ("mmi", "cdi", "felt")},
        **{f"{c}_missing": fn.flag(F.col(c).isNull()) for c in ("gap", "rms", "nst", "dmin")},
        "depth_band": bins.depth_band(), "mag_band": bins.mag_band(),
    })


def engineered(df: DataFrame, size: float = 2.5) -> DataFrame:
    """Event columns and the region with its id."""
    return add_region_ids(event_columns(df), size)


def sequence_features(df: DataFrame, size: float = 0.5, b_rows: int = 10_000,
                      rows_per_chunk: int | None = None) -> DataFrame:
    """Sequence, stress, density, b-value, interval and target columns.

    Steps with a shuffle of all rows are checkpointed, so a lost executor
    repeats one step and not the whole table. Every row moves with all columns it
    has by then: give only those that are wanted. Steps that add many columns come
    late, and links and larger events are looked up in the events as they came.
    """
    base = materialize(zero_fill(df).withColumn("region_code", geo.grid_code(size=size, prefix="R")))
    links = materialize(rangejoin.nearest_earlier(base))
    since = rangejoin.since_last(base, keys=["region_code"], rows_per_chunk=rows_per_chunk)
    follows = rangejoin.larger_follows(since, rows_per_chunk=rows_per_chunk, events=base)
    linked = materialize(sequences.sequence_stats(follows, rows_per_chunk=rows_per_chunk, links=links))
    # What counts rows comes after the sequences, which repeat rows whose head has several.
    valued = temporal.b_value_interpolated(seismicity_density(linked), rows=b_rows, rows_per_chunk=rows_per_chunk)
    return temporal.sequence_timing(valued, ["region_code"], rows_per_chunk=rows_per_chunk)


def regional_features(df: DataFrame) -> DataFrame:
    """Calendar, zone, history, quality and region columns per event."""
    filled = median_fill(df, ["rms", "gap", "dmin", "nst", "sig", "depth"])
    past = rangejoin.history_in_box(filled)
    scaled = minmax_scale(add_region_stats(past), ["latitude", "longitude"])
    return scaled.withColumns({
        "mag_class": bins.mag_class(), "depth_class": bins.depth_class(),
        "tectonic_zone": geo.tectonic_zone(),
        "year": F.year("time"), "month": F.month("time"), "day": F.day("time"),
        "day_of_week": F.weekday("time"), "day_of_year": F.dayofyear("time"), "hour": F.hour("time"),
        "season": fn.season(F.month("time")), "time_of_day": fn.time_of_day(F.hour("time")),
        "days_since_2000": fn.days_since_2000("time"),
        "has_tsunami": fn.flag(F.col("tsunami") == 1), "data_quality": fn.data_quality(),
        "region": F.concat_ws("_", F.col("lat_grid"), F.col("lon_grid")),
    })


def time_dataset(features: DataFrame, beside: list[str] = ()) -> DataFrame:
    """21 columns and whether an event follows within seven days; ``beside`` names columns to keep with them."""
    require_columns(features, [*TIME_FEATURES, *beside, "target_time_to_next"])
    label = (F.col("target_time_to_next") <= WEEK_S).cast("bigint")
    return (features.where("target_time_to_next is not null")
            .select("id", "time", *TIME_FEATURES, *beside, label.alias("target_quake_in_7days")))


def mag_dataset(features: DataFrame) -> DataFrame:
    """26 columns and the magnitude of the next event."""
    require_columns(features, [*MAG_FEATURES, "target_next_mag"])
    return (features.where("target_next_mag is not null")
            .select("id", "time", *MAG_FEATURES, "target_next_mag"))


LOOKBACK_CHUNK = 20_000
LOOKBACK_COLUMNS = ["mag", "depth", "gap", "nst", "rms", "prev_hours"]


def lookback_matrix(df: DataFrame, n: int = 8, keys: list[str] = (),
                    rows_per_chunk: int | None = None) -> DataFrame:
    """``n`` lags of six signals, five statistics, and the next event.

    ``features`` holds the lags oldest first, signal by signal, then mean and
    spread of the magnitude, mean depth, mean and spread of the gaps.
    """
    signals = [c for c in LOOKBACK_COLUMNS if c != "prev_hours"]

    def make(w):
        row = F.struct(F.unix_micros("time").alias("us"), *[F.col(c).cast("double").alias(c) for c in signals])
        frame = w.rowsBetween(-(n - 1), 0)
        # One row more than the window: the first gap needs the row before.
        return {
            "_rows": F.collect_list(row).over(w.rowsBetween(-n, 0)),
            "_mag_mean": F.avg("mag").over(frame), "_mag_std": F.stddev_pop("mag").over(frame),
            "_depth_mean": F.avg("depth").over(frame),
            "next_mag": F.lead("mag").over(w), "target_time": F.lead("time").over(w),
        }

    # Wide rows: small chunks keep all cores busy.
    found = over_rows(df, list(keys), n, 1, make, rows_per_chunk=rows_per_chunk or LOOKBACK_CHUNK)
    found = found.where((F.size("_rows") >= n) & F.col("target_time").isNotNull())
    hour, skip = F.lit(3600e6), F.size("_rows") - F.lit(n)
    found = found.withColumn("_last", F.slice("_rows", skip + 1, F.lit(n)))
    gaps = F.transform("_last", lambda x, i: F.coalesce(
        (x["us"] - F.get("_rows", skip + i - 1)["us"]) / hour, F.lit(0.0)))
    # The gaps of a window add up to the time between its ends.
    mean = (F.unix_micros("time") - F.get("_rows", F.lit(0))["us"]) / (hour * F.lit(float(n)))
    found = found.withColumns({"_prev_hours": gaps, "_gap_mean": mean})
    middle = F.col("_gap_mean")
    squares = F.aggregate("_prev_hours", F.lit(0.0), lambda a, x: a + (x - middle) * (x - middle))
    stats = F.array("_mag_mean", "_mag_std", "_depth_mean", "_gap_mean", F.sqrt(squares / F.lit(float(n))))

    def signal(name):
        return F.transform("_last", lambda x: x[name])

    lags = [signal(c) for c in signals]
    return found.select(
        *keys, "id", "seq", F.concat(*lags, "_prev_hours", stats).alias("features"), "next_mag",
        ((F.unix_micros("target_time") - F.unix_micros("time")) / hour).alias("next_hours"), "target_time")


def region_codes(df: DataFrame, column: str = "region_code") -> DataFrame:
    """Dense numbers from 0 for region codes in alphabetical order.

    Keep this table to score new data with the numbers used in training.
    """
    return (df.select(column).distinct()
            .withColumn("region_encoded", (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint")))


def region_encode(df: DataFrame, codes: DataFrame, column: str = "region_code") -> DataFrame:
    """Add the number of the region; codes that a grid bounds are broadcast."""
    return attach(df, codes, [column], codes.count())


def sequence_windows(df: DataFrame, columns: list[str], target: str, n: int = 5,
                     keys: list[str] = ("region_code",), rows_per_chunk: int | None = None) -> DataFrame:
    """The ``n`` events before each event as rows of numbers, oldest first."""
    def make(w):
        row = F.array(*[F.col(c).cast("double") for c in columns])
        return {"window": F.collect_list(row).over(w.rowsBetween(-n, -1))}
    found = over_rows(df, list(keys), n, 0, make, rows_per_chunk=rows_per_chunk)
    return (found.where(F.size("window") == n)
            .select(*keys, "id", "seq", "time", "window", F.col(target).alias("target")))


def ordered_split(df: DataFrame, train: float = 0.8, val: float = 0.1,
                  order: tuple[str, ...] = ("time", "seq"), rows_per_chunk: int | None = None) -> DataFrame:
    """Add ``split``: the oldest rows train, the next validate, the rest test."""
    total = scalars(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    first, second = F.floor(total * F.lit(train)), F.floor(total * F.lit(val))
    return row_index(df, name="_i", order=order, rows_per_chunk=rows_per_chunk).withColumn(
        "split", F.when(F.col("_i") < first, "train").when(F.col("_i") < first + second, "val")
        .otherwise("test")).drop("_i")


def train_test_split(df: DataFrame, train: float = 0.8, order: tuple[str, ...] = ("time", "seq"),
                     rows_per_chunk: int | None = None) -> DataFrame:
    """Two-way split with at least 10 training and 5 test rows."""
    total = scalars(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    cut = F.least(F.greatest(F.floor(total * F.lit(train)), F.lit(10)), total - 5)
    return row_index(df, name="_i", order=order, rows_per_chunk=rows_per_chunk).withColumn(
        "split", F.when(F.col("_i") < cut, "train").otherwise("test")).drop("_i")


def standardize(df: DataFrame, columns: list[str], fit: Column | None = None, suffix: str = "_std",
                eps: float = 1e-12) -> DataFrame:
    """(x - mean) / spread, both taken from the rows that pass ``fit``."""
    source = df if fit is None else df.where(fit)
    stats = fixed(source.agg(*[F.avg(c).alias(f"{c}_m") for c in columns],
                               *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]))
    out = {}
    for c in columns:
        spread = F.when(stats[f"{c}_s"] < eps, F.lit(1.0)).otherwise(stats[f"{c}_s"])
        out[c + suffix] = (F.col(c) - stats[f"{c}_m"]) / spread
    return df.withColumns(out)


def layout(df: DataFrame, keys: tuple[str, ...] = ("region_code",), order: tuple[str, ...] = ("time", "seq"),
           partitions: int | None = None) -> DataFrame:
    """Rows in (region, time) order; range partitions split a busy region."""
    columns = [*keys, *order]
    spread = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return spread.sortWithinPartitions(*columns)
