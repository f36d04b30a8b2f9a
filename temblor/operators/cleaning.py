"""Cleaning of raw catalogs: types, texts, duplicates, validity, gaps, samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temblor.functions.bins import MAG_RANGE, bin_column
from temblor.functions.scalars import normalize_mag_type, normalize_text
from temblor.operators.ordered import row_index
from temblor.operators.quantiles import exact_quantiles, fixed, medians, scalars
from temblor.schemas import coerce, require_columns
from temblor.session import materialize

FLOAT_COLUMNS = ["latitude", "longitude", "depth", "mag", "gap", "rms"]
LONG_COLUMNS = ["sig", "nst"]


def coerce_types(df: DataFrame, time: str = "time") -> DataFrame:
    """Epoch milliseconds to timestamps, texts to numbers; bad values to null."""
    typed = coerce(df, {**{c: "double" for c in FLOAT_COLUMNS}, **{c: "double" for c in LONG_COLUMNS}})
    longs = {c: F.expr(f"try_cast(`{c}` as bigint)") for c in LONG_COLUMNS if c in df.columns}
    millis = F.expr(f"try_cast(`{time}` as bigint)")
    return typed.withColumns({**longs, time: F.timestamp_millis(millis)})


def add_seq(df: DataFrame) -> DataFrame:
    """A unique row number ``seq``, the tie-break of all time orders.

    It is stored once, since it would change if rows were computed again.
    """
    return materialize(df.withColumn("seq", F.monotonically_increasing_id()))


def load_clean(df: DataFrame, event_type: str | None = "earthquake") -> DataFrame:
    """Typed rows with all required values, of one event type, from text columns."""
    require_columns(df, ["id", "time", "latitude", "longitude", "depth", "mag", "type"])
    stray = [c for c in df.columns if c in ("Unnamed: 0", "_c0", "")]
    numbers = ["latitude", "longitude", "depth", "mag", "mmi", "cdi", "felt", "sig", "tsunami",
               "gap", "rms", "nst", "dmin"]
    typed = coerce(df.drop(*stray), {"time": "timestamp", **{c: "double" for c in numbers}})
    kept = typed.na.drop(subset=["id", "time", "latitude", "longitude", "depth", "mag"])
    if event_type:
        kept = kept.where(F.col("type") == event_type)
    if "tsunami" in kept.columns:
        kept = kept.withColumn("tsunami", zero_one("tsunami"))
    return kept


def zero_one(col: str) -> Column:
    """A number clipped to 0..1 as a whole number; null counts as 0."""
    value = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).cast("bigint")


def dedupe_keep_last(df: DataFrame, key: str = "id", order: str | list[str] = "seq") -> DataFrame:
    """The last row of every key in ingest order.

    The rank filter is applied on the map side first, so a key with very many
    copies sends one row per task.
    """
    orders = [order] if isinstance(order, str) else order
    window = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in orders])
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def filter_invalid(df: DataFrame, event_type: str = "earthquake") -> DataFrame:
    return df.where(
        F.col("id").isNotNull() & F.col("time").isNotNull()
        & F.col("latitude").between(-90.0, 90.0) & F.col("longitude").between(-180.0, 180.0)
        & (F.col("depth") >= 0) & (F.col("mag") >= 0)
        & (normalize_text("type") == event_type)
    )


def median_fill(df: DataFrame, columns: list[str] = ("gap", "rms", "nst", "sig"),
                whole: list[str] = ("nst", "sig")) -> DataFrame:
    """Fill gaps with the exact median; whole-number columns truncate it."""
    filled = fixed(medians(df, list(columns)))
    return df.withColumns({
        c: F.coalesce(F.col(c), filled[c].cast("bigint") if c in whole else filled[c])
        for c in columns
    })


def zero_fill(df: DataFrame, columns: list[str] = ("mmi", "cdi", "felt")) -> DataFrame:
    return df.na.fill(0, subset=list(columns))


def winsorize(df: DataFrame, column: str, share: float = 0.99, name: str | None = None) -> DataFrame:
    """Cut values above the given quantile down to it."""
    limit = scalars(exact_quantiles(df, [column], [share]))[column][0]
    capped = F.when(F.col(column).isNotNull(), F.least(F.col(column).cast("double"), limit))
    return df.withColumn(name or column, capped)


def clean(df: DataFrame, order: str = "seq") -> DataFrame:
    """All cleaning steps in order, giving the clean table.

    Of rows with one id the last in ``order`` is kept.

    Valid rows are kept once, so that documents are not parsed again for the
    medians.
    """
    typed = coerce_types(df)
    valid = materialize(filter_invalid(dedupe_keep_last(typed, order=order)))
    filled = median_fill(valid)
    return filled.withColumns({
        "magType": normalize_mag_type("magType"),
        "status": normalize_text("status"),
        "type": normalize_text("type"),
    })


def between_years(df: DataFrame, first: int, end: int, time: str = "time") -> DataFrame:
    """Events from the start of ``first`` up to, not including, year ``end``."""
    return df.where((F.col(time) >= F.lit(f"{first:04d}-01-01").cast("timestamp"))
                    & (F.col(time) < F.lit(f"{end:04d}-01-01").cast("timestamp")))


def mag_range_counts(df: DataFrame, low: float = 0.0, high: float = 11.0, width: float = 0.5,
                     last: float = 10.0) -> DataFrame:
    """Counts per half-unit magnitude range, cut to [low, high).

    One range holds everything from ``last`` on; empty ranges are absent.
    """
    steps = F.lit(int(last / width))
    step = F.least(F.floor(F.col("mag") / F.lit(width)).cast("bigint"), steps)
    return (df.where((F.col("mag") >= low) & (F.col("mag") < high)).groupBy(step.alias("step"))
            .agg(F.count(F.lit(1)).alias("event_count"))
            .select(F.greatest(F.col("step") * F.lit(width), F.lit(low)).alias("mag_from"),
                    F.least(F.when(F.col("step") == steps, F.lit(11.0))
                            .otherwise((F.col("step") + 1) * F.lit(width)),
                            F.lit(high)).alias("mag_to"), "event_count"))


def search(df: DataFrame, text: str = "", mag_class: str | None = None) -> DataFrame:
    """Rows whose place, year or magnitude holds ``text``, of one magnitude class."""
    out = df
    if text:
        needle = text.lower()
        number = F.regexp_replace(F.col("mag").cast("string"), r"\.0$", "")
        hits = [F.lower(F.col("place")), F.year("time").cast("string"), number]
        test = F.lit(False)
        for hit in hits:
            test = test | F.coalesce(hit.contains(needle), F.lit(False))
        out = out.where(test)
    if mag_class:
        out = out.where(bin_column("mag", *MAG_RANGE, right=False) == mag_class)
    return out


def sample_order(key: str = "id", seed: int = 42) -> Column:
    """A repeatable random order: hash of the key and the seed."""
    return F.md5(F.concat(F.col(key), F.lit(f"/{seed}")))


def seeded_sample(df: DataFrame, rows: int, key: str = "id", seed: int = 42) -> DataFrame:
    """``rows`` rows without replacement; the same seed gives the same rows.

    The rows with the smallest hashes are taken. A filter on the hash first
    leaves little more than that number to sort.
    """
    total = df.count()
    if total <= rows:
        return df
    order = sample_order(key, seed)
    share = rows / total
    margin = 6 * math.sqrt(share / total) + 10 / total
    place = F.conv(F.substring(order, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
    near = df.where(place < share + margin)
    if near.count() < rows:
        near = df
    return near.orderBy(order, key).limit(rows)


def sample_per_group(df: DataFrame, group: list[str], rows: int, key: str = "id",
                     seed: int = 42) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(sample_order(key, seed), key)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= rows).drop("_n")


def time_geo_points(df: DataFrame, per_month: int = 450, seed: int = 42) -> DataFrame:
    """At most ``per_month`` map points per month, weighted by magnitude."""
    month = F.date_format("time", "yyyy-MM")
    weight = F.least(F.greatest(F.col("mag") / F.lit(10.0), F.lit(0.1)), F.lit(1.0))
    points = df.withColumns({"month": month, "weight": weight})
    return sample_per_group(points, ["month"], per_month, seed=seed)


def recent_fraction(df: DataFrame, share: float, rows_per_chunk: int | None = None) -> DataFrame:
    """The newest ``share`` of the rows, rounded down."""
    total = scalars(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    keep = F.floor(total * F.lit(share))
    return (row_index(df, rows_per_chunk=rows_per_chunk).where(F.col("idx") >= total - keep)
            .drop("idx"))


def missing_flag(columns: list[str]) -> Column:
    """True where any of the display columns is null."""
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNull()
    return test
