"""Summaries: overviews, per-period and per-region tables, correlations, curves."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temblor.functions import bins, geo
from temblor.operators.ordered import running
from temblor.operators.quantiles import average_rank, exact_quantiles, fixed, medians, scalars, value_counts
from temblor.operators.spatial import add_cells, describe_cells
from temblor.session import materialize

NUMERIC = ["mag", "depth", "sig", "gap", "rms", "nst", "dmin"]


def _n(name: str = "event_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def _stack(columns: list[str], parts: dict[str, str]) -> Column:
    """Turn one wide row into one struct per column; ``parts`` maps a field to
    the pattern of its wide column name."""
    return F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 *[F.col(pattern.format(c)).alias(field) for field, pattern in parts.items()])
        for c in columns])).alias("row")


def dataset_overview(raw: DataFrame, analysis: DataFrame, size: float = 2.5) -> DataFrame:
    """Row counts, share, time range and number of regions, in one row."""
    before = scalars(raw.agg(F.count(F.lit(1)).alias("n")))["n"]
    cell = F.when(geo.on_globe(), F.struct(geo.lat_cell(size=size), geo.lon_cell(size=size)))
    found = analysis.agg(_n("analysis_rows"), F.min("time").alias("time_min"), F.max("time").alias("time_max"),
                         F.count_distinct(cell).alias("distinct_regions"))
    return found.withColumns({"input_rows": before,
                              "analysis_share": F.col("analysis_rows") / F.greatest(before, F.lit(1))})


def numeric_summary(df: DataFrame, columns: list[str] = NUMERIC,
                    probs: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Count, mean, spread, limits, quantiles and missing share per column."""
    aggs = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in aggs.items()],
                  _n("_rows"))
    long = wide.select("_rows", _stack(columns, {n: "{}__" + n for n in aggs})).select("_rows", "row.*")
    shares = exact_quantiles(df, columns, list(probs)).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("q")) for c in columns])).alias("r"))
    names = [f"p{round(p * 100)}" for p in probs]
    quantiles = shares.select("r.feature", *[F.col("r.q")[i].alias(n) for i, n in enumerate(names)])
    return (long.join(F.broadcast(quantiles), "feature")
            .withColumn("missing_ratio", F.lit(1.0) - F.col("count") / F.col("_rows")).drop("_rows"))


def feature_overview(df: DataFrame, skip: tuple[str, ...] = ("time",)) -> DataFrame:
    """Missing share of every column; mean and spread of the numeric ones."""
    columns = [(c, t) for c, t in df.dtypes if c not in skip]
    numeric = {c for c, t in columns if t in ("double", "bigint", "int", "float")}
    nothing = F.lit(None).cast("double")
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__missing_ratio") for c, _ in columns],
                  *[(F.avg(c) if c in numeric else F.max(nothing)).alias(f"{c}__mean") for c, _ in columns],
                  *[(F.stddev_samp(c) if c in numeric else F.max(nothing)).alias(f"{c}__std") for c, _ in columns])
    parts = {n: "{}__" + n for n in ("missing_ratio", "mean", "std")}
    return wide.select(_stack([c for c, _ in columns], parts)).select("row.*")


def yearly_summary(df: DataFrame, time: str = "time") -> DataFrame:
    return df.groupBy(F.year(time).cast("bigint").alias("year")).agg(
        _n(), F.avg("mag").alias("mag_mean"), F.max("mag").alias("mag_max"), F.avg("depth").alias("depth_mean"))


def monthly_summary(df: DataFrame, time: str = "time") -> DataFrame:
    return df.groupBy(F.year(time).cast("bigint").alias("year"), F.month(time).cast("bigint").alias("month")).agg(
        _n(), F.avg("mag").alias("mag_mean"))


def month_pivot(monthly: DataFrame) -> DataFrame:
    """Years as rows, months 1 to 12 as columns ``m1`` ... ``m12``."""
    wide = monthly.groupBy("year").pivot("month", list(range(1, 13))).agg(F.sum("event_count"))
    return wide.select("year", *[F.coalesce(F.col(str(m)), F.lit(0).cast("bigint")).alias(f"m{m}")
                                 for m in range(1, 13)])


def region_share(df: DataFrame, size: float = 2.5) -> DataFrame:
    """Summary per region with its share of all events."""
    regions = add_cells(df, size).groupBy("lat_cell", "lon_cell").agg(
        _n(), F.avg("mag").alias("mag_mean"), F.max("mag").alias("mag_max"), F.avg("depth").alias("depth_mean"),
        F.avg("sig").alias("sig_mean"), F.avg("tsunami").alias("tsunami_rate"))
    # One row per region: at most cells_on_globe(size) rows meet here.
    share = F.col("event_count") / F.sum("event_count").over(Window.partitionBy())
    return describe_cells(regions, size).withColumn("event_share", share)


def group_mode(df: DataFrame, group: list[str], column: str, name: str | None = None) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value, nulls count."""
    counts = df.groupBy(*group, column).agg(_n("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("less"), F.col(column).isNull().alias("gone"), F.col(column).alias("value")))
    return counts.groupBy(*group).agg(best.alias("_best")).select(
        *group, F.col("_best.value").alias(name or f"top_{column}"), (-F.col("_best.less")).alias("mode_count"))


def region_profile(df: DataFrame, label: str | None = None, min_major: float = 5.0,
                   size: float = 2.5) -> DataFrame:
    """Per region: counts, quantiles, ratios, active years, dominant label, rank."""
    key = ["lat_cell", "lon_cell"]
    placed = add_cells(df, size).withColumn("_band", bins.depth_band())

    def ratio(test: Column) -> Column:
        return F.avg(test.cast("double"))

    main = placed.groupBy(*key).agg(
        _n(), F.avg("mag").alias("mag_mean"), F.max("mag").alias("mag_max"), F.avg("depth").alias("depth_mean"),
        F.avg("sig").alias("sig_mean"), F.avg("tsunami").alias("tsunami_rate"),
        F.count_distinct(F.year("time")).alias("active_years"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        *[ratio(F.col("_band") == b).alias(f"{b}_ratio") for b in ("shallow", "intermediate", "deep")],
        ratio(F.col("mag") >= min_major).alias("major_quake_ratio"),
        ratio(F.col("felt").isNotNull()).alias("has_felt_ratio"),
        ratio(F.col("mmi").isNotNull()).alias("has_mmi_ratio"))
    high = exact_quantiles(placed, ["mag", "depth"], [0.9], key)
    out = main.join(high.select(*key, F.col("mag")[0].alias("mag_p90"), F.col("depth")[0].alias("depth_p90")), key)
    if label:
        top = group_mode(placed, key, label, f"dominant_{label}")
        kinds = placed.groupBy(*key, label).agg(_n("_n")).groupBy(*key).agg(F.count(label).alias(f"{label}_count"))
        out = (out.join(top, key, "left").join(kinds, key, "left")
               .withColumn(f"dominant_{label}_share", F.col("mode_count") / F.col("event_count")).drop("mode_count"))
    rank = F.row_number().over(Window.orderBy(F.col("event_count").desc(), "region_code")).cast("bigint")
    return describe_cells(out, size).withColumns({"event_count_log1p": F.log1p(F.col("event_count").cast("double")),
                            "region_rank_by_count": rank})


def year_stats(df: DataFrame, positive_only: bool = True, by_year: bool = True) -> DataFrame:
    """Rounded means and limits, range counts and month counts.

    ``positive_only`` leaves values of 0 and below out of means and limits.
    """
    def used(c):
        return F.when(F.col(c) > 0, F.col(c)) if positive_only else F.col(c)

    def one(value):
        return F.coalesce(F.round(value, 1), F.lit(0.0))

    mag_class = bins.bin_column("mag", *bins.MAG_RANGE, right=False)
    depth_class = bins.bin_column("depth", *bins.DEPTH_RANGE, right=False)
    keys = [F.year("time").cast("bigint").alias("year")] if by_year else []
    return df.groupBy(*keys).agg(
        _n("total_events"), one(F.avg(used("mag"))).alias("avg_mag"), one(F.max(used("mag"))).alias("max_mag"),
        one(F.min(used("mag"))).alias("min_mag"), one(F.avg(used("depth"))).alias("avg_depth"),
        *[F.count_if(mag_class == label).alias(f"mag_{label}") for label in bins.MAG_RANGE[1]],
        *[F.count_if(depth_class == label).alias(f"depth_{label}") for label in bins.DEPTH_RANGE[1]],
        F.array(*[F.count_if(F.month("time") == m) for m in range(1, 13)]).alias("month_counts"))


def top_k(df: DataFrame, column: str, k: int, where: Column | None = None) -> DataFrame:
    """Most frequent values; ties in value order."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(column).agg(_n("n")).orderBy(F.col("n").desc(), column).limit(k)


def top_events(df: DataFrame, k: int = 10) -> DataFrame:
    return df.orderBy(F.col("mag").desc(), "time", "seq").limit(k)


def corr_matrix(df: DataFrame, columns: list[str] = NUMERIC, method: str = "pearson", fill: str = "drop",
                rows_per_chunk: int | None = None) -> DataFrame:
    """Correlations as (a, b, r) for every ordered pair of columns.

    ``fill`` replaces gaps by the median or drops rows with any gap.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if fill == "median":
        middle = fixed(medians(numbers, columns))
        numbers = numbers.withColumns({c: F.coalesce(F.col(c), middle[c]) for c in columns})
    else:
        numbers = numbers.na.drop()
    if method == "spearman":
        numbers = materialize(numbers)
        for c in columns:
            ranked = average_rank(numbers, c, "_rank", rows_per_chunk)
            numbers = ranked.drop(c).withColumnRenamed("_rank", c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = numbers.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    cells = []
    for a in columns:
        for b in columns:
            value = F.lit(1.0) if a == b else F.col(f"{a}__{b}" if (a, b) in pairs else f"{b}__{a}")
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value.alias("r")))
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def top_correlations(matrix: DataFrame, k: int = 5) -> DataFrame:
    """Strongest pairs, each once."""
    return (matrix.where(F.col("a") < F.col("b")).orderBy(F.abs("r").desc(), "a", "b").limit(k))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def frequency_magnitude(df: DataFrame, width: float = 0.5) -> DataFrame:
    """Straight-line fit of ln(count) on the centre of magnitude bins.

    Bins of equal width start at the smallest magnitude; the last is closed.
    """
    limits = fixed(df.agg(F.min("mag").alias("lo"), F.max("mag").alias("hi")))
    # Edges run from lo in steps up to, not including, hi + width.
    edges = F.ceil((limits["hi"] + F.lit(width) - limits["lo"]) / F.lit(width)).cast("bigint")
    top = limits["lo"] + (edges - 1) * F.lit(width)
    slot = F.floor((F.col("mag") - limits["lo"]) / F.lit(width)).cast("bigint")
    inside = df.where(F.col("mag") <= top).select(F.least(slot, edges - 2).alias("i"))
    counts = inside.groupBy("i").agg(_n("n"))
    center = limits["lo"] + (F.col("i") + F.lit(0.5)) * F.lit(width)
    line = counts.select(center.alias("x"), F.log(F.col("n").cast("double")).alias("y"))
    return line.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                    F.corr("x", "y").alias("r"), _n("bins"))


def exceedance(df: DataFrame, column: str = "mag", rows_per_chunk: int | None = None) -> DataFrame:
    """How many events reach each magnitude."""
    return (running(value_counts(df, column), [], {"at_least": ("sum", F.col("n"))}, (column,), reverse=True,
                    rows_per_chunk=rows_per_chunk).drop("n"))


def mag_stats(df: DataFrame, thresholds: tuple[float, ...] = (4.0, 5.0, 6.0)) -> DataFrame:
    middle = scalars(medians(df, ["mag"]))["mag"]
    found = df.agg(F.min("mag").alias("mag_min"), F.max("mag").alias("mag_max"), F.avg("mag").alias("mag_mean"),
                   F.stddev_samp("mag").alias("mag_std"),
                   *[F.count_if(F.col("mag") >= t).alias(f"at_least_{t:g}") for t in thresholds])
    return found.withColumn("mag_median", middle)


def histogram(df: DataFrame, column: str, buckets: int = 50) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value."""
    limits = fixed(df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")))
    step = (limits["hi"] - limits["lo"]) / F.lit(float(buckets))
    value = F.col(column).cast("double")
    slot = F.when(limits["hi"] == limits["lo"], F.lit(0).cast("bigint")).otherwise(
        F.least(F.floor((value - limits["lo"]) / step).cast("bigint"), F.lit(buckets - 1).cast("bigint")))
    return (df.where(F.col(column).isNotNull()).groupBy(slot.alias("bucket")).agg(_n("n"))
            .withColumns({"low": limits["lo"] + F.col("bucket") * step,
                          "high": limits["lo"] + (F.col("bucket") + 1) * step}))


def category_share(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value, nulls included."""
    total = scalars(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    return df.groupBy(column).agg(_n("n")).withColumn("percent", F.lit(100.0) * F.col("n") / total)


def concentration(df: DataFrame, ks: tuple[int, ...] = (10, 50, 100), size: float = 2.5) -> DataFrame:
    """Share of events in the busiest ``k`` cells."""
    cells = add_cells(df, size).groupBy("lat_cell", "lon_cell").agg(_n("n"))
    # One row per cell, at most cells_on_globe(size).
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "lat_cell", "lon_cell"))
    ranked = cells.withColumn("_rank", rank)
    wide = ranked.agg(F.sum("n").alias("_all"),
                      *[F.sum(F.when(F.col("_rank") <= k, F.col("n"))).alias(f"_{k}") for k in ks])
    rows = [F.struct(F.lit(k).cast("bigint").alias("k"), (F.col(f"_{k}") / F.col("_all")).alias("share")) for k in ks]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def peak_periods(series: DataFrame, period: str, value: str = "event_count") -> DataFrame:
    """Busiest and quietest period; the earlier one on a tie."""
    high = F.max(F.struct(F.col(value), (-F.unix_date(period)).alias("early"), F.col(period)))
    low = F.min(F.struct(F.col(value), F.unix_date(period).alias("early"), F.col(period)))
    found = series.agg(high.alias("h"), low.alias("l"), F.avg(value).alias("mean_count"))
    return found.select(F.col(f"h.{period}").alias("peak_period"), F.col(f"h.{value}").alias("peak_count"),
                        F.col(f"l.{period}").alias("low_period"), F.col(f"l.{value}").alias("low_count"), "mean_count")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    found = df.agg(_n("total"), F.count_if(F.col(label) == 1).alias("positive"))
    negative = F.col("total") - F.col("positive")
    return found.withColumns({
        "negative": negative, "positive_ratio": F.col("positive") / F.col("total"),
        "negative_ratio": negative / F.col("total"),
        "positive_weight": F.try_divide(negative, F.col("positive"))})
