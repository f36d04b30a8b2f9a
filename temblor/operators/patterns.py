"""Tokens, n-grams, transitions, item sets, rules and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temblor.functions import bins, geo
from temblor.operators.ordered import over_rows
from temblor.operators.quantiles import exact_quantiles, fixed, medians, ranked_quantiles, scalars
from temblor.operators.spatial import attach, hotspot_flag
from temblor.session import materialize

PHYSICAL_FEATURES = ["mag", "depth", "gap", "nst", "rms"]
LOCATION_PREFIXES = ("lat:", "lon:", "hotspot:")
EPS = 1e-12


def quantile_bins(df: DataFrame, columns: list[str], q: int = 3) -> DataFrame:
    """Add ``<column>_bin`` with labels ``<column>_q1`` ... by quantile limits.

    Where two limits coincide every row gets ``_q1``, nulls included.
    """
    shares = [i / q for i in range(q + 1)]
    limits = fixed(exact_quantiles(df, columns, shares))
    out = {}
    for c in columns:
        edges = [limits[c][i] for i in range(q + 1)]
        collapsed = reduce(lambda a, b: a | b, [edges[i] >= edges[i + 1] for i in range(q)])
        value = F.col(c).cast("double")
        chain = F.when(collapsed, f"{c}_q1")
        for i in range(1, q + 1):
            chain = chain.when(value <= edges[i], f"{c}_q{i}")
        out[f"{c}_bin"] = chain
    return df.withColumns(out)


def daily_token(df: DataFrame, time: str = "time") -> DataFrame:
    """The most frequent event token of each day; ties go to the first name."""
    counts = (df.select(F.to_date(time).alias("day"), bins.event_token().alias("token"))
              .groupBy("day", "token").agg(F.count(F.lit(1)).alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("token")))
    return counts.groupBy("day").agg(best.alias("best")).select(
        "day", "best.token", (-F.col("best.less")).alias("event_count"))


def _by_day() -> Window:
    # One row per calendar day: a century is 36,525 rows.
    return Window.orderBy("day")


def token_ngrams(tokens: DataFrame, lengths: tuple[int, ...] = (2, 3), k: int = 30) -> DataFrame:
    """Most frequent runs of daily tokens with their share of all runs."""
    days = scalars(tokens.agg(F.count(F.lit(1)).alias("n")))["n"]
    steps = {f"_t{i}": F.lead("token", i).over(_by_day()) for i in range(1, max(lengths))}
    ahead = tokens.withColumns(steps)
    found = []
    for length in lengths:
        parts = [F.col("token"), *[F.col(f"_t{i}") for i in range(1, length)]]
        found.append(F.struct(F.lit(length).cast("bigint").alias("pattern_len"),
                              F.when(parts[-1].isNotNull(), F.concat_ws(" -> ", *parts)).alias("pattern")))
    runs = ahead.select(F.explode(F.array(*found)).alias("r")).select("r.*").where("pattern is not null")
    counts = runs.groupBy("pattern_len", "pattern").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("pattern_len").orderBy(F.col("n").desc(), "pattern")
    top = counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k).drop("_r")
    windows = F.greatest(days - F.col("pattern_len") + 1, F.lit(1))
    return top.withColumn("support", F.col("n") / windows)


def transitions(tokens: DataFrame) -> DataFrame:
    """Share of each next token among all steps from a token."""
    steps = (tokens.withColumn("next_token", F.lead("token").over(_by_day()))
             .where("next_token is not null").groupBy("token", "next_token")
             .agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy("token"))
    return steps.withColumn("probability", F.col("n") / total)


def transactions(df: DataFrame, hot_cells: DataFrame, size: float = 5.0) -> DataFrame:
    """Eight ``key:value`` items per event; a value without a bin is ``<NA>``."""
    binned = hotspot_flag(quantile_bins(df, ["gap", "nst", "rms"]), hot_cells, size, "_hotspot")

    def item(key: str, value: Column) -> Column:
        return F.concat(F.lit(key + ":"), F.coalesce(value, F.lit("<NA>")))

    items = [
        item("mag", bins.bin_column("mag", *bins.MAG_ITEM, right=False)),
        item("depth", bins.bin_column("depth", *bins.DEPTH_ITEM, right=False)),
        item("gap", F.col("gap_bin")), item("nst", F.col("nst_bin")), item("rms", F.col("rms_bin")),
        item("lat", bins.bin_column("latitude", *bins.LAT_ZONE, include_lowest=True)),
        item("lon", bins.bin_column("longitude", *bins.LON_ZONE, include_lowest=True)),
        item("hotspot", F.when(F.col("_hotspot"), "hotspot_yes").otherwise("hotspot_no")),
    ]
    return binned.select("id", F.array_sort(F.array(*items)).alias("items"))


def frequent_itemsets(baskets: DataFrame, max_len: int = 3, min_support: float = 0.01) -> DataFrame:
    """All item sets up to ``max_len`` with their support; exact.

    Level by level: only frequent sets are prolonged, and only by items that are
    frequent themselves, so the work follows the frequent sets and not the
    subsets of a basket. Equal baskets are counted first, and again once their
    rare items are gone. Baskets hold sorted items, as many as they like.
    """
    distinct = materialize(baskets.groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    total = distinct.agg(F.sum("n")).first()[0] or 0

    def frequent(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("itemset").agg(F.sum("n").alias("n"))
        return materialize(counts.withColumn("support", F.col("n") / F.lit(float(max(1, total))))
                           .where(F.col("support") >= min_support))

    def prolonged(rows: DataFrame) -> DataFrame:
        """Every set longer by each item that stands after its last one."""
        after = F.slice("items", F.col("last") + 1, F.size("items"))
        return rows.select("items", "n", "last", "itemset", F.posexplode(after).alias("k", "item")).select(
            "items", "n", (F.col("last") + F.col("k") + 1).alias("last"),
            F.concat("itemset", F.array("item")).alias("itemset"))

    none = {"last": F.lit(0), "itemset": F.array().cast("array<string>")}
    ones = prolonged(distinct.withColumns(none))
    found = [frequent(ones)]
    if max_len > 1:
        left = ones.join(found[0].select("itemset"), "itemset", "left_semi").groupBy("items", "n").agg(
            F.array_sort(F.collect_list(F.struct("last", F.col("itemset")[0].alias("item")))).alias("kept"))
        small = materialize(left.groupBy(F.col("kept.item").alias("items")).agg(F.sum("n").alias("n")))
        rows = prolonged(small.withColumns(none))
    for _ in range(1, max_len):
        rows = prolonged(rows)
        found.append(frequent(rows))
        rows = rows.join(found[-1].select("itemset"), "itemset", "left_semi")
    return reduce(lambda a, b: a.unionByName(b), found)


def location_rules(itemsets: DataFrame, min_confidence: float = 0.35,
                   min_lift: float = 1.05) -> DataFrame:
    """Rules from event properties to one location item."""
    def located(item):
        return reduce(lambda a, b: a | b, [item.startswith(p) for p in LOCATION_PREFIXES])

    itemsets = materialize(itemsets)
    split = (itemsets.where(F.size("itemset") >= 2)
             .select("itemset", "support", F.explode("itemset").alias("consequent"))
             .where(located(F.col("consequent")))
             .withColumn("left", F.array_remove("itemset", F.col("consequent")))
             .where(~F.exists("left", located)))
    left = itemsets.select(F.col("itemset").alias("left"), F.col("support").alias("_left"))
    right = (itemsets.where(F.size("itemset") == 1)
             .select(F.col("itemset")[0].alias("consequent"), F.col("support").alias("_right")))
    joined = split.join(left, "left").join(right, "consequent")
    confidence = F.col("support") / F.col("_left")
    rules = joined.select(F.concat_ws(" + ", "left").alias("antecedent"), "consequent", "support",
                          confidence.alias("confidence"), (confidence / F.col("_right")).alias("lift"))
    return rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def robust_z(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """0.6745 (x - median) / MAD; 0 where the MAD vanishes."""
    center = fixed(medians(df, columns))
    away = df.select(*[F.abs(F.col(c) - center[c]).alias(c) for c in columns])
    spread = fixed(medians(away, columns))
    return df.withColumns({c + suffix: _z(F.col(c), center[c], spread[c]) for c in columns})


def _z(value: Column, center: Column, spread: Column) -> Column:
    return F.when(spread < EPS, F.lit(0.0)).otherwise(F.lit(0.6745) * (value - center) / spread)


def _ranked_z(df: DataFrame, column: str, rows_per_chunk: int | None) -> Column:
    """Robust z for a column whose values are nearly all different."""
    center = fixed(ranked_quantiles(df.select(column), column, [0.5], rows_per_chunk))["q0"]
    away = df.select(F.abs(F.col(column) - center).alias("away"))
    spread = fixed(ranked_quantiles(away, "away", [0.5], rows_per_chunk))["q0"]
    return _z(F.col(column), center, spread)


def outliers(df: DataFrame, size: float = 2.5, share: float = 0.995,
             rows_per_chunk: int | None = None) -> DataFrame:
    """Outlier score from properties, cell rarity and the gap to the event before.

    The score is the sum of absolute robust z of the five properties, twice the
    rarity of the cell and the absolute robust z of the log gap in hours.
    """
    cell = [geo.lat_cell(size=size).alias("_row"), geo.lon_cell(size=size).alias("_col")]
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    limits = fixed(counts.agg(F.min("_n").alias("lo"), F.max("_n").alias("hi")))

    def gap(window):
        hours = (F.unix_micros("time") - F.unix_micros(F.lag("time").over(window))) / F.lit(3600e6)
        return {"_gap": F.log1p(F.greatest(F.coalesce(hours, F.lit(0.0)), F.lit(0.0)))}

    timed = materialize(over_rows(df, [], 1, 0, gap, rows_per_chunk=rows_per_chunk))
    scored = robust_z(timed, PHYSICAL_FEATURES, "_score")
    scored = scored.withColumn("_gap_z", _ranked_z(timed, "_gap", rows_per_chunk))
    placed = attach(scored.withColumns({"_row": geo.lat_cell(size=size), "_col": geo.lon_cell(size=size)}),
                    counts, ["_row", "_col"], geo.cells_on_globe(size))
    rarity = F.lit(1.0) - (F.col("_n") - limits["lo"]) / (limits["hi"] - limits["lo"] + F.lit(EPS))
    total = reduce(lambda a, b: a + b, [F.abs(F.col(c + "_score")) for c in PHYSICAL_FEATURES])
    out = placed.withColumn("outlier_score", total + F.lit(2.0) * rarity + F.abs(F.col("_gap_z")))
    out = materialize(out)
    limit = fixed(ranked_quantiles(out.select("outlier_score"), "outlier_score", [share], rows_per_chunk))["q0"]
    return (out.withColumn("is_outlier", F.col("outlier_score") >= limit)
            .drop("_row", "_col", "_n", "_gap", "_gap_z", *[c + "_score" for c in PHYSICAL_FEATURES]))
