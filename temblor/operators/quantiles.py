"""Exact quantiles, ranks and other work on sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temblor.operators.ordered import running
from temblor.session import materialize

#: Bits by which bins are cut, and the different values of a bin that a task may sort.
BITS = 16
MOST_IN_BIN = 65_536


def scalars(row: DataFrame) -> dict[str, Column]:
    """Columns of a one-row frame as scalar subqueries.

    They can be used in any other frame without a join.
    """
    packed = row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias("row")).scalar()
    return {c: packed.getField(c) for c in row.columns}


def fixed(row: DataFrame) -> dict[str, Column]:
    """Values of a one-row frame, computed now and returned as literals.

    For statistics that many columns use: a subquery would be planned once per
    use, and again inside later ones. One row comes to the driver.
    """
    kinds = dict(row.dtypes)
    first = row.first()
    return {c: (F.array(*[F.lit(v) for v in first[c]]) if isinstance(first[c], list) else F.lit(first[c]))
            .cast(kinds[c]) for c in row.columns}


def value_counts(df: DataFrame, value: str, keys: list[str] = (), **sums: Column) -> DataFrame:
    """One row per distinct value with its count ``n``; copies fold early."""
    extra = [F.sum(col).alias(name) for name, col in sums.items()]
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n"), *extra))


def _order_key(value: Column) -> Column:
    """A long that sorts like the double; both zeros are one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2 ** 63 - 1))).otherwise(bits)


def _same(left: str, right: str, names: list[str]) -> Column:
    match = F.lit(True)
    for c in names:
        match = match & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return match


def _narrowed(left: DataFrame, bins: DataFrame, group: list[str], shift: int) -> tuple[DataFrame, DataFrame]:
    """Values and bins after ``BITS`` more bits: only bins that hold a wanted rank stay.

    A bin falls into ``2 ** BITS`` new ones at most, which is what a window here sees.
    """
    finer = left.withColumn("_finer", F.shiftright("_key", shift))
    counted = finer.groupBy(*group, "_bin", "_finer").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    order = Window.partitionBy(*group, "_bin").orderBy("_finer")
    counted = counted.withColumn("_first", F.sum("_n").over(order) - F.col("_n"))
    placed = counted.alias("c").join(bins.alias("b"), _same("c", "b", [*group, "_bin"])).select(
        *[f"c.`{c}`" for c in group], F.col("_finer").alias("_bin"), F.col("c._d").alias("_d"),
        (F.col("before") + F.col("_first")).alias("before"), F.col("_n"), "ranks")
    inside = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("_n")))
    bins = materialize(placed.withColumn("ranks", inside).where(F.size("ranks") > 0).drop("_n"))
    held = finer.drop("_bin").withColumnRenamed("_finer", "_bin")
    return materialize(held.alias("v").join(bins.alias("b"), _same("v", "b", [*group, "_bin"]), "left_semi")), bins


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    keys: list[str] = (), most: int = MOST_IN_BIN) -> DataFrame:
    """Linear-interpolation quantiles as arrays, one per column (and group).

    By selection: copies of a value are counted first. While the bins that hold a
    wanted rank have more than ``most`` different values, they are cut by the next
    bits of the values and only those with a wanted rank are kept. In the end a
    window over each bin finds the values. At most four rounds; no task sees more than a bin.
    """
    keys, group = list(keys), [*keys, "column"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
                      for c in columns])
    long = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(pairs).alias("_p")).select(*keys, "_p.column", "_p.value")
    left = materialize(value_counts(long, "value", group).withColumns(
        {"_key": _order_key(F.col("value")), "_bin": F.lit(0).cast("bigint")}))
    spots = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: p * (F.col("total") - 1))
    ranks = F.array_distinct(F.concat(F.transform("spots", lambda x: F.floor(x)), F.transform("spots", lambda x: F.ceil(x))))
    sizes = materialize(left.groupBy(*group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("_d"))
                        .withColumn("spots", spots).withColumn("ranks", ranks))
    bins = sizes.select(*group, F.lit(0).cast("bigint").alias("_bin"), "_d", F.lit(0).cast("bigint").alias("before"), "ranks")
    shift = 64
    while shift and (bins.agg(F.max("_d")).first()[0] or 0) > most:
        shift -= BITS
        left, bins = _narrowed(left, bins, group, shift)
    order = Window.partitionBy(*group, "_bin").orderBy("value")
    counted = left.withColumn("_upto", F.sum("n").over(order))
    first, upto = F.col("before") + F.col("_upto") - F.col("n"), F.col("before") + F.col("_upto")
    hits = counted.alias("v").join(bins.alias("b"), _same("v", "b", [*group, "_bin"])).select(
        *[f"v.`{c}`" for c in group], "value", F.filter("ranks", lambda r: (r >= first) & (r < upto)).alias("hit"))
    at_rank = F.flatten(F.collect_list(F.transform("hit", lambda r: F.struct(r.alias("rank"), F.col("value").alias("v")))))
    found = hits.where(F.size("hit") > 0).groupBy(*group).agg(F.map_from_entries(at_rank).alias("at"))

    def between(x: Column) -> Column:
        low, high = F.floor(x), F.ceil(x)
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(a == b, a).otherwise((high - x) * a + (x - low) * b)

    solved = found.alias("f").join(sizes.alias("s"), _same("f", "s", group)).select(
        *[f"f.`{c}`" for c in group], F.transform("spots", between).alias("q"))
    return solved.groupBy(*keys).agg(*[F.first(F.when(F.col("column") == c, F.col("q")), True).alias(c) for c in columns])


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median of each column."""
    found = exact_quantiles(df, columns, [0.5])
    return found.select(*[F.col(c)[0].alias(c) for c in columns])


def ranked_quantiles(df: DataFrame, value: str, probs: list[float],
                     rows_per_chunk: int | None = None) -> DataFrame:
    """One row ``q0, q1, ...`` of exact quantiles, for any number of values.

    Values are counted, running counts are taken chunk by chunk and only the
    two rows around each wanted rank are kept.
    """
    counted = running(value_counts(df, value), [], {"upto": ("sum", F.col("n"))}, (value,),
                      rows_per_chunk=rows_per_chunk)
    total = scalars(df.agg(F.count(value).alias("n")))["n"]
    first = F.col("upto") - F.col("n")
    picks = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (total - F.lit(1))
        low, high = F.floor(spot), F.ceil(spot)
        at_low = F.max(F.when((first <= low) & (low < F.col("upto")), F.col(value)))
        at_high = F.max(F.when((first <= high) & (high < F.col("upto")), F.col(value)))
        picks.append((at_low + (at_high - at_low) * F.max(spot - low)).alias(f"q{i}"))
    return counted.agg(*picks)


def average_rank(df: DataFrame, value: str, name: str = "rank",
                 rows_per_chunk: int | None = None) -> DataFrame:
    """Add the rank of a value from 1, equal values sharing their mean rank."""
    counted = running(value_counts(df, value), [], {"_upto": ("sum", F.col("n"))}, (value,),
                      rows_per_chunk=rows_per_chunk)
    rank = F.col("_upto") - (F.col("n") - F.lit(1)) / F.lit(2.0)
    return df.join(counted.select(value, rank.alias(name)), value, "left")
