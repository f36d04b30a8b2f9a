"""Ordered work that never gathers a whole group in one task.

A window over a region, or over the whole catalog, would put all its rows in
one task. Here rows are first cut into chunks of similar row counts along the
order column. Windows then run inside (group, chunk), and what must cross a
chunk border travels as a small summary (running totals) or as a few copied
border rows (frames of n rows). Results equal those of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 200_000
MAX_CHUNKS = 4096
CHUNK = "_chunk"


@dataclass(frozen=True)
class Ordered:
    """A frame with a chunk number that grows with its order columns."""

    df: DataFrame
    order: tuple[str, ...]
    chunks: int

    def with_df(self, df: DataFrame) -> Ordered:
        return Ordered(df, self.order, self.chunks)


def _bucketed(df: DataFrame, column: str, points: list[float], out: str) -> DataFrame:
    splits = [-math.inf, *points, math.inf]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    numbered = df.withColumn("_split_on", F.col(column).cast("double"))
    bucketizer = Bucketizer(splits=splits, inputCol="_split_on", outputCol=out, handleInvalid="keep")
    return bucketizer.transform(numbered).withColumn(out, F.col(out).cast("bigint")).drop("_split_on")


def _cuts_of_ties(keyed: DataFrame, key: str, second: str, times: dict[float, int], accuracy: int) -> dict:
    """Split points along the second column for all crowded instants, by one job."""
    found = keyed.where(F.col(key).isin(list(times))).groupBy(key).agg(*[
        F.percentile_approx(F.col(second).cast("double"), [i / (n + 1) for i in range(1, n + 1)], accuracy).alias(f"q{n}")
        for n in sorted(set(times.values()))])
    return {r[key]: sorted(set(r[f"q{times[r[key]]}"] or [])) for r in found.collect()}


def chunked(df: DataFrame | Ordered, order: tuple[str, ...] = ("time", "seq"),
            rows_per_chunk: int | None = None, split_ties: bool = True) -> Ordered:
    """Number chunks of about ``rows_per_chunk`` rows along ``order``.

    The driver only sees the split points (at most ``MAX_CHUNKS``). An instant
    that fills more than one chunk is cut along the second order column.
    """
    if isinstance(df, Ordered):
        return df
    rows_per_chunk = rows_per_chunk or ROWS_PER_CHUNK
    key = "_order_key"
    first = F.col(order[0])
    kind = dict(df.dtypes)[order[0]]
    number = F.unix_micros(first) if kind.startswith("timestamp") else first
    keyed = df.withColumn(key, number.cast("double"))
    rows = df.select(order[0]).count()
    wanted = min(MAX_CHUNKS, math.ceil(rows / rows_per_chunk))
    if wanted <= 1:
        return Ordered(df.withColumn(CHUNK, F.lit(0).cast("bigint")), tuple(order), 1)
    shares = [i / wanted for i in range(1, wanted)]
    error = 1.0 / (4 * wanted)
    points = keyed.approxQuantile(key, shares, error)
    distinct = sorted(set(points))
    out = _bucketed(keyed, key, distinct, CHUNK)
    chunks = len(distinct) + 1
    crowded = sorted(p for p in distinct if points.count(p) > 1)
    if split_ties and crowded and len(order) > 1:
        cuts = _cuts_of_ties(keyed, key, order[1], {p: points.count(p) for p in crowded}, 4 * wanted)
        chunks += sum(len(c) + 1 for c in cuts.values())
        # One row per crowded instant, fewer than chunks: small enough for every task.
        ties = df.sparkSession.createDataFrame(
            [(distinct.index(p) + 1, p, [float(x) for x in c]) for p, c in cuts.items()],
            "_bucket bigint, _instant double, _cuts array<double>")
        passed = F.size(F.filter("_cuts", lambda c: c <= F.col(order[1]).cast("double"))).cast("bigint")
        inner = (F.when(F.col("_bucket").isNull(), F.lit(0)).when(F.col(key) == F.col("_instant"), passed)
                 .otherwise(F.lit(MAX_CHUNKS)).cast("bigint"))
        out = (out.join(F.broadcast(ties), F.col(CHUNK) == F.col("_bucket"), "left")
               .withColumn(CHUNK, F.col(CHUNK) * F.lit(2 * MAX_CHUNKS) + inner).drop("_bucket", "_instant", "_cuts"))
    return Ordered(out.drop(key), tuple(order), chunks)


def _columns(names) -> list[Column]:
    return [F.col(n) for n in names]


def over_rows(data: DataFrame | Ordered, keys: list[str], before: int, after: int,
              make: Callable[[Window], dict[str, Column]], order: tuple[str, ...] = ("time", "seq"),
              rows_per_chunk: int | None = None) -> DataFrame:
    """Window columns whose frames reach at most ``before``/``after`` rows.

    ``make(window)`` returns the new columns; ``window`` is partitioned and
    ordered. Border rows are copied into the chunks that need them.
    """
    data = chunked(data, order, rows_per_chunk)
    df, by = data.df, [*keys, CHUNK]
    window = Window.partitionBy(*by).orderBy(*data.order)
    if data.chunks == 1:
        return df.withColumns(make(window)).drop(CHUNK)
    real = df.withColumn("_halo", F.lit(False))
    parts = [real]
    for reach, backwards in ((before, False), (after, True)):
        if reach:
            parts.append(_border_rows(data, keys, reach, backwards).withColumn("_halo", F.lit(True)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.withColumns(make(window)).where(~F.col("_halo")).drop("_halo", CHUNK)


def _border_rows(data: Ordered, keys: list[str], reach: int, backwards: bool) -> DataFrame:
    """Copies of the ``reach`` rows nearest to each chunk of a group.

    Only the last rows of each (group, chunk) can be among the rows just before
    a later chunk, so candidates per group are bounded by reach * chunks.
    """
    sort = [F.col(c).asc() if backwards else F.col(c).desc() for c in data.order]
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*sort)
    edge = data.df.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= reach).drop("_n")
    forward = [F.col(c).desc() if backwards else F.col(c).asc() for c in data.order]
    group = Window.partitionBy(*keys).orderBy(*forward)
    following = F.collect_set(CHUNK).over(group.rowsBetween(1, reach))
    targets = F.array_remove(following, F.col(CHUNK))
    return (edge.withColumn("_targets", targets).withColumn("_to", F.explode("_targets"))
            .drop("_targets", CHUNK).withColumnRenamed("_to", CHUNK))


def running(data: DataFrame | Ordered, keys: list[str], totals: dict[str, tuple[str, Column]],
            order: tuple[str, ...] = ("time", "seq"), reverse: bool = False,
            exclusive: bool = False, keep_chunk: bool = False,
            rows_per_chunk: int | None = None) -> DataFrame:
    """Running totals from the first row of a group up to the current row.

    ``totals`` maps a new column to ``(kind, column)``; kinds are ``sum``,
    ``max`` and ``min``. ``reverse`` runs from the last row backwards,
    ``exclusive`` leaves the current row out.
    """
    data = chunked(data, order, rows_per_chunk)
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    by = [*keys, CHUNK]
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in data.order]
    reach = (Window.unboundedPreceding, -1 if exclusive else 0)
    helpers = [] if keep_chunk else [CHUNK]
    if data.chunks == 1:
        window = Window.partitionBy(*by).orderBy(*sort).rowsBetween(*reach)
        return data.df.withColumns({n: kinds[k](c).over(window) for n, (k, c) in totals.items()}).drop(*helpers)
    values = {f"_v_{name}": col for name, (_, col) in totals.items()}
    rows = data.df.withColumns({**values, "_real": F.lit(True)})
    summary = rows.groupBy(*by).agg(*[kinds[k](f"_v_{n}").alias(f"_v_{n}") for n, (k, _) in totals.items()])
    step = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    earlier = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    # What earlier chunks add up to enters each chunk as its first row.
    carry = summary.select(*by, F.lit(False).alias("_real"), *[
        kinds[k](f"_v_{n}").over(earlier).alias(f"_v_{n}") for n, (k, _) in totals.items()])
    window = Window.partitionBy(*by).orderBy("_real", *sort).rowsBetween(*reach)
    out = rows.unionByName(carry, allowMissingColumns=True).withColumns(
        {n: kinds[k](f"_v_{n}").over(window) for n, (k, _) in totals.items()})
    return out.where("_real").drop("_real", *values, *helpers)


def row_index(data: DataFrame | Ordered, keys: list[str] = (), name: str = "idx",
              order: tuple[str, ...] = ("time", "seq"), rows_per_chunk: int | None = None) -> DataFrame:
    """Position of a row in its ordered group, from 0."""
    out = running(data, list(keys), {name: ("sum", F.lit(1).cast("bigint"))}, order,
                  rows_per_chunk=rows_per_chunk)
    return out.withColumn(name, F.col(name) - F.lit(1))


def trailing_blocks(data: DataFrame | Ordered, keys: list[str], rows: int,
                    totals: dict[str, tuple[str, Column]], order: tuple[str, ...] = ("time", "seq"),
                    rows_per_chunk: int | None = None) -> DataFrame:
    """Totals over the last ``rows`` rows, the current one included.

    For long frames: a group is cut into blocks of ``rows`` rows, a frame is
    the end of one block and the start of the next, so each row costs two
    running totals and one lookup instead of ``rows`` additions.
    """
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    indexed = row_index(data, keys, "_idx", order, rows_per_chunk)
    blocked = indexed.withColumn("_block", F.floor(F.col("_idx") / F.lit(rows)).cast("bigint"))
    base = Window.partitionBy(*keys, "_block")
    head = base.orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    # From a row to the end of its block: run backwards, so that the frame grows.
    tail = base.orderBy(F.col("_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    marked = blocked.withColumns({
        **{f"_head_{n}": kinds[k](c).over(head) for n, (k, c) in totals.items()},
        **{f"_tail_{n}": kinds[k](c).over(tail) for n, (k, c) in totals.items()},
    })
    # The rest of the frame is the tail of the block before, found at the row
    # where the frame starts. It is handed to the row where the frame ends.
    ends = marked.where((F.col("_idx") + F.lit(rows)) % rows != 0).select(
        *keys, (F.col("_idx") + F.lit(rows - 1)).alias("_idx"), F.lit(False).alias("_real"),
        *[F.col(f"_tail_{n}").alias(f"_prev_{n}") for n in totals])
    both = marked.withColumn("_real", F.lit(True)).unionByName(ends, allowMissingColumns=True)
    same_row = Window.partitionBy(*keys, "_idx")
    joined = both.withColumns({f"_prev_{n}": F.max(f"_prev_{n}").over(same_row) for n in totals}).where("_real")
    out = {}
    for name, (kind, _) in totals.items():
        own, past = F.col(f"_head_{name}"), F.col(f"_prev_{name}")
        if kind == "sum":
            out[name] = F.when(own.isNull() & past.isNull(), None).otherwise(
                F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0)))
        else:
            out[name] = F.greatest(own, past) if kind == "max" else F.least(own, past)
    helpers = [f"_{p}_{n}" for p in ("head", "tail", "prev") for n in totals]
    return joined.withColumns(out).drop("_block", "_idx", "_real", *helpers)
