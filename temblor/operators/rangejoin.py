"""Joins by distance and time.

Spark has no range join, so both sides get bucket numbers: one side is copied
into every bucket its range touches, the other sits in one bucket, and the
exact test follows the equi join. The hints keep Spark from broadcasting the
copied side. A bucket with very many rows is split by the adaptive skew join,
since every operator here regroups by event after the pairs are made.

Where a result needs no pairs they are not made: :func:`larger_follows` and
:func:`since_last` work on running maxima, :func:`nearest_earlier` and
:func:`shock_roles` look at short time spans first and take only events
without an answer on to longer ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.functions.geo import EARTH_KM, cartesian, haversine_km
from temblor.operators.boxes import TOTALS, box_totals, in_box
from temblor.operators.ordered import CHUNK, ROWS_PER_CHUNK, Ordered, chunked, running
from temblor.operators.quantiles import fixed
from temblor.operators.spatial import MAX_BROADCAST_CELLS
from temblor.session import materialize

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
# With more events than this in one bucket, nearest-event joins go by steps.
DENSE_BUCKET = 2_000
# More than any number of a row.
NUMBERS = Decimal(2 ** 63)


@dataclass(frozen=True)
class Axis:
    """One range condition: the build value lies in [low, high] of the probe."""

    low: Column
    high: Column
    value: Column
    width: float


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("bigint")


def bucket_columns(count: int) -> list[str]:
    return [f"_b{i}" for i in range(count)]


def spread_probe(probe: DataFrame, axes: list[Axis], names: list[str] | None = None) -> DataFrame:
    """Copy each probe row into all buckets its ranges touch."""
    out = probe
    for name, axis in zip(names or bucket_columns(len(axes)), axes):
        touched = F.sequence(_bucket(axis.low, axis.width), _bucket(axis.high, axis.width))
        out = out.withColumn(name, F.explode(touched))
    return out


def place_build(build: DataFrame, axes: list[Axis]) -> DataFrame:
    return build.withColumns({name: _bucket(axis.value, axis.width)
                              for name, axis in zip(bucket_columns(len(axes)), axes)})


def range_pairs(probe: DataFrame, build: DataFrame, axes: list[Axis], keep: Column, few: bool = False) -> DataFrame:
    """Inner join of all (probe, build) pairs that pass ``keep``.

    The two sides must have no column in common. ``few`` leaves copies of the probe
    out before they move, where the build has rows in few buckets.
    """
    names = bucket_columns(len(axes))
    spread, placed = spread_probe(probe, axes), place_build(build, axes)
    if few:
        buckets = materialize(placed.select(*names).distinct())
        if buckets.count() <= MAX_BROADCAST_CELLS:
            spread = spread.join(F.broadcast(buckets), names, "left_semi")
    return spread.join(placed.hint("merge"), names).where(keep).drop(*names)


def _events(df: DataFrame, prefix: str, extra: list[str] = ()) -> DataFrame:
    """Join columns of events under a prefix: seq, us, mag, position."""
    x, y, z = cartesian()
    return df.select(F.col("seq").alias(f"{prefix}seq"), F.unix_micros("time").alias(f"{prefix}us"),
                     F.col("mag").alias(f"{prefix}mag"), F.col("latitude").alias(f"{prefix}lat"),
                     F.col("longitude").alias(f"{prefix}lon"), x.alias(f"{prefix}x"),
                     y.alias(f"{prefix}y"), z.alias(f"{prefix}z"),
                     *[F.col(c).alias(f"{prefix}{c}") for c in extra])


def _box_pairs(probe: DataFrame, places: DataFrame, span: int, degrees: float, few: bool = False) -> DataFrame:
    """All earlier places in the box of each event."""
    size = 2.0 * degrees
    axes = [
        Axis(F.col("p_us") - span, F.col("p_us") - 1, F.col("b_us"), span),
        Axis(F.col("p_lat") - degrees, F.col("p_lat") + degrees, F.col("b_lat"), size),
        Axis(F.col("p_lon") - degrees, F.col("p_lon") + degrees, F.col("b_lon"), size),
    ]
    return range_pairs(probe, places, axes, in_box(span, degrees), few)


def history_in_box(df: DataFrame, days: int = 30, degrees: float = 1.0, empty_days: int = 9999,
                   crowded: int = DENSE_BUCKET, rows_per_chunk: int | None = None) -> DataFrame:
    """Events of the ``days`` before each event within a box of +-``degrees``.

    Adds their count, mean and largest magnitude (0 without any) and the whole
    days since the last one. Events of one instant and place are folded before
    the join.

    Where a cell of ``degrees`` holds more than ``crowded`` places in one time slot,
    its places are not paired but answered by bitmaps or running totals (see ``boxes``).
    """
    span = days * DAY_US
    probe = df.select(F.col("seq").alias("p_seq"), F.unix_micros("time").alias("p_us"),
                      F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    places = (df.groupBy(F.unix_micros("time").alias("b_us"), F.col("latitude").alias("b_lat"),
                         F.col("longitude").alias("b_lon"))
              .agg(F.count(F.lit(1)).alias("b_n"), F.sum("mag").alias("b_sum"), F.max("mag").alias("b_max")))
    found = box_totals(probe, places, lambda p, b, few: _box_pairs(p, b, span, degrees, few), span, degrees, crowded,
                       rows_per_chunk)
    joined = df.join(found, "seq", "left")
    n, total = F.coalesce("_n", F.lit(0).cast("bigint")), F.coalesce("_sum", F.lit(0.0))
    largest, last = F.col("_max"), F.col("_last")
    since = F.floor((F.unix_micros("time") - last) / F.lit(float(DAY_US))).cast("bigint")
    return joined.withColumns({
        f"hist_count_{days}d": n,
        f"hist_mag_mean_{days}d": F.when(n > 0, total / n).otherwise(F.lit(0.0)),
        f"hist_mag_max_{days}d": F.coalesce(largest, F.lit(0.0)),
        "days_since_last": F.coalesce(since, F.lit(empty_days).cast("bigint")),
    }).drop(*TOTALS)


def time_steps(span_us: int, densest: int) -> list[tuple[int, int]]:
    """Cut (0, span] into steps that double, so that the first is sparse.

    In a dense place most events find their neighbour in the first step, so
    the pairs stay near the number of events instead of its square.
    """
    steps = max(0, math.ceil(math.log2(max(1, densest) / DENSE_BUCKET)))
    ends = [max(1, span_us >> i) for i in range(steps, -1, -1)]
    ends = sorted(set(ends))
    return list(zip([0, *ends[:-1]], ends))


def few_steps(steps: list[tuple[int, int]], at_once: int = 2) -> list[tuple[int, int]]:
    """The same span in fewer steps, as each moves all open events again."""
    ends = [high for _, high in steps][::-1][::at_once][::-1]
    return list(zip([steps[0][0], *ends[:-1]], ends))


def surface_cells(width: float) -> int:
    """Cubes of ``width`` km that the surface of the earth touches, at most."""
    return math.ceil(2 * 4 * math.pi * (EARTH_KM / width) ** 2)


def _space_axes(probe: str, build: str, radius: float) -> list[Axis]:
    return [Axis(F.col(probe + c) - radius, F.col(probe + c) + radius, F.col(build + c), 2.0 * radius)
            for c in ("x", "y", "z")]


def _densest(events: DataFrame, prefix: str, radius: float, span_us: int) -> int:
    axes = [Axis(F.lit(0), F.lit(0), F.col(prefix + c), 2.0 * radius) for c in ("x", "y", "z")]
    axes.append(Axis(F.lit(0), F.lit(0), F.col(prefix + "us"), span_us))
    counts = place_build(events, axes).groupBy(*bucket_columns(4)).count()
    return counts.agg(F.max("count")).first()[0] or 0


def nearest_earlier(df: DataFrame, radius_km: float = 50.0, hours: float = 72.0,
                    densest: int | None = None) -> DataFrame:
    """(seq, parent): the latest larger event within reach, of the last hours.

    Distance is the chord. Events at the parent's instant are no children.
    Buckets whose largest event is not larger are left out before the join, and
    cubes of space without a larger event at any time before the rows move at all;
    the surface bounds the number of cubes, so they are broadcast.
    """
    span = int(hours * HOUR_US)
    children, parents = _events(df, "c_"), _events(df, "p_")
    if densest is None:
        densest = _densest(children, "c_", radius_km, span)
    chord2 = sum_squares([F.col("c_" + a) - F.col("p_" + a) for a in ("x", "y", "z")])
    steps = few_steps(time_steps(span, densest))
    links, names = None, bucket_columns(4)
    space = _space_axes("c_", "p_", radius_km)
    cubes = None
    if surface_cells(2.0 * radius_km) <= MAX_BROADCAST_CELLS:
        cubes = materialize(place_build(parents, space).groupBy(*names[:3]).agg(F.max("p_mag").alias("_largest")))
    for low, high in steps:
        time = Axis(F.col("c_us") - high, F.col("c_us") - low - 1, F.col("p_us"), high - low)
        placed = place_build(parents, [*space, time])
        largest = placed.groupBy(*names).agg(F.max("p_mag").alias("_largest"))
        spread = spread_probe(children, space)
        if cubes is not None:
            spread = (spread.join(F.broadcast(cubes), names[:3]).where(F.col("_largest") > F.col("c_mag"))
                      .drop("_largest"))
        spread = spread_probe(spread, [time], names[3:])
        spread = (spread.join(largest.hint("merge"), names)
                  .where(F.col("_largest") > F.col("c_mag")).drop("_largest"))
        age = F.col("c_us") - F.col("p_us")
        keep = ((age > low) & (age <= high) & (F.col("p_mag") > F.col("c_mag"))
                & (F.sqrt(chord2) <= radius_km))
        found = (spread.join(placed.hint("merge"), names).where(keep)
                 .groupBy(F.col("c_seq").alias("seq"))
                 .agg(F.max(F.struct("p_us", "p_seq")).getField("p_seq").alias("parent")))
        if len(steps) > 1:
            found = materialize(found)
            children = materialize(children.join(found, F.col("c_seq") == F.col("seq"), "left_anti"))
        links = found if links is None else links.unionByName(found)
    return links


def sum_squares(columns: list[Column]) -> Column:
    total = columns[0] * columns[0]
    for c in columns[1:]:
        total = total + c * c
    return total


def shock_roles(df: DataFrame, mag_min: float = 5.5, radius_km: float = 120.0,
                before_days: int = 7, after_days: int = 30, eps: float = 1e-12,
                densest: int | None = None) -> DataFrame:
    """Mainshock, foreshock, aftershock or unclassified, with the mainshock.

    The mainshock nearest in time wins, the earlier one on a tie. Mainshocks,
    the few, are copied into buckets; other events sit in one bucket each.
    """
    # Numbers in the order of ties, so that the nearest of many pairs is the least of one number: no sort by structs.
    ordered = _events(df.where(F.col("mag") >= mag_min), "m_", ["id"]).orderBy("m_us", "m_seq", "m_id")
    mains = materialize(ordered.withColumn("m_number", 2 * F.monotonically_increasing_id()))
    others = _events(df.where(F.col("mag") < mag_min), "o_")
    before, after = before_days * DAY_US, after_days * DAY_US
    span = max(before, after)
    if densest is None:
        densest = _densest(mains, "m_", radius_km, span)
    gap = F.col("o_us") - F.col("m_us")
    number = F.col("m_number") + (gap < 0).cast("bigint")
    nearest = F.min(F.abs(gap).cast("decimal(18,0)") * F.lit(NUMBERS) + number.cast("decimal(19,0)"))
    found_all, steps = None, time_steps(span, densest)
    for low, high in steps:
        back, ahead = min(high, before), min(high, after)
        axes = [*_space_axes("m_", "o_", radius_km),
                Axis(F.col("m_us") - back, F.col("m_us") + ahead, F.col("o_us"), back + ahead)]
        keep = (
            (gap >= -before) & (gap <= after) & (F.abs(gap) > low) & (F.abs(gap) <= high)
            & (F.col("o_mag") <= F.col("m_mag") + eps)
            & (haversine_km("m_lat", "m_lon", "o_lat", "o_lon") <= radius_km)
        )
        found = (range_pairs(mains.drop("m_seq", "m_id"), others, axes, keep).groupBy(F.col("o_seq").alias("seq"))
                 .agg(nearest.alias("_near")))
        if len(steps) > 1:
            found = materialize(found)
            others = materialize(others.join(found, F.col("o_seq") == F.col("seq"), "left_anti"))
        found_all = found if found_all is None else found_all.unionByName(found)
    number = F.expr(f"cast(_near % {NUMBERS} as bigint)")
    named = found_all.select("seq", F.expr(f"_near div {NUMBERS}").alias("gap"), (number % 2 == 1).alias("before"),
                             (number - number % 2).alias("m_number")).join(mains.select("m_number", "m_id"), "m_number")
    found_all = named.select("seq", F.struct("gap", "m_id", "before").alias("_near"))
    joined = df.join(found_all, "seq", "left")
    is_main = F.col("mag") >= mag_min
    role = (F.when(is_main, "mainshock").when(F.col("_near").isNull(), "unclassified")
            .when(F.col("_near.before"), "foreshock").otherwise("aftershock"))
    return joined.withColumns({
        "shock_role": role,
        "related_mainshock_id": F.when(is_main, F.col("id")).otherwise(F.coalesce("_near.m_id", F.lit(""))),
        "hours_to_mainshock": F.when(is_main, F.lit(0.0)).otherwise(F.col("_near.gap") / F.lit(float(HOUR_US))),
    }).drop("_near")


def larger_follows(df: DataFrame, unit: float = 1.0, rows_per_chunk: int | None = None,
                   events: DataFrame | None = None) -> DataFrame:
    """Does a larger event follow within 10^(0.5 mag - 1) time units?

    Adds ``is_aftershock`` (1 when so; the name is the published one) and
    ``mainshock_mag``, the largest magnitude in that span, else the own one.

    No pairs are made. Spans are sorted into classes by powers of two; a span
    of class k covers the end of one slot of 2^k microseconds, at most one
    whole slot and the start of another, so its maximum comes from running
    maxima inside slots. ``events`` are the rows of ``df`` with fewer columns, where
    those are cheaper to read.
    """
    width = F.pow(F.lit(10.0), F.lit(0.5) * F.col("mag") - F.lit(1.0)) * F.lit(float(unit) * 1e6)
    events = (df if events is None else events).select(
        "seq", "mag", F.unix_micros("time").alias("us"), F.greatest(width, F.lit(1.0)).alias("width"))
    events = events.withColumns({"k": F.floor(F.log2("width")).cast("bigint"),
                                 "end": F.col("us") + F.floor("width").cast("bigint")})
    classes = fixed(events.agg(*[F.coalesce(f("k"), F.lit(0).cast("bigint")).alias(n)
                                 for f, n in ((F.min, "lowest"), (F.max, "highest"))]))
    # Slots of smaller classes lie in those of the largest one. Ends come from the two slots before at most.
    most = events.groupBy(F.floor(F.col("us") / F.pow(F.lit(2.0), classes["highest"]))).count().agg(F.max("count")).first()[0]
    sparse = 6 * (most or 0) <= (rows_per_chunk or ROWS_PER_CHUNK)

    def slot(value: Column) -> Column:
        return F.floor(value / F.pow(F.lit(2.0), F.col("k"))).cast("bigint")

    whole = F.pow(F.lit(2.0), F.col("k")).cast("bigint")
    none = F.lit(None)
    # An event can only matter to spans of smaller events: classes up to its own.
    # Of one instant the largest is in all classes of the others.
    instants = materialize(events.groupBy("us").agg(F.max_by(F.struct("k", "mag"), F.struct("k", "mag")).alias("x")))
    data = (instants.select(F.explode(F.sequence(classes["lowest"], F.col("x.k"))).alias("k"), F.col("us").alias("pos"),
                            F.col("x.mag").alias("mag"))
            .select("k", "pos", "mag", none.cast("bigint").alias("seq"), F.lit("data").alias("kind")))
    starts = events.select("k", F.col("us").alias("pos"), none.cast("double").alias("mag"), "seq",
                           F.lit("start").alias("kind"))
    first, last = slot(F.col("us")), slot(F.col("end"))
    ends = events.select("k", F.explode(F.when(last - first > 1, F.array("end", (first + 2) * whole - 1))
                                        .otherwise(F.array("end"))).alias("pos"),
                         none.cast("double").alias("mag"), "seq", F.lit("end").alias("kind"))
    rows = data.unionByName(starts).unionByName(ends).withColumns({
        "slot": slot(F.col("pos")),
        "ahead": F.when(F.col("kind") == "data", 0).otherwise(1),
        "back": F.when(F.col("kind") == "data", 1).otherwise(0)})
    # Where all slots are small, plain windows over them need one shuffle.
    parts = (Ordered(rows.withColumn(CHUNK, F.lit(0).cast("bigint")), ("pos",), 1) if sparse
             else chunked(rows, ("pos",), rows_per_chunk, split_ties=False))
    ahead = running(Ordered(parts.df, ("pos", "ahead"), parts.chunks), ["k", "slot"],
                    {"upto": ("max", F.col("mag"))}, keep_chunk=True)
    both = running(Ordered(ahead, ("pos", "back"), parts.chunks), ["k", "slot"],
                   {"from": ("max", F.col("mag"))}, reverse=True)
    best = F.when(F.col("kind") == "start", F.col("from")).otherwise(F.col("upto"))
    largest = (both.where(F.col("kind") != "data").groupBy("seq").agg(F.max(best).alias("_largest")))
    joined = df.join(largest, "seq", "left")
    larger = F.coalesce(F.col("_largest") > F.col("mag"), F.lit(False))
    return joined.withColumns({
        "is_aftershock": F.when(larger, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        "mainshock_mag": F.when(larger, F.col("_largest")).otherwise(F.col("mag")),
    }).drop("_largest")


def since_last(df: DataFrame, mag_min: float = 5.0, default_s: int = 31_536_000,
               keys: list[str] = (), name: str = "time_since_last_M5",
               rows_per_chunk: int | None = None) -> DataFrame:
    """Whole seconds since the last event of at least ``mag_min`` before."""
    keys = list(keys)
    timed = df.withColumn("_us", F.unix_micros("time"))
    instants = timed.groupBy(*keys, "_us").agg(F.max(F.col("mag") >= mag_min).alias("_big"))
    found = running(instants, keys, {"_last": ("max", F.when(F.col("_big"), F.col("_us")))}, ("_us",),
                    exclusive=True, rows_per_chunk=rows_per_chunk).drop("_big")
    # A missing zone is a zone of its own, so keys compare null-safe.
    right = found.select("_last", *[F.col(c).alias(f"_r_{c}") for c in [*keys, "_us"]])
    match = F.lit(True)
    for c in [*keys, "_us"]:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = timed.join(right, match, "left").drop(*[f"_r_{c}" for c in [*keys, "_us"]])
    seconds = F.floor((F.col("_us") - F.col("_last")) / F.lit(1e6)).cast("bigint")
    return (joined.withColumn(name, F.coalesce(seconds, F.lit(default_s).cast("bigint")))
            .drop("_us", "_last"))


def majors_ahead(df: DataFrame, mag_min: float = 5.0, days: int = 7, keys: list[str] = (),
                 rows_per_chunk: int | None = None) -> DataFrame:
    """Count, seconds to the first and magnitude of the largest of the large events in the next ``days`` of the zone.

    Adds ``majors_ahead, first_major_s, largest_major`` (0 and nulls without any). No pairs are made:
    the span is the rest of one time slot and the beginning of the next, both from running totals.
    """
    keys, span = list(keys), days * DAY_US
    us = F.unix_micros("time")
    base = df.select(*keys, "seq", us.alias("pos"), "mag")
    none = {"at": F.lit(None).cast("bigint"), "size": F.lit(None).cast("double")}
    majors = base.where(F.col("mag") >= mag_min).withColumns(
        {"tie": F.col("seq"), "kind": F.lit(0), "at": F.col("pos"), "size": F.col("mag")})
    begins = base.withColumns({"tie": F.col("seq"), "kind": F.lit(1), **none})
    ends = base.withColumns({"pos": F.col("pos") + span, "tie": F.lit(2 ** 62), "kind": F.lit(2), **none})
    rows = majors.unionByName(begins).unionByName(ends).withColumn("slot", _bucket(F.col("pos"), span)).drop("mag")
    totals = {"n": ("sum", F.when(F.col("kind") == 0, F.lit(1).cast("bigint"))), "first": ("min", F.col("at")),
              "big": ("max", F.col("size"))}
    found = []
    for asked, reverse in ((1, True), (2, False)):
        ran = running(rows.where(F.col("kind").isin(0, asked)), [*keys, "slot"], totals, ("pos", "tie", "kind"),
                      reverse=reverse, exclusive=True, rows_per_chunk=rows_per_chunk)
        found.append(ran.where(F.col("kind") == asked).select("seq", "n", "first", "big"))
    both = found[0].unionAll(found[1]).groupBy("seq").agg(
        F.sum("n").alias("majors_ahead"), F.min("first").alias("_first"), F.max("big").alias("largest_major"))
    return df.join(both, "seq", "left").withColumns({
        "majors_ahead": F.coalesce("majors_ahead", F.lit(0).cast("bigint")),
        "first_major_s": F.floor((F.col("_first") - us) / F.lit(1e6)).cast("bigint")}).drop("_first")


def future_majors(df: DataFrame, mag_min: float = 5.0, days: int = 7, keys: list[str] = (),
                  asked: DataFrame | None = None) -> DataFrame:
    """All large events of the next ``days`` of the same zone, with the delay.

    A row per event and large event; ``asked`` (rows with ``id``) names the events
    wanted. For the whole of a busy catalog see :func:`majors_ahead`. Large events,
    the few, are copied into two time buckets.
    """
    keys, span = list(keys), days * DAY_US
    majors = df.where(F.col("mag") >= mag_min).select(
        *keys, F.col("id").alias("major_id"), F.col("mag").alias("major_mag"),
        F.col("seq").alias("major_seq"), F.unix_micros("time").alias("major_us"))
    slots = F.sequence(_bucket(F.col("major_us") - span, span), _bucket(F.col("major_us"), span))
    copied = majors.withColumn("_slot", F.explode(slots))
    events = df.select(*keys, "id", "seq", F.unix_micros("time").alias("us"))
    if asked is not None:
        events = events.join(asked.select("id").distinct(), "id", "left_semi")
    placed = events.withColumn("_slot", _bucket(F.col("us"), span))
    gap = F.col("major_us") - F.col("us")
    after = (gap > 0) | ((gap == 0) & (F.col("major_seq") > F.col("seq")))
    pairs = placed.join(copied.hint("merge"), [*keys, "_slot"]).where(after & (gap <= span))
    seconds = F.floor(gap / F.lit(1e6)).cast("bigint")
    return pairs.select(
        *keys, "id", "major_id", "major_mag", F.floor(seconds / 86400).alias("days_after"),
        F.floor((seconds % 86400) / 3600).alias("hours"), F.floor((seconds % 3600) / 60).alias("minutes"))


def missing_ids(listed: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Listed ids that are not stored, once each."""
    return listed.select(key).distinct().join(stored.select(key), key, "left_anti")
