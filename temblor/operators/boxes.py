"""Totals over a box in space and a span of time, without pairs where it is crowded.

A catalog is cut into blocks: cells as wide as the box reaches, and time slots as
long as its span. Places in sparse blocks meet the events around them as pairs.
A crowded block is ordered along both axes by its own split points, whose leaves
form a binary tree per axis. What a box covers of the block is a range of leaves
on each axis, so a few tree nodes on each; for each pair of nodes the running
totals over time answer. Only the leaf that a box edge cuts is paired, on each
axis. The span reaches into two slots: the end of one and the start of the next,
and both are running totals, forwards and backwards.

Work on a crowded block with n places grows as n log(n)^2, not as n^2. Trees are for
the largest blocks, as every place and event stands in many nodes, each a row that
is written. Crowded blocks up to some thousand places (``BITMAP``) go to a task
whole, with the events that look at them: a place is a bit, and what a box leaves of
a block is the AND of a few bitmaps, 64 places at a time. Nothing but the places and
events themselves is written there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.operators.ordered import CHUNK, ROWS_PER_CHUNK, Ordered, running
from temblor.session import materialize, share_code

BLOCK = ["cx", "cy", "slot"]
NODE = ["hx", "nx", "hy", "ny"]
#: Split points of a block on each axis are 2 ** DEEPEST - 1 at most.
DEEPEST = 10
#: Crowded blocks that are broadcast with their split points (some 16 KB each); beyond that they are joined.
MOST_BROADCAST = 2_000
TOTALS = ("_n", "_sum", "_max", "_last")
#: Blocks of this many places, from a word to tables of some 50 MB, are answered by bitmaps.
BITMAP = (64, 8192)
#: Places of a block beyond which bitmaps are cheaper than pairs.
PAIRED = 256
#: Cells along each axis whose blocks of one slot go to a task together.
TOGETHER = 4
AREA = ["ax", "ay", "slot"]
#: Events around such cells beyond which they are dealt over several tasks.
MOST_EVENTS = 200_000
#: Events that meet the blocks of a task at once, and that meet one block at once.
AT_ONCE, IN_CACHE = 1 << 15, 1 << 11


def bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("bigint")


def fold(rows: DataFrame, n="b_n", total="b_sum", most="b_max", last="b_us", key="p_seq") -> DataFrame:
    """Totals by event."""
    return rows.groupBy(F.col(key).alias("seq")).agg(
        F.sum(n).alias("_n"), F.sum(total).alias("_sum"), F.max(most).alias("_max"), F.max(last).alias("_last"))


def in_box(span: int, degrees: float) -> Column:
    return (
        (F.col("b_us") >= F.col("p_us") - span) & (F.col("b_us") < F.col("p_us"))
        & F.col("b_lat").between(F.col("p_lat") - degrees, F.col("p_lat") + degrees)
        & F.col("b_lon").between(F.col("p_lon") - degrees, F.col("p_lon") + degrees)
    )


def with_block(places: DataFrame, span: int, degrees: float) -> DataFrame:
    return places.withColumns({"cx": bucket(F.col("b_lon"), degrees), "cy": bucket(F.col("b_lat"), degrees),
                               "slot": bucket(F.col("b_us"), span)})


def crowded_blocks(placed: DataFrame, crowded: int) -> DataFrame:
    """Blocks with more than ``crowded`` places, and their count."""
    return materialize(placed.groupBy(*BLOCK).count().where(F.col("count") > crowded))


def _split_points(dense: DataFrame, blocks: DataFrame, leaf: int) -> DataFrame:
    """By block ``xs, ys``: points that cut it into parts of about ``leaf`` places along each axis."""
    shares = [k / 2 ** DEEPEST for k in range(1, 2 ** DEEPEST)]
    found = dense.groupBy(*BLOCK).agg(*[F.percentile_approx(c, shares, 2 ** (DEEPEST + 2)).alias(o)
                                        for c, o in (("b_lon", "xs"), ("b_lat", "ys"))])
    depth = F.least(F.lit(DEEPEST), F.greatest(F.lit(1), F.ceil(F.log2(F.col("count") / F.lit(float(leaf))))))
    step = F.pow(F.lit(2.0), F.lit(DEEPEST) - depth).cast("int")

    def picked(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.filter(name, lambda _, i: (i + 1) % step == 0)))

    return materialize(found.join(blocks, BLOCK).select(*BLOCK, picked("xs").alias("xs"), picked("ys").alias("ys")))


def _leaf(points: str, value: Column) -> Column:
    """Leaves alternate between what lies between split points (even) and the points themselves (odd)."""
    below = F.size(F.filter(points, lambda s: s < value))
    return (below + F.size(F.filter(points, lambda s: s <= value))).cast("int")


def _height(points: str) -> Column:
    """Of the tree over the leaves of an axis."""
    return F.ceil(F.log2((2 * F.size(points) + 1).cast("double"))).cast("int")


def _node(height: Column, number: Column) -> Column:
    return F.struct(height.cast("int").alias("h"), number.cast("int").alias("n"))


def _axis(top: str, at: str, side: Column) -> Column:
    """``nodes, edge``: what a box covers of a block's axis, and the leaf it cuts (-1 for none).

    ``top`` is the height of the axis and ``at`` the leaf where the box ends; both are columns, as an
    expression would be worked out again for every node. ``side`` is the block's place beside the
    event's: 0 is covered whole, one above ends at the box's upper end, one below begins at the lower.
    """
    heights = F.sequence(F.lit(0), F.col(top) - 1)
    odd = F.col(at) % 2 == 1

    def bit(number: Column, k: Column) -> Column:
        return F.floor(number / F.pow(F.lit(2.0), k)).cast("int") % 2

    def up(number: Column, k: Column) -> Column:
        return F.floor(number / F.pow(F.lit(2.0), k)).cast("int")

    upto = F.when(odd, F.col(at) + 1).otherwise(F.col(at))
    after = F.when(odd, F.col(at) - 1).otherwise(F.col(at))
    lower = F.transform(F.filter(heights, lambda k: bit(upto, k) == 1), lambda k: _node(k, up(upto, k) - 1))
    upper = F.transform(F.filter(heights, lambda k: bit(after, k) == 0), lambda k: _node(k, up(after, k) + 1))
    nodes = F.when(side > 0, lower).when(side < 0, upper).otherwise(F.array(_node(F.col(top), F.lit(0))))
    edge = F.when((side == 0) | odd, F.lit(-1)).otherwise(F.col(at))
    return F.struct(nodes.alias("nodes"), edge.cast("int").alias("edge"))


def dense_rows(probe: DataFrame, placed: DataFrame, blocks: DataFrame, span: int, degrees: float,
               leaf: int) -> tuple[DataFrame, DataFrame]:
    """Places of the crowded blocks with their leaves, and the events that look at them."""
    dense = placed.join(blocks.select(*BLOCK), BLOCK, "left_semi")
    points = _split_points(dense, blocks, leaf)
    if points.count() <= MOST_BROADCAST:
        points = F.broadcast(points)
    data = dense.join(points, BLOCK).select(
        *dense.columns, _leaf("xs", F.col("b_lon")).alias("ix"), _leaf("ys", F.col("b_lat")).alias("iy"),
        _height("xs").alias("tx"), _height("ys").alias("ty"))

    def around(name: str) -> Column:
        return F.sequence(bucket(F.col(name) - degrees, degrees), bucket(F.col(name) + degrees, degrees))

    first = bucket(F.col("p_us") - span, span)
    # An event looks at up to 18 blocks, each with work of its own, so a file read by one task is dealt out.
    spread = probe.repartition(probe.sparkSession.sparkContext.defaultParallelism, "p_seq") if (
        probe.rdd.getNumPartitions() < probe.sparkSession.sparkContext.defaultParallelism) else probe
    looks = (spread.withColumns({"at_x": bucket(F.col("p_lon"), degrees), "at_y": bucket(F.col("p_lat"), degrees)})
             .withColumn("cx", F.explode(around("p_lon"))).withColumn("cy", F.explode(around("p_lat")))
             .withColumn("slot", F.explode(F.array(first, first + 1))))
    sides = {"sx": F.col("cx") - F.col("at_x"), "sy": F.col("cy") - F.col("at_y")}

    def end(side: str, value: str) -> Column:
        return F.when(F.col(side) > 0, F.col(value) + degrees).otherwise(F.col(value) - degrees)

    met = looks.join(points, BLOCK).withColumns(sides).select(
        *BLOCK, "p_seq", "p_us", "p_lat", "p_lon", (F.col("slot") == first).alias("ends"), "sx", "sy",
        _height("xs").alias("tx"), _height("ys").alias("ty"),
        _leaf("xs", end("sx", "p_lon")).alias("lx"), _leaf("ys", end("sy", "p_lat")).alias("ly"))
    # The leaves are stored first: the nodes look at them again and again.
    asked = materialize(met).select(
        *BLOCK, "p_seq", "p_us", "p_lat", "p_lon", "ends",
        _axis("tx", "lx", F.col("sx")).alias("x"), _axis("ty", "ly", F.col("sy")).alias("y"))
    return materialize(data), materialize(asked)


def edge_pairs(data: DataFrame, asked: DataFrame, span: int, degrees: float) -> DataFrame:
    """Pairs of events with the places in the leaves their boxes cut."""
    event = ["p_seq", "p_us", "p_lat", "p_lon"]
    place = ["b_us", "b_lat", "b_lon", "b_n", "b_sum", "b_max"]
    by_x = (asked.where(F.col("x.edge") >= 0).select(*BLOCK, *event, F.col("x.edge").alias("ix"))
            .join(data.select(*BLOCK, *place, "ix").hint("merge"), [*BLOCK, "ix"]).select(*event, *place))
    by_y = (asked.where(F.col("y.edge") >= 0)
            .select(*BLOCK, *event, F.col("y.edge").alias("iy"), F.col("x.edge").alias("done"))
            .join(data.select(*BLOCK, *place, "ix", "iy").hint("merge"), [*BLOCK, "iy"])
            .where(F.col("ix") != F.col("done")).select(*event, *place))
    return by_x.unionAll(by_y).where(in_box(span, degrees))


def node_rows(data: DataFrame, asked: DataFrame, span: int) -> DataFrame:
    """Places by all nodes above their leaves, and events by the nodes their boxes cover, in order of time.

    An event comes before the places of its instant: those before it are its past
    in the slot, those after it (it stands a span earlier then) the rest of the slot.
    """
    def above(leaf: str, top: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(top)),
                           lambda k: _node(k, F.floor(F.col(leaf) / F.pow(F.lit(2.0), k))))

    held = (data.withColumn("x", F.explode(above("ix", "tx"))).withColumn("y", F.explode(above("iy", "ty")))
            .groupBy(*BLOCK, F.col("x.h").alias("hx"), F.col("x.n").alias("nx"), F.col("y.h").alias("hy"),
                     F.col("y.n").alias("ny"), F.col("b_us").alias("pos"))
            .agg(F.sum("b_n").alias("b_n"), F.sum("b_sum").alias("b_sum"), F.max("b_max").alias("b_max"))
            .withColumns({"b_us": F.col("pos"), "tie": F.lit(2 ** 62)}))
    wanted = (asked.withColumn("x", F.explode("x.nodes")).withColumn("y", F.explode("y.nodes"))
              .select(*BLOCK, F.col("x.h").alias("hx"), F.col("x.n").alias("nx"), F.col("y.h").alias("hy"),
                      F.col("y.n").alias("ny"), F.when(F.col("ends"), F.col("p_us") - span).otherwise(F.col("p_us")).alias("pos"),
                      F.col("p_seq").alias("tie"), "p_seq", "ends"))
    return held.unionByName(wanted, allowMissingColumns=True)


def _node_totals(rows: DataFrame, rows_per_chunk: int | None) -> DataFrame:
    """Running totals by node; only nodes with more rows than a chunk are cut along time.

    A node lies in one block, so nearly all have few rows, which a plain window takes;
    chunks over all of them would be as many as the rows ask for.
    """
    keys, order = [*BLOCK, *NODE], ("pos", "tie")
    totals = {"n": ("sum", F.col("b_n")), "sum": ("sum", F.col("b_sum")), "max": ("max", F.col("b_max")),
              "last": ("max", F.col("b_us"))}
    large = materialize(rows.groupBy(*keys).count().where(F.col("count") > (rows_per_chunk or ROWS_PER_CHUNK)))
    parts = [(rows, None)]
    if not large.isEmpty():
        names = large.select(*keys)
        parts = [(rows.join(names.hint("merge"), keys, "left_anti"), None),
                 (materialize(rows.join(names.hint("merge"), keys, "left_semi")), rows_per_chunk)]
    found = []
    for part, chunk in parts:
        for ends in (True, False):
            side = part.where(F.col("p_seq").isNull() | (F.col("ends") == ends))
            whole = Ordered(side.withColumn(CHUNK, F.lit(0).cast("bigint")), order, 1)
            ran = running(whole if part is parts[0][0] else side, keys, {f"r_{k}": v for k, v in totals.items()}, order,
                          reverse=ends, exclusive=True, rows_per_chunk=chunk)
            found.append(ran.where(F.col("p_seq").isNotNull()).select("p_seq", *[f"r_{k}" for k in totals]))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return fold(every, "r_n", "r_sum", "r_max", "r_last")


def _prefixes(bits: np.ndarray) -> np.ndarray:
    """Row k has the first k of the given bits set."""
    table = np.zeros((len(bits) + 1, (len(bits) + 63) // 64), dtype=np.uint64)
    table[np.arange(1, len(bits) + 1), bits >> 6] = np.uint64(1) << (bits & 63).astype(np.uint64)
    return np.bitwise_or.accumulate(table, axis=0, out=table)


class Bitmaps:
    """The places of a block as bits, once in order of time and once by size, and the first bits along each axis."""

    def __init__(self, us: np.ndarray, lat: np.ndarray, lon: np.ndarray, n: np.ndarray, total: np.ndarray,
                 most: np.ndarray, known: np.ndarray):
        count = len(us)
        by_time = np.argsort(us, kind="stable")
        # The largest first, NaN above all numbers, places without a size last.
        by_size = np.lexsort((np.where(np.isnan(most), -np.inf, -most), ~(known & np.isnan(most)), ~known))
        self.axes, self.layouts = [], ([], [])
        place = [np.empty(count, dtype=np.int64) for _ in range(2)]
        for at, order in zip(place, (by_time, by_size)):
            at[order] = np.arange(count)
        for values in (us, lat, lon):
            order = np.argsort(values, kind="stable")
            self.axes.append(values[order])
            for tables, at in zip(self.layouts, place):
                tables.append(_prefixes(at[order]))
        self.us, self.most, self.known = us[by_time], most[by_size], known[by_size]
        size = self.layouts[0][0].shape[1] * 8
        choice = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").T

        def by_byte(values: np.ndarray) -> np.ndarray:
            """Sums for all values of each byte."""
            padded = np.zeros(size * 8, dtype=values.dtype)
            padded[:count] = values
            return padded.reshape(size, 8) @ choice.astype(values.dtype)

        total = np.where(known, total, 0.0)[by_time]
        self.odd = [(k, total[k]) for k in np.flatnonzero(~np.isfinite(total)).tolist()]
        self.totals = by_byte(np.where(np.isfinite(total), total, 0.0))
        self.counts = by_byte(n[by_time]) if (n != 1).any() else None

    def _left(self, layout: list[np.ndarray], ranges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        found = None
        for table, (low, high) in zip(layout, ranges):
            bits = table[high]
            cut = np.flatnonzero(low)
            bits[cut] ^= table[low[cut]]
            found = bits if found is None else np.bitwise_and(found, bits, out=found)
        return found

    def ask(self, us: np.ndarray, lat: np.ndarray, lon: np.ndarray, span: int, degrees: float):
        """``event, n, total, most, known, last`` of the events that have places in their boxes."""
        limits = ((us - span, us, "left"), (lat - degrees, lat + degrees, "right"),
                  (lon - degrees, lon + degrees, "right"))
        ranges = [(np.searchsorted(values, low, "left"), np.searchsorted(values, high, side))
                  for values, (low, high, side) in zip(self.axes, limits)]
        near = np.flatnonzero(np.logical_and.reduce([high > low for low, high in ranges]))
        for begin in range(0, len(near), IN_CACHE):
            event = near[begin:begin + IN_CACHE]
            part = [(low[event], high[event]) for low, high in ranges]
            bits = self._left(self.layouts[0], part)
            some = bits.any(axis=1)
            if not some.any():
                continue
            event, bits, part = event[some], bits[some], [(low[some], high[some]) for low, high in part]
            rows, width = np.arange(len(event)), bits.shape[1]
            word = width - 1 - (bits[:, ::-1] != 0).argmax(axis=1)
            value = bits[rows, word]
            upper = value >> np.uint64(32)
            top = np.where(upper > 0, np.frexp(upper.astype(np.float64))[1] + 32,
                           np.frexp((value & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]) - 1
            last = self.us[word * 64 + top]
            by_byte = np.ascontiguousarray(bits.view(np.uint8).T)
            total = np.zeros(len(event))
            n = None if self.counts is None else np.zeros(len(event), dtype=np.int64)
            for k, byte in enumerate(by_byte):
                total += self.totals[k].take(byte)
                if n is not None:
                    n += self.counts[k].take(byte)
            if n is None:
                n = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            with np.errstate(invalid="ignore"):
                for k, x in self.odd:
                    total[(bits[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1) != 0] += x
            bits = self._left(self.layouts[1], part)
            word = (bits != 0).argmax(axis=1)
            value = bits[rows, word]
            first = word * 64 + np.frexp((value & (~value + np.uint64(1))).astype(np.float64))[1] - 1
            yield event, n, total, self.most[first], self.known[first], last


#: Sums and sizes that are NaN, and totals without any size, as bits of ``odd``: pandas has one mark for NaN and null.
NAN_SUM, NAN_MAX, NO_SIZE = 1, 2, 4


def _area_totals(places: dict[str, np.ndarray], events: dict[str, np.ndarray], span: int,
                 degrees: float) -> pd.DataFrame:
    """Totals of events over the blocks of an area."""
    count = len(events["us"])
    n, last, total = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).min), np.zeros(count)
    most, known = np.full(count, -np.inf), np.zeros(count, bool)
    border = np.flatnonzero((np.diff(places["cx"]) != 0) | (np.diff(places["cy"]) != 0)) + 1
    for begin, end in zip([0, *border.tolist()], [*border.tolist(), len(places["us"])]):
        part = {k: v[begin:end] for k, v in places.items()}
        block = Bitmaps(part["us"], part["lat"], part["lon"], part["n"] >> 1, part["total"], part["most"],
                        (part["n"] & 1) == 1)
        for event, m, s, x, sized, at in block.ask(events["us"], events["lat"], events["lon"], span, degrees):
            with np.errstate(invalid="ignore"):
                total[event] += s
            n[event] += m
            last[event] = np.maximum(last[event], at)
            most[event] = np.where(sized, np.maximum(most[event], x), most[event])
            known[event] |= sized
    some = n > 0
    odd = np.isnan(total) * NAN_SUM + np.isnan(most) * NAN_MAX + ~known * NO_SIZE
    return pd.DataFrame({"seq": events["n"], "_n": n, "_sum": total, "_max": most, "_last": last,
                         "odd": odd.astype(np.int32)})[some]


def _area_tasks(span: int, degrees: float, at_once: int):
    """Places of an area come first, then its events, about ``at_once`` together."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, places, events, waiting = None, [], [], 0

        def joined(parts):
            return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

        def answers():
            if places and events:
                yield _area_totals(joined(places), joined(events), span, degrees)

        for frame in frames:
            by = frame[[*AREA, "share", "kind"]].to_numpy()
            data = {k: frame[k].to_numpy() for k in ("cx", "cy", "us", "lat", "lon", "n", "total", "most")}
            border = (np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1).tolist()
            for begin, end in zip([0, *border], [*border, len(by)]):
                if begin == end:
                    continue
                *at, kind = by[begin].tolist()
                if at != key:
                    yield from answers()
                    key, places, events, waiting = at, [], [], 0
                (events if kind else places).append({k: v[begin:end] for k, v in data.items()})
                waiting += (end - begin) * kind
                if waiting >= at_once:
                    yield from answers()
                    events, waiting = [], 0
        yield from answers()

    return run


def bitmap_totals(probe: DataFrame, placed: DataFrame, blocks: DataFrame, span: int, degrees: float) -> DataFrame:
    """Totals by event over the places of the given blocks, each block in one task."""
    share_code(probe.sparkSession)

    def area(cell: Column) -> Column:
        return F.floor(cell / F.lit(TOGETHER)).cast("bigint")

    def areas(name: str) -> Column:
        return F.sequence(area(bucket(F.col(name) - degrees, degrees)), area(bucket(F.col(name) + degrees, degrees)))

    held = placed.join(blocks.select(*BLOCK), BLOCK, "left_semi").withColumns(
        {"ax": area(F.col("cx")), "ay": area(F.col("cy"))})
    wanted = blocks.select(area(F.col("cx")).alias("ax"), area(F.col("cy")).alias("ay"), "slot").distinct()
    slots = F.sequence(bucket(F.col("p_us") - span, span), bucket(F.col("p_us") - 1, span))
    asked = (probe.where("p_seq is not null").withColumn("ax", F.explode(areas("p_lon")))
             .withColumn("ay", F.explode(areas("p_lat"))).withColumn("slot", F.explode(slots))
             .join(wanted, AREA, "left_semi"))
    # One row per area with very many events, so few.
    busy = materialize(asked.groupBy(*AREA).count().where(F.col("count") > MOST_EVENTS).select(
        *AREA, F.ceil(F.col("count") / F.lit(MOST_EVENTS)).alias("shares")))
    shares = F.coalesce("shares", F.lit(1))
    none, zero = F.lit(0.0), F.lit(0).cast("bigint")
    share = F.explode(F.sequence(zero, shares - 1))
    places = held.join(F.broadcast(busy), AREA, "left").select(
        *AREA, share.alias("share"), F.lit(0).alias("kind"), "cx", "cy", F.col("b_us").alias("us"),
        F.col("b_lat").cast("double").alias("lat"), F.col("b_lon").cast("double").alias("lon"),
        (F.col("b_n") * 2 + F.col("b_max").isNotNull().cast("bigint")).alias("n"),
        F.coalesce(F.col("b_sum").cast("double"), none).alias("total"),
        F.coalesce(F.col("b_max").cast("double"), none).alias("most"))
    events = asked.join(F.broadcast(busy), AREA, "left").select(
        *AREA, F.pmod(F.xxhash64("p_seq"), shares).alias("share"), F.lit(1).alias("kind"), zero.alias("cx"),
        zero.alias("cy"), F.col("p_us").alias("us"), F.col("p_lat").cast("double").alias("lat"),
        F.col("p_lon").cast("double").alias("lon"),
        F.col("p_seq").cast("bigint").alias("n"), none.alias("total"), none.alias("most"))
    rows = places.unionByName(events).repartition(*AREA, "share").sortWithinPartitions(
        *AREA, "share", "kind", "cx", "cy")
    found = rows.mapInPandas(_area_tasks(span, degrees, AT_ONCE),
                             "seq bigint, _n bigint, _sum double, _max double, _last bigint, odd int")

    def real(name: str, mark: int) -> Column:
        """With NaN and null where they are marked."""
        return (F.when(F.col("odd").bitwiseAND(NO_SIZE) > 0, None).when(F.col("odd").bitwiseAND(mark) > 0, float("nan"))
                .otherwise(F.col(name)).alias(name))

    return fold(found.select("seq", "_n", real("_sum", NAN_SUM), real("_max", NAN_MAX), "_last"), *TOTALS, key="seq")


def box_totals(probe: DataFrame, places: DataFrame, pairs, span: int, degrees: float, crowded: int,
               rows_per_chunk: int | None = None) -> DataFrame:
    """``seq, _n, _sum, _max, _last`` over the places in the box before each event.

    ``probe`` has ``p_seq, p_us, p_lat, p_lon``, ``places`` has ``b_us, b_lat, b_lon`` and the
    totals ``b_n, b_sum, b_max`` of each; ``pairs(probe, places, few)`` joins the sparse blocks, with ``few``
    where there are crowded ones besides.
    """
    placed = with_block(places, span, degrees)
    fits = F.col("count").between(*BITMAP)
    blocks = crowded_blocks(placed, min(crowded, PAIRED)).where(fits | (F.col("count") > crowded))
    if blocks.isEmpty():
        return fold(pairs(probe, places, False))
    sparse = placed.join(blocks.select(*BLOCK), BLOCK, "left_anti").drop(*BLOCK)
    parts = [fold(pairs(probe, sparse, True))]
    whole, large = blocks.where(fits), blocks.where(~fits)
    if not whole.isEmpty():
        parts.append(bitmap_totals(probe, placed, whole, span, degrees))
    if not large.isEmpty():
        data, asked = dense_rows(probe, placed, large, span, degrees, max(1, math.ceil(crowded / 8)))
        parts += [fold(edge_pairs(data, asked, span, degrees)),
                  _node_totals(materialize(node_rows(data, asked, span)), rows_per_chunk)]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return fold(every, *TOTALS, key="seq")
