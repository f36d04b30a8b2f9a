"""Chunked windows must equal plain ones, also with ties and a busy group."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from temblor.operators import ordered, rangejoin, temporal
from temblor.operators.quantiles import average_rank, exact_quantiles, ranked_quantiles


def by_region():
    return Window.partitionBy("region_code").orderBy("time", "seq")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select("seq", *columns).collect())


@pytest.mark.parametrize("size", [10_000, 60, 7])
def test_row_index(events, size):
    got = ordered.row_index(events, ["region_code"], rows_per_chunk=size)
    assert rows(got, "idx") == rows(events.withColumn("idx", F.row_number().over(by_region()) - 1), "idx")
    whole = ordered.row_index(events, rows_per_chunk=size)
    assert sorted(r["idx"] for r in whole.collect()) == list(range(400))


@pytest.mark.parametrize("size", [10_000, 60, 7])
def test_frames_cross_chunk_borders(events, size):
    def make(w):
        return {"total": F.sum("seq").over(w.rowsBetween(-5, -1)), "nxt": F.lead("seq", 2).over(w),
                "prev": F.lag("seq", 3).over(w)}
    got = ordered.over_rows(events, ["region_code"], 5, 2, make, rows_per_chunk=size)
    assert got.count() == 400
    assert rows(got, "total", "nxt", "prev") == rows(events.withColumns(make(by_region())), "total", "nxt", "prev")


@pytest.mark.parametrize("size", [10_000, 50])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_totals(events, size, reverse, exclusive):
    totals = {"s": ("sum", F.col("seq")), "hi": ("max", F.col("mag")), "lo": ("min", F.col("mag"))}
    got = ordered.running(events, ["region_code"], totals, reverse=reverse, exclusive=exclusive, rows_per_chunk=size)
    order = [F.col("time").desc(), F.col("seq").desc()] if reverse else ["time", "seq"]
    frame = Window.partitionBy("region_code").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    want = events.withColumns({"s": F.sum("seq").over(frame), "hi": F.max("mag").over(frame),
                               "lo": F.min("mag").over(frame)})
    assert rows(got, "s", "hi", "lo") == rows(want, "s", "hi", "lo")


@pytest.mark.parametrize("size", [10_000, 45])
@pytest.mark.parametrize("frame", [1, 13, 64])
def test_trailing_blocks(events, size, frame):
    got = ordered.trailing_blocks(events, ["region_code"], frame, {
        "n": ("sum", F.lit(1).cast("bigint")), "s": ("sum", F.col("seq")), "lo": ("min", F.col("mag"))},
        rows_per_chunk=size)
    over = by_region().rowsBetween(-(frame - 1), 0)
    want = events.withColumns({"n": F.count(F.lit(1)).over(over), "s": F.sum("seq").over(over),
                               "lo": F.min("mag").over(over)})
    assert rows(got, "n", "s", "lo") == rows(want, "n", "s", "lo")


def test_chunks_split_one_crowded_instant(spark):
    """A third of the rows share one instant and still spread over chunks."""
    df = spark.range(3000).select(F.col("id").alias("seq"), F.timestamp_seconds(
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id"))).alias("time"))
    parts = ordered.chunked(df, rows_per_chunk=200)
    sizes = [r["count"] for r in parts.df.groupBy(ordered.CHUNK).count().collect()]
    assert max(sizes) <= 450 and sum(sizes) == 3000
    index = ordered.row_index(df, rows_per_chunk=200)
    want = df.withColumn("idx", F.row_number().over(Window.orderBy("time", "seq")) - 1)
    assert rows(index, "idx") == rows(want, "idx")


def test_empty_and_single_row(spark, events):
    nothing = events.limit(0)
    assert ordered.row_index(nothing, ["region_code"]).count() == 0
    assert temporal.since_prev(events.limit(1)).first()["time_since_last_event"] == 0.0


@pytest.mark.parametrize("size", [10_000, 30])
def test_quantiles(events, size):
    values = sorted(r["mag"] for r in events.collect())

    def exact(p):
        spot = p * (len(values) - 1)
        low = math.floor(spot)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (spot - low)

    got = exact_quantiles(events, ["mag", "depth"], [0.1, 0.5, 0.95]).first()["mag"]
    assert got == pytest.approx([exact(0.1), exact(0.5), exact(0.95)])
    ranked = ranked_quantiles(events, "mag", [0.0, 0.33, 1.0], rows_per_chunk=size).first()
    assert list(ranked) == pytest.approx([exact(0.0), exact(0.33), exact(1.0)])


@pytest.mark.parametrize("size", [10_000, 10])
def test_average_rank(events, size):
    got = {r["seq"]: r["rank"] for r in average_rank(events, "mag", rows_per_chunk=size).collect()}
    want = events.toPandas().set_index("seq")["mag"].rank(method="average").to_dict()
    assert got == pytest.approx(want)


@pytest.mark.parametrize("size", [10_000, 40])
def test_since_last_is_strictly_before(events, size):
    got = {r["seq"]: r["time_since_last_M5"] for r in
           rangejoin.since_last(events, keys=["region_code"], rows_per_chunk=size).collect()}
    data = [r.asDict() for r in events.collect()]
    for e in data:
        past = [x["time"] for x in data if x["region_code"] == e["region_code"] and x["mag"] >= 5
                and x["time"] < e["time"]]
        want = int((e["time"] - max(past)).total_seconds()) if past else 31_536_000
        assert got[e["seq"]] == want
