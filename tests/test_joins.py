"""Range joins and sequences against brute force."""

import math

import pytest
from pyspark.sql import functions as F

from temblor.operators import boxes, rangejoin, sequences

R = 6371.0


def local(df):
    return [r.asDict() for r in df.collect()]


def us(e):
    return round(e["time"].timestamp() * 1e6)


def chord(a, b):
    def xyz(e):
        la, lo = math.radians(e["latitude"]), math.radians(e["longitude"])
        return R * math.cos(la) * math.cos(lo), R * math.cos(la) * math.sin(lo), R * math.sin(la)
    return math.dist(xyz(a), xyz(b))


def arc(a, b):
    return 2 * R * math.asin(min(1.0, chord(a, b) / (2 * R)))


def brute_parents(data, radius=50.0, hours=72):
    out = {}
    for e in data:
        near = [p for p in data if us(p) < us(e) and us(p) >= us(e) - hours * 3_600_000_000
                and p["mag"] > e["mag"] and chord(p, e) <= radius]
        if near:
            out[e["seq"]] = max(near, key=lambda p: (us(p), p["seq"]))["seq"]
    return out


@pytest.mark.parametrize("densest", [None, 10_000, 100_000])
def test_parent_links_in_one_or_many_steps(events, densest):
    got = {r["seq"]: r["parent"] for r in rangejoin.nearest_earlier(events, densest=densest).collect()}
    assert got == brute_parents(local(events))


def test_time_steps_cover_the_span_once():
    steps = rangejoin.time_steps(1000, rangejoin.DENSE_BUCKET * 20)
    assert steps[0][0] == 0 and steps[-1][1] == 1000 and len(steps) == 6
    assert all(a[1] == b[0] for a, b in zip(steps, steps[1:]))
    assert rangejoin.time_steps(1000, 5) == [(0, 1000)]


def test_sequences(events):
    parents = brute_parents(local(events))
    data = {e["seq"]: e for e in local(events)}

    def root(seq):
        while seq in parents:
            seq = parents[seq]
        return seq

    for size in (None, 50):
        stats = local(sequences.sequence_stats(events, rows_per_chunk=size))
        assert len(stats) == len(data)
        heads = sorted({root(s) for s in data}, key=lambda s: (us(data[s]), s))
        number = {s: i + 1 for i, s in enumerate(heads)}
        for e in stats:
            head = root(e["seq"])
            members = sorted((s for s in data if root(s) == head), key=lambda s: (us(data[s]), s))
            assert e["sequence_id"] == number[head]
            assert e["seq_length"] == len(members)
            assert e["seq_position"] == members.index(e["seq"]) + 1
            assert e["seq_mainshock_mag"] == data[head]["mag"]
            assert e["is_seq_mainshock"] == int(head == e["seq"])
            assert e["time_since_seq_start_sec"] == (us(e) - us(data[head])) / 1e6 >= 0


def test_roots_of_a_long_chain_and_a_hot_root(spark):
    chain = [(i, i - 1) for i in range(1, 40)]
    star = [(1000 + i, 0) for i in range(500)]
    links = spark.createDataFrame(chain + star, "seq bigint, parent bigint")
    found = sequences.resolve_roots(links).collect()
    assert len(found) == 539 and {r["root"] for r in found} == {0}
    assert sequences.resolve_roots(links.limit(0)).count() == 0


@pytest.mark.parametrize("densest", [None, 50_000])
def test_shock_roles(events, densest):
    data = local(events)
    mains = sorted((e for e in data if e["mag"] >= 5.5), key=lambda e: (us(e), e["seq"]))
    got = {r["seq"]: r for r in rangejoin.shock_roles(events, densest=densest).collect()}
    for e in data:
        row = got[e["seq"]]
        if e["mag"] >= 5.5:
            assert (row["shock_role"], row["related_mainshock_id"]) == ("mainshock", e["id"])
            continue
        near = [m for m in mains if -7 * 86_400e6 <= us(e) - us(m) <= 30 * 86_400e6 and us(e) != us(m)
                and arc(m, e) <= 120]
        if not near:
            assert row["shock_role"] == "unclassified" and row["related_mainshock_id"] == ""
            continue
        best = min(near, key=lambda m: (abs(us(e) - us(m)), us(m), m["seq"]))
        assert row["related_mainshock_id"] == best["id"]
        assert row["shock_role"] == ("foreshock" if us(e) < us(best) else "aftershock")


@pytest.mark.parametrize("densest", [None, 50_000])
def test_shock_roles_without_a_sort_of_pairs(spark, densest):
    """Of all pairs one number is kept, so that a task holds a number per event; ties as before."""
    rows = [("late", 9, 1000, 6.0), ("twin b", 2, 400, 6.0), ("twin a", 2, 400, 7.0), ("none", None, 1000, 6.0),
            ("middle", 1, 700, 3.0), ("after", 3, 800, 3.0), ("same time", 4, 400, 3.0), ("first", 5, 100, 3.0),
            ("unknown", None, 500, 3.0)]
    frame = spark.createDataFrame([(*r, 10.0, 20.0) for r in rows],
                                  "id string, seq bigint, s bigint, mag double, latitude double, longitude double")
    events = frame.selectExpr("*", "timestamp_seconds(1000000000 + s) as time")
    roles = rangejoin.shock_roles(events, densest=densest)
    assert "SortAggregate" not in roles._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["shock_role"], r["related_mainshock_id"], r["hours_to_mainshock"]) for r in roles.collect()}
    assert got["middle"] == ("aftershock", "twin a", 300 / 3600)  # the earlier one, then by seq and id
    assert got["after"] == ("foreshock", "none", 200 / 3600)
    assert got["same time"] == ("foreshock", "none", 600 / 3600)
    assert got["first"] == ("foreshock", "twin a", 300 / 3600)
    assert got["unknown"] == ("unclassified", "", None)
    assert got["late"] == ("mainshock", "late", 0.0)


@pytest.mark.parametrize("size", [10_000, 60])
@pytest.mark.parametrize("unit", [1.0, 60.0, 5000.0])
def test_larger_follows(events, size, unit):
    data = local(events)
    got = {r["seq"]: r for r in rangejoin.larger_follows(events, unit, rows_per_chunk=size).collect()}
    for e in data:
        width = math.floor(max(10 ** (0.5 * e["mag"] - 1) * unit * 1e6, 1))
        larger = [x["mag"] for x in data if us(e) <= us(x) <= us(e) + width and x["mag"] > e["mag"]]
        assert got[e["seq"]]["is_aftershock"] == int(bool(larger))
        assert got[e["seq"]]["mainshock_mag"] == (max(larger) if larger else e["mag"])


@pytest.mark.parametrize("crowded,size", [(10_000, None), (1, 10_000), (1, 40)])
def test_history_in_box(events, crowded, size):
    data = local(events)
    found = rangejoin.history_in_box(events, 1, 0.5, crowded=crowded, rows_per_chunk=size)
    got = {r["seq"]: r for r in found.collect()}
    for e in data:
        past = [x for x in data if us(e) - 86_400_000_000 <= us(x) < us(e)
                and e["latitude"] - 0.5 <= x["latitude"] <= e["latitude"] + 0.5
                and e["longitude"] - 0.5 <= x["longitude"] <= e["longitude"] + 0.5]
        row = got[e["seq"]]
        assert row["hist_count_1d"] == len(past)
        if past:
            assert row["hist_mag_max_1d"] == max(x["mag"] for x in past)
            assert row["hist_mag_mean_1d"] == pytest.approx(sum(x["mag"] for x in past) / len(past))
            assert row["days_since_last"] == (us(e) - max(us(x) for x in past)) // 86_400_000_000
        else:
            assert (row["hist_mag_mean_1d"], row["days_since_last"]) == (0.0, 9999)


def test_parent_link_across_the_date_line(spark):
    rows = [("a", 0, 0, 0.0, 179.9, 5.0), ("b", 1, 3600, 0.0, -179.9, 4.0)]
    df = spark.createDataFrame(rows, "id string, seq bigint, s bigint, latitude double, longitude double, mag double")
    df = df.withColumn("time", F.timestamp_seconds("s"))
    assert [tuple(r) for r in rangejoin.nearest_earlier(df).collect()] == [(1, 0)]


def test_missing_ids(spark):
    listed = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    stored = spark.createDataFrame([("a",)], "id string")
    assert sorted(r["id"] for r in rangejoin.missing_ids(listed, stored).collect()) == ["b", "c"]


def test_history_of_two_crowded_neighbours_needs_few_pairs(spark):
    def made(n):
        k = F.col("seq")
        return spark.range(n).select(
            F.col("id").alias("seq"), F.timestamp_micros(k * 37 % 1009 * 10_000_000 + k).alias("time"),
            (k * 7919 % 4001 / 4001.0).alias("latitude"),
            F.when(k % 3 == 0, F.lit(0.25)).otherwise(k * 104_729 % 7993 / 3996.6).alias("longitude"),
            (k % 50 / 10.0).alias("mag"))

    counted = {}
    for n in (3000, 6000, 12_000):
        df = made(n)
        probe = df.selectExpr("seq as p_seq", "unix_micros(time) as p_us", "latitude as p_lat", "longitude as p_lon")
        places = df.selectExpr("unix_micros(time) as b_us", "latitude as b_lat", "longitude as b_lon", "1L as b_n",
                               "mag as b_sum", "mag as b_max")
        span = 5_000_000_000
        placed = boxes.with_block(places, span, 1.0)
        blocks = boxes.crowded_blocks(placed, 100)
        data, asked = boxes.dense_rows(probe, placed, blocks, span, 1.0, 25)
        everything = data.select("b_us", "b_lat", "b_lon").crossJoin(probe).where(boxes.in_box(span, 1.0)).count()
        counted[n] = boxes.edge_pairs(data, asked, span, 1.0).count(), everything
    assert counted[12_000][1] > 12 * counted[3000][1]  # what pairs would cost
    assert counted[12_000][0] < 6 * counted[3000][0]
    assert counted[12_000][0] < counted[12_000][1] / 8


@pytest.mark.parametrize("size", [None, 300])
def test_history_with_places_on_split_points(spark, size):
    rows = [(k, (k * 37 % 101) * 60_000_000, (k % 4) / 2.0, (k * 5 % 7) / 2.0 - 1.5, k % 9 / 2.0) for k in range(700)]
    df = spark.createDataFrame(rows, "seq bigint, us bigint, latitude double, longitude double, mag double").withColumn(
        "time", F.timestamp_micros("us"))
    found = {r["seq"]: r for r in rangejoin.history_in_box(df, 1, 0.5, crowded=8, rows_per_chunk=size).collect()}
    for seq, at, lat, lon, _ in rows:
        past = [x for x in rows if at - 86_400_000_000 <= x[1] < at and abs(x[2] - lat) <= 0.5 and abs(x[3] - lon) <= 0.5]
        assert found[seq]["hist_count_1d"] == len(past)
        assert found[seq]["hist_mag_max_1d"] == max((x[4] for x in past), default=0.0)
        assert found[seq]["hist_mag_mean_1d"] == pytest.approx(sum(x[4] for x in past) / max(1, len(past)))


@pytest.mark.parametrize("size", [None, 40])
def test_majors_ahead_equal_their_list(events, size):
    listed = {}
    named = events.where("region_code is not null")
    for r in rangejoin.future_majors(named, 4.0, keys=["region_code"]).collect():
        listed.setdefault(r["id"], []).append(r)
    found = local(rangejoin.majors_ahead(named, 4.0, keys=["region_code"], rows_per_chunk=size))
    assert len(found) == named.count()
    for e in found:
        rows = listed.get(e["id"], [])
        assert e["majors_ahead"] == len(rows)
        assert e["largest_major"] == max((r["major_mag"] for r in rows), default=None)
        first = min((r["days_after"] * 86400 + r["hours"] * 3600 + r["minutes"] * 60 for r in rows), default=None)
        assert (e["first_major_s"] is None) == (first is None)
        assert first is None or first == e["first_major_s"] // 60 * 60


def test_box_work_is_dealt_out_and_small_nodes_are_not_cut(spark, monkeypatch):
    from temblor.operators import boxes

    rows = [(k, f"2020-01-{k % 20 + 1:02d} 0{k % 10}:00:00", 0.3 * (k % 3), 0.1 * (k % 9), float(k % 5)) for k in range(120)]
    df = spark.createDataFrame(rows, "seq long, t string, latitude double, longitude double, mag double").select(
        "*", F.to_timestamp("t").alias("time")).drop("t").coalesce(1)
    kinds, parts = [], []
    run, dense = boxes.running, boxes.dense_rows

    def ran(data, *args, **named):
        kinds.append(isinstance(data, boxes.Ordered))
        return run(data, *args, **named)

    def asked(*args):
        found = dense(*args)
        parts.append(found[1].rdd.getNumPartitions())
        return found

    monkeypatch.setattr(boxes, "running", ran)
    monkeypatch.setattr(boxes, "dense_rows", asked)
    got = {}
    for size in (1000, 5):
        found = rangejoin.history_in_box(df, 3, 1.0, crowded=4, rows_per_chunk=size)
        got[size] = {r["seq"]: (r["hist_count_3d"], r["hist_mag_max_3d"], r["days_since_last"]) for r in found.collect()}
    assert kinds == [True, True, True, True, False, False]  # only nodes with more than five rows are cut
    assert min(parts) > 1 or spark.sparkContext.defaultParallelism == 1
    far = rangejoin.history_in_box(df, 3, 1.0, crowded=10 ** 6).collect()
    want = {r["seq"]: (r["hist_count_3d"], r["hist_mag_max_3d"], r["days_since_last"]) for r in far}
    assert got[1000] == want and got[5] == want


def test_parent_links_take_few_steps_and_skip_cubes_without_a_larger_event(spark):
    span = 72 * rangejoin.HOUR_US
    steps = rangejoin.few_steps(rangejoin.time_steps(span, 100_000))
    assert len(steps) == 4 and steps[0][0] == 0 and steps[-1][1] == span
    assert all(a[1] == b[0] for a, b in zip(steps, steps[1:]))
    assert rangejoin.few_steps([(0, 5)]) == [(0, 5)]
    rows = [(i, 1_000_000_000 + 60 * i, 10.0, 20.0 + 0.05 * (i % 3), 5.0 - (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "seq bigint, s bigint, latitude double, longitude double, mag double").selectExpr(
        "seq", "timestamp_seconds(s) as time", "latitude", "longitude", "mag")
    found = rangejoin.nearest_earlier(df)
    assert {r["seq"]: r["parent"] for r in found.collect()} == brute_parents(local(df))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()


def test_larger_follows_of_small_slots_is_not_cut_along_time(events):
    plan = rangejoin.larger_follows(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 2 and "_real" not in plan
    rows = events.unionByName(events.withColumn("seq", events["seq"] + 1000))  # of one instant the largest counts
    data = local(rows)
    got = {r["seq"]: r["mainshock_mag"] for r in rangejoin.larger_follows(rows, 60.0).collect()}
    for e in data:
        width = math.floor(max(10 ** (0.5 * e["mag"] - 1) * 6e7, 1))
        assert got[e["seq"]] == max([x["mag"] for x in data if us(e) <= us(x) <= us(e) + width] + [e["mag"]])


def test_history_by_bitmaps_equals_pairs(spark, monkeypatch):
    k = F.col("id")
    mag = (F.when(k % 11 == 0, None).when(k % 97 == 1, float("nan")).when(k % 89 == 2, float("inf"))
           .otherwise(k * 31 % 70 / 10.0))
    rows = spark.range(900).select(
        k.alias("seq"), F.timestamp_micros(k * 37 % 211 * 1_500_000_000).alias("time"),
        (k * 17 % 40 / 20.0 - 1).alias("latitude"), (k * 29 % 60 / 20.0 - 1).alias("longitude"), mag.alias("mag"))
    rows = rows.unionAll(rows.where("seq % 7 = 0")).unionAll(rows.where("seq = 5").withColumn("seq", F.lit(None)))
    names = ["seq", "hist_count_2d", "hist_mag_mean_2d", "hist_mag_max_2d", "days_since_last"]

    def taken(frame):
        return sorted(((repr(r[0]), r[1], repr(round(r[2], 9)), repr(r[3]), r[4]) for r in frame.select(names).collect()))

    want = taken(rangejoin.history_in_box(rows, 2, 1.0, crowded=10 ** 6))
    assert {"nan", "inf", "0.0"} <= {r[2] for r in want}
    trees, tasks, whole = [], [], boxes.bitmap_totals
    monkeypatch.setattr(boxes, "dense_rows", lambda *args: trees.append(args))
    monkeypatch.setattr(boxes, "bitmap_totals", lambda *args: tasks.append(args[2].count()) or whole(*args))
    for most, at_once in ((200_000, 1 << 15), (100, 50)):
        monkeypatch.setattr(boxes, "MOST_EVENTS", most)
        monkeypatch.setattr(boxes, "AT_ONCE", at_once)
        assert taken(rangejoin.history_in_box(rows, 2, 1.0, crowded=64)) == want
    assert min(tasks) > 2 and not trees  # no places by all nodes of trees
