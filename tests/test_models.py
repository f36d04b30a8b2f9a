"""Patterns, metrics, clustering, forecasts and streams."""

import datetime as dt
import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from temblor.operators import clustering, features, forecast, metrics, patterns, summary, temporal
from temblor.sources.catalog import catalog
from temblor.streaming import jobs


def test_itemsets_and_rules_by_brute_force(spark):
    baskets = [["depth:a", "lat:n", "mag:x"], ["depth:a", "lat:n", "mag:y"], ["depth:b", "lat:s", "mag:x"],
               ["depth:a", "lat:n", "mag:x"]]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(baskets)], "id string, items array<string>")
    counts = {}
    for b in baskets:
        for size in (1, 2, 3):
            for combo in combinations(b, size):
                counts[combo] = counts.get(combo, 0) + 1
    got = {tuple(r["itemset"]): r["n"] for r in
           patterns.frequent_itemsets(df, 3, 0.5).collect()}
    assert got == {k: v for k, v in counts.items() if v / 4 >= 0.5}
    rules = patterns.location_rules(patterns.frequent_itemsets(df, 3, 0.25), 0.9, 1.1).collect()
    found = {(r["antecedent"], r["consequent"]): r["lift"] for r in rules}
    assert found[("depth:a", "lat:n")] == pytest.approx(4 / 3)
    assert all(c.startswith("lat:") for _, c in found)


@pytest.mark.parametrize("size", [0, 2, 7, 9])
def test_itemsets_read_whole_baskets(spark, size):
    basket = [f"i{k}" for k in range(size)]
    df = spark.createDataFrame([("a", basket), ("b", basket[:1])], "id string, items array<string>")
    got = {tuple(r["itemset"]) for r in patterns.frequent_itemsets(df, 3, 0.5).collect()}
    assert got == {c for n in (1, 2, 3) for c in combinations(basket, n)}


def test_itemsets_of_long_baskets_follow_the_frequent_sets(spark):
    rows = [(str(b), sorted([f"rare{b}_{k:03d}" for k in range(200)] + [x for i, x in enumerate("abcd") if b % (i + 1) == 0]))
            for b in range(120)]
    df = spark.createDataFrame(rows, "id string, items array<string>")
    counts = {}
    for _, items in rows:
        for n in (1, 2, 3):
            for c in combinations([x for x in items if len(x) == 1], n):
                counts[c] = counts.get(c, 0) + 1
    got = {tuple(r["itemset"]): r["n"] for r in patterns.frequent_itemsets(df, 3, 0.05).collect()}
    assert got == {c: n for c, n in counts.items() if n / 120 >= 0.05}
    assert patterns.frequent_itemsets(df.limit(0)).count() == 0


def test_sweep_has_all_thresholds(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.35), (1, 0.05)], "label bigint, score double")
    rows = metrics.threshold_sweep(df).collect()
    assert len(rows) == 81 and {r["tp"] + r["fn"] for r in rows} == {2}
    assert sum(r["tp"] + r["fp"] == 0 for r in rows) == 81 - 26
    low = spark.createDataFrame([(1, 0.01), (0, 0.02)], "label bigint, score double")
    assert metrics.best_threshold(low).first()["threshold"] == pytest.approx(0.1)


def test_quantile_bins_collapse(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (9.0,), (None,)], "gap double")
    assert {r["gap_bin"] for r in patterns.quantile_bins(df, ["gap"]).collect()} == {"gap_q1"}


def test_robust_z_without_spread(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (2.0,), (50.0,)], "x double")
    assert {r["x_z"] for r in patterns.robust_z(df, ["x"]).collect()} == {0.0}


@pytest.mark.parametrize("size", [10_000, 5])
def test_auc_with_ties_and_one_class(spark, size):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.4), (1, 0.8), (0, 0.8)]
    df = spark.createDataFrame(rows, "label bigint, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auc(df, rows_per_chunk=size).first()["auc"] == pytest.approx(want)
    assert metrics.auc(df.where("label = 1")).first()["auc"] is None


def test_threshold_sweep_equals_direct_counts(spark):
    df = spark.range(300).select((F.col("id") % 3 == 0).cast("bigint").alias("label"),
                                 ((F.col("id") * 37) % 101 / 100.0).alias("score"))
    swept = {round(r["threshold"], 6): r for r in metrics.threshold_sweep(df).collect()}
    direct = metrics.threshold_metrics(df, thresholds=tuple(metrics.SWEEP)).collect()
    assert len(direct) == 81
    for row in direct:
        other = swept[round(row["threshold"], 6)]
        assert all(row[c] == other[c] for c in ("tp", "fp", "tn", "fn", "f1"))


def test_calendar_keeps_empty_days(spark):
    df = spark.sql("select timestamp '2020-01-01 05:00:00' as time, 4.0D as mag, 10.0D as depth union all "
                   "select timestamp '2020-01-04 01:00:00', 7.0D, 20.0D")
    daily = temporal.daily_agg(df).orderBy("day").collect()
    assert [r["event_count"] for r in daily] == [1.0, 0.0, 0.0, 1.0] and daily[1]["mean_mag"] == 0.0
    labels = temporal.future_label(temporal.daily_agg(df), 6.5, 2).orderBy("day").collect()
    assert [r["label"] for r in labels] == [0, 1, 1, 0]
    assert temporal.quiet_periods(temporal.daily_agg(df)).count() == 0


def test_splits_keep_order_and_rows(events):
    split = features.ordered_split(events).collect()
    assert {s: sum(r["split"] == s for r in split) for s in ("train", "val", "test")} == {
        "train": 320, "val": 40, "test": 40}
    assert max(r["time"] for r in split if r["split"] == "train") <= min(
        r["time"] for r in split if r["split"] == "test")
    small = features.train_test_split(events.limit(12)).collect()
    assert sum(r["split"] == "train" for r in small) == 7


@pytest.mark.parametrize("size", [10_000, 50])
def test_lookback_windows(events, size):
    full = events.withColumns({c: F.col("mag") + 1 for c in ("gap", "nst", "rms")})
    got = {r["seq"]: r for r in features.lookback_matrix(full, 3, rows_per_chunk=size).collect()}
    data = sorted((r.asDict() for r in full.collect()), key=lambda e: (e["time"], e["seq"]))
    assert len(got) == len(data) - 3
    for i in range(2, len(data) - 1):
        row, window = got[data[i]["seq"]], data[i - 2:i + 1]
        assert row["features"][:3] == [e["mag"] for e in window]
        gaps = [0.0 if j == 0 else (data[j]["time"] - data[j - 1]["time"]).total_seconds() / 3600
                for j in range(i - 2, i + 1)]
        assert row["features"][15:18] == pytest.approx(gaps)
        assert row["features"][21] == pytest.approx(sum(gaps) / 3, abs=1e-9)
        assert row["next_mag"] == data[i + 1]["mag"]


def test_mixed_kmeans_finds_far_groups(events):
    near = events.where("region_code in ('z1', 'z3', 'z5')")
    scaled = features.standardize(near, ["mag"])
    labeled, centers, inertia = clustering.mixed_kmeans(scaled.withColumn("mag_std", F.lit(0.0)), ["mag_std"], 3)
    pairs = {(r["region_code"], r["cluster"]) for r in labeled.select("region_code", "cluster").distinct().collect()}
    assert len(centers) == 3 and inertia >= 0
    assert len({z for z, _ in pairs}) == len(pairs)
    with pytest.raises(ValueError):
        clustering.mixed_kmeans(scaled, ["mag_std"], 1)


def test_silhouettes_of_several_labels_at_once(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = [([float(k % 7), float(k % 11)], k % 3, int(k % 7 > 3), 0, int(k == 5)) for k in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, a bigint, b int, one int, alone int")
    found = clustering.silhouettes(df, "x", ["a", "b", "one", "alone"])
    assert found["one"] is None
    for c in ("a", "b", "alone"):
        rows = df.select(array_to_vector("x").alias("features"), F.col(c).cast("double").alias("prediction"))
        assert found[c] == pytest.approx(ClusteringEvaluator().evaluate(rows))


def test_small_regions_get_no_cluster(spark, sf):
    profile = summary.region_profile(catalog(spark, sf).withColumn("tsunami", F.lit(0.0)))
    labeled = clustering.region_clusters(profile, 2, min_events=15)
    assert labeled.count() == profile.count()
    wrong = labeled.where((F.col("event_count") < 15) != (F.col("region_cluster") == -1))
    assert wrong.count() == 0


def test_quiet_model_scores_are_probabilities(spark, sf):
    _, scored, threshold = forecast.fit_quiet_model(catalog(spark, sf), mag_min=4.0)
    rows = scored.collect()
    assert rows and 0.0 <= threshold <= 1.0
    assert all(0.0 <= r["pred_proba_major_next_horizon"] <= 1.0 for r in rows)


def test_stream_last_n_keeps_state_over_restarts(spark, events, tmp_path):
    source, root, check = f"{tmp_path}/src", f"{tmp_path}/state", f"{tmp_path}/cp"
    rows = events.select("id", "time", "region_code", "mag")
    parts = [rows.where("region_code <> 'z0'"), rows.where("region_code = 'z0'"), rows.where("region_code is null"),
             rows.where("region_code = 'z1'")]  # the last one repeats events
    seen = []
    for part in parts:  # one start per part, from the same checkpoint
        part.coalesce(2).write.mode("append").parquet(source)
        stream = jobs.read_parquet_stream(spark, source, rows.schema)
        jobs.stream_last_n(stream, root, check, n=4, on_update=lambda batch, number: seen.append(
            {r["region_code"] for r in batch.collect()})).awaitTermination()
    zones = {r["region_code"] for r in rows.collect()}
    assert seen == [zones - {"z0", None}, {"z0"}, {None}, {"z1"}]  # a batch touches its own zones
    data = [r.asDict() for r in rows.collect()]
    state = {r["region_code"]: r for r in jobs.last_state(spark, root).collect()}
    assert set(state) == zones
    for zone, row in state.items():
        last = sorted((r["time"], r["id"], r["mag"]) for r in data if r["region_code"] == zone)[-4:]
        assert row["ids"] == [r[1] for r in last]
        mags = [r[2] for r in last]
        value = -6 + 0.4 * sum(mags) / len(mags) + 0.6 * max(mags) + 0.1 * len(last)
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-value)))


def test_busy_zones_send_few_rows(spark, events):
    rows = events.select("region_code", "id", F.unix_micros("time").alias("us"), "mag").repartition(3)
    sent = jobs.newest(rows, ["region_code"], 4)
    assert sent.count() <= 3 * 4 * rows.select("region_code").distinct().count()


def test_store_takes_each_id_once(spark, events, tmp_path):
    root = f"{tmp_path}/store"
    rows = events.select("id", "time", "mag")
    jobs.append_new(rows.where("seq < 150"), root, -1, buckets=2)
    first, second = rows.where("seq < 250").unionByName(rows.where("seq between 200 and 240")), rows.where("seq >= 100")
    nameless = rows.limit(1).withColumn("id", F.lit(None).cast("string"))

    def stored():
        return sorted((r["id"], r["time"], r["mag"], r["batch"]) for r in jobs.read_store(spark, root).collect())

    for number, part in ((0, first), (1, second.unionByName(nameless)), (2, rows)):
        jobs.append_new(part, root, number, buckets=2)
    want = sorted((r["id"], r["time"], r["mag"], -1 if r["seq"] < 150 else 0 if r["seq"] < 250 else 1)
                  for r in events.collect())
    assert stored() == want
    jobs.append_new(second, root, 1, buckets=2)  # a repeated batch
    assert stored() == want
    latest = rows.where("seq = 7").withColumn("id", F.lit("new")).withColumn("mag", F.lit(1.0))
    jobs.append_new(latest.unionByName(latest.withColumn("time", F.expr("time + interval 1 day"))), root, 3, buckets=2)
    assert [r[1:3] for r in stored() if r[0] == "new"] == [(latest.first()["time"] + dt.timedelta(days=1), 1.0)]


def test_stream_majors_equal_batch(spark, events, tmp_path):
    from temblor.operators.rangejoin import future_majors

    rows = events.select("id", "seq", "time", "mag", "region_code")
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    streams = [jobs.read_parquet_stream(spark, source, rows.schema) for _ in range(2)]
    pairs = jobs.run_available(jobs.stream_future_majors(*streams, watermark="1 year", salts=3),
                               str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = future_majors(events, keys=["region_code"])
    assert sorted((r["id"], r["major_id"]) for r in pairs.collect()) == sorted(
        (r["id"], r["major_id"]) for r in batch.collect())


def test_a_boosted_model_is_fitted_once_and_read_back(spark, sf):
    from functools import partial

    from temblor.registered import forecast as registered

    calls = []

    def fit(lookback):
        calls.append(1)
        return partial(forecast.fit_next_mag, trees=2, depth=2)(lookback)

    model, scored = registered._boosted(spark, sf, "test_mag", fit)
    again, _ = registered._boosted(spark, sf, "test_mag", fit)
    assert calls == [1] and scored.count() > 0
    importance = forecast.feature_importance(again, forecast.lookback_names(), spark).collect()
    assert model.toDebugString == again.toDebugString
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0)


def test_rounds_of_several_sets_share_a_pass_and_equal_single_ones(spark):
    rows = [(float(i % 13), -60.0 + 7 * (i % 17), -170.0 + 11 * (i % 31)) for i in range(400)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, latitude double, longitude double")
    sets = [[{"a": 1.0, "lat": 0.0, "lon": 0.0}, {"a": 9.0, "lat": 20.0, "lon": 90.0}],
            [{"a": 5.0, "lat": -30.0, "lon": -100.0}, {"a": 5.0, "lat": -30.0, "lon": -100.0},
             {"a": 2.0, "lat": 40.0, "lon": 120.0}]]
    for s, (fresh, sizes, within) in zip(sets, clustering.centroid_steps(df, ["a"], sets, 1000.0), strict=True):
        near = clustering.nearest_centroid(df, ["a"], s, 1000.0).where("cluster >= 0")
        want = {r["cluster"]: r for r in near.groupBy("cluster").agg(
            F.count("*").alias("n"), F.avg("a").alias("a"), F.sum("distance2").alias("d")).collect()}
        assert sizes == {i: r["n"] for i, r in want.items()}
        assert within == pytest.approx(sum(r["d"] for r in want.values()))
        assert {i: c["a"] for i, c in fresh.items()} == pytest.approx({i: r["a"] for i, r in want.items()})
        assert clustering.centroid_step(df, ["a"], s, 1000.0) == fresh


def test_rows_of_an_iteration_are_dealt_over_the_cores(spark):
    rows = spark.range(0, 40_000, 1, 1).select(F.col("id").cast("string").alias("id"), (F.col("id") % 97).cast(
        "double").alias("x"))
    cores = spark.sparkContext.defaultParallelism
    assert clustering.dealt(rows).rdd.getNumPartitions() == min(4, cores)
    assert clustering.dealt(rows.limit(900)).rdd.getNumPartitions() == 1
    sweep = {r["k"]: r for r in clustering.k_sweep(rows, ["x"], 2, 3).collect()}
    assert sweep[3]["inertia"] < sweep[2]["inertia"] and sweep[2]["train_rows"] == 40_000


def test_large_events_meet_only_the_events_of_two_slots(spark, events, tmp_path):
    from temblor.operators.rangejoin import future_majors

    rows = events.select("id", "seq", F.expr("time + make_interval(0, 0, 0, cast(seq % 40 as int))").alias("time"), "mag",
                         "region_code")
    rows.write.parquet(str(tmp_path / "in"))
    streams = [jobs.read_parquet_stream(spark, str(tmp_path / "in"), rows.schema) for _ in range(2)]
    pairs = jobs.stream_future_majors(*streams, days=2, watermark="1 year", salts=2)
    plan = pairs._jdf.queryExecution().analyzed().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "slot" in join
    found = jobs.run_available(pairs, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = future_majors(rows, days=2, keys=["region_code"])
    assert sorted((r["id"], r["major_id"]) for r in found.collect()) == sorted(
        (r["id"], r["major_id"]) for r in batch.collect())


def test_files_of_arrivals_grow_with_the_documents():
    from temblor.registered import streams

    assert streams.arrival_files(20_000) == 4
    assert streams.arrival_files(72_000_000) * streams.DOCS_PER_FILE >= 72_000_000
    assert streams.arrival_files(1_900_001) % 2 == 0


def test_feature_table_takes_only_its_columns_and_b_values_of_the_anchors(spark, sf):
    from temblor.operators import temporal
    from temblor.registered.features import _features
    from temblor.sources.catalog import catalog

    assert not {"place", "net", "status", "rms"} & set(_features(spark, sf).columns)
    df = catalog(spark, sf).select("id", "seq", "time", (F.col("mag") + 2).alias("mag"))
    whole = {r["id"]: r["b_value"] for r in temporal.b_value(df, 300).collect()}
    got = {r["id"]: r["regional_b_value"] for r in temporal.b_value_interpolated(df, 10_000, 300).collect()}
    assert got.keys() == whole.keys() and len(set(whole.values())) > 2
    assert all(got[k] == pytest.approx(v) for k, v in whole.items())
    one = temporal.b_value_interpolated(df.limit(1), 10, 300).collect()
    assert [r["regional_b_value"] for r in one] == [1.0]


def test_time_dataset_shows_every_step_of_the_feature_table(spark, sf):
    from temblor.registered.features import time_dataset
    from temblor.schemas import MAG_FEATURES, TIME_FEATURES

    found = time_dataset(spark, sf)
    steps = {"log_stress" if c == "coulomb_stress_proxy" else c for c in [*TIME_FEATURES, *MAG_FEATURES]}
    assert set(found.columns) == steps | {"id", "us", "target_quake_in_7days"}
