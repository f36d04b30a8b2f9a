"""Sources, cleaning, bins, regions: edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from temblor.functions import bins, geo
from temblor.functions import scalars as fn
from temblor.operators import cleaning, spatial
from temblor.schemas import require_columns
from temblor.sources import geojson, store


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def feature(i, **extra):
    doc = {"type": "Feature", "id": f"ev{i}", "properties": {"mag": 1.5, "time": 1000, "code": f"c{i}"},
           "geometry": {"type": "Point", "coordinates": [10.0, 20.0, 5.0]}}
    doc.update(extra)
    return doc


def test_document_shapes(spark):
    bare = feature(3)
    del bare["type"]
    docs = [feature(1), {"type": "FeatureCollection", "features": [feature(2), feature(4, id=None)]}, bare,
            [feature(5), feature(6)], {"type": "Other"}, []]
    texts = [json.dumps(d) for d in docs] + ['{"type": "Feature", "id": "cut', "", "42"]
    df = spark.createDataFrame([(t,) for t in texts], "document string")
    rows = geojson.parse_documents(df).collect()
    good = sorted(r["id"] for r in rows if r["supported"])
    assert good == ["c4", "ev1", "ev2", "ev3", "ev5", "ev6"]
    assert sum(not r["supported"] for r in rows) == 4
    first = next(r for r in rows if r["id"] == "ev1")
    assert (first["longitude"], first["latitude"], first["depth"]) == (10.0, 20.0, 5.0)


def test_short_coordinates(spark):
    doc = feature(1, geometry={"type": "Point", "coordinates": [10.0]})
    df = spark.createDataFrame([(json.dumps(doc),)], "document string")
    row = geojson.parse_documents(df).first()
    assert (row["longitude"], row["latitude"], row["depth"]) == (10.0, None, None)


def test_files_in_year_folders(spark, tmp_path):
    for year, name, text in [("2001", "event_1.5_ab_1.json", json.dumps(feature(1))),
                             ("2002", "event_unknown_x2.json", json.dumps(feature(2), indent=2)),
                             ("2002", "event_3.0_x3.json", "{broken")]:
        (tmp_path / year).mkdir(exist_ok=True)
        (tmp_path / year / name).write_text(text)
    rows = geojson.scan_json(spark, str(tmp_path)).withColumn("year", geojson.year_of_path())
    got = sorted((r["year"], r["supported"], r["id"]) for r in rows.collect())
    assert [g[:2] for g in got] == [("2001", True), ("2002", False), ("2002", True)]
    names = geojson.list_event_files(spark, str(tmp_path))
    known = geojson.filename_keys(names).select("file_mag", "file_id").collect()
    assert sorted(tuple(r) for r in known) == [(1.5, "ab_1"), (3.0, "x3")]
    assert geojson.filename_keys(names, high=2.0, with_unknown=True).count() == 2


def test_dedupe_keeps_the_last_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 4, "w")],
                               "id string, seq bigint, v string")
    assert sorted(one(cleaning.dedupe_keep_last(df), "v")) == ["w", "z"]


def test_filter_invalid_limits(spark):
    rows = [("a", 90.0, 180.0, 0.0, 0.0, " Earthquake "), ("b", 90.1, 0.0, 0.0, 0.0, "earthquake"),
            ("c", 0.0, 0.0, -0.1, 0.0, "earthquake"), ("d", 0.0, 0.0, 0.0, -0.1, "earthquake"),
            ("e", 0.0, 0.0, 0.0, 0.0, "explosion"), (None, 0.0, 0.0, 0.0, 0.0, "earthquake"),
            ("g", None, 0.0, 0.0, 0.0, "earthquake")]
    df = spark.createDataFrame(rows, "id string, latitude double, longitude double, depth double, mag double, "
                                     "type string").withColumn("time", F.current_timestamp())
    assert one(cleaning.filter_invalid(df), "id") == ["a"]


def test_text_rules(spark):
    df = spark.createDataFrame([("  ML ",), ("ml(TexNet)",), ("mb_lg",), ("M w-w",), ("",), ("NaN",), ("none",), (None,),
                                ("ms_20",)], "t string")
    got = one(df.select(fn.normalize_mag_type("t").alias("t")), "t")
    assert got == ["ml", "ml", "mblg", "mww", "unknown", "nan", "unknown", "unknown", "ms"]


def test_coerce_bad_values(spark):
    df = spark.createDataFrame([("a", "x", "1.5", "7.9"), ("b", "1000", "oops", None)],
                               "id string, time string, mag string, sig string")
    rows = {r["id"]: r for r in cleaning.coerce_types(df).collect()}
    assert rows["a"]["time"] is None and rows["a"]["mag"] == 1.5 and rows["a"]["sig"] == 7
    assert rows["b"]["mag"] is None and rows["b"]["time"].year == 1970


def test_seeded_sample_with_and_without_prefilter(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    want = sorted(one(df.orderBy(cleaning.sample_order(), "id").limit(200), "id"))
    assert sorted(one(cleaning.seeded_sample(df, 200), "id")) == want
    assert cleaning.seeded_sample(df, 9000).count() == 5000
    assert sorted(one(cleaning.seeded_sample(df, 200, seed=1), "id")) != want


def test_mag_ranges(spark):
    df = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (9.99,), (10.0,), (10.9,)], "mag double")
    got = sorted(tuple(r) for r in cleaning.mag_range_counts(df).collect())
    assert got == [(0.0, 0.5, 2), (0.5, 1.0, 1), (9.5, 10.0, 1), (10.0, 11.0, 2)]


def test_bins_close_on_the_right_side(spark):
    df = spark.createDataFrame([(70.0, 5.0), (70.1, 5.01), (300.0, 7.0), (800.0, 10.5), (None, None)],
                               "depth double, mag double")
    assert one(df.select(bins.depth_band().alias("b")), "b") == ["shallow", "intermediate", "intermediate", "deep", None]
    assert one(df.select(bins.depth_class().alias("b")), "b") == ["Intermediate", "Intermediate", "Deep", "Deep", "Unknown"]
    assert one(df.select(bins.mag_band().alias("b")), "b")[:3] == ["moderate", "strong", "major"]
    assert one(df.select(bins.event_token().alias("b")), "b")[-2:] == ["M_unknown_depth_unknown"] * 2
    with pytest.raises(ValueError):
        bins.bin_column("mag", [0, 1], ["a", "b"])


def test_grid_code_limits(spark):
    df = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (90.5, 0.0), (0.0, None)],
                               "latitude double, longitude double")
    assert one(df.select(geo.grid_code().alias("c")), "c") == ["G000_000", "G072_144", None, None]
    assert one(df.select(geo.grid_code(size=0.1).alias("c")), "c")[1] == "G1800_3600"


def test_regions_at_the_pole_keep_their_code(spark):
    df = spark.createDataFrame([(90.0, 180.0), (90.5, 0.0), (0.0, 0.0)], "latitude double, longitude double")
    rows = {r["region_code"]: r["region_id"] for r in spatial.region_dimension(df).collect()}
    assert rows == {"G036_072": 1, "G072_144": 2}
    assert sorted(str(r["region_id"]) for r in spatial.add_region_ids(df).collect()) == ["1", "2", "None"]


def test_centroid_and_scale(spark):
    df = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0)], "latitude double, longitude double")
    row = spatial.spherical_centroid(df).first()
    assert abs(abs(row["centroid_longitude"]) - 180.0) < 1e-9
    assert spatial.geo_scale(df).first()[0] == pytest.approx(111.19, abs=0.1)
    same = spark.createDataFrame([(5.0, 5.0)] * 3, "latitude double, longitude double")
    assert spatial.geo_scale(same).first()[0] == 1.0


def test_require_columns(events):
    with pytest.raises(ValueError, match="gap"):
        require_columns(events, ["id", "gap"])


def test_stage_store_resumes(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert store.StageStore(spark, str(tmp_path)).run("first", make).count() == 5
    stages = store.StageStore(spark, str(tmp_path))
    stages.run("second", lambda: spark.range(2))
    assert len(calls) == 1
    assert [(r["version"], r["step"], r["row_count"]) for r in stages.stages().orderBy("version").collect()] == [
        (1, "first", 5), (2, "second", 2)]


def test_year_layout_prunes_partitions(spark, events, tmp_path):
    path = str(tmp_path / "t")
    store.write_by_year(events.withColumn("type", F.lit("earthquake")), path)
    plan = spark.read.parquet(path).where("year = 2001").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<id:string>" in plan
    lines = store.markdown_table(spark.range(1)).collect()
    assert lines[0]["line"] == "| 0 |"
