"""The branches for large inputs on the test tables, against the SQL of the plain queries.

Small tables take one chunk and one time step. These queries ask for small
chunks, crowded cells and several steps, so that the same SQL checks the plans
that large inputs get.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.operators import cleaning, metrics, patterns, rangejoin, temporal
from temblor.registered import ORACLES, QUERIES
from temblor.registered.metrics import _pred, _rounded
from temblor.registered.ranges import shifted
from temblor.registered.spatial import r6
from temblor.registered.temporal import _grid
from temblor.sources.catalog import catalog

ROWS = 500
#: Events in a bucket that ask for several steps in time.
DENSEST = 100_000


def twin(of: str):
    """Register under ``<of>_scale`` with the SQL of ``of``."""
    def keep(fn):
        QUERIES[f"{of}_scale"], ORACLES[f"{of}_scale"] = fn, ORACLES[of]
        return fn
    return keep


@twin("interval_lags")
def interval_lags(spark, sf_dir):
    return temporal.interval_lags(_grid(spark, sf_dir), rows_per_chunk=ROWS).select(
        "id", *[f"interval_lag{i}" for i in range(1, 6)])


@twin("stress_proxy")
def stress_proxy(spark, sf_dir):
    def log(name):
        return r6(F.log10(F.lit(1.0) + F.col("coulomb_stress_proxy")), name)

    region = temporal.stress_proxy(_grid(spark, sf_dir), rows_per_chunk=ROWS).select("*", log("log_stress"))
    return temporal.stress_proxy(region.drop("coulomb_stress_proxy"), keys=[], rows_per_chunk=ROWS).select(
        "id", "log_stress", log("log_stress_all"))


@twin("next_targets")
def next_targets(spark, sf_dir):
    return temporal.next_targets(_grid(spark, sf_dir), rows_per_chunk=ROWS).select(
        "id", "target_time_to_next", "target_next_mag", "target_next_mag_binary")


@twin("b_value")
def b_value(spark, sf_dir):
    return temporal.b_value(catalog(spark, sf_dir), rows_per_chunk=ROWS).select("id", r6("b_value", "b_value"))


@twin("since_last_m5")
def since_last_m5(spark, sf_dir):
    return rangejoin.since_last(catalog(spark, sf_dir), rows_per_chunk=ROWS).select("id", "time_since_last_M5")


@twin("majors_ahead")
def majors_ahead(spark, sf_dir):
    return rangejoin.majors_ahead(_grid(spark, sf_dir), 4.5, keys=["region_code"], rows_per_chunk=ROWS).select(
        "id", "majors_ahead", "first_major_s", "largest_major")


@twin("aftershock_flag_days")
def aftershock_flag_days(spark, sf_dir):
    return rangejoin.larger_follows(catalog(spark, sf_dir), unit=86400, rows_per_chunk=ROWS).select(
        "id", "is_aftershock", "mainshock_mag")


@twin("auc")
def auc(spark, sf_dir):
    return _rounded(metrics.auc(_pred(spark, sf_dir), rows_per_chunk=ROWS), "auc")


@twin("outliers")
def outliers(spark, sf_dir):
    events = cleaning.median_fill(catalog(spark, sf_dir))
    return patterns.outliers(events, rows_per_chunk=ROWS).select(
        "id", r6("outlier_score", "outlier_score"), "is_outlier")


@twin("historical_30d")
def historical_30d(spark, sf_dir):
    out = rangejoin.history_in_box(catalog(spark, sf_dir), crowded=10, rows_per_chunk=ROWS)
    return out.select("id", "hist_count_30d", shifted("hist_mag_mean_30d"), "hist_mag_max_30d", "days_since_last")


@twin("parent_link")
def parent_link(spark, sf_dir):
    return rangejoin.nearest_earlier(catalog(spark, sf_dir), densest=DENSEST).select("seq", "parent")


@twin("shock_roles")
def shock_roles(spark, sf_dir):
    return rangejoin.shock_roles(catalog(spark, sf_dir), densest=DENSEST).select(
        "id", "shock_role", "related_mainshock_id", "hours_to_mainshock")
