"""Jobs: documents to clean table, features to data sets, exploration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.operators import cleaning, features, patterns, spatial, summary, temporal
from temblor.sources import geojson
from temblor.sources.store import StageStore, files_fingerprint, fingerprint


def clean_job(spark: SparkSession, documents: str, root: str) -> DataFrame:
    """Scan document files, clean them, keep both stages."""
    stages, source = StageStore(spark, root), files_fingerprint(spark, documents)
    # The stored stage keeps the row numbers from changing.
    raw = stages.run("scanned", lambda: geojson.scan_json(spark, documents).where("supported").drop("supported")
                     .withColumn("seq", F.monotonically_increasing_id()), source=source)
    # Of several rows with one id the last by path and place in its document is kept.
    return stages.run("cleaned", lambda: cleaning.clean(raw, order=["path", "position"]).drop("position"),
                      source=source)


def feature_job(spark: SparkSession, events: DataFrame, root: str, first_year: int = 2000,
                end_year: int = 2026) -> dict[str, DataFrame]:
    """Sequence features of a range of years and the two model data sets."""
    stages = StageStore(spark, root)
    given = {"source": fingerprint(events), "first_year": first_year, "end_year": end_year}
    table = stages.run("sequence_features", lambda: features.sequence_features(
        cleaning.between_years(events, first_year, end_year)), **given)
    return {
        "features": table,
        "time": stages.run("time_dataset", lambda: features.time_dataset(table), **given),
        "mag": stages.run("mag_dataset", lambda: features.mag_dataset(table), **given),
    }


def exploration_job(spark: SparkSession, raw: DataFrame, root: str) -> dict[str, DataFrame]:
    """The summary tables of a catalog, one stage each."""
    stages, source = StageStore(spark, root), fingerprint(raw)
    events = stages.run("earthquakes", lambda: raw.where(F.col("type") == "earthquake").withColumn(
        "tsunami", cleaning.zero_one("tsunami")), source=source)
    makers = {
        "overview": lambda: summary.dataset_overview(raw, events),
        "numeric_summary": lambda: summary.numeric_summary(events),
        "correlation": lambda: summary.corr_matrix(events, fill="median"),
        "yearly": lambda: summary.yearly_summary(events),
        "monthly": lambda: summary.monthly_summary(events),
        "regions": lambda: summary.region_share(events),
        "hotspots": lambda: spatial.hotspots(events),
        "daily": lambda: temporal.daily_features(temporal.daily_agg(events)),
        "tokens": lambda: patterns.token_ngrams(patterns.daily_token(events)),
    }
    return {name: stages.run(name, make, source=source) for name, make in makers.items()}
