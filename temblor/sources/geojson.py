"""GeoJSON event documents: files, texts and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from temblor.schemas import DOCUMENT, FEATURE
from temblor.session import materialize, share_code
from temblor.sources.collections import RANGE_BYTES, read_features

_FIELDS = ["time", "place", "mag", "magType", "sig", "gap", "rms", "nst", "dmin", "tsunami",
           "mmi", "cdi", "felt", "status", "type", "net"]


def _feature(document: Column) -> Column:
    return F.struct(*[document.getField(n).alias(n) for n in FEATURE.fieldNames()])


def _features(document: Column, in_list: Column) -> Column:
    kind = document.getField("type")
    shaped = document.getField("properties").isNotNull() & document.getField("geometry").isNotNull()
    listed = document.getField("features")
    return (F.when(in_list, F.array(_feature(document)))
            .when((kind == "FeatureCollection") & listed.isNotNull(), listed)
            .when((kind == "Feature") | shaped, F.array(_feature(document))))


def parse_documents(df: DataFrame, text: str = "document", keep: list[str] = ()) -> DataFrame:
    """One row per feature of a Feature, FeatureCollection, list or bare dict.

    A document of another shape gives one row with ``supported`` false;
    ``position`` is the feature's place in its document. Every text is read as a list, so that it is parsed once.
    """
    in_list = F.substring(F.ltrim(F.col(text)), 1, 1) == "["
    as_list = F.when(in_list, F.col(text)).when(
        F.trim(F.col(text)) != "", F.concat(F.lit("["), F.col(text), F.lit("]")))
    documents = F.from_json(as_list, T.ArrayType(DOCUMENT))
    found = df.select(*keep, F.flatten(F.transform(
        documents, lambda d: _features(d, in_list))).alias("features"))
    rows = found.select(*keep, F.col("features").isNotNull().alias("supported"),
                        F.posexplode_outer("features").alias("position", "feature"))
    return flatten(rows.where(F.col("feature").isNotNull() | ~F.col("supported")), [*keep, "supported", "position"])


def flatten(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Columns of a ``feature`` struct; ``time`` stays in epoch milliseconds."""
    properties = F.col("feature.properties")
    place = F.col("feature.geometry.coordinates")
    event_id = F.coalesce(F.nullif(F.col("feature.id"), F.lit("")),
                          F.nullif(properties.getField("code"), F.lit("")))
    return df.select(*keep, event_id.alias("id"),
                     F.try_element_at(place, F.lit(2)).alias("latitude"),
                     F.try_element_at(place, F.lit(1)).alias("longitude"),
                     F.try_element_at(place, F.lit(3)).alias("depth"),
                     *[properties.getField(n).alias(n) for n in _FIELDS])


#: Files above this many bytes are read by byte ranges, feature by feature.
LARGE_FILE = 64 << 20


def read_documents(spark: SparkSession, root: str, pattern: str = "*.json", large: int = LARGE_FILE,
                   range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every JSON file below ``root`` as (path, document text).

    A file is one row; of a file above ``large`` bytes each feature is one, read
    by several tasks. One listing covers all year folders.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(root).select("path", "length"))
    small = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
             .text(root, wholetext=True).where(F.col("_metadata.file_size") <= large)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")))
    big = materialize(files.where(F.col("length") > large))
    if big.isEmpty():
        return small
    share_code(spark)
    return small.unionByName(read_features(big, range_bytes))


def scan_json(spark: SparkSession, root: str, pattern: str = "*.json", large: int = LARGE_FILE,
              range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All features below ``root``; broken documents stay as unsupported rows."""
    return parse_documents(read_documents(spark, root, pattern, large, range_bytes), keep=["path"])


def scan_lines(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Features of files with one document per line, which Spark may split."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    return parse_documents(lines.select(F.col("_metadata.file_path").alias("path"),
                                        F.col("value").alias("document")), keep=["path"])


def year_of_path(path: str = "path") -> Column:
    return F.regexp_extract(F.col(path), r"/(?:year=)?(\d+)/[^/]+$", 1)


def filename_keys(df: DataFrame, name: str = "file_name", low: float | None = None,
                  high: float | None = None, with_unknown: bool = False) -> DataFrame:
    """Magnitude and id from names such as ``event_<mag>_<id>.json``."""
    pattern = r"^event_([^_]+)_(.+)\.json$"
    mag = F.expr(f"try_cast(regexp_extract(`{name}`, '{pattern}', 1) as double)")
    out = df.withColumns({"file_mag": mag, "file_id": F.regexp_extract(name, pattern, 2)})
    out = out.where(F.col("file_id") != "")
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.col("file_mag") >= low)
    if high is not None:
        keep = keep & (F.col("file_mag") <= high)
    unknown = F.col("file_mag").isNull()
    return out.where((~unknown & keep) | unknown if with_unknown else ~unknown & keep)


def unknown_magnitudes(names: DataFrame, name: str = "file_name", keys: list[str] = ()) -> DataFrame:
    """How many event files there are, and of how many the name has no magnitude."""
    return filename_keys(names, name, with_unknown=True).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("file_mag").isNull()).alias("unknown"))


def list_event_files(spark: SparkSession, root: str) -> DataFrame:
    """Names of the stored event files; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "event_*.json").load(root))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))


def to_document(df: DataFrame) -> Column:
    """An event row as a GeoJSON Feature text (writer side)."""
    return F.to_json(feature_struct(df, F.col("id")))


def feature_struct(df: DataFrame, event_id: Column) -> Column:
    present = [c for c in _FIELDS if c in df.columns and c != "time"]
    return F.struct(
        F.lit("Feature").alias("type"), event_id.alias("id"),
        F.struct(F.unix_millis("time").alias("time"), F.col("id").alias("code"),
                 *[F.col(c) for c in present]).alias("properties"),
        F.struct(F.lit("Point").alias("type"),
                 F.array("longitude", "latitude", "depth").alias("coordinates")).alias("geometry"),
    )
