"""Streams of events: ingest, daily counts, last events per zone, large events ahead.

Ingest and the last events per zone take rows of any age. Daily counts and large
events ahead take a watermark; rows later than that are dropped from the stream
and are repaired by the batch join :func:`temblor.operators.rangejoin.missing_ids`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from temblor.operators.cleaning import coerce_types
from temblor.operators.rangejoin import DAY_US
from temblor.session import materialize, share_code
from temblor.sources.geojson import parse_documents

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                        files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_ingest(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Event documents of a folder, one per line, as typed rows; repeats are left to :func:`store_new`."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = parse_documents(reader.text(path).select(F.col("value").alias("document")))
    return coerce_types(rows.where("supported").drop("supported"))


def store_new(stream: DataFrame, root: str, checkpoint: str, id_col: str = "id", buckets: int = 4096):
    """Append rows whose id the store does not hold; returns the started query.

    Batch ``b`` writes its own folder and looks only at those before it, so a
    repeated batch puts the same rows in place again. See :func:`append_new`.
    """
    return (stream.writeStream.foreachBatch(lambda batch, number: append_new(batch, root, number, id_col, buckets))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def append_new(batch: DataFrame, root: str, number: int, id_col: str = "id", buckets: int = 4096) -> None:
    """Write the rows of a batch whose id is new as batch ``number`` of the store.

    The store has the rows and a Bloom filter of their ids by batch. Only ids that
    the filter knows are compared with the stored ones; when it knows none, the
    stored ids are not read. Of rows with one id the latest in time is taken. The
    filter is made for some 3,000 ids in a bucket; more only cost comparisons. Use one
    number of buckets for a store. Rows without an id are left out.
    """
    spark = batch.sparkSession
    order = F.struct(*[F.col(c) for c in (["time"] if "time" in batch.columns else [])],
                     F.xxhash64(*[F.col(f"`{c}`") for c in batch.columns]))
    whole = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    rows = batch.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max_by(whole, order).alias("row"))
    filters = _earlier(spark, f"{root}/filter", number)
    if filters is not None:
        merged = filters.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        asked = rows.withColumn("bucket", _filter_bucket(F.col("_id"), buckets)).join(merged, "bucket", "left")
        known = F.coalesce(_filter_knows(F.col("bits"), F.col("_id")), F.lit(False))
        rows = materialize(asked.select("_id", "row", known.alias("known")))
        hits = rows.where("known")
        if not hits.isEmpty():
            stored = _earlier(spark, f"{root}/events", number).select(F.col(id_col).alias("_id"))
            rows = rows.where("not known").unionByName(hits.join(stored, "_id", "left_anti"))
    rows.select("row.*").write.mode("overwrite").parquet(f"{root}/events/batch={number}")
    written = spark.read.schema(batch.schema).parquet(f"{root}/events/batch={number}").select(F.col(id_col).alias("_id"))
    bits = written.withColumn("bucket", _filter_bucket(F.col("_id"), buckets)).withColumn(
        "bit", F.explode(_filter_bits(F.col("_id"))))
    bits.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits")).write.mode("overwrite").parquet(
        f"{root}/filter/batch={number}")


def _earlier(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """Rows of the batches before ``number``; None where there are none."""
    try:
        return spark.read.parquet(path).where(F.col("batch") < number)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def _filter_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _filter_bits(key: Column) -> Column:
    """Four of the 32,768 bits of a bucket."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(32_768)) for k in range(4)])


def _filter_knows(bits: Column, key: Column) -> Column:
    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.floor(byte / F.pow(F.lit(2.0), bit % 8)).cast("int") % 2 == 1

    return F.forall(_filter_bits(key), is_set)


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """All rows of a store, with the batch that brought them."""
    return spark.read.parquet(f"{root}/events")


def stream_daily(stream: DataFrame, watermark: str = "30 days", time: str = "time") -> DataFrame:
    """Events, mean and largest magnitude per day."""
    day = F.window(time, "1 day")
    counts = stream.withWatermark(time, watermark).groupBy(day.alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"), F.avg("mag").alias("mean_mag"), F.max("mag").alias("max_mag"))
    return counts.select(F.to_date("w.start").alias("day"), "event_count", "mean_mag", "max_mag")


def stream_future_majors(stream: DataFrame, majors: DataFrame, key: str = "region_code", mag_min: float = 5.0,
                         days: int = 7, watermark: str = "30 days", salts: int = 8) -> DataFrame:
    """Each event with every large event of its zone in the next ``days``.

    The rows of a zone are spread over ``salts`` keys by a hash of the id; the
    large events, the few, are copied to all of them. So one busy zone does
    not keep its state in one task. A key holds one slot of ``days``, and a large
    event goes to its own slot and the one before, so that it is compared with
    the events of two slots and not with all of its zone.
    """
    salt, slot = F.pmod(F.xxhash64("id"), F.lit(salts)), F.floor(F.unix_micros("time") / F.lit(days * DAY_US))
    left = (stream.withWatermark("time", watermark)
            .select(F.col(key).alias("zone"), salt.alias("salt"), slot.alias("slot"), "id", "seq", "time"))
    copies = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.array(
        F.struct(s.alias("salt"), slot.alias("slot")), F.struct(s.alias("salt"), (slot - 1).alias("slot"))))))
    right = (majors.where(F.col("mag") >= mag_min).withWatermark("time", watermark)
             .select(F.col(key).alias("m_zone"), copies.alias("m_at"), F.col("id").alias("major_id"), F.col("mag").alias("major_mag"),
                     F.col("seq").alias("major_seq"), F.col("time").alias("major_time")))
    later = (F.col("major_time") > F.col("time")) | (
        (F.col("major_time") == F.col("time")) & (F.col("major_seq") > F.col("seq")))
    pairs = left.join(right, (F.col("zone") == F.col("m_zone")) & (F.col("salt") == F.col("m_at.salt"))
                      & (F.col("slot") == F.col("m_at.slot")) & (F.col("major_time") >= F.col("time"))
                      & (F.col("major_time") <= F.col("time") + F.expr(f"interval {days} days")) & later)
    return pairs.select(F.col("zone").alias(key), "id", "major_id", "major_mag", "time", "major_time")


#: Weights of the score of a zone: constant, mean and largest magnitude, number of events.
SCORE = (-6.0, 0.4, 0.6, 0.1)
_HELD = "id string, us bigint, mag double"


class LastEvents(StatefulProcessor):
    """Keeps the newest ``n`` events of a zone and scores them when some arrive."""

    def __init__(self, keys: list[str], n: int, weights: tuple[float, float, float, float]):
        self.keys, self.n, self.weights = keys, n, weights

    def init(self, handle) -> None:
        self.held = handle.getListState("last", _HELD)

    def handleInputRows(self, key, rows, timerValues):
        found = {row[0]: tuple(row) for row in self.held.get()}
        for frame in rows:
            found |= {r.id: (r.id, int(r.us), None if pd.isna(r.mag) else float(r.mag)) for r in frame.itertuples()}
            found = {r[0]: r for r in sorted(found.values(), key=lambda r: r[1::-1])[-self.n:]}
        last = list(found.values())
        self.held.put(last)
        mags = [r[2] for r in last if r[2] is not None]
        constant, mean, largest, count = self.weights
        value = constant + count * len(last) + (mean * sum(mags) / len(mags) + largest * max(mags) if mags else 0.0)
        row = {k: [v] for k, v in zip(self.keys, key)}
        yield pd.DataFrame(row | {"ids": [[r[0] for r in last]], "last_us": [last[-1][1]],
                                  "score": [1.0 / (1.0 + math.exp(-value))]})

    def close(self) -> None:
        pass


def newest(rows: DataFrame, keys: list[str], n: int, most: int = 100_000) -> DataFrame:
    """At most ``n`` rows per zone from each task, so that a busy zone sends few."""
    schema = rows.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            held = held.sort_values(["us", "id"]).groupby(keys, dropna=False, sort=False).tail(n)
            if len(held) > most:
                yield held
                held = None
        if held is not None:
            yield held

    return rows.mapInPandas(run, schema)


def stream_last_n(stream: DataFrame, root: str, checkpoint: str, keys: list[str] = ("region_code",), n: int = 6,
                  weights: tuple[float, float, float, float] = SCORE,
                  on_update: Callable[[DataFrame, int], None] | None = None):
    """Keep the last ``n`` events (``id, time, mag``) per zone in keyed state and score each zone that got some.

    Each batch writes ``ids, last_us, score`` of its own zones to a folder of its
    number, so a repeated batch writes the same rows. ``on_update`` gets them.
    State lies in RocksDB below the checkpoint. A new root and checkpoint reset all zones.
    """
    spark, keys = stream.sparkSession, list(keys)
    share_code(spark)
    rows = stream.select(*keys, "id", F.unix_micros("time").alias("us"), F.col("mag").cast("double").alias("mag"))
    kinds = dict(rows.dtypes)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ids array<string>, last_us bigint, score double"])
    scored = newest(rows.where(F.col("id").isNotNull() & F.col("us").isNotNull()), keys, n).groupBy(
        *keys).transformWithStateInPandas(LastEvents(keys, n, tuple(weights)), out, "Update", "None")

    def update(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        if on_update:
            on_update(spark.read.schema(batch.schema).parquet(f"{root}/batch={number}"), number)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # a query takes the setting of the moment it starts
    try:
        return (scored.writeStream.foreachBatch(update).outputMode("update")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def last_state(spark: SparkSession, root: str, keys: list[str] = ("region_code",)) -> DataFrame:
    """The latest ``ids, last_us, score`` of each zone."""
    found = spark.read.parquet(root)
    return found.groupBy(*keys).agg(F.max_by(F.struct("ids", "last_us", "score"), "batch").alias("x")).select(*keys, "x.*")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data at hand and read its result table.

    In complete mode every batch replaces the table.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
