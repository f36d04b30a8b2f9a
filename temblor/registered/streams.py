"""Streams over the catalog, run until all data are used."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from temblor.operators import cleaning, spatial
from temblor.registered import register
from temblor.registered.spatial import GRID, r6
from temblor.sources import geojson, store
from temblor.sources.catalog import catalog, raw_catalog
from temblor.streaming import jobs

# The test folders hold all years at once in no time order.
ANY_AGE = "20 years"


#: Documents of a file of arrivals, some 50 MB.
DOCS_PER_FILE = 100_000


def arrival_files(docs: int) -> int:
    """Files for so many documents: four, or an even number that grows with them; half of them arrive at once."""
    return max(4, 2 * math.ceil(docs / (2 * DOCS_PER_FILE)))


def _catalog_stream(spark, sf_dir):
    """The gridded catalog as a stream of several files."""
    path = store.scratch_folder(spark, "stream")
    rows = spatial.add_grid(catalog(spark, sf_dir)).select("id", "seq", "time", "mag", "region_code")
    rows.repartitionByRange(4, "time").write.parquet(path)
    return jobs.read_parquet_stream(spark, path, rows.schema, files_per_trigger=2)


@register("stream_ingest", """
select cast(year("time") as bigint) as year, count(*) as n, count(distinct id) as ids, max(mag) as mag_max
from ev group by 1""")
def stream_ingest(spark, sf_dir):
    """Half of the documents are stored before, all arrive twice; every id is stored once."""
    path, root = store.scratch_folder(spark, "arrivals"), store.scratch_folder(spark, "stored")
    events = raw_catalog(spark, sf_dir)
    docs = events.select(geojson.to_document(events).alias("value"))
    files = arrival_files(2 * events.count())
    docs.unionByName(docs).repartition(files).write.text(path)
    old = spark.read.text(path).where(F.crc32(F.col("value").cast("binary")) % 2 == 0).select(F.col("value").alias("document"))
    jobs.append_new(cleaning.coerce_types(geojson.parse_documents(old).where("supported").drop("supported")), root, -1)
    stream = jobs.stream_ingest(spark, path, files_per_trigger=files // 2)
    jobs.store_new(stream, root, store.scratch_folder(spark, "cp")).awaitTermination()
    return jobs.read_store(spark, root).groupBy(F.year("time").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.max("mag").alias("mag_max"))


@register("stream_daily", """
select strftime("time", '%Y-%m-%d') as day, count(*) as event_count, round(avg(mag), 6) as mean_mag, max(mag) as max_mag
from eq group by 1""")
def stream_daily(spark, sf_dir):
    daily = jobs.stream_daily(_catalog_stream(spark, sf_dir), ANY_AGE)
    found = jobs.run_available(daily, store.scratch_folder(spark, "daily"), store.scratch_folder(spark, "cp"),
                               "complete")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_count", r6("mean_mag", "mean_mag"),
                        "max_mag")


@register("stream_last_n", GRID + """,
r as (select region_code, id, us, mag, row_number() over (partition by region_code order by us desc, id desc) as n
      from grid)
select region_code, string_agg(id, ',' order by us, id) as ids,
       round(1/(1 + exp(-(-6 + 0.4*avg(mag) + 0.6*max(mag) + 0.1*count(*)))), 6) as score
from r where n <= 6 group by 1""")
def stream_last_n(spark, sf_dir):
    """The last six events of each zone and their score, from the state of a stream."""
    root = store.scratch_folder(spark, "last")
    jobs.stream_last_n(_catalog_stream(spark, sf_dir), root, store.scratch_folder(spark, "cp")).awaitTermination()
    return jobs.last_state(spark, root).select("region_code", F.array_join("ids", ",").alias("ids"), r6("score", "score"))


@register("stream_future_majors", GRID + """
select a.region_code, a.id, b.id as major_id, b.mag as major_mag, b.us - a.us as delay_us
from grid a join grid b on a.region_code = b.region_code and b.mag >= 5 and b.us <= a.us + 604800000000
     and (b.us > a.us or (b.us = a.us and b.seq > a.seq))""")
def stream_future_majors(spark, sf_dir):
    stream, majors = _catalog_stream(spark, sf_dir), _catalog_stream(spark, sf_dir)
    pairs = jobs.stream_future_majors(stream, majors, watermark=ANY_AGE)
    found = jobs.run_available(pairs, store.scratch_folder(spark, "majors"), store.scratch_folder(spark, "cp"))
    return found.select("region_code", "id", "major_id", "major_mag",
                        (F.unix_micros("major_time") - F.unix_micros("time")).alias("delay_us"))
