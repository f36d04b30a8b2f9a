"""The event catalog derived from the driver's ``events`` table.

Only integer arithmetic and plain IEEE division are used, so that Spark and an
SQL engine derive the same bits. The SQL text serves the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHARED = """
       -54e0 + (user_id % 12)*10 + ((event_id*7919) % 2000)/1e3 as latitude,
       -174e0 + (user_id % 12)*30 + ((event_id*104729) % 2000)/1e3 as longitude,
       ((event_id*31) % 70000)/1e2 as depth,
       value/50e0 as mag,
       case when event_id % 50 = 0 then null
            when event_type = 'click' then 'ml'
            when event_type = 'view' then ' ML '
            when event_type = 'purchase' then 'mb'
            when event_type = 'signup' then 'mb_lg'
            else 'ml(texnet)' end as "magType",
       case when event_id % 40 = 7 then null
            else cast(floor(value*10) as bigint) end as sig,
       case when event_id % 4 = 0 then null else ((event_id*17) % 3600)/1e1 end as gap,
       case when event_id % 25 = 3 then null else ((event_id*13) % 200)/1e2 end as rms,
       case when event_id % 3 = 0 then null else (event_id*7) % 120 end as nst,
       case when event_id % 5 < 2 then null else ((event_id*11) % 3000)/1e3 end as dmin,
       case when event_id % 6 = 0 then null when event_id % 194 = 1 then 2
            when event_id % 97 = 1 then 1 else 0 end as tsunami,
       case when event_id % 25 = 0 then (event_id % 90)/1e1 end as mmi,
       case when event_id % 25 = 0 then ((event_id*3) % 90)/1e1 end as cdi,
       case when event_id % 25 = 0 then event_id % 500 end as felt,
       case when event_id % 7 = 0 then 'automatic' else 'reviewed' end as status,
       case when event_type = 'error' and event_id % 5 = 0 then 'quarry blast'
            else 'earthquake' end as type,
       case user_id % 4 when 0 then 'us' when 1 then 'ci' when 2 then 'ak' else 'nc' end as net,
       case when event_id % 33 = 0 then null
            else concat('zone ', user_id % 12, ' cell ', user_id) end as place
"""

CATALOG_SQL = f"""ev as (
select concat('ev', event_id) as id, event_id as seq,
       make_timestamp(946684800000000 + (epoch_us(ts) - 1704067200000000)*120) as "time",
       946684800000000 + (epoch_us(ts) - 1704067200000000)*120 as us,
{_SHARED}
from events),
eq as (select * from ev where type = 'earthquake')
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with the text variants and gaps a raw catalog has."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    micros = "946684800000000 + (unix_micros(cast(ts as timestamp)) - 1704067200000000)*120"
    shared = _SHARED.replace('"', "`")
    return spark.sql(
        "select concat('ev', cast(event_id as string)) as id, event_id as seq, "
        f"timestamp_micros({micros}) as time, {shared} from {{events}}",
        events=read_table(spark, sf_dir, "events"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earthquakes only, the input of nearly every operator."""
    return raw_catalog(spark, sf_dir).where(F.col("type") == "earthquake")


def seconds(column: str = "time"):
    """Epoch seconds as a double."""
    return F.unix_micros(column) / F.lit(1e6)
