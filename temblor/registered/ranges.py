"""Joins and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.operators import rangejoin, sequences, spatial
from temblor.registered import register
from temblor.registered.spatial import GRID, haversine_sql, r6
from temblor.registered.temporal import shifted
from temblor.sources.catalog import catalog, raw_catalog


@register("attach_region_stats", """
g as (select *, floor(latitude/10)*10 as lat_grid, floor(longitude/10)*10 as lon_grid from eq),
a as (select lat_grid, lon_grid, avg(mag) m, stddev_samp(mag) s, count(*) n from g group by 1, 2),
y as (select year("time") as yr, lat_grid, lon_grid, count(*) n from g group by 1, 2, 3)
select id, round(a.m, 6) as region_mag_mean, round(a.s, 6) as region_mag_std, a.n as region_event_count,
       y.n as yearly_region_count
from g join a using (lat_grid, lon_grid)
       join y on y.lat_grid = g.lat_grid and y.lon_grid = g.lon_grid and y.yr = year(g."time")""")
def attach_region_stats(spark, sf_dir):
    from temblor.operators.features import add_region_stats

    out = add_region_stats(catalog(spark, sf_dir))
    return out.select("id", r6("region_mag_mean", "region_mag_mean"),
                      r6("region_mag_std", "region_mag_std"), "region_event_count", "yearly_region_count")


@register("historical_30d", """
h as (select a.seq, count(*) n, avg(b.mag) m, max(b.mag) x, max(b.us) last_us from eq a join eq b
      on b.us < a.us and b.us >= a.us - 2592000000000
         and b.latitude between a.latitude - 1 and a.latitude + 1
         and b.longitude between a.longitude - 1 and a.longitude + 1 group by 1)
select id, coalesce(n, 0) as hist_count_30d, round(coalesce(m, 0) + 1.2345678e-8, 6) as hist_mag_mean_30d,
       coalesce(x, 0) as hist_mag_max_30d, coalesce((us - last_us)//86400000000, 9999) as days_since_last
from eq left join h using (seq)""")
def historical_30d(spark, sf_dir):
    out = rangejoin.history_in_box(catalog(spark, sf_dir))
    # Means of 16 decimals lie exactly between two roundings; see ``shifted``.
    return out.select("id", "hist_count_30d", shifted("hist_mag_mean_30d"),
                      "hist_mag_max_30d", "days_since_last")


PARENTS = """
pos as (select seq, us, mag, 6371*cos(radians(latitude))*cos(radians(longitude)) x,
               6371*cos(radians(latitude))*sin(radians(longitude)) y, 6371*sin(radians(latitude)) z,
               us // 259200000000 as slot from eq),
cand as (select *, slot as look from pos union all select *, slot + 1 from pos),
links as (select c.seq, max_by(p.seq, (p.us, p.seq)) as parent from pos c join cand p
          on p.look = c.slot and p.us < c.us and p.us >= c.us - 259200000000 and p.mag > c.mag
          and sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2) + pow(c.z - p.z, 2)) <= 50 group by c.seq)"""


@register("parent_link", PARENTS + " select seq, parent from links")
def parent_link(spark, sf_dir):
    return rangejoin.nearest_earlier(catalog(spark, sf_dir)).select("seq", "parent")


ROOTS = PARENTS + """,
walk as (select seq, seq as root from eq where seq not in (select seq from links)
         union all select l.seq, w.root from links l join walk w on l.parent = w.seq),
members as (select eq.*, root from eq join walk using (seq))"""


@register("sequence_root", ROOTS + " select id, root from members")
def sequence_root(spark, sf_dir):
    return sequences.sequence_roots(catalog(spark, sf_dir)).select("id", "root")


SEQUENCES = ROOTS + """,
heads as (select root, row_number() over (order by us, seq) as sequence_id, mag, us as start_us
          from members where seq = root),
stats as (select m.id, h.sequence_id, row_number() over (partition by m.root order by m.us, m.seq) as seq_position,
                 count(*) over (partition by m.root) as seq_length, h.mag as seq_mainshock_mag,
                 (m.seq = m.root)::bigint as is_seq_mainshock, (m.us - h.start_us)/1e6 as time_since_seq_start_sec
          from members m join heads h using (root))"""


@register("sequence_stats", SEQUENCES + " select * from stats")
def sequence_stats(spark, sf_dir):
    return sequences.sequence_stats(catalog(spark, sf_dir)).select(
        "id", "sequence_id", "seq_position", "seq_length", "seq_mainshock_mag", "is_seq_mainshock",
        "time_since_seq_start_sec")


@register("sequence_totals", SEQUENCES + """
select sum(is_seq_mainshock)::bigint as sequences, count(*) as events, max(seq_length) as longest,
       round(count(*)/sum(is_seq_mainshock), 6) as mean_length from stats""")
def sequence_totals(spark, sf_dir):
    totals = sequences.sequence_totals(sequences.sequence_stats(catalog(spark, sf_dir)))
    return totals.withColumn("mean_length", F.round("mean_length", 6))


ROLES = f"""
mains as (select * from eq where mag >= 55e-1),
near as (select o.seq, arg_min(m.id, (abs(o.us - m.us), m.us, m.seq)) as mid, min(abs(o.us - m.us)) as dt,
                arg_min(o.us < m.us, (abs(o.us - m.us), m.us, m.seq)) as before
         from eq o join mains m on o.us >= m.us - 604800000000 and o.us <= m.us + 2592000000000 and o.us <> m.us
           and o.mag < 55e-1 and o.mag <= m.mag + 1e-12
           and {haversine_sql('m.latitude', 'm.longitude', 'o.latitude', 'o.longitude')} <= 120 group by o.seq),
roles as (select id, case when mag >= 55e-1 then 'mainshock' when dt is null then 'unclassified'
                     when before then 'foreshock' else 'aftershock' end as shock_role,
                 case when mag >= 55e-1 then id else coalesce(mid, '') end as related_mainshock_id,
                 case when mag >= 55e-1 then 0 else dt/3600e6 end as hours_to_mainshock
          from eq left join near using (seq))"""


@register("shock_roles", ROLES + """
select id, shock_role, related_mainshock_id, hours_to_mainshock from roles""")
def shock_roles(spark, sf_dir):
    return rangejoin.shock_roles(catalog(spark, sf_dir)).select(
        "id", "shock_role", "related_mainshock_id", "hours_to_mainshock")


@register("shock_role_counts", ROLES + " select shock_role, count(*) as n from roles group by 1")
def shock_role_counts(spark, sf_dir):
    return (rangejoin.shock_roles(catalog(spark, sf_dir)).groupBy("shock_role")
            .agg(F.count(F.lit(1)).alias("n")))


def _follows(unit):
    return f"""
f as (select a.seq, max(b.mag) as m from eq a join eq b
      on b.us >= a.us and b.us <= a.us + floor(greatest(pow(10, 5e-1*a.mag - 1)*{unit}e6, 1))
      and b.mag > a.mag group by 1)
select id, (m is not null)::bigint as is_aftershock, coalesce(m, mag) as mainshock_mag
from eq left join f using (seq)"""


@register("aftershock_flag", _follows(1))
def aftershock_flag(spark, sf_dir):
    return rangejoin.larger_follows(catalog(spark, sf_dir)).select("id", "is_aftershock", "mainshock_mag")


@register("aftershock_flag_days", _follows(86400))
def aftershock_flag_days(spark, sf_dir):
    """Days instead of seconds, so that the thin test catalog has matches."""
    return rangejoin.larger_follows(catalog(spark, sf_dir), unit=86400).select(
        "id", "is_aftershock", "mainshock_mag")


@register("since_last_m5", """
select id, coalesce((us - max(case when mag >= 5 then us end) over
       (order by us range between unbounded preceding and 1 preceding))//1000000, 31536000) as time_since_last_M5
from eq""")
def since_last_m5(spark, sf_dir):
    return rangejoin.since_last(catalog(spark, sf_dir)).select("id", "time_since_last_M5")


@register("future_majors", GRID + """
select a.region_code, a.id, b.id as major_id, b.mag as major_mag,
       (b.us - a.us)//1000000//86400 as days_after, (b.us - a.us)//1000000 % 86400 // 3600 as hours,
       (b.us - a.us)//1000000 % 3600 // 60 as minutes
from grid a join grid b on a.region_code = b.region_code and b.mag >= 5 and b.us <= a.us + 604800000000
     and (b.us > a.us or (b.us = a.us and b.seq > a.seq))""")
def future_majors(spark, sf_dir):
    return rangejoin.future_majors(spatial.add_grid(catalog(spark, sf_dir)), keys=["region_code"])


@register("majors_ahead", GRID + """,
j as (select a.id, count(*) as n, min(b.us - a.us)//1000000 as first_s, max(b.mag) as big
      from grid a join grid b on a.region_code = b.region_code and b.mag >= 4.5 and b.us <= a.us + 604800000000
        and (b.us > a.us or (b.us = a.us and b.seq > a.seq)) group by 1)
select id, coalesce(n, 0) as majors_ahead, first_s as first_major_s, big as largest_major from grid left join j using (id)""")
def majors_ahead(spark, sf_dir):
    return rangejoin.majors_ahead(spatial.add_grid(catalog(spark, sf_dir)), 4.5, keys=["region_code"]).select(
        "id", "majors_ahead", "first_major_s", "largest_major")


@register("future_majors_asked", GRID + """
select a.id, b.id as major_id, (b.us - a.us)//1000000//86400 as days_after
from grid a join grid b on a.region_code = b.region_code and b.mag >= 4.5 and b.us <= a.us + 604800000000
     and (b.us > a.us or (b.us = a.us and b.seq > a.seq)) where a.mag >= 4""")
def future_majors_asked(spark, sf_dir):
    """The list for the events asked for: those of magnitude 4 and more."""
    events = spatial.add_grid(catalog(spark, sf_dir))
    return rangejoin.future_majors(events, 4.5, keys=["region_code"], asked=events.where("mag >= 4")).select(
        "id", "major_id", "days_after")


@register("missing_events", "select id from ev where status <> 'reviewed'")
def missing_events(spark, sf_dir):
    """The list names every event twice; the store holds the reviewed ones."""
    listed = raw_catalog(spark, sf_dir).select("id")
    stored = raw_catalog(spark, sf_dir).where(F.col("status") == "reviewed")
    return rangejoin.missing_ids(listed.unionByName(listed), stored)
