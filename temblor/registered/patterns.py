"""Tokens, item sets, rules, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.operators import cleaning, patterns, spatial
from temblor.registered import register
from temblor.registered.spatial import TOKEN, r6
from temblor.sources.catalog import catalog

DAILY = f"""
tok as (select cast("time" as date) as day, {TOKEN} as token, count(*) as n from eq group by 1, 2),
daily as (select day, token, n as event_count from
          (select *, row_number() over (partition by day order by n desc, token) as r from tok) where r = 1)"""


@register("daily_token", DAILY + """
select strftime(day, '%Y-%m-%d') as day, token, event_count from daily""")
def daily_token(spark, sf_dir):
    tokens = patterns.daily_token(catalog(spark, sf_dir))
    return tokens.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("token_ngrams", DAILY + """,
ahead as (select token, lead(token) over (order by day) as t1, lead(token, 2) over (order by day) as t2 from daily),
runs as (select 2::bigint as pattern_len, concat(token, ' -> ', t1) as pattern from ahead where t1 is not null
         union all select 3::bigint, concat(token, ' -> ', t1, ' -> ', t2) from ahead where t2 is not null),
c as (select pattern_len, pattern, count(*) as n from runs group by 1, 2)
select pattern_len, pattern, n, round(n/((select count(*) from daily) - pattern_len + 1), 6) as support
from (select *, row_number() over (partition by pattern_len order by n desc, pattern) as r from c) where r <= 30""")
def token_ngrams(spark, sf_dir):
    grams = patterns.token_ngrams(patterns.daily_token(catalog(spark, sf_dir)))
    return grams.withColumn("support", F.round("support", 6))


@register("transitions", DAILY + """,
s as (select token, lead(token) over (order by day) as next_token from daily),
c as (select token, next_token, count(*) as n from s where next_token is not null group by 1, 2)
select token, next_token, n, round(n/sum(n) over (partition by token), 6) as probability from c""")
def transitions(spark, sf_dir):
    steps = patterns.transitions(patterns.daily_token(catalog(spark, sf_dir)))
    return steps.withColumn("probability", F.round("probability", 6))


def _zone(col, low, step, name):
    first = f"when {col} >= {low} and {col} <= {low + step} then '{name}_{low}_{low + step}'"
    rest = " ".join(f"when {col} > {low + i*step} and {col} <= {low + (i+1)*step} then "
                    f"'{name}_{low + i*step}_{low + (i+1)*step}'" for i in range(1, 6))
    return f"case {first} {rest} end"


BASKETS = """
hc as (select concat(cast(floor((latitude + 90)/25e-1) as bigint), '_',
              cast(floor((longitude + 180)/25e-1) as bigint)) as grid_id, count(*) as n from eq group by 1),
hot as (select grid_id from hc where n >= (select quantile_cont(n, 0.95) from hc)),
q as (select quantile_cont(gap, 1/3e0) g1, quantile_cont(gap, 2/3e0) g2, quantile_cont(nst, 1/3e0) n1,
             quantile_cont(nst, 2/3e0) n2, quantile_cont(rms, 1/3e0) r1, quantile_cont(rms, 2/3e0) r2 from eq),
bins as (select id,
  'mag:' || coalesce(case when mag >= 0 and mag < 3 then 'mag_low' when mag >= 3 and mag < 45e-1 then 'mag_moderate'
     when mag >= 45e-1 and mag < 6 then 'mag_strong' when mag >= 6 and mag < 105e-1 then 'mag_major' end, '<NA>') as a,
  'depth:' || coalesce(case when depth >= 0 and depth < 70 then 'depth_shallow'
     when depth >= 70 and depth < 300 then 'depth_intermediate'
     when depth >= 300 and depth < 800 then 'depth_deep' end, '<NA>') as b,
  'gap:' || coalesce(case when gap <= g1 then 'gap_q1' when gap <= g2 then 'gap_q2' when gap > g2 then 'gap_q3' end, '<NA>') as c,
  'nst:' || coalesce(case when nst <= n1 then 'nst_q1' when nst <= n2 then 'nst_q2' when nst > n2 then 'nst_q3' end, '<NA>') as d,
  'rms:' || coalesce(case when rms <= r1 then 'rms_q1' when rms <= r2 then 'rms_q2' when rms > r2 then 'rms_q3' end, '<NA>') as e,
  'lat:' || coalesce(""" + _zone("latitude", -90, 30, "lat") + """, '<NA>') as f,
  'lon:' || coalesce(""" + _zone("longitude", -180, 60, "lon") + """, '<NA>') as g,
  'hotspot:' || case when concat(cast(floor((latitude + 90)/5) as bigint), '_', cast(floor((longitude + 180)/5) as bigint))
     in (select grid_id from hot) then 'hotspot_yes' else 'hotspot_no' end as h
  from eq, q),
tx as (select id, list_sort([a, b, c, d, e, f, g, h]) as items from bins)"""


def _baskets(spark, sf_dir):
    events = catalog(spark, sf_dir)
    return patterns.transactions(events, spatial.hotspots(events))


@register("transactions", BASKETS + " select id, array_to_string(items, '|') as items from tx")
def transactions(spark, sf_dir):
    return _baskets(spark, sf_dir).withColumn("items", F.array_join("items", "|"))


ITEMSETS = BASKETS + """,
one as (select id, unnest(items) as i from tx),
sets as (select [i] as itemset from one
  union all select [x.i, y.i] from one x join one y on x.id = y.id and x.i < y.i
  union all select [x.i, y.i, z.i] from one x join one y on x.id = y.id and x.i < y.i
                                     join one z on x.id = z.id and y.i < z.i),
fis as (select itemset, count(*) as n, count(*)/(select count(*) from tx) as support from sets group by 1
        having count(*)/(select count(*) from tx) >= 1e-2)"""


@register("frequent_itemsets", ITEMSETS + """
select array_to_string(itemset, '|') as itemset, n, round(support, 6) as support from fis""")
def frequent_itemsets(spark, sf_dir):
    sets = patterns.frequent_itemsets(_baskets(spark, sf_dir))
    return sets.select(F.array_join("itemset", "|").alias("itemset"), "n", r6("support", "support"))


RULES = ITEMSETS + """,
s as (select itemset, support, unnest(itemset) as y from fis where len(itemset) >= 2),
x as (select *, list_filter(itemset, lambda i: i <> y) as left_part from s where y[1:3] in ('lat', 'lon', 'hot')),
r as (select array_to_string(left_part, ' + ') as antecedent, x.y as consequent, x.support,
             x.support/l.support as confidence, x.support/l.support/o.support as lift
      from x join fis l on l.itemset = left_part join fis o on o.itemset = [x.y]
      where len(list_filter(left_part, lambda i: i[1:3] in ('lat', 'lon', 'hot'))) = 0)
select antecedent, consequent, round(support, 6) as support, round(confidence, 6) as confidence,
       round(lift, 6) as lift from r """


def _rules(spark, sf_dir, **limits):
    rules = patterns.location_rules(patterns.frequent_itemsets(_baskets(spark, sf_dir)), **limits)
    return rules.select("antecedent", "consequent", r6("support", "support"),
                        r6("confidence", "confidence"), r6("lift", "lift"))


@register("location_rules", RULES + "where confidence >= 35e-2 and lift >= 105e-2")
def location_rules(spark, sf_dir):
    return _rules(spark, sf_dir)


@register("location_rules_low", RULES + "where confidence >= 1e-1 and lift >= 101e-2")
def location_rules_low(spark, sf_dir):
    """Lower limits, since few rules of the test catalog pass the usual ones."""
    return _rules(spark, sf_dir, min_confidence=0.1, min_lift=1.01)


def _z(col, source="w"):
    return (f"(select case when median(abs({col} - m)) < 1e-12 then null else median(abs({col} - m)) end "
            f"from {source}, (select median({col}) as m from {source}))")


@register("robust_z", f"""
w as (select * from eq)
select id, round(6745e-4*(mag - (select median(mag) from w))/{_z('mag')}, 9) as mag_z,
       round(6745e-4*(depth - (select median(depth) from w))/{_z('depth')}, 9) as depth_z from w""")
def robust_z(spark, sf_dir):
    scored = patterns.robust_z(catalog(spark, sf_dir), ["mag", "depth"])
    return scored.select("id", F.round("mag_z", 9).alias("mag_z"), F.round("depth_z", 9).alias("depth_z"))


_PARTS = " + ".join(f"abs(6745e-4*({c} - (select median({c}) from w))/{_z(c)})"
                    for c in ("mag", "depth", "gap", "nst", "rms"))


@register("outliers", f"""
m as (select median(gap) gap, median(rms) rms, cast(trunc(median(nst)) as bigint) nst from eq),
w as (select id, us, seq, mag, depth, coalesce(eq.gap, m.gap) gap, coalesce(eq.nst, m.nst) nst,
             coalesce(eq.rms, m.rms) rms, floor((latitude + 90)/25e-1) r, floor((longitude + 180)/25e-1) c
      from eq, m),
n as (select *, count(*) over (partition by r, c) as cnt,
             ln(1 + coalesce((us - lag(us) over (order by us, seq))/3600e6, 0)) as g from w),
s as (select id, {_PARTS} + 2*(1 - (cnt - (select min(cnt) from n))/((select max(cnt) - min(cnt) from n) + 1e-12))
             + abs(6745e-4*(g - (select median(g) from n))/{_z('g', 'n')}) as score from n)
select id, round(score, 6) as outlier_score, score >= (select quantile_cont(score, 0.995) from s) as is_outlier from s""")
def outliers(spark, sf_dir):
    events = cleaning.median_fill(catalog(spark, sf_dir))
    return patterns.outliers(events).select("id", r6("outlier_score", "outlier_score"), "is_outlier")
