"""Clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.operators import cleaning, clustering, features, summary
from temblor.registered import register
from temblor.registered.spatial import GRID, r6
from temblor.session import materialize
from temblor.sources.catalog import catalog

SCALED = [c + "_scaled" for c in clustering.EVENT_FEATURES]
PHYSICAL = ["mag", "depth", "gap", "nst", "rms"]


def _events(spark, sf_dir):
    flagged = catalog(spark, sf_dir).withColumn("tsunami", cleaning.zero_one("tsunami"))
    return features.engineered(flagged)


def _matrix(spark, sf_dir):
    flagged = catalog(spark, sf_dir).withColumn("tsunami", cleaning.zero_one("tsunami"))
    return clustering.robust_scale(features.event_columns(flagged), clustering.EVENT_FEATURES)


@register("robust_scale", """
m as (select median(gap) gap from eq),
f as (select id, mag, coalesce(eq.gap, m.gap) as gap from eq, m),
q as (select quantile_cont(mag, 0.1) a, median(mag) b, quantile_cont(mag, 0.9) c, quantile_cont(gap, 0.1) d,
             median(gap) e, quantile_cont(gap, 0.9) f from f)
select id, round((mag - b)/(c - a), 8) as mag, round((f.gap - e)/(q.f - d), 8) as gap from f, q""")
def robust_scale(spark, sf_dir):
    scaled = clustering.robust_scale(catalog(spark, sf_dir), ["mag", "gap"])
    return scaled.select("id", F.round("mag_scaled", 8).alias("mag"), F.round("gap_scaled", 8).alias("gap"))


@register("event_k_eval")
def event_k_eval(spark, sf_dir):
    return clustering.k_sweep(_matrix(spark, sf_dir), SCALED)


def _best_fit(matrix):
    """Labels by the sweep's model of the best silhouette, and that model."""
    sweep, models = clustering.sweep_models(matrix, SCALED)
    model = models[clustering.best_k(sweep)]
    return clustering.label_rows(matrix, SCALED, model, "event_cluster"), model


@register("event_clusters")
def event_clusters(spark, sf_dir):
    """Clusters of all events, with the k of the best silhouette."""
    labeled, _ = _best_fit(materialize(_matrix(spark, sf_dir)))
    return labeled.select("id", "event_cluster")


@register("event_cluster_centroids")
def event_cluster_centroids(spark, sf_dir):
    """Centroids of the fitted model in the units of the columns."""
    matrix = materialize(_matrix(spark, sf_dir))
    labeled, model = _best_fit(matrix)
    scales = clustering.scaling(matrix, clustering.EVENT_FEATURES)
    centers = clustering.restore_centroids(spark, [c.tolist() for c in model.clusterCenters()],
                                           clustering.EVENT_FEATURES, scales)
    sizes = labeled.groupBy("event_cluster").agg(F.count(F.lit(1)).alias("event_count"))
    return centers.join(sizes, "event_cluster")


@register("restored_centroids", """
m as (select median(mag) mag, median(gap) gap from eq),
f as (select coalesce(eq.mag, m.mag) mag, coalesce(eq.gap, m.gap) gap from eq, m),
q as (select quantile_cont(mag, 0.1) a, median(mag) b, quantile_cont(mag, 0.9) c, quantile_cont(gap, 0.1) d,
             median(gap) e, quantile_cont(gap, 0.9) f from f),
c as (select * from (values (0, 0e0, 0e0), (1, 1e0, -1e0), (2, 5e-1, 25e-2)) t(i, x, y))
select i::bigint as event_cluster, round(x*(c - a) + b, 8) as mag_centroid, round(y*(f - d) + e, 8) as gap_centroid
from c, q""")
def restored_centroids(spark, sf_dir):
    """Given centroids put back into units by the scaling of the catalog."""
    scales = clustering.scaling(catalog(spark, sf_dir), ["mag", "gap"])
    out = clustering.restore_centroids(spark, [[0.0, 0.0], [1.0, -1.0], [0.5, 0.25]], ["mag", "gap"], scales)
    return out.withColumns({c: F.round(c, 8) for c in ("mag_centroid", "gap_centroid")})


@register("cluster_profile", GRID + """,
g as (select *, floor(mag) as label from grid),
k as (select label, "magType" as v, count(*) as n from g group by 1, 2),
b as (select label, case when depth <= 70 then 'shallow' when depth <= 300 then 'intermediate' else 'deep' end as v,
             count(*) as n from g group by 1, 2),
kk as (select label, v from (select *, row_number() over (partition by label order by n desc, v nulls last) r from k) where r = 1),
bb as (select label, v from (select *, row_number() over (partition by label order by n desc, v nulls last) r from b) where r = 1)
select label::bigint as label, count(*) as event_count, round(avg(mag), 6) as mag_mean, round(avg(depth), 6) as depth_mean,
       round(avg(sig), 6) as sig_mean, round(avg(least(greatest(coalesce(tsunami, 0), 0), 1)), 6) as tsunami_rate,
       count(distinct region_code) as region_count, round(quantile_cont(mag, 0.9), 6) as mag_p90,
       any_value(kk.v) as top_mag_type, any_value(bb.v) as top_depth_band
from g join kk using (label) join bb using (label) group by 1""")
def cluster_profile(spark, sf_dir):
    """Whole magnitude units stand in as given labels."""
    events = _events(spark, sf_dir).withColumn("label", F.floor("mag"))
    out = clustering.cluster_profile(events, "label")
    return out.withColumns({c: F.round(c, 6) for c in ("mag_mean", "depth_mean", "sig_mean", "tsunami_rate", "mag_p90")})


@register("mixed_kmeans")
def mixed_kmeans(spark, sf_dir):
    """Rows with a gap have cluster -1."""
    scaled = features.standardize(catalog(spark, sf_dir), PHYSICAL)
    labeled, _, _ = clustering.mixed_kmeans(scaled, [c + "_std" for c in PHYSICAL], 4)
    return labeled.select("id", "cluster", r6("distance2", "distance2"))


CENTERS = [{"mag": 2.0, "depth": 30.0, "lat": 10.0, "lon": 20.0}, {"mag": 5.0, "depth": 200.0, "lat": -40.0, "lon": 150.0},
           {"mag": 3.5, "depth": 90.0, "lat": 55.0, "lon": -120.0}]


@register("nearest_centroid", """
c as (select * from (values (0, 2e0, 30e0, 10e0, 20e0), (1, 5e0, 200e0, -40e0, 150e0), (2, 35e-1, 90e0, 55e0, -120e0))
      t(i, m, d, la, lo)),
h as (select id, i, (mag - m)*(mag - m) + (depth - d)*(depth - d) as p,
             sin(radians(la - latitude)/2)**2 + cos(radians(latitude))*cos(radians(la))*sin(radians(lo - longitude)/2)**2 as h
      from eq, c where mag is not null and depth is not null and latitude is not null and longitude is not null),
d as (select id, i, p + (2*6371*asin(sqrt(h))/1000)**2 as d from h),
n as (select id, i, d, row_number() over (partition by id order by d, i) as r from d)
select eq.id, coalesce(n.i, -1)::bigint as cluster, round(n.d, 4) as distance2
from eq left join n on eq.id = n.id and n.r = 1""")
def nearest_centroid(spark, sf_dir):
    """Labels by given centroids, 1000 km weighing as one unit."""
    found = clustering.nearest_centroid(catalog(spark, sf_dir), ["mag", "depth"], CENTERS, 1000.0)
    return found.select("id", "cluster", F.round("distance2", 4).alias("distance2"))


@register("mixed_k_sweep")
def mixed_k_sweep(spark, sf_dir):
    scaled = features.standardize(catalog(spark, sf_dir).na.drop(subset=PHYSICAL), PHYSICAL)
    return clustering.mixed_k_sweep(scaled, [c + "_std" for c in PHYSICAL])


@register("physical_clusters")
def physical_clusters(spark, sf_dir):
    """k by the between/within ratio on standardized properties; -1 for gaps."""
    events = catalog(spark, sf_dir)
    scaled = features.standardize(events.na.drop(subset=PHYSICAL), PHYSICAL)
    columns = [c + "_std" for c in PHYSICAL]
    sweep, models = clustering.sweep_models(scaled, columns, 3, 8)
    labeled = clustering.label_rows(scaled, columns, models[clustering.best_k(sweep, "separation")], "cluster_physical")
    return (events.select("id").join(labeled.select("id", "cluster_physical"), "id", "left")
            .withColumn("cluster_physical", F.coalesce("cluster_physical", F.lit(-1).cast("bigint"))))


def _regions(spark, sf_dir):
    return summary.region_profile(_events(spark, sf_dir).drop(
        "lat_cell", "lon_cell", "region_code", "region_lat_center", "region_lon_center"))


@register("region_k_eval")
def region_k_eval(spark, sf_dir):
    eligible = _regions(spark, sf_dir).where(F.col("event_count") >= 25)
    scaled = clustering.robust_scale(eligible, clustering.REGION_FEATURES)
    return clustering.k_sweep(scaled, [c + "_scaled" for c in clustering.REGION_FEATURES], key="region_code")


def _clustered_regions(spark, sf_dir):
    """Regions with the k of the best silhouette."""
    regions = materialize(_regions(spark, sf_dir))
    columns = clustering.REGION_FEATURES
    scaled = clustering.robust_scale(regions.where(F.col("event_count") >= 25), columns)
    sweep = clustering.k_sweep(scaled, [c + "_scaled" for c in columns], key="region_code")
    return clustering.fit_regions(regions, clustering.best_k(sweep))


@register("region_clusters")
def region_clusters(spark, sf_dir):
    labeled, _ = _clustered_regions(spark, sf_dir)
    return labeled.select("region_code", "event_count", "region_cluster")


@register("region_cluster_profile")
def region_cluster_profile(spark, sf_dir):
    """Means of the regions of a cluster beside its centroid in the columns' own units."""
    labeled, model = _clustered_regions(spark, sf_dir)
    centroids = clustering.region_centroids(spark, model, labeled.where("region_cluster >= 0"))
    return clustering.region_cluster_profile(labeled, centroids)


@register("hotspot_kmeans")
def hotspot_kmeans(spark, sf_dir):
    """Five clusters of standardized position and depth."""
    columns = ["longitude", "latitude", "depth"]
    scaled = features.standardize(catalog(spark, sf_dir), columns)
    labeled, _ = clustering.fit_clusters(scaled, [c + "_std" for c in columns], 5, label="cluster")
    return labeled.select("id", "cluster")


@register("pca_2d")
def pca_2d(spark, sf_dir):
    """Two components of all events beside their cluster."""
    labeled, _ = _best_fit(materialize(_matrix(spark, sf_dir)))
    return clustering.pca_2d(labeled, SCALED).select("id", "event_cluster", r6("pc1", "pc1"), r6("pc2", "pc2"))


@register("pca_two_columns", """
c as (select id, mag - avg(mag) over () as x, (depth - avg(depth) over ())/100 as y from eq),
m as (select var_samp(x) a, covar_samp(x, y) b, var_samp(y) c from c),
e as (select *, (a + c)/2 + sqrt((a - c)*(a - c)/4 + b*b) as l from m),
v as (select b/sqrt(b*b + (l - a)*(l - a)) as p, (l - a)/sqrt(b*b + (l - a)*(l - a)) as q from e)
select id, round(abs(x*p + y*q), 6) as pc1, round(abs(y*p - x*q), 6) as pc2 from c, v""")
def pca_two_columns(spark, sf_dir):
    """Components of two columns, which have a closed form; their signs are free."""
    events = catalog(spark, sf_dir).select("id", "mag", (F.col("depth") / 100).alias("d"))
    found = clustering.pca_2d(events, ["mag", "d"])
    return found.select("id", r6(F.abs("pc1"), "pc1"), r6(F.abs("pc2"), "pc2"))


@register("silhouette_given", """
p as (select seq % 3 as label, mag as x, depth/100 as y from eq),
s as (select label, count(*) as n, sum(x) sx, sum(y) sy, sum(x*x + y*y) q from p group by 1),
d as (select p.label, row_number() over () as id, x, y from p),
t as (select d.id, d.label = s.label as own, (s.n*(x*x + y*y) + s.q - 2*(x*sx + y*sy))
        /(case when d.label = s.label then s.n - 1 else s.n end) as v from d, s),
m as (select id, max(v) filter (own) as a, min(v) filter (not own) as b from t group by 1)
select round(avg((b - a)/greatest(a, b)), 6) as silhouette, count(*) as n from m""")
def silhouette_given(spark, sf_dir):
    """Mean silhouette of given labels."""
    events = catalog(spark, sf_dir).select((F.col("seq") % 3).alias("label"), F.array("mag", F.col("depth") / 100).alias("x"))
    found = clustering.silhouettes(events, "x", ["label"])["label"]
    return events.agg(F.round(F.lit(found), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@register("centroid_update", """
c as (select * from (values (0, 2e0, 30e0, 10e0, 20e0), (1, 5e0, 200e0, -40e0, 150e0), (2, 35e-1, 90e0, 55e0, -120e0))
      t(i, m, d, la, lo)),
h as (select id, mag, depth, latitude, longitude, i, (mag - m)*(mag - m) + (depth - d)*(depth - d) as p,
             sin(radians(la - latitude)/2)**2 + cos(radians(latitude))*cos(radians(la))*sin(radians(lo - longitude)/2)**2 as h
      from eq, c),
n as (select *, row_number() over (partition by id order by p + (2*6371*asin(sqrt(h))/1000)**2, i) as r from h),
a as (select i, avg(mag) mag, avg(depth) depth, avg(cos(radians(latitude))*cos(radians(longitude))) x,
             avg(cos(radians(latitude))*sin(radians(longitude))) y, avg(sin(radians(latitude))) z from n where r = 1 group by 1)
select i::bigint as cluster, round(mag, 6) as mag, round(depth, 6) as depth,
       round(degrees(atan2(z, sqrt(x*x + y*y))), 6) as lat, round(degrees(atan2(y, x)), 6) as lon from a""")
def centroid_update(spark, sf_dir):
    """One update of given centroids by the rows nearest to them."""
    found = clustering.centroid_step(catalog(spark, sf_dir), ["mag", "depth"], CENTERS, 1000.0)
    rows = [(i, *[float(c[x]) for x in ("mag", "depth", "lat", "lon")]) for i, c in found.items()]
    made = spark.createDataFrame(rows, "cluster bigint, mag double, depth double, lat double, lon double")
    return made.select("cluster", *[r6(c, c) for c in ("mag", "depth", "lat", "lon")])
