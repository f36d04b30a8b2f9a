"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.functions.scalars import sigmoid
from temblor.operators import metrics
from temblor.registered import register
from temblor.registered.spatial import r6
from temblor.sources.catalog import catalog

# Deterministic predictions derived from the catalog: a score from magnitude
# and depth, the label from the significance, and a linear magnitude estimate.
PRED = """
pred as (select id, seq, (coalesce(sig, 0) >= 60)::bigint as label,
                round(1/(1 + exp(-(mag - 1 + (depth - 350)/500))), 4) as score,
                mag, 8e-1*mag + depth/1e3 as estimate from eq)"""


def _pred(spark, sf_dir):
    score = F.round(sigmoid(F.col("mag") - 1 + (F.col("depth") - 350) / 500), 4)
    return catalog(spark, sf_dir).select(
        "id", "seq", (F.coalesce("sig", F.lit(0)) >= 60).cast("bigint").alias("label"), score.alias("score"),
        "mag", (F.lit(0.8) * F.col("mag") + F.col("depth") / 1e3).alias("estimate"))


@register("regression_metrics", PRED + """
select round(avg(abs(mag - estimate)), 6) as mae, round(avg(pow(mag - estimate, 2)), 6) as mse,
       round(sqrt(avg(pow(mag - estimate, 2))), 6) as rmse,
       round(avg(abs((mag - estimate)/greatest(abs(mag), 1e-12))), 6) as mape,
       round(1 - avg(pow(mag - estimate, 2))/var_pop(mag), 6) as r2, round(avg(mag - estimate), 6) as mean_error
from pred""")
def regression_metrics(spark, sf_dir):
    found = metrics.regression_metrics(_pred(spark, sf_dir), "mag", "estimate")
    return found.select(*[r6(c, c) for c in ("mae", "mse", "rmse", "mape", "r2", "mean_error")])


SCORES = """
       round(tp/greatest(1, tp + fp), 6) as precision, round(tp/greatest(1, tp + fn), 6) as recall,
       round(2*(tp/greatest(1, tp + fp))*(tp/greatest(1, tp + fn))
             /greatest(1e-12, tp/greatest(1, tp + fp) + tp/greatest(1, tp + fn)), 6) as f1,
       round((tp + tn)/greatest(1, tp + tn + fp + fn), 6) as accuracy"""
COUNTS = """count(*) filter (label = 1 and score >= t) as tp, count(*) filter (label = 0 and score >= t) as fp,
       count(*) filter (label = 0 and score < t) as tn, count(*) filter (label = 1 and score < t) as fn"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("threshold_metrics", PRED + f""",
c as (select t as threshold, {COUNTS}, avg(pow(score - label, 2)) as brier
      from pred, (values (3e-1), (5e-1), (7e-1)) g(t) group by t)
select threshold, tp, fp, tn, fn, round(brier, 6) as brier, {SCORES} from c""")
def threshold_metrics(spark, sf_dir):
    return _rounded(metrics.threshold_metrics(_pred(spark, sf_dir)), "brier", "precision", "recall", "f1", "accuracy")


SWEEP = PRED + f""",
g as (select 1e-1 + (9e-1 - 1e-1)/80*range as t from range(81)),
c as (select t as threshold, {COUNTS} from pred, g group by t),
f as (select threshold, tp, fp, tn, fn, {SCORES} from c)"""


@register("threshold_sweep", SWEEP + """
select round(threshold, 6) as threshold, tp, fp, tn, fn, precision, recall, f1, accuracy from f""")
def threshold_sweep(spark, sf_dir):
    return _rounded(metrics.threshold_sweep(_pred(spark, sf_dir)), "threshold", "precision", "recall", "f1",
                    "accuracy")


@register("best_threshold", SWEEP + """
select round(threshold, 6) as threshold, f1 from f order by f1 desc, f.threshold limit 1""")
def best_threshold(spark, sf_dir):
    return _rounded(metrics.best_threshold(_pred(spark, sf_dir)), "threshold", "f1")


@register("auc", PRED + """,
r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1)/2e0 as k from pred)
select round((sum(k) filter (label = 1) - sum(label)*(sum(label) + 1)/2)/(sum(label)*(count(*) - sum(label))), 6) as auc,
       sum(label)::bigint as positives, (count(*) - sum(label))::bigint as negatives from r""")
def auc(spark, sf_dir):
    return _rounded(metrics.auc(_pred(spark, sf_dir)), "auc")


ROC = PRED + """,
s as (select score, count(*) as n, sum(label) as hits from pred group by 1),
p as (select score, hits, sum(n) over (order by score desc) as rows_upto, sum(hits) over (order by score desc) as hits_upto,
             sum(hits) over () as pos, sum(n) over () as total from s)"""


@register("roc_points", ROC + """
select score as threshold, round((rows_upto - hits_upto)/(total - pos), 6) as fpr, round(hits_upto/pos, 6) as tpr,
       round(hits_upto/rows_upto, 6) as precision from p""")
def roc_points(spark, sf_dir):
    return _rounded(metrics.roc_points(_pred(spark, sf_dir)).drop("_hits"), "fpr", "tpr", "precision")


@register("curve_points", ROC + """
select score as threshold, round((rows_upto - hits_upto)/(total - pos), 6) as fpr, round(hits_upto/pos, 6) as tpr,
       round(hits_upto/rows_upto, 6) as precision from p
union all select 'infinity'::double, 0e0, 0e0, 1e0""")
def curve_points(spark, sf_dir):
    """All points of both curves with their common start."""
    points = metrics.with_curve_ends(metrics.roc_points(_pred(spark, sf_dir)))
    return _rounded(points, "fpr", "tpr", "precision")


@register("gain_over_baseline", PRED + """,
m as (select avg(((score >= 5e-1) = (label = 1))::int::double) as accuracy, avg((score - label)*(score - label)) as brier,
             avg(label::double) as r from pred),
b as (select *, case when r >= 5e-1 then r else 1 - r end as ba, r*(1 - r) as bb from m)
select round(accuracy, 6) as accuracy, round(ba, 6) as baseline_accuracy,
       round((accuracy - ba)/(ba + 1e-8)*100, 6) as accuracy_gain, round(brier, 6) as brier,
       round(bb, 6) as baseline_brier, round((bb - brier)/(bb + 1e-8)*100, 6) as brier_gain from b""")
def gain_over_baseline(spark, sf_dir):
    out = metrics.gain_over_baseline(_pred(spark, sf_dir))
    return _rounded(out, *out.columns)


@register("average_precision", ROC + """
select round(sum(hits_upto/rows_upto*hits)/sum(hits), 6) as average_precision from p""")
def average_precision(spark, sf_dir):
    points = metrics.roc_points(_pred(spark, sf_dir))
    return _rounded(metrics.average_precision(points), "average_precision")


@register("rate_baseline", PRED + """,
r as (select avg(label) as rate from pred)
select round(rate, 6) as rate, round(case when rate >= 5e-1 then rate else 1 - rate end, 6) as accuracy, 5e-1 as auc,
       round(rate*(1 - rate), 6) as brier from r""")
def rate_baseline(spark, sf_dir):
    return _rounded(metrics.rate_baseline(_pred(spark, sf_dir)), "rate", "accuracy", "brier")


@register("error_histogram", PRED + """,
e as (select estimate - mag as error from pred),
l as (select min(error) as lo, max(error) as hi from e)
select least(cast(floor((error - lo)/((hi - lo)/50e0)) as bigint), 49) as bucket, count(*) as n from e, l group by 1""")
def error_histogram(spark, sf_dir):
    return metrics.error_histogram(_pred(spark, sf_dir), "mag", "estimate").select("bucket", "n")


@register("best_run", PRED + """,
h as (select seq % 25 as epoch, avg(pow(score - label, 2)) as val_loss from pred group by 1)
select arg_min(epoch, val_loss) as best_epoch, round(min(val_loss), 6) as best_loss, max(epoch) as epochs,
       round(arg_max(val_loss, epoch), 6) as final_loss from h""")
def best_run(spark, sf_dir):
    """A 25-row loss history, one row per residue of the event number."""
    loss = F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label")))
    history = _pred(spark, sf_dir).groupBy((F.col("seq") % 25).alias("epoch")).agg(loss.alias("val_loss"))
    return _rounded(metrics.best_run(history), "best_loss", "final_loss")
