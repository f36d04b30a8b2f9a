"""Scores of predictions: errors, confusion counts, curves, baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temblor.operators.ordered import running
from temblor.operators.quantiles import value_counts
from temblor.operators.summary import histogram

EPS = 1e-12
# Thresholds 0.10 to 0.90 in steps of 0.01.
SWEEP = [0.1 + (0.9 - 0.1) / 80 * i for i in range(81)]


def regression_metrics(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """MAE, RMSE, MSE, MAPE and R2 in one row."""
    error = F.col(y) - F.col(p)
    found = df.agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
                   F.avg(F.abs(error) / F.greatest(F.abs(F.col(y)), F.lit(EPS))).alias("mape"),
                   F.var_pop(y).alias("_var"), F.avg(error).alias("mean_error"))
    return found.withColumns({"rmse": F.sqrt("mse"), "r2": F.lit(1.0) - F.col("mse") / F.col("_var")}).drop("_var")


def _scores(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    one = F.lit(1)
    precision, recall = tp / F.greatest(one, tp + fp), tp / F.greatest(one, tp + fn)
    return {
        "tp": tp, "fp": fp, "tn": tn, "fn": fn, "precision": precision, "recall": recall,
        "f1": F.lit(2.0) * precision * recall / F.greatest(F.lit(EPS), precision + recall),
        "accuracy": (tp + tn) / F.greatest(one, tp + fp + tn + fn),
    }


def threshold_metrics(df: DataFrame, y: str = "label", score: str = "score",
                      thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Confusion counts and scores at each threshold, from one pass."""
    hit = F.col(y) == 1
    wide = df.agg(F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"),
                  F.count_if(hit).alias("_pos"), F.count(F.lit(1)).alias("_all"),
                  *[F.count_if(hit & (F.col(score) >= t)).alias(f"_tp{i}") for i, t in enumerate(thresholds)],
                  *[F.count_if(F.col(score) >= t).alias(f"_p{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"),
                              F.col(f"_p{i}").alias("p")) for i, t in enumerate(thresholds)])
    long = wide.select("brier", "_pos", "_all", F.explode(rows).alias("r")).select("brier", "_pos", "_all", "r.*")
    return _finish(long, ["threshold", "brier"])


def _finish(long: DataFrame, keep: list[str]) -> DataFrame:
    tp = F.col("tp")
    fp, fn = F.col("p") - tp, F.col("_pos") - tp
    return long.select(*keep, *[c.alias(n) for n, c in
                                _scores(tp, fp, F.col("_all") - F.col("_pos") - fp, fn).items()])


def threshold_sweep(df: DataFrame, y: str = "label", score: str = "score",
                    grid: list[float] = SWEEP) -> DataFrame:
    """Scores at every threshold of an ascending grid.

    A row is counted once, by the number of thresholds it reaches; sums over
    that small table give all thresholds, so rows are never copied.
    """
    reached = reduce(lambda a, b: a + b, [(F.col(score) >= t).cast("int") for t in grid])
    counts = df.groupBy(reached.alias("reached")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("hits"))
    # At most len(grid) + 1 rows from here on.
    total = Window.partitionBy()
    levels = counts.withColumns({"_all": F.sum("n").over(total), "_pos": F.sum("hits").over(total)})
    passed = (levels.select(F.explode(F.sequence(F.lit(0), F.col("reached"))).alias("i"), "n", "hits", "_all", "_pos")
              .groupBy("i").agg(F.sum("n").alias("p"), F.sum("hits").alias("tp"),
                                F.max("_all").alias("_all"), F.max("_pos").alias("_pos")))
    # Every threshold has its row; those that no score reaches count nothing. Level 0 carries the totals.
    steps = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "i int, threshold double")
    totals = passed.where("i = 0").select(F.col("_all").alias("all"), F.col("_pos").alias("pos"))
    full = (steps.join(F.broadcast(passed.where("i > 0").drop("_all", "_pos")), "i", "left")
            .join(F.broadcast(totals.withColumn("k", F.lit(1))), F.lit(1) == F.col("k"), "left").drop("k"))
    zero = F.lit(0).cast("bigint")
    return _finish(full.select("threshold", F.coalesce("p", zero).alias("p"), F.coalesce("tp", zero).alias("tp"),
                               F.coalesce("all", zero).alias("_all"), F.coalesce("pos", zero).alias("_pos")),
                   ["threshold"])


def best_threshold(df: DataFrame, y: str = "label", score: str = "score", grid: list[float] = SWEEP) -> DataFrame:
    """The threshold with the highest F1; the lowest one on a tie."""
    swept = threshold_sweep(df, y, score, grid)
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("low")))
    found = swept.agg(best.alias("b"))
    return found.select((-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"))


def _ranked(df: DataFrame, y: str, score: str, reverse: bool, rows_per_chunk: int | None) -> DataFrame:
    """Distinct scores with counts and running counts of rows and positives."""
    counts = value_counts(df.select(score, F.col(y).cast("bigint").alias(y)), score, hits=F.col(y))
    return running(counts, [], {"rows_upto": ("sum", F.col("n")), "hits_upto": ("sum", F.col("hits"))}, (score,),
                   reverse=reverse, rows_per_chunk=rows_per_chunk)


def auc(df: DataFrame, y: str = "label", score: str = "score", rows_per_chunk: int | None = None) -> DataFrame:
    """Area under the ROC curve by mean ranks; null with one class only."""
    ranked = _ranked(df, y, score, False, rows_per_chunk)
    rank = F.col("rows_upto") - (F.col("n") - 1) / F.lit(2.0)
    sums = ranked.agg(F.sum(rank * F.col("hits")).alias("ranks"), F.sum("hits").alias("pos"), F.sum("n").alias("all"))
    pos, neg = F.col("pos"), F.col("all") - F.col("pos")
    value = F.try_divide(F.col("ranks") - pos * (pos + 1) / F.lit(2.0), (pos * neg).cast("double"))
    return sums.select(value.alias("auc"), pos.alias("positives"), neg.alias("negatives"))


def roc_points(df: DataFrame, y: str = "label", score: str = "score", rows_per_chunk: int | None = None) -> DataFrame:
    """False and true positive rate, precision and recall at every score."""
    from temblor.operators.quantiles import scalars

    ranked = _ranked(df, y, score, True, rows_per_chunk)
    totals = scalars(df.agg(F.count(score).alias("n"), F.count_if(F.col(y) == 1).alias("pos")))
    negatives = totals["n"] - totals["pos"]
    return ranked.select(
        F.col(score).alias("threshold"),
        F.try_divide((F.col("rows_upto") - F.col("hits_upto")).cast("double"), negatives.cast("double")).alias("fpr"),
        F.try_divide(F.col("hits_upto").cast("double"), totals["pos"].cast("double")).alias("tpr"),
        (F.col("hits_upto") / F.col("rows_upto")).alias("precision"), F.col("hits").alias("_hits"))


def average_precision(points: DataFrame) -> DataFrame:
    """Precision weighted by the recall each score adds."""
    return points.agg((F.sum(F.col("precision") * F.col("_hits")) / F.sum("_hits")).alias("average_precision"))


def rate_baseline(df: DataFrame, y: str = "label") -> DataFrame:
    """Scores of always predicting the share of positives."""
    rate = df.agg(F.avg(F.col(y).cast("double")).alias("rate"))
    r = F.col("rate")
    return rate.select(r, F.when(r >= 0.5, r).otherwise(F.lit(1.0) - r).alias("accuracy"),
                       F.lit(0.5).alias("auc"), (r * (F.lit(1.0) - r)).alias("brier"))


def improvement(model: Column, baseline: Column, lower_is_better: bool = False) -> Column:
    """Percent gained over a baseline."""
    gain = baseline - model if lower_is_better else model - baseline
    return gain / (baseline + F.lit(1e-8)) * F.lit(100.0)


def with_curve_ends(points: DataFrame) -> DataFrame:
    """ROC and precision-recall points with the start above all scores: nothing found, precision 1."""
    nothing = points.limit(0).select("threshold", "fpr", "tpr", "precision")
    start = points.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0, 1.0)], nothing.schema)
    return points.select("threshold", "fpr", "tpr", "precision").unionByName(start)


def gain_over_baseline(df: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """Accuracy and Brier score at 0.5 of a model, of the share of positives, and the gain in percent."""
    hit = (F.col(score) >= 0.5) == (F.col(y) == 1)
    miss = F.col(score) - F.col(y).cast("double")
    model = df.agg(F.avg(hit.cast("double")).alias("accuracy"), F.avg(miss * miss).alias("brier"),
                   F.avg(F.col(y).cast("double")).alias("r"))
    r = F.col("r")
    base = {"accuracy": F.when(r >= 0.5, r).otherwise(F.lit(1.0) - r), "brier": r * (F.lit(1.0) - r)}
    return model.select(
        "accuracy", base["accuracy"].alias("baseline_accuracy"),
        improvement(F.col("accuracy"), base["accuracy"]).alias("accuracy_gain"), "brier",
        base["brier"].alias("baseline_brier"), improvement(F.col("brier"), base["brier"], True).alias("brier_gain"))


def error_histogram(df: DataFrame, y: str = "label", p: str = "prediction", buckets: int = 50) -> DataFrame:
    return histogram(df.select((F.col(p) - F.col(y)).alias("error")), "error", buckets)


def best_run(history: DataFrame, loss: str = "val_loss", epoch: str = "epoch") -> DataFrame:
    """Epoch with the lowest loss and the values of the last epoch."""
    best = F.min(F.struct(loss, epoch))
    last = F.max(F.struct(epoch, loss))
    return history.agg(best.alias("b"), last.alias("l")).select(
        F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{loss}").alias("best_loss"),
        F.col(f"l.{epoch}").alias("epochs"), F.col(f"l.{loss}").alias("final_loss"))
