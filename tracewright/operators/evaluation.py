"""Metrics: points, intervals, classifiers, clusterings, sets, parameter sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.columns import prf, ratio
from tracewright.operators.matching import match_intervals
from tracewright.operators.timeline import as_list, exact_quantiles, value_bucket


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def binary_metrics(scored: DataFrame, label: str, prob: str, thresholds: Sequence[float] = (0.5,),
                   by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy per threshold, in one pass."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    cells = scored.groupBy(*by, label, F.col(prob).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    hit, pos = F.col("_s") >= F.col("threshold"), F.col(label) == 1

    def cell(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))

    out = cells.withColumn("threshold", t).groupBy(*by, "threshold").agg(
        cell(hit & pos).alias("tp"), cell(hit & ~pos).alias("fp"),
        cell(~hit & pos).alias("fn"), cell(~hit & ~pos).alias("tn"))
    return out.select(*by, "threshold", "tp", "fp", "fn", "tn", *prf("tp", "fp", "fn"),
                      ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
                      .alias("accuracy"))


def average_precision(scored: DataFrame, label: str, prob: str) -> DataFrame:
    """Step-wise average precision over distinct scores.

    Cumulative counts are taken inside coarse score buckets and shifted by bucket totals.
    """
    per = (scored.groupBy(F.col(prob).cast("double").alias("_s"))
           .agg(F.count_if(F.col(label) == 1).alias("_p"), F.count(F.lit(1)).alias("_n"))
           .withColumn("_b", value_bucket(F.col("_s") * 65536)))
    sums = per.groupBy("_b").agg(F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn"))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_op"),
                       F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_on"))
    inside = Window.partitionBy("_b").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = (per.withColumn("_cp", F.sum("_p").over(inside)).withColumn("_cn", F.sum("_n").over(inside)).join(sums, "_b"))
    precision = (F.col("_cp") + F.col("_op")) / (F.col("_cn") + F.col("_on")).cast("double")
    return cum.agg(ratio(F.sum(precision * F.col("_p")), F.sum("_p")).alias("average_precision"),
                   F.sum("_p").alias("positives"), F.sum("_n").alias("rows"))


def boundary_metrics(pairs: DataFrame, pred: DataFrame, gt: DataFrame, tolerances: Sequence[int],
                     error: str = "error") -> DataFrame:
    """P/R/F1 and mean and median error of matched points per tolerance.

    ``pairs`` must be matched at each tolerance (column ``tolerance``) or at the widest one.
    """
    if "tolerance" in pairs.columns:
        per = pairs
    else:
        tol = F.explode(F.array(*[F.lit(int(t)).cast("long") for t in tolerances]))
        per = pairs.withColumn("tolerance", tol).filter(F.col(error) <= F.col("tolerance"))
    counts = per.groupBy("tolerance").agg(F.count(F.lit(1)).alias("tp"), F.avg(error).alias("mean_error"))
    median = exact_quantiles(per, "tolerance", error, {"median_error": 0.5})
    totals = _count(pred, "predicted").crossJoin(_count(gt, "truth"))  # two one-row tables
    grid = totals.withColumn("tolerance", F.explode(F.array(*[F.lit(int(t)).cast("long") for t in tolerances])))
    return (grid.join(counts, "tolerance", "left").join(median, "tolerance", "left").na.fill({"tp": 0})
            .withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("truth") - F.col("tp"))
            .select("tolerance", "predicted", "truth", "tp", "fp", "fn", *prf("tp", "fp", "fn"),
                    "mean_error", "median_error"))


def count_errors(pred: DataFrame, gt: DataFrame, key) -> DataFrame:
    """Predicted and true counts per key, errors and ratio."""
    key = as_list(key)
    a = pred.groupBy(*key).agg(F.count(F.lit(1)).alias("predicted"))
    b = gt.groupBy(*key).agg(F.count(F.lit(1)).alias("truth"))
    both = a.join(b, key, "full_outer").na.fill(0, ["predicted", "truth"])
    diff = F.col("predicted") - F.col("truth")
    return (both.withColumn("count_error", diff).withColumn("absolute_error", F.abs(diff))
            .withColumn("relative_error", F.abs(diff) / F.nullif(F.col("truth").cast("double"), F.lit(0.0)))
            .withColumn("ratio", F.col("predicted") / F.nullif(F.col("truth").cast("double"), F.lit(0.0))))


def missed(gt: DataFrame, pairs: DataFrame, key, gt_id: str) -> DataFrame:
    """Truth rows nothing matched."""
    return gt.join(pairs.select(*as_list(key), gt_id), [*as_list(key), gt_id], "left_anti")


def interval_metrics(pairs: DataFrame, pred: DataFrame, truth: DataFrame, key, pred_id: str, truth_id: str,
                     thresholds: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """P/R/F1, count ratio and mean matched IoU at several thresholds.

    The threshold is a group key, so all thresholds are matched together.
    """
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    graded = (pairs.select(*as_list(key), pred_id, truth_id, "iou").withColumn("threshold", t)
              .filter(F.col("iou") >= F.col("threshold")))
    taken = match_intervals(graded, [*as_list(key), "threshold"], pred_id, truth_id)
    hits = taken.groupBy("threshold").agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"))
    totals = _count(pred, "predicted").crossJoin(_count(truth, "truth")).withColumn("threshold", t)
    return (totals.join(hits, "threshold", "left").na.fill({"tp": 0})
            .withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("truth") - F.col("tp"))
            .select("threshold", "predicted", "truth", "tp", *prf("tp", "fp", "fn"),
                    ratio("predicted", "truth").alias("pred_gt_ratio"), "mean_iou"))


def case_table(pred: DataFrame, gt: DataFrame, pairs: DataFrame, key, pred_id: str, gt_id: str,
               pred_ts: str = "ts", gt_ts: str = "ts") -> DataFrame:
    """One row per true positive, false positive and false negative."""
    key = as_list(key)
    tp = pairs.select(F.lit("TP").alias("case_type"), *key, pred_id, gt_id, "pred_ts", "gt_ts", "error")
    fp = (pred.join(pairs.select(*key, pred_id), [*key, pred_id], "left_anti")
          .select(F.lit("FP").alias("case_type"), *key, pred_id, F.col(pred_ts).alias("pred_ts")))
    fn = (gt.join(pairs.select(*key, gt_id), [*key, gt_id], "left_anti")
          .select(F.lit("FN").alias("case_type"), *key, gt_id, F.col(gt_ts).alias("gt_ts")))
    return tp.unionByName(fp, True).unionByName(fn, True)


def _pairs(n: Column) -> Column:
    d = n.cast("double")
    return d * (d - 1) / 2


def contingency(df: DataFrame, truth: str, cluster: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return df.groupBy(*by, truth, cluster).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def cluster_quality(df: DataFrame, truth: str, cluster: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Purity, concentration and adjusted Rand index from the contingency table.

    ``weight`` names a column that says how many rows a row of ``df`` stands for.
    """
    cells = contingency(df, truth, cluster, by, weight)
    per_cluster = cells.groupBy(*by, cluster).agg(F.sum("n").alias("size"), F.max("n").alias("top"))
    sizes = per_cluster.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by).orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    best5 = (sizes.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0)))
             .withColumn("_use", F.least(F.col("_k"), F.greatest(F.lit(5) - F.col("_before"), F.lit(0))))
             .groupBy(*by).agg(F.sum(F.col("_use") * F.col("size")).alias("_top5")))
    c = per_cluster.groupBy(*by).agg(
        F.sum("size").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest"),
        F.sum("top").alias("_pure"), F.avg(F.col("top") / F.col("size")).alias("mean_purity"),
        F.avg((F.col("size") == 1).cast("double")).alias("singleton_share"),
        F.sum(_pairs(F.col("size"))).alias("_pc"))
    t = (cells.groupBy(*by, truth).agg(F.sum("n").alias("n")).groupBy(*by)
         .agg(F.count(F.lit(1)).alias("true_labels"), F.sum(_pairs(F.col("n"))).alias("_pt")))
    s = cells.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("_ps"))
    out = c.join(t, list(by)).join(s, list(by)).join(best5, list(by)) if by else \
        c.crossJoin(t).crossJoin(s).crossJoin(best5)  # one-row tables
    expected = ratio(F.col("_pt") * F.col("_pc"), _pairs(F.col("rows")))
    top = (F.col("_pt") + F.col("_pc")) / 2 - expected
    ari = F.when((F.col("rows") <= 1) | (top == 0), F.lit(1.0)).otherwise((F.col("_ps") - expected) / top)
    return out.select(*by, "rows", "clusters", "true_labels", (F.col("_pure") / F.col("rows")).alias("weighted_purity"),
                      "mean_purity", "largest", (F.col("_top5") / F.col("rows")).alias("top5_share"),
                      "singleton_share", ari.alias("ari"))


def set_recovery(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Precision, recall, F1, Jaccard and the recovered and missing items per row."""
    p, t = F.array_distinct(pred), F.array_distinct(truth)
    both = F.size(F.array_intersect(p, t)).cast("double")
    known = F.size(t) > 0
    precision, recall = ratio(both, F.size(p)), ratio(both, F.size(t))
    return (df.withColumn("recovered", F.sort_array(F.array_intersect(p, t)))
            .withColumn("missing", F.sort_array(F.array_except(t, p)))
            .withColumn("precision", F.when(known, precision)).withColumn("recall", F.when(known, recall))
            .withColumn("f1", F.when(known, ratio(2 * F.col("precision") * F.col("recall"),
                                                  F.col("precision") + F.col("recall"))))
            .withColumn("jaccard", F.when(known, both / F.size(F.array_union(p, t)))))


def accepted_precision(df: DataFrame, accepted: Column, correct: Column, by: Sequence[str] = ()) -> DataFrame:
    """Precision of the accepted labels."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("held_out"), F.count_if(accepted).alias("accepted"),
                                F.count_if(accepted & correct).alias("correct"))
            .withColumn("precision", ratio("correct", "accepted")))


def best_setting(results: DataFrame, params: Sequence[str], metric: str = "f1",
                 by: Sequence[str] = ()) -> DataFrame:
    """Parameters with the highest metric; the smallest parameters win a tie."""
    prefer = F.struct(F.col(metric), *[-F.col(p) for p in params])
    return (results.groupBy(*by).agg(F.max_by(F.struct(*params), prefer).alias("_p"), F.max(metric).alias(metric))
            .select(*by, "_p.*", metric))


def with_params(df: DataFrame, **grid: Sequence[float]) -> DataFrame:
    """One copy of each row per parameter combination; the grid is a literal, not a table."""
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles as one row per quantile."""
    wide = exact_quantiles(df, list(by), col, {f"q{i}": q for i, q in enumerate(qs)})
    rows = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{i}").alias("value"))
                               for i, q in enumerate(qs)]))
    return wide.select(*by, rows.alias("_r")).select(*by, "_r.*")


def sweep_thresholds(scored: DataFrame, label: str, prob: str, thresholds: Sequence[float]) -> DataFrame:
    """Metrics at every threshold and the best one flagged."""
    return binary_metrics(scored, label, prob, thresholds)


def sweep_merge(scored: DataFrame, gt: DataFrame, key, ts: str, score: str, gt_id: str,
                gaps: Sequence[int], tolerances: Sequence[int], chunk: int) -> DataFrame:
    """Merge gap x tolerance sweep (A25).  Gap and tolerance are key columns, so every setting
    is one more group of the same merge and the same match, not one more job."""
    from tracewright.operators.matching import match_points
    from tracewright.operators.segments import merge_points
    key = as_list(key)
    gap_values = [int(g) for g in gaps]
    tol_values = [int(t) for t in tolerances]
    merged = merge_points(_as_long(with_params(scored.select(*key, ts, score), gap=gap_values), "gap"),
                          [*key, "gap"], ts, score, "gap", chunk)
    pred = _as_long(with_params(merged, tolerance=tol_values), "tolerance").withColumn("pred_id", F.col("predicted_ts"))
    truth = _as_long(with_params(gt.select(*key, ts, gt_id), gap=gap_values, tolerance=tol_values), "gap", "tolerance")
    setting = ["gap", "tolerance"]
    found = match_points(pred.withColumnRenamed("predicted_ts", ts), truth, [*key, *setting], ts, "pred_id", gt_id,
                         "tolerance", max(int(chunk), 2 * max(tol_values)))
    hits = found.groupBy(*setting).agg(F.count(F.lit(1)).alias("tp"), F.avg("error").alias("mean_error"))
    n_pred = pred.groupBy(*setting).agg(F.count(F.lit(1)).alias("predicted"))
    return (n_pred.crossJoin(_count(gt, "truth"))  # one row
            .join(hits, setting, "left").na.fill({"tp": 0})
            .withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("truth") - F.col("tp"))
            .select(*setting, "predicted", "truth", "tp", *prf("tp", "fp", "fn"), "mean_error"))


def sweep_peaks(scored: DataFrame, gt: DataFrame, key, ts: str, score: str, gt_id: str, thresholds: Sequence[float],
                distances: Sequence[int], tol: int, chunk: int) -> DataFrame:
    """Score threshold x least distance of peaks, matched within one tolerance.

    Maxima are found once; threshold and distance are key columns of one suppression and one match.
    """
    from tracewright.operators.matching import local_maxima, match_points, suppress
    key, setting = as_list(key), ["threshold", "min_distance"]
    grid = {"threshold": [float(t) for t in thresholds], "min_distance": [int(d) for d in distances]}
    maxima = local_maxima(scored.select(*key, ts, score), key, ts, score, chunk).filter(F.col(score) >= min(grid["threshold"]))
    peaks = _as_long(with_params(maxima, **grid), "min_distance").filter(F.col(score) >= F.col("threshold"))
    kept = suppress(peaks, [*key, *setting], ts, score, "min_distance", max(int(chunk), 2 * max(grid["min_distance"])))
    pred = kept.withColumn("pred_id", F.col(ts).cast("long"))
    truth = _as_long(with_params(gt.select(*key, ts, gt_id), **grid), "min_distance")
    found = match_points(pred, truth, [*key, *setting], ts, "pred_id", gt_id, tol, chunk)
    hits = found.groupBy(*setting).agg(F.count(F.lit(1)).alias("tp"), F.avg("error").alias("mean_error"))
    n_pred = pred.groupBy(*setting).agg(F.count(F.lit(1)).alias("predicted"))
    every = _as_long(with_params(_count(gt, "truth"), **grid), "min_distance")  # one row for each setting
    return (every.join(n_pred, setting, "left").join(hits, setting, "left").na.fill({"tp": 0, "predicted": 0})
            .withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("truth") - F.col("tp"))
            .select(*setting, "predicted", "truth", "tp", *prf("tp", "fp", "fn"), "mean_error"))


def _as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})
