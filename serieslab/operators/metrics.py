"""Evaluation metrics as aggregations by one or more keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.core import lengths, matched, materialise, quantiles, safe_corr, value_ranks, windowed, with_row_index, with_scalars
from serieslab.operators.bootstrap import resampled_ics
from serieslab.operators.rolling import average_ranks


def regression_metrics(df: DataFrame, y: str, p: str, by: str = "series") -> DataFrame:
    e = F.col(y) - F.col(p)
    out = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"))
    return out.select(by, "n", "mse", "mae", F.sqrt("mse").alias("rmse"), F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).alias("r2"))


def skill_scores(df: DataFrame, y: str, p: str, by: str = "series") -> DataFrame:
    """Squared errors against predicting zero and the mean, as ratios and skills, and the error in standard deviations."""
    e = F.col(y) - F.col(p)
    out = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean_y"), F.stddev_pop(y).alias("std_y"), F.avg(e * e).alias("mse"), F.avg(F.col(y) ** 2).alias("mse_zero"), F.var_pop(y).alias("mse_mean")
    )
    ratio = lambda b: F.when(F.col(b) > 0, 1 - F.col("mse") / F.col(b))
    return out.withColumns({"skill_zero": ratio("mse_zero"), "skill_mean": ratio("mse_mean"), "nrmse": F.when(F.col("std_y") > 0, F.sqrt("mse") / F.col("std_y"))})


def spearman_ic(df: DataFrame, y: str, p: str) -> DataFrame:
    """(series, ic): Pearson correlation of average ranks; null where one side is constant."""
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    ranked = average_ranks(average_ranks(both, y, "_ry"), p, "_rp")
    return ranked.groupBy("series").agg(safe_corr("_ry", "_rp").alias("ic"))


def ic_bootstrap(df: DataFrame, y: str, p: str, rounds: int = 1000, block: int | None = None, seed: int = 42, width: int | None = None) -> DataFrame:
    """(series, n_rounds, mean, std, t, p_value, low, high) of the rank correlation over circular blocks; starts come from a hash, so reruns agree.

    Each round's rows are ranked within the round, without copies of rows (see bootstrap). Rows with a null on either side are left out. A
    series under ten blocks gets its own correlation with no spread (0 rounds, t 0, p 1). t is against zero, its p value normal. `width` is
    the number of rows that a task takes."""
    own = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select("series", F.col("idx").alias("_i"), F.col(y).alias("_y"), F.col(p).alias("_p"))
    dense = with_row_index(own, ["series"], ["_i"]).drop("_i")
    ranked = materialise(ranks_and_ties(ranks_and_ties(dense, "_y", "ry", "ny"), "_p", "rp", "np").select("series", "idx", "ry", "ny", "rp", "np"))
    ics = resampled_ics(ranked, rounds, block, seed, width)
    found = ics.groupBy("series").agg(F.count("ic").alias("n_rounds"), F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("std"), F.percentile("ic", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    out = with_scalars(ranked.groupBy("series").agg(safe_corr("ry", "rp").alias("ic")), found, "left")
    whole, spread = F.coalesce("ic", F.lit(0.0)), F.coalesce("std", F.lit(0.0))
    t = F.when(spread > 0, F.col("mean") / (spread / F.sqrt("n_rounds"))).otherwise(0.0)
    out = out.select("series", F.coalesce("n_rounds", F.lit(0).cast("long")).alias("n_rounds"), F.coalesce("mean", whole).alias("mean"), spread.alias("std"), t.alias("t"), F.coalesce(F.col("_q")[0], whole).alias("low"), F.coalesce(F.col("_q")[1], whole).alias("high"))
    return out.withColumn("p_value", F.when(F.col("std") > 0, two_sided_p(F.col("t"))).otherwise(1.0))


def ranks_and_ties(df: DataFrame, x: str, rank: str, ties: str) -> DataFrame:
    """Adds the average rank of x in its series and the number of rows that share it."""
    ranks = value_ranks(df, x, ["series"]).select("series", F.col("value").alias(x), (F.col("below") + (F.col("n") + 1) / 2).alias(rank), F.col("n").alias(ties))
    return with_scalars(df, ranks, "left", ["series", x])


def directional_accuracy(df: DataFrame, y: str, p: str, by: str = "series") -> DataFrame:
    """Share of equal signs among rows where both are not zero; 0.5 without such rows."""
    met = (F.col(y) != 0) & (F.col(p) != 0)
    return df.groupBy(by).agg(F.coalesce(F.avg(F.when(met, (F.signum(y) == F.signum(p)).cast("double"))), F.lit(0.5)).alias("accuracy"))


def diebold_mariano(df: DataFrame, y: str, p: str) -> DataFrame:
    """(series, n, dm, p_value): loss of the forecast against predicting zero, with Newey-West variance; (0, 1) under 50 rows. The number of
    lags follows each series' own length; rows are numbered anew after those without a value are left out."""
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select("series", F.col("idx").alias("_i"), ((F.col(y) - F.col(p)) ** 2 - F.col(y) ** 2).alias("_d"))
    d = with_row_index(d, ["series"], ["_i"]).drop("_i")
    facts = d.groupBy("series").agg(F.avg("_d").alias("_mean"), F.floor(4 * F.pow(F.count("*") / 100, F.lit(2 / 9))).cast("int").alias("_h"))
    h = facts.agg(F.max("_h")).first()[0] or 0
    centred = with_scalars(d, facts).withColumn("_c", F.col("_d") - F.col("_mean"))
    lagged = windowed(centred, {f"_c{k}": (lambda w, k=k: F.lag("_c", k).over(w)) for k in range(1, h + 1)}, back=max(h, 1))
    long_run = F.sum(F.col("_c") ** 2)
    for k in range(1, h + 1):
        weight = F.greatest(F.lit(0.0), 1 - F.lit(k) / (F.first("_h") + 1))
        long_run = long_run + 2 * weight * F.coalesce(F.sum(F.col("_c") * F.col(f"_c{k}")), F.lit(0.0))
    out = lagged.groupBy("series").agg(F.count("*").alias("n"), F.avg("_d").alias("_m"), long_run.alias("_s"))
    dm = F.when((F.col("n") >= 50) & (F.col("_s") > 0), F.col("_m") / F.sqrt(F.col("_s") / F.col("n") / F.col("n"))).otherwise(0.0)
    out = out.select("series", "n", dm.alias("dm"))
    return out.withColumn("p_value", F.when(F.col("n") < 50, 1.0).otherwise(two_sided_p(F.col("dm"))))


def two_sided_p(z: Column) -> Column:
    """Normal two-sided p value, by a rational approximation with an error under 2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: coefficients of the approximation of the error function
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def vol_adjusted_metrics(df: DataFrame, y: str, p: str, sigma: str) -> DataFrame:
    """skill_scores of y and p over sigma, cut at the quantiles of y; a missing value stays missing."""
    own = df.where(F.col(sigma) > 0).withColumns({"_y": F.col(y) / F.col(sigma), "_p": F.col(p) / F.col(sigma)})
    q = quantiles(own, "_y", ["series"], [0.001, 0.999], "_q")
    cut = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col("_q")[0]), F.col("_q")[1]))
    return skill_scores(with_scalars(own, q).withColumns({"_y": cut("_y"), "_p": cut("_p")}), "_y", "_p")


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy and precision, recall and F1 weighted by the classes' rows."""
    cells = df.groupBy(F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    true = cells.groupBy(F.col("_y").alias("_c")).agg(F.sum("_n").alias("_t"), F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)).alias("_h"))
    said = cells.groupBy(F.col("_p").alias("_c")).agg(F.sum("_n").alias("_s"))
    each = true.join(said, "_c", "left").withColumns({"_pr": F.coalesce(F.col("_h") / F.col("_s"), F.lit(0.0)), "_re": F.col("_h") / F.col("_t")})
    each = each.withColumn("_f", F.when(F.col("_pr") + F.col("_re") > 0, 2 * F.col("_pr") * F.col("_re") / (F.col("_pr") + F.col("_re"))).otherwise(0.0))
    weigh = lambda c: F.sum(F.col(c) * F.col("_t")) / F.sum("_t")
    return each.agg(F.sum("_t").alias("n"), (F.sum("_h") / F.sum("_t")).alias("accuracy"), weigh("_pr").alias("precision"), weigh("_re").alias("recall"), weigh("_f").alias("f1"))


def auc_roc(df: DataFrame, y: str, score: str, by: str = "series") -> DataFrame:
    """Exact area under the curve, ties counting one half, from distinct scores."""
    ranks = value_ranks(df.where(F.col(y).isNotNull()), score, [by])
    at = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(by, F.col(score).alias("value")).agg(F.sum(y).alias("_pos")).transform(matched, ranks, [by, "value"])
    s = at.groupBy(by).agg(F.sum("_pos").alias("pos"), F.sum("n").alias("_n"), F.sum(F.col("_pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("_r"))
    neg = F.col("_n") - F.col("pos")
    return s.select(by, F.when((F.col("pos") > 0) & (neg > 0), (F.col("_r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).alias("auc"))


def average_precision(df: DataFrame, y: str, score: str, by: str = "series") -> DataFrame:
    """Sum over distinct scores, descending, of the gain in recall times the precision there."""
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    ranks = value_ranks(rows, score, [by])
    pos = value_ranks(rows.where(F.col(y) == 1), score, [by]).select(by, "value", F.col("n").alias("_p"), F.col("below").alias("_pb"))
    total = rows.groupBy(by).agg(F.count("*").alias("_n"), F.sum(y).alias("_t"))
    at = matched(pos, ranks, [by, "value"]).transform(with_scalars, total, "inner", by)
    precision = (F.col("_t") - F.col("_pb")) / (F.col("_n") - F.col("below"))
    return at.groupBy(by).agg(F.sum(F.col("_p") / F.col("_t") * precision).alias("ap"))


def brier_ece(df: DataFrame, y: str, p: str, bins: int = 10, by: str = "series") -> DataFrame:
    """(by, brier, ece): ece over bins (lo, hi]; a probability of 0 is in none."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    cells = rows.groupBy(by, F.ceil(F.col(p) * bins).alias("_b")).agg(F.count("*").alias("_n"), F.avg(p).alias("_c"), F.avg(y).alias("_a"), F.sum((F.col(y) - F.col(p)) ** 2).alias("_s"))
    gap = F.when(F.col("_b") > 0, F.abs(F.col("_c") - F.col("_a")) * F.col("_n")).otherwise(0.0)
    return cells.groupBy(by).agg((F.sum("_s") / F.sum("_n")).alias("brier"), (F.sum(gap) / F.sum("_n")).alias("ece"))


def precision_at_top(df: DataFrame, y: str, score: str, share: float, tie: str, by: str = "series") -> DataFrame:
    """Precision among the max(1, int(n * share)) highest scores, ties by a column. Rows are placed by ranges, not in one task."""
    ranked = with_row_index(df.withColumn("_neg", -F.col(score)), [by], ["_neg", tie], "_place")
    n = df.groupBy(by).agg(F.count("*").alias("_n"))
    return ranked.transform(with_scalars, n, "inner", by).where(F.col("_place") < F.greatest(F.lit(1), F.floor(F.col("_n") * share))).groupBy(by).agg(F.count("*").alias("k"), F.avg(y).alias("precision"))


def fold_mean(metrics: DataFrame) -> DataFrame:
    """(metric, mean, folds) of (fold, metric, value)."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("folds"))


def sweep_report(results: DataFrame, threshold: float) -> DataFrame:
    """(horizon, n, mean, best, above) of (horizon, r2)."""
    return results.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("r2").alias("mean"), F.max("r2").alias("best"), F.count_if(F.col("r2") > threshold).alias("above"))


def best_pairs(results: DataFrame, k: int = 2) -> DataFrame:
    """The k best entries of each of the two best horizons: (horizon, name, r2, place)."""
    w = Window.partitionBy("horizon").orderBy(F.desc("r2"), "name")
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

