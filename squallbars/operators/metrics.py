"""Evaluation metrics as aggregations; curves from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.operators.layout import attach, attach_small, exact_quantiles, running_totals

col = F.col


def _avg(test: Column) -> Column:
    return F.avg(test.cast("double"))


def _group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Side-by-side result tables: on the group keys, or one row each."""
    if keys:
        return attach(a, b, keys)
    return a.withColumn("_o", b.select(F.struct("*")).scalar()).select("*", "_o.*").drop("_o")


# ---- regression -------------------------------------------------------------------------------------
def pinball(y: Column, p: Column, q: float) -> Column:
    gap = y - p
    return F.greatest(gap * q, gap * (q - 1))


def band_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), band: float = 0.3, q: float = 0.5) -> DataFrame:
    err = F.abs(col(p) - col(y))
    return _group(df, keys, (F.avg(err) / F.avg(F.abs(y))).alias("normalized_mae"),
                  _avg(err / (F.abs(y) + 1e-6) < band).alias("within_band_accuracy"),
                  F.avg(pinball(col(y), col(p), q)).alias("quantile_loss"), _avg(col(y) <= col(p)).alias("coverage"))


def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    gap = col(y) - col(p)
    rows = df.withColumn("_abs", F.abs(gap))
    out = _group(rows, keys, F.avg("_abs").alias("mae"), F.avg(gap * gap).alias("mse"),
                 F.sqrt(F.avg(gap * gap)).alias("rmse"),
                 (1 - F.sum(gap * gap) / (F.var_pop(y) * F.count(y))).alias("r2"),
                 F.avg(F.try_divide(col("_abs"), F.abs(y))).alias("mape"),
                 (1 - F.var_pop(gap) / F.var_pop(y)).alias("explained_variance"), F.max("_abs").alias("max_error"),
                 F.stddev_pop(gap).alias("std_error"))
    median = exact_quantiles(rows, keys, "_abs", [0.5]).withColumnRenamed("q0", "median_ae")
    return _join(out, median, keys)


def interval_metrics(df: DataFrame, y: str, quantiles: dict[float, str], keys: Sequence[str] = ()) -> DataFrame:
    """Pinball, MAE and empirical coverage per quantile; coverage and width of the outer interval."""
    aggs = []
    for q, c in quantiles.items():
        tag = str(q).replace("0.", "q")
        aggs += [F.avg(pinball(col(y), col(c), q)).alias(f"pinball_{tag}"), F.avg(F.abs(col(y) - col(c))).alias(f"mae_{tag}"),
                 _avg(col(y) <= col(c)).alias(f"coverage_below_{tag}")]
    low, mid, high = (quantiles[q] for q in (0.1, 0.5, 0.9))
    gap = col(y) - col(mid)
    rows = df.withColumn("_width", col(high) - col(low))
    aggs += [_avg(col(y).between(col(low), col(high))).alias("interval_coverage"), F.avg("_width").alias("mean_width"),
             _avg(col("_width") < 0).alias("non_monotonic"), F.sqrt(F.avg(gap * gap)).alias("rmse_median"),
             (F.avg(F.when(col(y) != 0, F.abs(gap / F.when(col(y) != 0, col(y))))) * 100).alias("mape_median")]
    median = exact_quantiles(rows, keys, "_width", [0.5]).withColumnRenamed("q0", "median_width")
    return _join(_group(rows, keys, *aggs), median, keys)


def winkler(df: DataFrame, y: str, low: str, high: str, keys: Sequence[str] = (), alpha: float = 0.2) -> DataFrame:
    miss = F.when(col(y) < col(low), col(low) - col(y)).when(col(y) > col(high), col(y) - col(high)).otherwise(0.0)
    return _group(df, keys, F.avg(col(high) - col(low) + 2 / alpha * miss).alias("winkler_score"))


# ---- ordinal ----------------------------------------------------------------------------------------
def quadratic_kappa(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quadratic weighted kappa from the moments of both label positions.

    Positions are ranks among the labels that occur; expected disagreement follows from the marginals.
    """
    cells = df.groupBy(*keys, y, p).agg(F.count(F.lit(1)).alias("_n"))
    labels = _group(cells, keys, F.array_sort(F.array_distinct(F.concat(F.collect_set(y), F.collect_set(p)))).alias("_l"))
    placed = (attach(cells, labels, keys) if keys else cells.withColumn("_l", labels.scalar()))
    i, j, n = (F.array_position("_l", col(y)), F.array_position("_l", col(p)), col("_n"))
    total = F.sum(n)
    observed = F.sum(n * F.pow(i - j, 2)) / total
    expected = (F.sum(n * i * i) + F.sum(n * j * j)) / total - 2 * F.sum(n * i) * F.sum(n * j) / total / total
    return _group(placed, keys, (1 - F.try_divide(observed, expected)).alias("qwk"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of tie-averaged ranks, from counts per distinct pair."""
    pairs = df.filter(col(x).isNotNull() & col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_n"))

    def ranks(c: str, out: str) -> DataFrame:
        r = running_totals(pairs, [], c, {"n": F.sum("_n")})
        return r.select(c, (col("cum_n") - (col("n") - 1) / 2).alias(out))

    both = attach_small(attach_small(pairs, ranks(x, "_rx"), [x]), ranks(y, "_ry"), [y])  # a label of few values is a hot key
    n, a, b = F.sum("_n"), col("_rx"), col("_ry")

    def mean(c: Column) -> Column:
        return F.sum(col("_n") * c) / n

    cov = mean(a * b) - mean(a) * mean(b)
    spread = F.sqrt((mean(a * a) - mean(a) * mean(a)) * (mean(b * b) - mean(b) * mean(b)))
    return both.agg(F.coalesce(F.try_divide(cov, spread), F.lit(0.0)).alias("spearman"))


def ordinal_metrics(df: DataFrame, y: str, p: str, top: int, low: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement of a continuous grade with integer labels, continuous and rounded half-even."""
    clipped = F.least(F.greatest(col(p), F.lit(float(low))), F.lit(float(top)))
    rows = df.withColumn("_c", clipped).withColumn("_r", F.rint("_c").cast("int")).withColumn("_y", F.rint(y).cast("int"))
    gap = F.abs(col("_y") - col("_r"))
    out = _group(rows, keys, F.avg(F.abs(col(y) - col("_c"))).alias("mae"),
                 F.sqrt(F.avg(F.pow(col(y) - col("_c"), 2))).alias("rmse"), F.avg(gap).alias("mae_rounded"),
                 F.sqrt(F.avg(gap * gap)).alias("rmse_rounded"), _avg(gap == 0).alias("exact_match"),
                 _avg(gap <= 1).alias("within_1"), F.avg(F.abs(col(y) - col(p))).alias("mae_continuous"))
    return _join(out, quadratic_kappa(rows, "_y", "_r", keys), keys)


def mae_per_class(df: DataFrame, y: str, p: str, top: int) -> DataFrame:
    rounded = F.rint(F.least(F.greatest(col(p), F.lit(0.0)), F.lit(float(top))))
    return df.groupBy(y).agg(F.avg(F.abs(col(y) - rounded)).alias("mae_class"))


# ---- binary -----------------------------------------------------------------------------------------
def _f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.coalesce(F.try_divide((1 + b2) * precision * recall, b2 * precision + recall), F.lit(0.0))


def binary_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, keys: Sequence[str] = (),
                   betas: Sequence[float] = (0.5, 1, 2, 3)) -> DataFrame:
    """Scores at a threshold (>=), probability losses, confusion counts, ranking areas and lift.

    Everything follows from the counts per distinct score, so the rows are read once.
    """
    curve = score_curve(df, y, p, keys)
    score, pos, neg = col("threshold").cast("double"), col("pos"), col("n") - col("pos")
    hit = col("threshold") >= threshold
    prob = F.least(F.greatest(score, F.lit(1e-7)), F.lit(1 - 1e-7))
    rows, none = F.sum("n"), F.lit(0).cast("long")
    base = _group(curve, keys, F.sum(F.when(hit, pos).otherwise(none)).alias("tp"), F.sum(F.when(hit, neg).otherwise(none)).alias("fp"),
                  F.sum(F.when(hit, none).otherwise(pos)).alias("fn"), F.sum(F.when(hit, none).otherwise(neg)).alias("tn"),
                  (F.sum(pos * F.pow(score - 1, 2) + neg * F.pow(score, 2)) / rows).alias("brier_score"),
                  (-F.sum(pos * F.ln(prob) + neg * F.ln(1 - prob)) / rows).alias("log_loss"),
                  (F.sum("pos") / rows).alias("base_rate"), *_areas())
    zero = F.lit(0.0)
    base = base.withColumns({"precision": F.coalesce(F.try_divide(col("tp"), col("tp") + col("fp")), zero),
                             "recall": F.coalesce(F.try_divide(col("tp"), col("tp") + col("fn")), zero)})
    base = base.select("*", *[_f_beta(col("precision"), col("recall"), b).alias(f"f{b}".replace(".", "_")) for b in betas])
    return base.withColumn("lift", F.try_divide(col("pr_auc"), col("base_rate")))


def score_curve(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score taken as threshold."""
    keys = list(keys)
    steps = running_totals(df, keys, p, {"n": F.count(F.lit(1)), "pos": F.sum(col(y).cast("long"))}, descending=True)
    return steps.select(*keys, col(p).alias("threshold"), "n", "pos", "cum_n", "cum_pos", col("total_pos").alias("_p"),
                        col("total_n").alias("_all"), (col("cum_pos") / col("cum_n")).alias("precision"),
                        F.try_divide(col("cum_pos"), col("total_pos")).alias("recall"))


def _areas() -> list[Column]:
    """Average precision (step sum), trapezoid PR area and ROC area over a score curve."""
    gain = F.try_divide(col("pos"), col("_p"))
    before = F.coalesce(F.try_divide(col("cum_pos") - col("pos"), col("cum_n") - col("n")), F.lit(1.0))
    negatives = col("_all") - col("_p")
    below, own = negatives - (col("cum_n") - col("cum_pos")), col("n") - col("pos")
    return [F.sum(gain * col("precision")).alias("pr_auc"),
            F.sum(gain * (col("precision") + before) / 2).alias("pr_auc_trapezoid"),
            F.try_divide(F.sum(col("pos") * (below + own / 2)), F.max("_p") * F.max(negatives)).alias("roc_auc")]


def ranking_areas(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """PR and ROC areas; the ROC area of a single class is null."""
    return _group(score_curve(df, y, p, keys), keys, *_areas())


def best_thresholds(df: DataFrame, y: str, p: str, betas: Sequence[float] = (0.5, 1, 2, 3),
                    min_recalls: Sequence[float] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Per rule the best threshold: highest F-beta, or highest precision at a minimum recall.

    Lowest threshold on ties; without any score of enough recall the one with the highest recall.
    All rules read one curve.
    """
    curve = score_curve(df, y, p, keys)
    precision, recall = col("precision"), col("recall")
    merits = {f"f{b}": (1 + b * b) * precision * recall / (b * b * precision + recall + 1e-9) for b in betas}
    merits |= {f"recall_{m}": F.when(recall >= m, precision).otherwise(recall - 2) for m in min_recalls}
    spot = F.struct("threshold", "precision", "recall")
    picks = [F.struct(F.lit(n).alias("name"), F.max_by(spot, F.struct(m, -col("threshold"))).alias("b")) for n, m in merits.items()]
    best = _group(curve, keys, F.array(*picks).alias("_picks")).select(*keys, F.explode("_picks").alias("_x"))
    return best.select(*keys, "_x.name", "_x.b.*")


def best_threshold(df: DataFrame, y: str, p: str, beta: float = 2.0, min_recall: float | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    betas, recalls = ((beta,), ()) if min_recall is None else ((), (min_recall,))
    return best_thresholds(df, y, p, betas, recalls, keys).drop("name")


# ---- multiclass -------------------------------------------------------------------------------------
def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = df.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(col(y).alias("label"), col("n").alias("actual"), F.lit(0).cast("long").alias("said"),
                                       F.when(col(y) == col(p), col("n")).otherwise(0).cast("long").alias("tp")),
                              F.struct(col(p).alias("label"), F.lit(0).cast("long").alias("actual"), col("n").alias("said"),
                                       F.lit(0).cast("long").alias("tp"))))
    sums = cells.select(sides.alias("s")).select("s.*").groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("said").alias("said"), F.sum("actual").alias("support"))
    zero = F.lit(0.0)
    out = sums.withColumns({"precision": F.coalesce(F.try_divide(col("tp"), col("said")), zero),
                            "recall": F.coalesce(F.try_divide(col("tp"), col("support")), zero)})
    return out.withColumn("f1", _f_beta(col("precision"), col("recall"), 1)).select(
        "label", "precision", "recall", "f1", "support", "tp", "said")


def multiclass_metrics(df: DataFrame, y: str, p: str, prob_true: str | None = None) -> DataFrame:
    rep = class_report(df, y, p)
    support = F.sum("support")
    names = ("precision", "recall", "f1")
    micro = F.sum("tp") / support
    out = rep.agg(micro.alias("accuracy"), *[F.avg(n).alias(f"{n}_macro") for n in names],
                  *[micro.alias(f"{n}_micro") for n in names],
                  *[(F.sum(col(n) * col("support")) / support).alias(f"{n}_weighted") for n in names])
    if prob_true:
        loss = df.agg(F.avg(-F.ln(F.least(F.greatest(col(prob_true), F.lit(1e-15)), F.lit(1 - 1e-15))))).scalar()
        out = out.withColumn("log_loss", loss)
    return out


def one_vs_rest_auc(df: DataFrame, y: str, scores: dict[str, str]) -> DataFrame:
    """ROC area of each class against the rest and their mean; ``scores`` maps class to score column."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (col(y) == c).cast("int").alias("y"),
                                                  col(s).alias("score")) for c, s in scores.items()])).alias("r")).select("r.*")
    areas = ranking_areas(rows, "y", "score", ["class"]).select("class", "roc_auc")
    return areas.withColumn("macro_auc", areas.agg(F.avg("roc_auc")).scalar())


# ---- calibration and folds --------------------------------------------------------------------------
def calibration_curve(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean predicted and observed rate in quantile bins of the score."""
    qs = [i / bins for i in range(1, bins)]
    cuts = exact_quantiles(df, [], p, qs).select(F.array(*[f"q{i}" for i in range(len(qs))])).scalar()
    place = F.size(F.filter(col("_cuts"), lambda c: c < col(p)))
    return (df.withColumn("_cuts", cuts).groupBy(place.alias("bin"))
            .agg(F.avg(p).alias("prob_pred"), F.avg(col(y).cast("double")).alias("prob_true"), F.count(F.lit(1)).alias("n")))


def over_folds(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of per-fold metrics."""
    return per_fold.agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(f"{m}_mean") for m in metrics],
                        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])


def fold_report(per_fold: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per-fold metrics beside the rows and ranges of the fold's training and validation parts (``folds.summary``)."""
    return sizes.join(per_fold, "fold")
