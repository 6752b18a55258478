"""Queries over scored rows: walk-forward folds, metrics, thresholds and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from squallbars.catalog.registry import query, r, rounded
from squallbars.catalog.sql import rd, rds, with_tables
from squallbars.operators import folds, metrics
from squallbars.sources import inputs

col = F.col

# ---- folds ------------------------------------------------------------------------------------------


def month_bounds_sql(train: int, val: int, step: int, expanding: bool) -> str:
    start = "t0" if expanding else f"vs - INTERVAL {train} MONTH"
    return f"""
span AS (SELECT min(datetime) AS t0, max(datetime) AS t1 FROM dbars),
walk AS (SELECT 0 AS i, t0, t1, t0 + INTERVAL {train} MONTH AS vs FROM span UNION ALL
  SELECT i + 1, t0, t1, vs + INTERVAL {step} MONTH FROM walk WHERE vs + INTERVAL {step} MONTH <= t1),
bounds AS (SELECT CAST(i AS INT) AS fold, {start} AS train_start, vs AS val_start, vs + INTERVAL {val} MONTH AS val_end FROM walk
  WHERE vs <= t1)"""


FOLD_SUMMARY = """
f AS (SELECT fold, datetime, CASE WHEN datetime < val_start THEN 'train' ELSE 'val' END AS role FROM dbars JOIN bounds
  ON datetime >= train_start AND datetime < val_end)"""
FOLD_BODY = """
SELECT * FROM (SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_val,
  min(datetime) FILTER (role = 'train') AS train_from, max(datetime) FILTER (role = 'train') AS train_to,
  min(datetime) FILTER (role = 'val') AS val_from, max(datetime) FILTER (role = 'val') AS val_to FROM f GROUP BY fold)
WHERE n_train > 0 AND n_val > 0"""


@query("v01_quarter_blocks", with_tables("dbars", month_bounds_sql(48, 3, 3, True), FOLD_SUMMARY, body=FOLD_BODY, recursive=True))
def quarter_blocks(spark, sf_dir):
    rows = inputs.daily_bars(spark, sf_dir)
    return folds.summary(rows, "datetime", folds.block_folds(rows, "datetime", 48, 3, 3))


@query("v03_year_blocks", with_tables("dbars", month_bounds_sql(36, 12, 12, False), FOLD_SUMMARY, body=FOLD_BODY, recursive=True))
def year_blocks(spark, sf_dir):
    rows = inputs.daily_bars(spark, sf_dir)
    bounds = folds.block_folds(rows, "datetime", 36, 12, 12, expanding=False)
    return folds.summary(rows, "datetime", bounds)


@query("v04_even_splits", with_tables("dbars", """
span AS (SELECT epoch_us(min(datetime)) AS lo, epoch_us(max(datetime)) AS hi FROM dbars),
b0 AS (SELECT i, lo, lo + 365 * 86400000000 + CAST(floor((hi - 180 * 86400000000 - lo - 365 * 86400000000) * i / 4) AS BIGINT) AS s
  FROM span, range(0, 5) t(i)),
bounds AS (SELECT CAST(i AS INT) AS fold, make_timestamp(lo) AS train_start, make_timestamp(s) AS val_start,
  make_timestamp(s + 180 * 86400000000) AS val_end FROM b0)""", FOLD_SUMMARY, body=FOLD_BODY))
def even_splits(spark, sf_dir):
    rows = inputs.daily_bars(spark, sf_dir)
    return folds.summary(rows, "datetime", folds.even_folds(rows, "datetime", 5, 180, 365))


PERIOD_BODY = """
SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_val FROM f GROUP BY fold"""


@query("v02_last_quarters", with_tables("dbars", """
q AS (SELECT DISTINCT date_trunc('quarter', datetime) AS q FROM dbars),
v AS (SELECT q, CAST(row_number() OVER (ORDER BY q) - 1 AS INT) AS fold FROM (SELECT q FROM q ORDER BY q DESC LIMIT 6)),
f AS (SELECT fold, CASE WHEN date_trunc('quarter', datetime) = q THEN 'val' ELSE 'train' END AS role FROM dbars JOIN v
  ON date_trunc('quarter', datetime) <= q)""", body=PERIOD_BODY))
def last_quarters(spark, sf_dir):
    rows = inputs.daily_bars(spark, sf_dir).withColumn("q", F.date_trunc("quarter", "datetime"))
    return folds.summary(rows, "q", folds.last_period_folds(rows, "q", 6)).select("fold", "n_train", "n_val")


@query("v06_expanding_quarters", with_tables("dbars", """
b AS (SELECT *, date_trunc('quarter', datetime) AS q, CAST(close > open AS INT) AS y FROM dbars),
v AS (SELECT q, CAST(row_number() OVER (ORDER BY q) - 3 AS INT) AS fold FROM (SELECT DISTINCT q FROM b)),
f AS (SELECT fold, y, CASE WHEN b.q = v.q THEN 'val' ELSE 'train' END AS role FROM b JOIN v ON b.q <= v.q WHERE fold >= 0)""",
    body=PERIOD_BODY + " HAVING count(DISTINCT y) FILTER (role = 'val') = 2"))
def expanding_quarters(spark, sf_dir):
    rows = inputs.daily_bars(spark, sf_dir).withColumns({"q": F.date_trunc("quarter", "datetime"),
                                                         "y": (col("close") > col("open")).cast("int")})
    bounds = folds.expanding_period_folds(rows, "q", 2)
    both = folds.two_class_folds(rows, "q", bounds, "y")
    return folds.summary(rows, "q", bounds).join(both, "fold", "left_semi").select("fold", "n_train", "n_val")


@query("v05_rolling_windows", with_tables("dbars", """
p AS (SELECT *, row_number() OVER (ORDER BY datetime, ticker) - 1 AS pos, count(*) OVER () AS n FROM dbars),
f AS (SELECT k AS fold, datetime, CASE WHEN pos < k * 700 + 1000 THEN 'train' ELSE 'val' END AS role FROM p,
  range(0, (SELECT CAST(floor((count(*) - 1300) / 700) AS BIGINT) + 1 FROM dbars)) t(k)
  WHERE pos >= k * 700 AND pos < k * 700 + 1300)""", body=FOLD_BODY))
def rolling_windows(spark, sf_dir):
    rows = inputs.daily_bars(spark, sf_dir)
    return folds.rolling_folds(rows, "datetime", 1000, 300, 700, ["ticker"]).summary("datetime")


@query("v07_sequential_splits", with_tables("dbars", """
p AS (SELECT *, row_number() OVER (ORDER BY datetime, ticker) - 1 AS pos, count(*) OVER () AS n FROM dbars),
f AS (SELECT k AS fold, datetime, CASE WHEN pos < n - (5 - k) * (n // 6) THEN 'train' ELSE 'val' END AS role FROM p,
  range(0, 5) t(k) WHERE pos < n - (5 - k) * (n // 6) + n // 6)""", body=FOLD_BODY))
def sequential_splits(spark, sf_dir):
    rows = inputs.daily_bars(spark, sf_dir)
    return folds.sequential_folds(rows, "datetime", 5, ["ticker"]).summary("datetime")


# ---- regression and ordinal metrics -----------------------------------------------------------------
@query("m01_band_metrics", with_tables("scored", body=f"""
SELECT fold, {rd('avg(abs(q50 - actual)) / avg(abs(actual))')} AS normalized_mae,
  {rd('avg(CAST(abs(q50 - actual) / (abs(actual) + 1e-6) < 0.3::DOUBLE AS INT))')} AS within_band_accuracy,
  {rd('avg(greatest((actual - q50) * 0.5::DOUBLE, (actual - q50) * -0.5::DOUBLE))')} AS quantile_loss,
  {rd('avg(CAST(actual <= q50 AS INT))')} AS coverage FROM scored GROUP BY 1"""))
def band_metrics(spark, sf_dir):
    out = metrics.band_metrics(inputs.scored(spark, sf_dir), "actual", "q50", ["fold"])
    return out.select("fold", *rounded("normalized_mae", "within_band_accuracy", "quantile_loss", "coverage"))


_reg = ["mae", "mse", "rmse", "r2", "mape", "explained_variance", "max_error", "std_error", "median_ae"]


@query("m02_regression_metrics", with_tables("scored", "g AS (SELECT fold, actual AS y, q50 AS p, actual - q50 AS e FROM scored)", body=f"""
SELECT fold, {rd('avg(abs(e))')} AS mae, {rd('avg(e * e)')} AS mse, {rd('sqrt(avg(e * e))')} AS rmse,
  {rd('1 - sum(e * e) / (var_pop(y) * count(*))')} AS r2, {rd('avg(abs(e) / nullif(abs(y), 0))')} AS mape,
  {rd('1 - var_pop(e) / var_pop(y)')} AS explained_variance, {rd('max(abs(e))')} AS max_error,
  {rd('stddev_pop(e)')} AS std_error, {rd('quantile_cont(abs(e), 0.5)')} AS median_ae FROM g GROUP BY 1"""))
def regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(inputs.scored(spark, sf_dir), "actual", "q50", ["fold"]).select("fold", *rounded(*_reg))


KAPPA_SQL = """
lab AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT {y} AS v FROM {t} UNION SELECT {p} FROM {t})),
cells AS (SELECT a.i AS i, b.i AS j, count(*) AS n FROM {t} JOIN lab a ON {y} = a.v JOIN lab b ON {p} = b.v GROUP BY 1, 2),
ri AS (SELECT i, sum(n) AS n FROM cells GROUP BY 1), cj AS (SELECT j, sum(n) AS n FROM cells GROUP BY 1),
kap AS (SELECT 1 - (SELECT sum(n * pow(i - j, 2)) FROM cells) / ((SELECT sum(ri.n * cj.n * pow(i - j, 2)) FROM ri, cj)
  / (SELECT sum(n) FROM cells)) AS qwk)"""


@query("m03_ordinal_gradation", with_tables("scored", """
g AS (SELECT *, least(greatest(grade_pred, 0), 7) AS c, CAST(round_even(least(greatest(grade_pred, 0), 7), 0) AS INT) AS rr FROM scored),
rk AS (SELECT rank() OVER (ORDER BY grade) + (count(*) OVER (PARTITION BY grade) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS ry FROM g)""",
    KAPPA_SQL.format(t="g", y="grade", p="rr"), body=f"""
SELECT {rd('avg(abs(grade - c))')} AS mae, {rd('sqrt(avg(pow(grade - c, 2)))')} AS rmse, {rd('avg(abs(grade - rr))')} AS mae_rounded,
  {rd('avg(CAST(abs(grade - rr) <= 1 AS INT))')} AS within_1, {rd('(SELECT corr(rx, ry) FROM rk)')} AS spearman,
  {rd('(SELECT qwk FROM kap)')} AS qwk FROM g"""))
def ordinal_gradation(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir)
    out = metrics.ordinal_metrics(rows, "grade", "grade_pred", 7)
    clipped = rows.withColumn("_c", F.least(F.greatest("grade_pred", F.lit(0.0)), F.lit(7.0)))
    out = out.withColumn("spearman", metrics.spearman(clipped, "grade", "_c").scalar())
    return out.select(*rounded("mae", "rmse", "mae_rounded", "within_1", "spearman", "qwk"))


@query("m04_ordinal_metrics", with_tables("scored", """
g AS (SELECT *, CAST(round_even(least(greatest(grade_pred, 0), 7), 0) AS INT) AS rr FROM scored)""",
    KAPPA_SQL.format(t="g", y="grade", p="rr"), body=f"""
SELECT {rd('avg(CAST(grade = rr AS INT))')} AS exact_match, {rd('avg(CAST(abs(grade - rr) <= 1 AS INT))')} AS within_1,
  {rd('avg(abs(grade - rr))')} AS mae_rounded, {rd('sqrt(avg(pow(grade - rr, 2)))')} AS rmse_rounded,
  {rd('avg(abs(grade - grade_pred))')} AS mae_continuous, {rd('(SELECT qwk FROM kap)')} AS qwk FROM g"""))
def ordinal_metrics(spark, sf_dir):
    out = metrics.ordinal_metrics(inputs.scored(spark, sf_dir), "grade", "grade_pred", 7)
    return out.select(*rounded("exact_match", "within_1", "mae_rounded", "rmse_rounded", "mae_continuous", "qwk"))


@query("m04_mae_per_class", with_tables("scored", body=f"""
SELECT grade, {rd('avg(abs(grade - round_even(least(greatest(grade_pred, 0), 7), 0)))')} AS mae_class FROM scored GROUP BY 1"""))
def mae_per_class(spark, sf_dir):
    return metrics.mae_per_class(inputs.scored(spark, sf_dir), "grade", "grade_pred", 7).withColumn("mae_class", r("mae_class"))


_q = {0.1: "q10", 0.5: "q50", 0.9: "q90"}
_tags = {q: str(q).replace("0.", "q") for q in _q}
_qm = {}
for _v, _c in _q.items():
    _qm[f"pinball_{_tags[_v]}"] = f"avg(greatest((actual - {_c}) * {_v}::DOUBLE, (actual - {_c}) * {_v - 1}::DOUBLE))"
    _qm[f"mae_{_tags[_v]}"] = f"avg(abs(actual - {_c}))"
    _qm[f"coverage_below_{_tags[_v]}"] = f"avg(CAST(actual <= {_c} AS INT))"
_qm |= {"interval_coverage": "avg(CAST(actual BETWEEN q10 AND q90 AS INT))", "mean_width": "avg(q90 - q10)",
        "non_monotonic": "avg(CAST(q90 - q10 < 0 AS INT))", "rmse_median": "sqrt(avg(pow(actual - q50, 2)))",
        "mape_median": "100 * avg(abs((actual - q50) / nullif(actual, 0)))", "median_width": "quantile_cont(q90 - q10, 0.5)"}


@query("m05_interval_metrics", with_tables("scored", body=f"""
SELECT fold, {', '.join(f'{rd(e)} AS {n}' for n, e in _qm.items())} FROM scored GROUP BY 1"""))
def interval_metrics(spark, sf_dir):
    return metrics.interval_metrics(inputs.scored(spark, sf_dir), "actual", _q, ["fold"]).select("fold", *rounded(*_qm))


@query("m06_winkler", with_tables("scored", body=f"""
SELECT fold, {rd('avg(q90 - q10 + CASE WHEN actual < q10 THEN 2 / 0.2::DOUBLE * (q10 - actual) WHEN actual > q90 THEN 2 / 0.2::DOUBLE * (actual - q90) ELSE 0 END)')} AS winkler_score
FROM scored GROUP BY 1"""))
def winkler(spark, sf_dir):
    return metrics.winkler(inputs.scored(spark, sf_dir), "actual", "q10", "q90", ["fold"]).withColumn(
        "winkler_score", r("winkler_score"))


# ---- binary metrics ---------------------------------------------------------------------------------
CURVE_SQL = """
s AS (SELECT score, count(*) AS n, sum(y_true) AS pos FROM scored GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cum_n, sum(pos) OVER (ORDER BY score DESC) AS cum_pos,
  sum(pos) OVER () AS p, sum(n) OVER () AS alln FROM s),
curve AS (SELECT *, CAST(cum_pos AS DOUBLE) / cum_n AS precision, CAST(cum_pos AS DOUBLE) / p AS recall FROM c)"""
AREA_SQL = """
area AS (SELECT sum(CAST(pos AS DOUBLE) / p * precision) AS pr_auc,
  sum(CAST(pos AS DOUBLE) / p * (precision + coalesce(CAST(cum_pos - pos AS DOUBLE) / nullif(cum_n - n, 0), 1)) / 2) AS pr_auc_trapezoid,
  (SELECT CAST(sum(CASE WHEN a.score > b.score THEN a.pos * (b.n - b.pos) WHEN a.score = b.score THEN a.pos * (b.n - b.pos) / 2.0
    ELSE 0 END) AS DOUBLE) / (max(a.p) * max(a.alln - a.p)) FROM c a, c b) AS roc_auc FROM curve)"""
_bin = ["precision", "recall", "f0_5", "f1", "f2", "f3", "brier_score", "log_loss", "base_rate"]
BINARY_SQL = f"""
k AS (SELECT count(*) FILTER (score >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (score >= 0.5 AND y_true = 0) AS fp,
  count(*) FILTER (score < 0.5 AND y_true = 1) AS fn, count(*) FILTER (score < 0.5 AND y_true = 0) AS tn,
  avg(pow(score - y_true, 2)) AS brier_score, avg(CASE WHEN y_true = 1 THEN -ln(least(greatest(score, 1e-7), 1 - 1e-7))
  ELSE -ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)) END) AS log_loss, avg(y_true) AS base_rate FROM scored),
k2 AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM k),
k3 AS (SELECT *, {', '.join(f"(1 + {b}) * precision * recall / ({b} * precision + recall) AS {n}" for b, n in ((0.25, 'f0_5'), (1, 'f1'), (4, 'f2'), (9, 'f3')))} FROM k2)"""


@query("m07_binary_metrics", with_tables("scored", BINARY_SQL, body=f"SELECT tp, fp, fn, tn, {rds(*_bin)} FROM k3"))
def binary_metrics(spark, sf_dir):
    out = metrics.binary_metrics(inputs.scored(spark, sf_dir), "y_true", "score")
    return out.select("tp", "fp", "fn", "tn", *rounded(*_bin))


@query("m08_score_curve", with_tables("scored", CURVE_SQL, body=f"""
SELECT score AS threshold, CAST(cum_n AS BIGINT) AS cum_n, CAST(cum_pos AS BIGINT) AS cum_pos, {rds('precision', 'recall')} FROM curve"""))
def score_curve(spark, sf_dir):
    out = metrics.score_curve(inputs.scored(spark, sf_dir), "y_true", "score")
    return out.select("threshold", "cum_n", "cum_pos", *rounded("precision", "recall"))


@query("m08_ranking_areas", with_tables("scored", CURVE_SQL, AREA_SQL, body=f"SELECT {rds('pr_auc', 'pr_auc_trapezoid', 'roc_auc')} FROM area"))
def ranking_areas(spark, sf_dir):
    return metrics.ranking_areas(inputs.scored(spark, sf_dir), "y_true", "score").select(
        *rounded("pr_auc", "pr_auc_trapezoid", "roc_auc"))


_BETAS = (0.5, 1, 2, 3)


@query("m09_best_thresholds", with_tables("scored", CURVE_SQL, body=" UNION ALL ".join(
    f"""SELECT * FROM (SELECT 'f{b}' AS name, score AS threshold, {rds('precision', 'recall')} FROM curve ORDER BY
  (1 + {b * b}) * precision * recall / ({b * b} * precision + recall + 1e-9) DESC, score LIMIT 1)""" for b in _BETAS)
    + f""" UNION ALL SELECT * FROM (SELECT 'recall_0.6' AS name, score AS threshold, {rds('precision', 'recall')} FROM curve
  WHERE recall >= 0.6 ORDER BY precision DESC, score LIMIT 1)"""))
def best_thresholds(spark, sf_dir):
    out = metrics.best_thresholds(inputs.scored(spark, sf_dir), "y_true", "score", _BETAS, (0.6,))
    return out.select("name", "threshold", *rounded("precision", "recall"))


_cls = ["click", "error", "purchase", "signup", "view"]
REPORT_SQL = """
rep AS (SELECT label, (SELECT count(*) FROM scored s WHERE s.label = l.label) AS support,
  (SELECT count(*) FROM scored s WHERE s.predicted = l.label) AS said,
  (SELECT count(*) FROM scored s WHERE s.predicted = l.label AND s.label = l.label) AS tp FROM (SELECT DISTINCT label FROM scored) l),
rep2 AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM rep),
rep3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rep2)"""


@query("m10_class_report", with_tables("scored", REPORT_SQL, body=f"SELECT label, support, {rds('precision', 'recall', 'f1')} FROM rep3"))
def class_report(spark, sf_dir):
    return metrics.class_report(inputs.scored(spark, sf_dir), "label", "predicted").select(
        "label", "support", *rounded("precision", "recall", "f1"))


_mc = {"accuracy": "sum(tp) / sum(support)", **{f"{n}_macro": f"avg({n})" for n in ("precision", "recall", "f1")},
       **{f"{n}_micro": "sum(tp) / sum(support)" for n in ("precision", "recall", "f1")},
       **{f"{n}_weighted": f"sum({n} * support) / sum(support)" for n in ("precision", "recall", "f1")},
       "log_loss": "(SELECT avg(-ln(least(greatest(score, 1e-15), 1 - 1e-15))) FROM scored)"}


@query("m10_multiclass_metrics", with_tables("scored", REPORT_SQL, body=f"SELECT {', '.join(f'{rd(e)} AS {n}' for n, e in _mc.items())} FROM rep3"))
def multiclass_metrics(spark, sf_dir):
    return metrics.multiclass_metrics(inputs.scored(spark, sf_dir), "label", "predicted", "score").select(*rounded(*_mc))


@query("m10_one_vs_rest_auc", with_tables("scored", f"""
x AS ({' UNION ALL '.join(f"SELECT '{c}' AS class, CAST(label = '{c}' AS INT) AS y, (event_id * {41 + 6 * i}) % 1000 / 1000.0::DOUBLE AS s FROM scored" for i, c in enumerate(_cls))}),
g AS (SELECT class, s, count(*) AS n, sum(y) AS pos FROM x GROUP BY 1, 2),
h AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT class, sum(pos * (below + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos)) AS roc_auc FROM h GROUP BY 1)""", body=f"""
SELECT class, {rd('roc_auc')} AS roc_auc, {rd('avg(roc_auc) OVER ()')} AS macro_auc FROM a"""))
def one_vs_rest(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).select("*", *[
        ((col("event_id") * (41 + 6 * i)) % 1000 / 1000.0).alias(f"s_{c}") for i, c in enumerate(_cls)])
    return metrics.one_vs_rest_auc(rows, "label", {c: f"s_{c}" for c in _cls}).select("class", *rounded("roc_auc", "macro_auc"))


@query("m12_calibration_curve", with_tables("scored", f"""
cut AS (SELECT [{', '.join(f'quantile_cont(score, {i / 10})' for i in range(1, 10))}] AS q FROM scored)""", body=f"""
SELECT len(list_filter(q, lambda c: c < score)) AS bin, {rd('avg(score)')} AS prob_pred, {rd('avg(y_true)')} AS prob_true,
  count(*) AS n FROM scored, cut GROUP BY 1"""))
def calibration_curve(spark, sf_dir):
    out = metrics.calibration_curve(inputs.scored(spark, sf_dir), "y_true", "score")
    return out.select(col("bin").cast("long").alias("bin"), *rounded("prob_pred", "prob_true"), "n")


@query("m13_fold_metrics", with_tables("scored", f"""
p AS (SELECT fold, avg(pow(score - y_true, 2)) AS brier_score, avg(y_true) AS base_rate, count(*) FILTER (score >= 0.5 AND y_true = 1)
  / count(*) FILTER (score >= 0.5) AS precision FROM scored GROUP BY 1)""", body=f"""
SELECT count(*) AS folds, {', '.join(f"{rd(f'avg({m})')} AS {m}_mean, {rd(f'stddev_samp({m})')} AS {m}_std" for m in ('brier_score', 'base_rate', 'precision'))} FROM p"""))
def fold_metrics(spark, sf_dir):
    names = ["brier_score", "base_rate", "precision"]
    per_fold = metrics.binary_metrics(inputs.scored(spark, sf_dir), "y_true", "score", keys=["fold"])
    return metrics.over_folds(per_fold, names).select("folds", *rounded(*[f"{m}_{s}" for m in names for s in ("mean", "std")]))


@query("m13_fold_report", with_tables("scored", """
v AS (SELECT p, CAST(row_number() OVER (ORDER BY p) - 1 AS INT) AS k FROM (SELECT DISTINCT fold AS p FROM scored ORDER BY 1 DESC LIMIT 3))""", f"""
t AS (SELECT k, count(*) AS n_train, min(fold) AS train_from, max(fold) AS train_to FROM scored JOIN v ON fold < p GROUP BY 1)""", f"""
w AS (SELECT k, count(*) AS n_val, min(fold) AS val_from, max(fold) AS val_to, {rd('avg(pow(score - y_true, 2))')} AS brier_score,
  {rd('avg(y_true)')} AS base_rate, {rd('count(*) FILTER (score >= 0.5 AND y_true = 1) / count(*) FILTER (score >= 0.5)')} AS precision
  FROM scored JOIN v ON fold = p GROUP BY 1)""", body="""
SELECT k AS fold, n_train, n_val, train_from, train_to, val_from, val_to, brier_score, base_rate, precision FROM t JOIN w USING (k)"""))
def fold_report(spark, sf_dir):
    """Each fold's ranges and rows beside its metrics."""
    rows = inputs.scored(spark, sf_dir).withColumnRenamed("fold", "period")
    bounds = folds.last_period_folds(rows, "period", 3)
    per_fold = metrics.binary_metrics(folds.validation_rows(rows, "period", bounds), "y_true", "score", keys=["fold"])
    names = ["brier_score", "base_rate", "precision"]
    return metrics.fold_report(per_fold.select("fold", *rounded(*names)), folds.summary(rows, "period", bounds))


@query("m14_oof_table", with_tables("scored", """
v AS (SELECT fold AS q, row_number() OVER (ORDER BY fold) AS k FROM (SELECT DISTINCT fold FROM scored ORDER BY 1 DESC LIMIT 3))""", body="""
SELECT event_id, CAST(k - 1 AS INT) AS fold, y_true, score FROM scored JOIN v ON fold = q"""))
def oof_table(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).withColumnRenamed("fold", "period")
    return folds.validation_rows(rows, "period", folds.last_period_folds(rows, "period", 3)).select("event_id", "fold", "y_true", "score")


@query("m15_lift", with_tables("scored", CURVE_SQL, AREA_SQL, body=f"""
SELECT {rd('pr_auc / (SELECT avg(y_true) FROM scored)')} AS lift FROM area"""))
def lift(spark, sf_dir):
    return metrics.binary_metrics(inputs.scored(spark, sf_dir), "y_true", "score").select(*rounded("lift"))
