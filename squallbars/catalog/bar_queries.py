"""Queries over bars: technical indicators and generic windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from squallbars.catalog.registry import query, r, rounded
from squallbars.catalog.sql import BY, TR, frame, fwd, lag, lead, rd, rds, roll, wilder, with_tables
from squallbars.operators import indicators as ind
from squallbars.operators import labels
from squallbars.operators.layout import over_bars, safe_chunk
from squallbars.sources import inputs

KEY = ["ticker", "datetime"]
N = 21
col = F.col

BASE_SQL = f"""
t0 AS (SELECT *, {TR} AS trange, abs(close - {lag('close')}) AS step,
  CASE WHEN close / nullif({lag('close')}, 0) > 0 THEN ln(close / nullif({lag('close')}, 0)) END AS lr,
  CASE WHEN low <> 0 THEN pow(ln(greatest(high / low, 1e-12)), 2) END AS hl2,
  abs(open - close) AS body FROM bars)"""


def base_columns(df, w):
    df = ind.with_true_range(df, w)
    return df.select("*", ind.close_step(w).alias("step"), ind.log_return(w).alias("lr"),
                     ind.log_range_squared().alias("hl2"), F.abs(col("open") - col("close")).alias("body"))


def bar_query(name, cols, sql, back, ahead=0, atr=None, stage=None, digits=6, daily=False):
    """Register a windowed query: ``cols(w)`` gives output columns, ``sql`` the same as SQL text.

    ``atr`` maps names to smoothing lengths; ``stage`` is (columns builder, SQL dict) computed first.
    """
    ctes, source = [BASE_SQL], "t0"
    if atr:
        ctes += [wilder("t0", "a", {k: ("trange", n) for k, n in atr.items()}),
                 "t1 AS (SELECT * FROM t0 LEFT JOIN a USING (ticker, datetime))"]
        source = "t1"
    if stage:
        ctes.append(f"t2 AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage[1].items())} FROM {source})")
        source = "t2"
    outs = ", ".join(f"{rd(e, digits)} AS {n}" for n, e in sql.items())
    text = with_tables("bars", *ctes, body=f"SELECT ticker, datetime, {outs} FROM {source}", recursive=bool(atr))

    @query(name, text)
    def run(spark, sf_dir):
        def build(df, w):
            df = base_columns(df, w)
            if atr:
                df = ind.with_atr(df, w, **atr)
            if stage:
                df = df.select("*", *[c.alias(n) for n, c in stage[0](w).items()])
            return df.select("*", *[c.alias(f"out_{n}") for n, c in cols(w).items()])

        chunk = safe_chunk(back, ahead, min(atr.values()) if atr else 0)
        out = over_bars(inputs.bars(spark, sf_dir), build, back=back, ahead=ahead, chunk_rows=chunk)
        return out.select(*KEY, *[r(f"out_{n}", digits).alias(n) for n in sql])

    return run


def er_sql(n: int) -> str:
    path = roll("sum", "step", n)
    return f"CASE WHEN {path} = 0 THEN 0 ELSE abs(close - {lag('close', n)}) / nullif({path}, 0) END"


def range_sql(n: int) -> str:
    return f"({roll('max', 'high', n)} - ({roll('min', 'low', n)}))"


def z_sql(c: str, n: int, eps: str = " + 1e-9") -> str:
    return f"({c} - ({roll('avg', c, n)})) / nullif(({roll('stddev_samp', c, n)}){eps}, 0)"


bar_query("flagship_bar_features",
          lambda w: {"trange": col("trange"), "efficiency_ratio": ind.efficiency_ratio(w, N),
                     "future_range_3h": w.fwd(F.max, "high", 3) - w.fwd(F.min, "low", 3)},
          {"trange": "trange", "efficiency_ratio": er_sql(N),
           "future_range_3h": f"{fwd('max', 'high', 3)} - ({fwd('min', 'low', 3)})"}, back=N + 1, ahead=3)
bar_query("i01_true_range", lambda w: {"trange": col("trange")}, {"trange": "trange"}, back=1)
bar_query("i02_atr", lambda w: {"atr": col("atr"), "atr_slow": col("atr_slow")}, {"atr": "atr", "atr_slow": "atr_slow"},
          back=1, atr={"atr": N, "atr_slow": 100}, digits=5)
bar_query("i03_atr_normalized", lambda w: {"atr_normalized": ind.ratio("atr", "close")},
          {"atr_normalized": "atr / nullif(close, 0)"}, back=1, atr={"atr": N})
bar_query("i05_kaufman_efficiency", lambda w: {"kaufman_efficiency_ratio": ind.efficiency_ratio(w, N)},
          {"kaufman_efficiency_ratio": er_sql(N)}, back=N + 1)
bar_query("i06_custom_efficiency", lambda w: {"custom_efficiency_ratio": ind.custom_efficiency(w, N)},
          {"custom_efficiency_ratio": f"({roll('sum', 'trange', N)}) / nullif({range_sql(N)}, 0)"}, back=N + 1)
bar_query("i07_wick_ratio", lambda w: {"wick_ratio": ind.body_share()},
          {"wick_ratio": "body / nullif(trange, 0) + 1e-9"}, back=1)
bar_query("i08_relative_range", lambda w: {"relative_range": ind.zscore(w, "trange", 5 * N)},
          {"relative_range": z_sql("trange", 5 * N)}, back=5 * N + 1)
bar_query("i09_zscore_atr", lambda w: {"zscore_atr": ind.zscore(w, "atr", N, eps=0)},
          {"zscore_atr": z_sql("atr", N, "")}, back=N + 1, atr={"atr": N})
bar_query("i10_fast_vs_slow_atr", lambda w: {"fast_vs_slow_atr": ind.ratio("fast", "slow")},
          {"fast_vs_slow_atr": "fast / nullif(slow, 0)"}, back=1, atr={"fast": N, "slow": 100})
bar_query("i11_relative_volume", lambda w: {"relative_volume": ind.zscore(w, "volume", N)},
          {"relative_volume": z_sql("volume", N)}, back=N)
bar_query("i12_band_width", lambda w: {"band_width": ind.band_width(w, N),
                                       "normalized_bb_width": F.try_divide(ind.band_width(w, N), col("atr"))},
          {"band_width": f"6 * ({roll('stddev_pop', 'close', N)})",
           "normalized_bb_width": f"6 * ({roll('stddev_pop', 'close', N)}) / nullif(atr, 0)"},
          back=N, atr={"atr": N})
_sma = roll("avg", "close", 240)
bar_query("i13_distance_from_sma", lambda w: {"distance_from_sma": F.try_divide(ind.sma_gap(w, 240), col("atr240"))},
          {"distance_from_sma": f"CASE WHEN coalesce(close > ({_sma}), false) THEN high - ({_sma}) "
                                f"ELSE ({_sma}) - low END / nullif(atr240, 0)"}, back=240, atr={"atr240": 240})
bar_query("i14_rolling_entropy", lambda w: {"entropy": ind.rolling_entropy(w, "close", N)},
          {"entropy": "-list_sum(list_transform(list_transform(range(0, 10), lambda b: len(list_filter(places, "
                      f"lambda p: p = b)) / {N}.0::DOUBLE), lambda p: CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END))"},
          back=N, stage=(lambda w: {}, {
              "places": f"CASE WHEN count(close) OVER ({BY} ROWS {N - 1} PRECEDING) = {N} THEN list_transform("
                        f"list(close) OVER ({BY} ROWS {N - 1} PRECEDING), lambda x: least(floor((x - CASE WHEN "
                        f"max(close) OVER ({BY} ROWS {N - 1} PRECEDING) > min(close) OVER ({BY} ROWS {N - 1} PRECEDING) "
                        f"THEN min(close) OVER ({BY} ROWS {N - 1} PRECEDING) ELSE close - 0.5 END) / coalesce(nullif("
                        f"(max(close) OVER ({BY} ROWS {N - 1} PRECEDING) - min(close) OVER ({BY} ROWS {N - 1} PRECEDING))"
                        f" / 10, 0), 0.1)), 9)) END"}))
SHORT, LONG = max(3, N // 3), max(max(3, N // 3) + 1, 3 * N)
_rs, _rl = roll("stddev_samp", "lr", SHORT), roll("stddev_samp", "lr", LONG)
bar_query("i15_realized_volatility",
          lambda w: {"realized_vol_short": w.roll(F.stddev_samp, "lr", SHORT),
                     "realized_vol_long": w.roll(F.stddev_samp, "lr", LONG),
                     "realized_vol_ratio": F.try_divide(w.roll(F.stddev_samp, "lr", SHORT),
                                                        w.roll(F.stddev_samp, "lr", LONG) + 1e-9)},
          {"realized_vol_short": _rs, "realized_vol_long": _rl, "realized_vol_ratio": f"({_rs}) / (({_rl}) + 1e-9)"},
          back=LONG + 1)
_pk = f"sqrt(({roll('avg', 'hl2', N)}) / (4 * ln(2)))"
bar_query("i16_parkinson", lambda w: {"parkinson_vol": ind.parkinson(w, N),
                                      "parkinson_vol_over_atr": F.try_divide(ind.parkinson(w, N), col("atr") + 1e-9)},
          {"parkinson_vol": _pk, "parkinson_vol_over_atr": f"{_pk} / (atr + 1e-9)"}, back=N, atr={"atr": N})
bar_query("i18_tr_over_atr", lambda w: {"tr_over_atr": F.try_divide(col("trange"), col("atr") + 1e-9)},
          {"tr_over_atr": "trange / (atr + 1e-9)"}, back=1, atr={"atr": N})
bar_query("i19_atr_short_over_long", lambda w: {"atr_short_over_long": F.try_divide(col("s"), col("l") + 1e-9)},
          {"atr_short_over_long": "s / (l + 1e-9)"}, back=1, atr={"s": N // 2, "l": N * 2})
bar_query("i20_abs_log_return_sum", lambda w: {"abs_log_return_sum": w.roll(F.sum, F.abs(col("lr")), SHORT)},
          {"abs_log_return_sum": roll("sum", "abs(lr)", SHORT)}, back=SHORT + 1)
bar_query("i21_vvov", lambda w: {"vvov": F.try_divide(w.roll(F.stddev_samp, "atr", N), w.roll(F.avg, "atr", N) + 1e-9)},
          {"vvov": f"({roll('stddev_samp', 'atr', N)}) / (({roll('avg', 'atr', N)}) + 1e-9)"}, back=N, atr={"atr": N})
bar_query("i22_log_return", lambda w: {"log_return": col("lr")}, {"log_return": "lr"}, back=1)
bar_query("i25_range_efficiency",
          lambda w: {"range_efficiency": F.try_divide(ind.window_range(w, 12), w.roll(F.sum, "trange", 12)),
                     "dni": F.try_divide(w.roll(F.sum, "body", 12), w.roll(F.sum, "trange", 12))},
          {"range_efficiency": f"{range_sql(12)} / nullif(({roll('sum', 'trange', 12)}), 0)",
           "dni": f"({roll('sum', 'body', 12)}) / nullif(({roll('sum', 'trange', 12)}), 0)"}, back=13)
bar_query("i26_volume_features",
          lambda w: {"volume_zscore": ind.zscore(w, "volume", 5 * N),
                     "price_volume_ratio": F.try_divide(col("trange"), col("volume") + 1e-9)},
          {"volume_zscore": z_sql("volume", 5 * N), "price_volume_ratio": "trange / (volume + 1e-9)"}, back=5 * N)

# ---- directional movement ---------------------------------------------------------------------------
def adx_ctes(n: int) -> tuple[str, ...]:
    """`m4` with ADX and both directional lines of length `n` over `t0`."""
    return (
        f"m AS (SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM t0)",
        "m1 AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0 END AS pdm, "
        "CASE WHEN dn > up AND dn > 0 THEN dn WHEN dn IS NOT NULL THEN 0 END AS mdm FROM m)",
        wilder("m1", "s1", {"s_tr": ("trange", n), "s_p": ("pdm", n), "s_m": ("mdm", n)}),
        "m2 AS (SELECT ticker, datetime, 100 * s_p / nullif(s_tr, 0) AS dmp, 100 * s_m / nullif(s_tr, 0) AS dmn FROM s1)",
        "m3 AS (SELECT *, CASE WHEN dmp IS NOT NULL THEN coalesce(100 * abs(dmp - dmn) / nullif(dmp + dmn, 0), 0) END AS dx "
        "FROM m2)",
        wilder("m3", "s2", {"adx": ("dx", n)}),
        "m4 AS (SELECT t0.ticker, t0.datetime, adx, dmp, dmn FROM t0 LEFT JOIN m3 USING (ticker, datetime) "
        "LEFT JOIN s2 USING (ticker, datetime))",
    )


ADX_SQL = adx_ctes(N)


@query("i17_adx", with_tables("bars", BASE_SQL, *ADX_SQL, recursive=True, body=f"""
SELECT ticker, datetime, {rds('adx', 'dmp', 'dmn', digits=4)}, {rd('dmp - dmn', 4)} AS di_spread,
  {rd(f"(adx + {lag('adx', 2)}) / 2", 4)} AS adxr FROM m4"""))
def adx(spark, sf_dir):
    def build(df, w):
        return ind.with_adx(ind.with_true_range(df, w), w, N)

    out = over_bars(inputs.bars(spark, sf_dir), build, back=3)
    return out.select(*KEY, *rounded("adx", "adxr", "dmp", "dmn", "di_spread", digits=4))


@query("i24_exploratory_block", with_tables("bars calendar", BASE_SQL, *adx_ctes(12), wilder("t0", "a", {"atr": ("trange", 12)}), """
hits AS (SELECT date_trunc('hour', date) AS datetime, arg_max(actual = forecast, importance * 1000000000000 - event_id) AS hit FROM calendar
  WHERE importance IS NOT NULL AND actual IS NOT NULL AND forecast IS NOT NULL GROUP BY 1)""",
    f"x0 AS (SELECT *, {roll('stddev_pop', 'close', 12)} AS std12 FROM t0 LEFT JOIN a USING (ticker, datetime) LEFT JOIN m4 USING (ticker, datetime) LEFT JOIN hits USING (datetime))",
    recursive=True, body=f"""
SELECT ticker, datetime, {rd('std12', 4)} AS std, {rd(roll('avg', 'std12', 12), 4)} AS std_mean,
  CAST(coalesce(std12 > ({roll('avg', 'std12', 12)}), false) AS INT) AS std_cls, {rd('adx', 4)} AS adx, {rd(f"volume / {lag('volume')} - 1", 4)} AS volume_diff,
  CAST(coalesce(trange > atr, false) AS INT) AS is_high_range, CAST(coalesce(hit, false) AS INT) AS is_true_forecast,
  {rd('trange / 0.00001::DOUBLE', 4)} AS readable_range FROM x0"""))
def exploratory_block(spark, sf_dir):
    """Spread, trend strength and volume of bars, and whether the hour's first event of greatest importance met its forecast."""
    def build(df, w):
        df = base_columns(df, w).withColumn("std12", w.roll(F.stddev_pop, "close", 12))
        df = ind.with_adx(ind.with_atr(df, w, atr=12), w, 12)
        mean = w.roll(F.avg, "std12", 12)
        return df.select("*", mean.alias("std_mean"), labels.sure(col("std12") > mean).cast("int").alias("std_cls"),
                         (F.try_divide(col("volume"), w.lag("volume")) - 1).alias("volume_diff"),
                         labels.sure(col("trange") > col("atr")).cast("int").alias("is_high_range"), (col("trange") / 0.00001).alias("readable_range"))

    out = over_bars(inputs.bars(spark, sf_dir), build, back=25, chunk_rows=safe_chunk(25, 0, 12))
    known = inputs.calendar(spark, sf_dir).dropna(subset=["importance", "actual", "forecast"])
    first = F.max_by(col("actual") == col("forecast"), col("importance").cast("long") * 1_000_000_000_000 - col("event_id"))
    hits = known.groupBy(F.date_trunc("hour", "date").alias("datetime")).agg(first.alias("hit"))
    joined = out.withColumnRenamed("std12", "std").join(hits, "datetime", "left").withColumn("is_true_forecast", F.coalesce(col("hit"), F.lit(False)).cast("int"))
    return joined.select(*KEY, *rounded("std", "std_mean", "adx", "volume_diff", "readable_range", digits=4), "std_cls", "is_high_range", "is_true_forecast")


@query("i27_hurst", with_tables("bars", """
v AS (SELECT ticker, datetime, list(close) OVER (PARTITION BY ticker ORDER BY datetime ROWS 99 PRECEDING) AS v FROM bars)""", """
d AS (SELECT ticker, datetime, list_transform(range(1, 100), lambda i: ln(v[i + 1]) - ln(v[i])) AS d FROM v WHERE len(v) = 100 AND list_min(v) > 0)""", f"""
e AS (SELECT ticker, datetime, size, (i - 1) // size AS b, i, d[i] AS x FROM d, (SELECT unnest({list(ind.HURST_SIZES)}) AS size), range(1, 100) r(i)
  WHERE i <= 99 // size * size)""", """
m AS (SELECT *, avg(x) OVER (PARTITION BY ticker, datetime, size, b) AS mean FROM e)""", """
w AS (SELECT *, sum(x - mean) OVER (PARTITION BY ticker, datetime, size, b ORDER BY i) AS walk FROM m)""", """
s AS (SELECT ticker, datetime, size, max(walk) - min(walk) AS span, stddev_pop(x) AS sd FROM w GROUP BY ticker, datetime, size, b)""", """
p AS (SELECT ticker, datetime, ln(size) AS x, ln(avg(span / sd)) AS y FROM s WHERE sd > 0 GROUP BY ticker, datetime, size)""", f"""
h AS (SELECT ticker, datetime, {rd('regr_slope(y, x)')} AS hurst FROM p GROUP BY 1, 2 HAVING count(*) >= 2)""", body="""
SELECT ticker, datetime, hurst FROM bars LEFT JOIN h USING (ticker, datetime)"""))
def hurst(spark, sf_dir):
    def build(df, w):
        values = w.frame(F.collect_list, "close", -99, 0)
        return df.select("*", ind.hurst_exponent(values).alias("hurst"))

    out = over_bars(inputs.bars(spark, sf_dir), build, back=100)
    return out.select(*KEY, *rounded("hurst"))


# ---- generic windows --------------------------------------------------------------------------------
def lag_block_sql(f: str) -> dict[str, str]:
    low, high = roll("min", f, 24), roll("max", f, 24)
    return {
        **{f"{f}_lag_{k}": lag(f, k) for k in (1, 8, 24, 48)},
        f"{f}_roll_mean_4": roll("avg", f, 4), f"{f}_roll_mean_8": roll("avg", f, 8),
        f"{f}_roll_min_24": low, f"{f}_roll_max_24": high,
        f"{f}_relative_position_24": f"({f} - ({low})) / CASE WHEN ({high}) - ({low}) = 0 THEN 1e-6 ELSE ({high}) - ({low}) END",
        f"{f}_diff_8": f"{f} - {lag(f, 8)}",
    }


bar_query("w10_smart_lags", lambda w: ind.lag_block(w, "er"), lag_block_sql("er"), back=N + 50,
          stage=(lambda w: {"er": ind.efficiency_ratio(w, N)}, {"er": er_sql(N)}))
bar_query("w11_rolling_mean_pct_change",
          lambda w: {"sma_5": w.roll(F.avg, "close", 5), "pct_change": F.try_divide(col("close"), w.lag("close")) - 1},
          {"sma_5": roll("avg", "close", 5), "pct_change": f"close / nullif({lag('close')}, 0) - 1"}, back=5, digits=8)


SPANS = (1, 3, 6, 12, 24)
_stage_sql, _out_sql = {}, {}
for _k in SPANS:
    _stage_sql[f"volume_{_k}_before"] = frame("sum", "volume", -_k, -1)
    _stage_sql[f"range_{_k}_before"] = f"({frame('max', 'high', -3, -1)}) - ({frame('min', 'low', -3, -1)})"
    _stage_sql[f"dni_{_k}_before"] = (f"({frame('sum', 'body', -_k, -1)}) / "
                                      f"nullif(({frame('sum', 'trange', -_k, -1)}), 0)")
    for _m in ("volume", "range", "dni"):
        _b = f"{_m}_{_k}_before"
        _out_sql |= {_b: _b, f"{_m}_{_k}_after": lead(_b, _k + 1),
                     f"{_m}_{_k}_ratio": f"CAST({_b} AS DOUBLE) / nullif({lead(_b, _k + 1)}, 0)"}
bar_query("w12_before_after",
          lambda w: {n: c for k in SPANS for m in ind.TRIPLES for n, c in ind.before_after(w, m, k).items()}, _out_sql,
          back=26, ahead=25, stage=(lambda w: {n: c for k in SPANS for n, c in ind.before_windows(w, k).items()}, _stage_sql))


@query("w01_latest_bars", with_tables("bars", body="""
SELECT ticker, datetime, open, high, low, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker
  ORDER BY datetime DESC) AS k FROM bars WHERE isodow(datetime) < 6) WHERE k <= 60"""))
def latest_bars(spark, sf_dir):
    from squallbars.operators.history import latest_rows
    rows = inputs.bars(spark, sf_dir).filter(F.weekday("datetime") < 5)
    return latest_rows(rows, ["ticker"], "datetime", 60).select(*KEY, "open", "high", "low", "close").orderBy(*KEY)


@query("w14_last_bar_per_ticker", with_tables("bars", body="""
SELECT ticker, max(datetime) AS datetime, arg_max(close, datetime) AS close, arg_max(volume, datetime) AS volume
FROM bars GROUP BY ticker"""))
def last_bar(spark, sf_dir):
    return (inputs.bars(spark, sf_dir).groupBy("ticker")
            .agg(F.max_by(F.struct("datetime", "close", "volume"), "datetime").alias("b")).select("ticker", "b.*"))
