"""Queries over bars: daily block, the whole feature frame and forward-looking labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from squallbars.catalog.bar_queries import ADX_SQL, BASE_SQL, KEY, N, bar_query, er_sql, lag_block_sql, range_sql, z_sql
from squallbars.catalog.registry import query, r, rounded
from squallbars.catalog.sql import BY, frame, fwd, lag, lead, rd, rds, roll, wilder, with_tables
from squallbars.operators import indicators as ind
from squallbars.operators import labels
from squallbars.operators.layout import attach_small, exact_quantiles, over_bars, safe_chunk
from squallbars.plans import features as plan
from squallbars.session import shared
from squallbars.sources import inputs

col = F.col

# ---- daily block ------------------------------------------------------------------------------------
DAILY_SQL = """daily AS (SELECT ticker, date_trunc('day', b.datetime)::TIMESTAMP AS datetime,
  first(open ORDER BY b.datetime) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY b.datetime) AS close
  FROM bars b GROUP BY 1, 2)"""
_tr = BASE_SQL.replace("FROM bars", "FROM daily").replace("t0 AS", "d0 AS")
DAYBLOCK_SQL = (
    DAILY_SQL, _tr, wilder("d0", "da", {"day_atr": ("trange", N)}),
    f"""d1 AS (SELECT ticker, datetime, {', '.join(f"{lag('(high - low)', k)} AS day_range_{k}" for k in (1, 2, 3, 4))},
  {', '.join(f"close / nullif({lag('close', k)}, 0) - 1 AS day_change_{k}" for k in (1, 2, 3, 4))},
  {lag('day_atr')} AS prev_daily_atr FROM d0 LEFT JOIN da USING (ticker, datetime))""")
FILLED_SQL = f"""
b0 AS (SELECT * FROM bars LEFT JOIN d1 USING (ticker, datetime)),
b1 AS (SELECT ticker, datetime, open, high, low, close, volume, {', '.join(
    f'last_value({c} IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS {c}' for c in plan.DAY_COLUMNS)} FROM b0)"""


@query("a04_daily_resample", with_tables("bars", DAILY_SQL, body="SELECT * FROM daily"))
def daily_resample(spark, sf_dir):
    return plan.resample_daily(inputs.bars(spark, sf_dir))


@query("i04_daily_block", with_tables("bars", *DAYBLOCK_SQL, recursive=True, body=f"""
SELECT ticker, datetime, {rds(*plan.DAY_COLUMNS)} FROM d1"""))
def daily_block(spark, sf_dir):
    return plan.daily_block(inputs.bars(spark, sf_dir), N).select(*KEY, *rounded(*plan.DAY_COLUMNS))


@query("i04_daily_block_point_in_time", with_tables("bars", DAILY_SQL, body=f"""
SELECT ticker, datetime, {', '.join(rd(f"{lag('close', 1)} / nullif({lag('close', k + 1)}, 0) - 1") + f' AS day_change_{k}'
                                    for k in (1, 2, 3, 4))} FROM daily"""))
def daily_block_pit(spark, sf_dir):
    cols = [f"day_change_{k}" for k in (1, 2, 3, 4)]
    return plan.daily_block(inputs.bars(spark, sf_dir), N, point_in_time=True).select(*KEY, *rounded(*cols))


@query("j06_daily_onto_hourly", with_tables("bars", *DAYBLOCK_SQL, FILLED_SQL, recursive=True, body=f"""
SELECT ticker, datetime, {rds(*plan.DAY_COLUMNS)} FROM b1"""))
def daily_onto_hourly(spark, sf_dir):
    bars = shared(inputs.bars(spark, sf_dir))
    return plan.attach_daily(bars, N).select(*KEY, *rounded(*plan.DAY_COLUMNS))


# ---- the whole feature frame ------------------------------------------------------------------------
_short, _long = max(3, N // 3), N * 3
FEATURE_SQL = {
    "atr_normalized": "atr / nullif(close, 0)", "kaufman_efficiency_ratio": er_sql(N),
    "custom_efficiency_ratio": f"({roll('sum', 'trange', N)}) / nullif({range_sql(N)}, 0)",
    "wick_ratio": "body / nullif(trange, 0) + 1e-9", "relative_range": z_sql("trange", 5 * N),
    "zscore_atr": z_sql("atr", N, ""), "fast_vs_slow_atr": "atr / nullif(slow, 0)",
    "normalized_bb_width": f"6 * ({roll('stddev_pop', 'close', N)}) / nullif(atr, 0)",
    "tr_over_atr": "trange / (atr + 1e-9)",
    "realized_vol_short": roll("stddev_samp", "lr", _short), "realized_vol_long": roll("stddev_samp", "lr", _long),
    "realized_vol_ratio": f"({roll('stddev_samp', 'lr', _short)}) / (({roll('stddev_samp', 'lr', _long)}) + 1e-9)",
    "parkinson_vol": f"sqrt(({roll('avg', 'hl2', N)}) / (4 * ln(2)))",
    "parkinson_vol_over_atr": f"sqrt(({roll('avg', 'hl2', N)}) / (4 * ln(2))) / (atr + 1e-9)",
    "atr_short_over_long": "s / (l + 1e-9)", "abs_log_return_sum": roll("sum", "abs(lr)", _short),
    "vvov": f"({roll('stddev_samp', 'atr', N)}) / (({roll('avg', 'atr', N)}) + 1e-9)", "log_return": "lr",
}
_lags = {n: e for f in plan.LAGGED for n, e in lag_block_sql(f).items()}
TIME_SQL = """CAST(week(datetime) AS INTEGER) AS week, CAST(month(datetime) AS INTEGER) AS month,
  CAST(quarter(datetime) AS INTEGER) AS quarter, CAST(isodow(datetime) - 1 AS INTEGER) AS dayofweek,
  CAST(day(datetime) AS INTEGER) AS day, CAST(hour(datetime) AS INTEGER) AS hour"""
SESSION_SQL = """CAST(CASE WHEN month(datetime) BETWEEN 3 AND 10 THEN hour(datetime) BETWEEN 7 AND 15
    ELSE hour(datetime) BETWEEN 8 AND 16 END AS INTEGER) AS is_europe,
  CAST(CASE WHEN month(datetime) BETWEEN 3 AND 10 THEN hour(datetime) BETWEEN 13 AND 21
    ELSE hour(datetime) BETWEEN 14 AND 22 END AS INTEGER) AS is_usa, CAST(hour(datetime) < 9 AS INTEGER) AS is_asia"""
def feature_ctes(source: str, slow: int, sma: int) -> tuple[str, ...]:
    """The feature frame `f1` over a table of bars."""
    mean = roll("avg", "close", sma)
    gap = f"CASE WHEN coalesce(close > ({mean}), false) THEN high - ({mean}) ELSE ({mean}) - low END / nullif(sma_atr, 0)"
    return (
        BASE_SQL.replace("FROM bars", f"FROM {source}"), *ADX_SQL,
        wilder("t0", "a", {"atr": ("trange", N), "slow": ("trange", slow), "sma_atr": ("trange", sma),
                           "s": ("trange", N // 2), "l": ("trange", 2 * N)}),
        f"f0 AS (SELECT t0.*, a.* EXCLUDE (ticker, datetime), m4.* EXCLUDE (ticker, datetime), dmp - dmn AS di_spread "
        "FROM t0 LEFT JOIN a USING (ticker, datetime) LEFT JOIN m4 USING (ticker, datetime))",
        f"f1 AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in (FEATURE_SQL | {'distance_from_sma': gap}).items())}, "
        f"(adx + {lag('adx', 2)}) / 2 AS adxr FROM f0)")


FEATURE_CTES = (*DAYBLOCK_SQL, FILLED_SQL, *feature_ctes("b1", 100, 240))
_plain = [c for c in plan.PLAIN] + plan.LAGGED + plan.DAY_COLUMNS
_ints = ["week", "month", "quarter", "dayofweek", "day", "hour", "is_europe", "is_usa", "is_asia"]


@query("i23_add_features", with_tables("bars", *FEATURE_CTES, recursive=True, body=f"""
SELECT ticker, datetime, {rds(*_plain, digits=4)},
  {', '.join(f'{rd(e, 4)} AS {n}' for n, e in _lags.items())}, {TIME_SQL}, {SESSION_SQL},
  {rd('sin(hour(datetime) * 2 * pi() / 24)', 4)} AS sin_hour FROM f1"""))
def add_features(spark, sf_dir):
    out = plan.add_features(inputs.bars(spark, sf_dir), N)
    return out.select(*KEY, *rounded(*_plain, *_lags, "sin_hour", digits=4), *_ints)


_daily = [c for c in (*plan.PLAIN, *plan.LAGGED) if c != "trange"]


@query("i23_daily_features", with_tables("dbars", *feature_ctes("dbars", 2 * N, N), recursive=True, body=f"""
SELECT ticker, datetime, {rd('trange', 8)} AS trange, {rds(*_daily, digits=4)}, {', '.join(f'{rd(e, 4)} AS {n}' for n, e in _lags.items())}, {TIME_SQL} FROM f1"""))
def daily_features(spark, sf_dir):
    out = plan.add_features(inputs.daily_bars(spark, sf_dir), N, "daily")
    # Prices are quotients of cents by quantities up to 50: fewer than eight digits would round exact halves.
    return out.select(*KEY, r("trange", 8).alias("trange"), *rounded(*_daily, *_lags, digits=4), *_ints[:6])


# ---- labels -----------------------------------------------------------------------------------------
def fr_sql(n: int, skip: int = 0, head: bool = False) -> str:
    out = f"({frame('max', 'high', 1 + skip, n + skip)}) - ({frame('min', 'low', 1 + skip, n + skip)})"
    return f"(CASE WHEN row_number() OVER ({BY}) >= {n} THEN {out} END)" if head else f"({out})"


def eff_sql(n: int) -> str:
    return f"(({fwd('sum', '(high - low)', n, head_gap=True)}) / ({fr_sql(n, head=True)} + 1e-6))"


ATR = {"atr": N}
HS = (1, 3, 6, 24)
bar_query("t01_future_range", lambda w: {f"future_range_{h}h": labels.future_range(w, h) for h in HS},
          {f"future_range_{h}h": fr_sql(h) for h in HS}, back=1, ahead=24)
bar_query("t02_future_range_from_now", lambda w: {f"future_range_{h}h": labels.future_range(w, h) for h in (2, 12)},
          {f"future_range_{h}h": fr_sql(h) for h in (2, 12)}, back=1, ahead=12)
bar_query("t03_overall_future_range", lambda w: {"path_6": labels.future_path(w, 6)},
          {"path_6": fwd("sum", "trange", 6, head_gap=True)}, back=7, ahead=6)
bar_query("t04_future_efficiency", lambda w: {f"eff_{h}": labels.future_efficiency(w, h) for h in HS},
          {f"eff_{h}": eff_sql(h) for h in HS}, back=1, ahead=24, digits=5)
@query("t05_future_trend_strength", with_tables("bars", BASE_SQL, *ADX_SQL, recursive=True, body=f"""
SELECT ticker, datetime, {rd(f"CASE WHEN ({fwd('max', 'adx', 24, head_gap=True)}) > 30 THEN ({fwd('max', 'adx', 24, head_gap=True)}) ELSE "
                             f"({fwd('min', 'adx', 24, head_gap=True)}) END", 4)} AS strength FROM m4"""))
def future_trend_strength(spark, sf_dir):
    def build(df, w):
        df = ind.with_adx(ind.with_true_range(df, w), w, N)
        return df.withColumn("strength", labels.future_trend_strength(w, "adx", 24))

    out = over_bars(inputs.bars(spark, sf_dir), build, back=3, ahead=24, chunk_rows=safe_chunk(3, 24, N))
    return out.select("ticker", "datetime", r("strength", 4).alias("strength"))


bar_query("t05_strength_of_atr",
          lambda w: {"strength": labels.future_trend_strength(w, "atr", 24)},
          {"strength": f"CASE WHEN ({fwd('max', 'atr', 24, head_gap=True)}) > 30 THEN "
                       f"({fwd('max', 'atr', 24, head_gap=True)}) ELSE ({fwd('min', 'atr', 24, head_gap=True)}) END"},
          back=1, ahead=24, atr=ATR, digits=5)
_wick = ("coalesce(max(CASE WHEN trange > atr * {a} AND body / nullif(trange, 0) < {s} THEN 1 ELSE 0 END) OVER "
         f"({BY} ROWS BETWEEN 1 FOLLOWING AND {{n}} FOLLOWING), 0)")
bar_query("t06_big_wick", lambda w: {"doji_4": labels.big_wick_ahead(w), "doji_6": labels.big_wick_ahead(w, 6, 0.3, 1.5)},
          {"doji_4": _wick.format(a=1, s="0.5::DOUBLE", n=4), "doji_6": _wick.format(a="1.5::DOUBLE", s="0.3::DOUBLE", n=6)},
          back=1, ahead=6, atr=ATR)
bar_query("t07_volatility_grade", lambda w: {"grade": labels.volatility_grade(w, 4)},
          {"grade": "CASE " + " ".join(f"WHEN {fr_sql(4, head=True)} > atr * {k} THEN {k}" for k in range(7, 0, -1))
                    + " ELSE 0 END"}, back=4, ahead=4, atr=ATR)
_double = (f"CASE WHEN ({fwd('max', 'high', 6, head_gap=True)}) > ({frame('max', 'high', -46, 1)}) AND "
           f"({fwd('min', 'low', 6, head_gap=True)}) < ({frame('min', 'low', -46, 1)}) THEN 1 ELSE 0 END")
bar_query("t08_extremum_breakout", lambda w: {"breakout": labels.double_breakout(w, 48, 6).cast("int")},
          {"breakout": _double}, back=47, ahead=7)
_flips = (f"CASE WHEN count(close) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 6 THEN "
          f"list_reduce(list({{'h': high, 'l': low, 'lo': low, 'hi': high, 'up': CAST(close > open AS INTEGER), 'n': 0}}) "
          f"OVER ({BY} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), lambda a, x: {{'h': x.h, 'l': x.l, "
          "'lo': CASE WHEN a.up = 1 AND x.l < a.lo THEN x.l ELSE a.lo END, "
          "'hi': CASE WHEN a.up = 0 AND x.h > a.hi THEN x.h ELSE a.hi END, "
          "'up': CASE WHEN a.up = 0 AND x.h > a.hi THEN 1 WHEN a.up = 1 AND x.l < a.lo THEN 0 ELSE a.up END, "
          "'n': a.n + CASE WHEN (a.up = 0 AND x.h > a.hi) OR (a.up = 1 AND x.l < a.lo) THEN 1 ELSE 0 END}).n END")
bar_query("t09_direction_changes", lambda w: {"dir_changes": labels.direction_changes(w, 6)}, {"dir_changes": _flips},
          back=1, ahead=6)
_bar8 = f"list({{'h': high, 'l': low, 'c': close, 'n': next_close}}) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)"
_sfp = (f"CASE WHEN count(close) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) = 8 AND up IS NOT NULL AND "
        f"((len(list_filter({_bar8}, lambda b: (b.h > up AND b.c <= up) OR coalesce(b.c > up AND b.n <= up, false))) > 0 "
        f"AND {lead('close', 7)} < (up + dn) / 2) OR (len(list_filter({_bar8}, lambda b: (b.l < dn AND b.c >= dn) OR "
        f"coalesce(b.c < dn AND b.n >= dn, false))) > 0 AND {lead('close', 7)} > (up + dn) / 2)) THEN 1 ELSE 0 END")
_sfp_stage = {"next_close": lead("close"), "up": frame("max", "high", -24, -1), "dn": frame("min", "low", -24, -1)}
bar_query("t10_swing_failure", lambda w: {"sfp": labels.swing_failure(w, 24, 8)}, {"sfp": _sfp}, back=24, ahead=9,
          stage=(lambda w: {"next_close": w.lead("close")}, _sfp_stage))
bar_query("t11_clip", lambda w: {"clipped": labels.clip(F.try_divide(labels.future_range(w, 3), col("atr")), 1, 3)},
          {"clipped": f"CASE WHEN {fr_sql(3)} / nullif(atr, 0) IS NOT NULL THEN greatest(1, least(3, {fr_sql(3)} / "
                      "nullif(atr, 0))) END"}, back=1, ahead=3, atr=ATR)


@query("t12_trend_or_flat", with_tables("bars", BASE_SQL, *ADX_SQL, recursive=True, body=f"""
SELECT ticker, datetime, CASE WHEN round({lead('adx', 24)}, 6) > 25 THEN 'Trend' WHEN round({lead('adx', 24)}, 6) < 15
  THEN 'Flat' ELSE 'None' END AS regime FROM m4"""))
def trend_or_flat(spark, sf_dir):
    def build(df, w):
        df = ind.with_adx(ind.with_true_range(df, w), w, N)
        return df.withColumn("regime", labels.trend_or_flat(F.round(w.lead("adx", 24), 6), 25, 15))

    return over_bars(inputs.bars(spark, sf_dir), build, back=3, ahead=24).select(*KEY, "regime")


bar_query("t13_angle", lambda w: {"angle": labels.angle(col("close"), w.lead("close", 47), col("atr"))},
          {"angle": f"degrees(atan(({lead('close', 47)} - close) / nullif(atr, 0)))"}, back=1, ahead=47, atr=ATR, digits=4)

# set_targets and the labels that need per-ticker quartiles
T0_SQL = (*DAYBLOCK_SQL, FILLED_SQL, BASE_SQL.replace("FROM bars", "FROM b1"), wilder("t0", "a", {"atr": ("trange", N)}),
          f"""g0 AS (SELECT *, {er_sql(N)} AS er, {lead('close')} AS next_close, {frame('max', 'high', -24, -1)} AS up,
  {frame('min', 'low', -24, -1)} AS dn FROM t0 LEFT JOIN a USING (ticker, datetime))""",
          f"""g1 AS (SELECT *, {', '.join(
              f"least({fr_sql(h)} / nullif(atr, 0), CASE WHEN {fr_sql(h)} / nullif(atr, 0) IS NOT NULL THEN {cap}.0::DOUBLE END) AS fr{h}"
              for h, cap in plan.RANGE_CAPS.items())}, {', '.join(f'{eff_sql(h)} AS path{h}' for h in HS)},
  {_wick.format(a='1.5::DOUBLE', s='0.3::DOUBLE', n=6)} AS doji, {_flips} AS dir_changes, {_double} AS breakout,
  {_sfp} AS sfp, {frame('avg', 'er', 0, 23)} AS er24, {lead('close', 23)} - close AS move24,
  {lead('close', 47)} - close AS move48, abs(close - {lag('close', 48)}) AS past48 FROM g0)""",
          """cuts AS (SELECT ticker, quantile_cont(er24, 0.25) AS er_lo, quantile_cont(er24, 0.75) AS er_hi,
  quantile_cont(past48, 0.75) AS unit48, quantile_cont(path6, 0.75) AS p6, quantile_cont(path24, 0.75) AS p24
  FROM g1 GROUP BY ticker)""",
          """g2 AS (SELECT *, degrees(atan(move48 / nullif(unit48, 0))) AS slope FROM g1 JOIN cuts USING (ticker)),
g3 AS (SELECT *, CASE WHEN er24 > er_hi AND abs(move24) > prev_daily_atr * 0.7::DOUBLE THEN 'Trend' WHEN er24 < er_lo
    THEN 'Flat' ELSE 'None' END AS trg_direction_1day,
  CASE WHEN abs(slope) >= 35 AND abs(move48) > prev_daily_atr THEN 'Trend' WHEN abs(slope) < 20 THEN 'Flat'
    ELSE 'None' END AS trg_direction_2day,
  coalesce(dir_changes > 2 AND fr3 >= 2, false) AS trg_is_chaos_3h,
  coalesce(path6 >= p6 AND fr6 >= 2 AND dir_changes > 1, false) AS trg_is_chaos_6h,
  coalesce(path24 >= p24 AND fr24 >= 3 AND dir_changes > 1, false) AS trg_is_chaos_24h FROM g2)""")


def _targets(spark, sf_dir):
    return plan.set_targets(plan.label_inputs(inputs.bars(spark, sf_dir), N), 6)


def target_query(name: str, sql: str, *cols) -> None:
    @query(name, with_tables("bars", *T0_SQL, recursive=True, body=f"SELECT ticker, datetime, {sql} FROM g3"))
    def run(spark, sf_dir):
        return _targets(spark, sf_dir).select(*KEY, *[c() if callable(c) else c for c in cols])


target_query("t14_direction_1day", "trg_direction_1day", "trg_direction_1day")
target_query("t15_direction_2day", "trg_direction_2day", "trg_direction_2day")
_fr = [f"trg_future_range_{h}h" for h in HS]
_frl = [f"{n}_log" for n in _fr]
target_query("t16_clipped_ranges",
             ", ".join(f"{rd(f'fr{h}', 5)} AS trg_future_range_{h}h, {rd(f'ln(1 + fr{h})', 5)} AS trg_future_range_{h}h_log"
                       for h in HS), *[lambda n=n: r(n, 5).alias(n) for n in _fr + _frl])
_chaos = ["trg_is_chaos_3h", "trg_is_chaos_6h", "trg_is_chaos_24h"]
target_query("t17_chaos", ", ".join(_chaos), *_chaos)
_ov = [f"trg_overall_future_range_{h}h" for h in HS]
target_query("t18_set_targets",
             ", ".join(f"{rd(f'fr{h}', 5)} AS trg_future_range_{h}h, {rd(f'ln(1 + fr{h})', 5)} AS trg_future_range_{h}h_log, "
                       f"{rd(f'path{h}', 5)} AS trg_overall_future_range_{h}h" for h in HS)
             + ", doji AS trg_big_doji, dir_changes AS trg_dir_changes, breakout = 1 AS trg_is_extremum_breakout, "
               "sfp AS trg_is_sfp, trg_direction_1day, trg_direction_2day, " + ", ".join(_chaos),
             *[lambda n=n: r(n, 5).alias(n) for n in _fr + _frl + _ov], "trg_big_doji", "trg_dir_changes",
             "trg_is_extremum_breakout", "trg_is_sfp", "trg_direction_1day", "trg_direction_2day", *_chaos)

# earlier label variants
bar_query("t19_range_over_atr", lambda w: {"target_range": F.try_divide(labels.future_range(w, 8, head_gap=True), col("atr"))},
          {"target_range": f"{fr_sql(8, head=True)} / nullif(atr, 0)"}, back=1, ahead=8, atr=ATR)
_top8, _low8 = f"({fwd('max', 'high', 8, head_gap=True)})", f"({fwd('min', 'low', 8, head_gap=True)})"
bar_query("t20_breakout_category", lambda w: {"category": labels.breakout_category(w)},
          {"category": "CASE " + " ".join(
              f"WHEN {_top8} > ({roll('max', 'high', v)}) AND {_low8} < ({roll('min', 'low', v)}) THEN {k}"
              for k, v in ((4, 144), (3, 96), (2, 48), (1, 24))) + " ELSE 0 END"}, back=144, ahead=8)


def stop_sql(n: int, stop: float) -> dict[str, str]:
    top, low = f"({fwd('max', 'high', n, head_gap=True)})", f"({fwd('min', 'low', n, head_gap=True)})"
    exp = f"coalesce({top} - {low} > atr * 3, false)"
    whip = f"coalesce({top} > close + atr * {stop}::DOUBLE AND {low} < close - atr * {stop}::DOUBLE, false)"
    back = f"coalesce(abs({lead('close', n)} - close) < atr * 0.3::DOUBLE, false)"
    return {"expansion": f"CAST({exp} AS INT)", "chaos": f"CAST({exp} OR {whip} AS INT)",
            "neutral_chaos": f"CAST({whip} AND {back} AS INT)", "strong_move": f"CAST({whip} AND NOT {back} AS INT)"}


bar_query("t21_atr_expansion", lambda w: {"chaos": labels.stop_run(w, 8, 1.5)["chaos"]},
          {"chaos": stop_sql(8, 1.5)["chaos"]}, back=1, ahead=8, atr=ATR)
bar_query("t22_future_chaos", lambda w: labels.stop_run(w, 12, 1.5), stop_sql(12, 1.5), back=1, ahead=12, atr={"atr": 36})


@query("t23_efficiency_flags", with_tables(
    "bars", BASE_SQL, f"e0 AS (SELECT *, ({roll('sum', 'trange', N)}) / nullif({range_sql(N)}, 0) AS er FROM t0)",
    f"e1 AS (SELECT *, {fwd('max', 'er', 6, head_gap=True)} AS top, {fwd('min', 'er', 6, head_gap=True)} AS low6 FROM e0)",
    "q AS (SELECT ticker, quantile_cont(er, 0.25) AS lo, quantile_cont(er, 0.75) AS hi FROM e0 GROUP BY ticker)", body="""
SELECT ticker, datetime, CAST(coalesce(top >= hi, false) AS INT) AS is_flat, CAST(coalesce(low6 <= lo, false) AS INT)
  AS is_trend FROM e1 JOIN q USING (ticker)"""))
def efficiency_flags(spark, sf_dir):
    def build(df, w):
        df = ind.with_true_range(df, w).withColumn("er", ind.custom_efficiency(w, N))
        return df.select("*", w.fwd(F.max, "er", 6, head_gap=True).alias("top"),
                         w.fwd(F.min, "er", 6, head_gap=True).alias("low6"))

    out = shared(over_bars(inputs.bars(spark, sf_dir), build, back=N + 1, ahead=6))
    cuts = exact_quantiles(out, ["ticker"], "er", [0.25, 0.75])
    return attach_small(out, cuts, ["ticker"]).select(
        *KEY, labels.sure(col("top") >= col("q1")).cast("int").alias("is_flat"),
        labels.sure(col("low6") <= col("q0")).cast("int").alias("is_trend"))


bar_query("t24_range_from_next_bar", lambda w: {"next_range": labels.future_range(w, 6, skip=1)},
          {"next_range": fr_sql(6, skip=1)}, back=1, ahead=8)
