"""Building blocks of the check SQL: derived tables and window frames."""

from __future__ import annotations

from squallbars.sources import inputs


def _case(values: list, index: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


TABLES = {
    "bars": """
bars AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS datetime,
  first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2)""",
    "dbars": """
dlines AS (SELECT l_returnflag || l_linestatus AS ticker, date_trunc('day', l_shipdate)::TIMESTAMP AS datetime, *,
  l_extendedprice / l_quantity AS value FROM lineitem),
dbars AS (SELECT ticker, datetime,
  first(value ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
  max(value) AS high, min(value) AS low,
  last(value ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
  count(*) AS volume FROM dlines GROUP BY 1, 2)""",
    "calendar": f"""
cal0 AS (SELECT event_id, ts AS date, CAST(event_id % 3 - 1 AS INTEGER) AS importance,
  {_case(inputs.CURRENCIES, 'event_id % 8')} AS currency, {_case(inputs.COUNTRIES, 'event_id % 8')} AS country,
  {_case(inputs.TITLES, '(event_id // 7) % 16')} AS title,
  {_case(inputs.SOURCES, 'event_id % 6')} AS source, {_case(inputs.PERIODS, 'event_id % 4')} AS period,
  {_case(inputs.CATEGORIES, 'event_id % 5')} AS category, {_case(inputs.SCALES, 'event_id % 3')} AS scale,
  value AS actual, round(value * 0.95, 2) AS previous FROM events),
calendar AS (SELECT *, CASE WHEN title LIKE '%Speech%' OR title LIKE '%Holiday%' THEN 'Calendar' ELSE title END
  AS indicator, CASE WHEN event_id % 10 = 0 THEN actual ELSE round((actual + previous) / 2, 3) END AS forecast
  FROM cal0)""",
    "series": """
series AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::TIMESTAMP AS date,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS value FROM orders GROUP BY 1, 2)""",
    "scored": f"""
scored AS (SELECT event_id, ts, date_trunc('week', ts)::TIMESTAMP AS fold, event_type AS label,
  CAST(event_type = 'purchase' AS INTEGER) AS y_true, (event_id * 37) % 1000 / 1000.0::DOUBLE AS score,
  value AS actual, value * 0.5::DOUBLE AS q10, value * (0.8::DOUBLE + (event_id % 5) / 10.0::DOUBLE) AS q50,
  value * 1.7::DOUBLE - CASE WHEN event_id % 7 = 0 THEN value * 1.5::DOUBLE ELSE 0.0::DOUBLE END AS q90,
  {_case(['click', 'error', 'purchase', 'signup', 'view'], '(event_id * 13) % 5')} AS predicted,
  CAST(event_id % 8 AS INTEGER) AS grade, (event_id * 29) % 90 / 10.0::DOUBLE - 0.5::DOUBLE AS grade_pred FROM events)""",
    "settings": f"""
settings AS (SELECT c_custkey AS user_id, CAST((c_custkey % 53) / 2.0 - 12 AS DECIMAL(3,1)) AS user_timezone,
  c_custkey % 2 = 0 AS daily_alerts, c_custkey % 3 = 0 AS weekly_alerts, c_custkey % 5 = 0 AS chaos_alerts,
  c_custkey % 2 = 1 AS show_low_importance, c_custkey % 3 <> 1 AS show_medium_importance,
  c_custkey % 5 <> 2 AS show_high_importance,
  {_case(['Conservative', 'Base', 'Aggressive'], 'c_custkey % 3')} AS ml_risk_level FROM customer)""",
}


def with_tables(names: str, *more: str, body: str, recursive: bool = False) -> str:
    """WITH <derived tables>, <more CTEs> <body>."""
    parts = [TABLES[n].strip() for n in names.split()] + [m.strip() for m in more]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def rd(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def rds(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{rd(n, digits)} AS {n}" for n in names)


BY = "PARTITION BY ticker ORDER BY datetime"


def _bound(k: int) -> str:
    return f"{-k} PRECEDING" if k < 0 else "CURRENT ROW" if k == 0 else f"{k} FOLLOWING"


def frame(agg: str, c: str, start: int, end: int, full: bool = True, by: str = BY) -> str:
    """Aggregate over rows start..end, null on incomplete frames when ``full``."""
    over = f"OVER ({by} ROWS BETWEEN {_bound(start)} AND {_bound(end)})"
    call = f"{agg}({c}) {over}"
    return f"CASE WHEN count({c}) {over} = {end - start + 1} THEN {call} END" if full else call


def roll(agg: str, c: str, n: int, by: str = BY) -> str:
    return frame(agg, c, -(n - 1), 0, by=by)


def fwd(agg: str, c: str, n: int, by: str = BY, head_gap: bool = False) -> str:
    value = frame(agg, c, 1, n, by=by)
    return f"CASE WHEN row_number() OVER ({by}) >= {n} THEN {value} END" if head_gap else value


def lag(c: str, k: int = 1, by: str = BY) -> str:
    return f"lag({c}, {k}) OVER ({by})"


def lead(c: str, k: int = 1, by: str = BY) -> str:
    return f"lead({c}, {k}) OVER ({by})"


TR = (f"CASE WHEN {lag('close')} IS NULL THEN NULL ELSE greatest(high - low, abs(high - {lag('close')}), "
      f"abs(low - {lag('close')})) END")


def wilder(source: str, out: str, outs: dict[str, tuple[str, int]]) -> str:
    """Recursive smoothing of non-null columns of ``source``; all columns must be null on the same rows."""
    first = next(iter(outs.values()))[0]
    cols = sorted({c for c, _ in outs.values()})
    seq = f"{out}_seq"
    return f"""
{seq} AS (SELECT ticker, datetime, {', '.join(cols)}, row_number() OVER ({BY}) AS k
  FROM {source} WHERE {first} IS NOT NULL),
{out}_run AS (SELECT ticker, datetime, k, {', '.join(f'CAST({c} AS DOUBLE) AS {o}' for o, (c, _) in outs.items())}
  FROM {seq} WHERE k = 1
  UNION ALL SELECT s.ticker, s.datetime, s.k,
  {', '.join(f'q.{o} * (1 - 1.0::DOUBLE / {n}) + s.{c} / {n}' for o, (c, n) in outs.items())}
  FROM {out}_run q JOIN {seq} s ON s.ticker = q.ticker AND s.k = q.k + 1),
{out} AS (SELECT ticker, datetime, {', '.join(f'CASE WHEN k >= {n} THEN {o} END AS {o}' for o, (_, n) in outs.items())}
  FROM {out}_run)"""
