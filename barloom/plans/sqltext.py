"""Shared pieces of the SQL texts: the same domain views the DataFrame side derives."""

from __future__ import annotations


def r(expr: str, places: int = 6) -> str:
    """Text twin of ``r6``."""
    return f"(floor(({expr}) * 1e{places} + 0.5001) / 1e{places})"


TRADES = """trades AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
         l_quantity AS size, l_extendedprice AS amount,
         (l_orderkey * 8 + l_linenumber) * 1024 + l_partkey % 1024 AS seq
  FROM lineitem)"""

DAILY = TRADES + """, daily AS (
  SELECT code, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(size) AS volume, sum(amount) AS turnover
  FROM trades GROUP BY code, date)"""

# rets: bar clock pos with log and simple return
RETS = DAILY + """, rets AS (
  SELECT *, ln(close / prev) AS lret, close / prev - 1 AS ret FROM (
    SELECT *, row_number() OVER k - 1 AS pos, lag(close) OVER k AS prev
    FROM daily WINDOW k AS (PARTITION BY code ORDER BY date)))"""

# clipped simple return used by every book
BOOKRET = RETS + """, br AS (
  SELECT *, CASE WHEN lret IS NOT NULL THEN exp(greatest(least(lret, 0.6), -0.6)) - 1 END AS cret FROM rets)"""

MONTHLY = TRADES + """, monthly AS (
  SELECT code, mi, arg_max(price, dseq) AS close, sum(amount) AS turnover, sum(size) AS volume,
         last_day(make_date(CAST(mi // 12 AS INT), CAST(mi % 12 + 1 AS INT), 1)) AS month
  FROM (SELECT *, year(date) * 12 + month(date) - 1 AS mi,
               datediff('day', DATE '1970-01-01', date) * 17592186044416 + (seq >> 10) AS dseq FROM trades)
  GROUP BY code, mi)"""

# monthly signal table: clipped log return, 12-1 momentum, next month's return
MSIG = MONTHLY + """, ms0 AS (
  SELECT code, mi, month, close, turnover, volume,
    max(close) OVER (k RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p1,
    max(close) OVER (k RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS p12
  FROM monthly WINDOW k AS (PARTITION BY code ORDER BY mi)),
ms1 AS (SELECT *, CASE WHEN p1 IS NOT NULL THEN exp(greatest(least(ln(close / p1), 0.6), -0.6)) - 1 END AS mret, p1 / p12 - 1 AS mom FROM ms0),
msig AS (SELECT *, max(mret) OVER (PARTITION BY code ORDER BY mi RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS fret FROM ms1)"""

STATEMENTS = """statements AS (
  SELECT code, fiscal_date, sum(l_extendedprice) AS sales, sum(l_extendedprice * l_discount) AS cost,
         sum(l_quantity) AS units, sum(o_totalprice) AS assets,
         CAST(fiscal_date + 45 AS DATE) AS avail_date
  FROM (SELECT l_suppkey AS code, l_extendedprice, l_discount, l_quantity, o_totalprice,
          CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) - 1 AS fiscal_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  GROUP BY code, fiscal_date)"""

SYMBOLS = """symbols AS (
  SELECT s_suppkey AS code, s_name AS name, n_name AS nation,
    CASE WHEN s_nationkey % 2 = 0 THEN 'GBX' ELSE 'USD' END AS currency,
    CASE WHEN s_acctbal >= 0 THEN 'active' ELSE 'delisted' END AS status
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def bars(minutes: int) -> str:
    """OHLC bars of the event stream per event type."""
    return f"""bars AS (
  SELECT event_type AS code, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(value, ts) AS open,
         max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n_ticks
  FROM events GROUP BY 1, 2)"""


def frame(lo: int, hi: int) -> str:
    """RANGE frame text from signed offsets."""

    def side(v: int) -> str:
        return "CURRENT ROW" if v == 0 else f"{abs(v)} {'PRECEDING' if v < 0 else 'FOLLOWING'}"

    return f"RANGE BETWEEN {side(lo)} AND {side(hi)}"


def full(agg: str, x: str, n: int, lag: int = 0, min_obs: int | None = None, k: str = "k") -> str:
    """Rolling aggregate guarded by the observation count; window named ``k``."""
    f = frame(-(n - 1 + lag), -lag)
    return f"CASE WHEN count({x}) OVER ({k} {f}) >= {min_obs or n} THEN {agg} OVER ({k} {f}) END"
