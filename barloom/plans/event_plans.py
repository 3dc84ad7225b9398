"""Event and first-passage plans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as fc
from ..functions.columns import r6, r6_any, year_of
from ..operators import book, events, fades, metrics, recursion, rolling, trendlines, xsec
from ..operators.aggregate import grid_neighbourhood, with_grid
from ..operators.clock import Clock, with_position
from ..sources import tables as t
from . import query
from . import sqltext as q
from .cross_section import splits
from .features import CHANNEL_SQL
from .panel import market, session_bars
from .recursions import WILDER  # noqa: F401
from .sqltext import full, r

BAR = Clock("code", "pos")
SESS = ["code", "session"]

SESSION = q.bars(30) + """, sb0 AS (SELECT *, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session, (hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR)) // 30 AS slot FROM bars),
  sb1 AS (SELECT *, row_number() OVER (PARTITION BY code, session ORDER BY slot) - 1 AS bar_no FROM sb0 WHERE slot >= 19 AND slot < 32),
  sb AS (SELECT *, count(*) OVER (PARTITION BY code, session) AS n_bars FROM sb1 WHERE slot = bar_no + 19 QUALIFY count(*) OVER (PARTITION BY code, session) >= 4)"""


@query("candle_flags", f"""WITH {q.bars(60)}, x AS (SELECT *, close > open AS bull, high - low AS rng, abs(close - open) AS body, high - greatest(open, close) AS uw, least(open, close) - low AS lw FROM bars),
 y AS (SELECT *, lag(bull) OVER k AS pb, high >= lag(high) OVER k AND low <= lag(low) OVER k AS cov FROM x WINDOW k AS (PARTITION BY code ORDER BY ts))
 SELECT code, ts, NOT bull AND rng > 0 AND uw >= 2 * body AND uw >= 0.5 * rng AND lw <= 0.1 * rng AS star, bull AND rng > 0 AND lw >= 2 * body AND lw >= 0.5 * rng AND uw <= 0.1 * rng AS hammer,
  coalesce(pb AND NOT bull AND cov, false) AS bear_engulf, coalesce(NOT pb AND bull AND cov, false) AS bull_engulf FROM y""")
def _(spark, sf):
    d = events.candle_flags(t.bars(t.ticks(spark, sf), 60), ["code"], "ts")
    return d.select("code", "ts", "star", "hammer", "bear_engulf", "bull_engulf")


@query("opening_range_box", f"""WITH {SESSION} SELECT code, session, {r('max(high)')} AS box_hi, {r('min(low)')} AS box_lo, arg_max(close, bar_no) > arg_min(open, bar_no) AS box_up FROM sb WHERE bar_no < 3 GROUP BY code, session""")
def _(spark, sf):
    return events.opening_box(session_bars(spark, sf), SESS).select("code", "session", r6("box_hi").alias("box_hi"), r6("box_lo").alias("box_lo"), "box_up")


ORB = SESSION + """, bx AS (SELECT *, max(high) FILTER (WHERE bar_no < 3) OVER s AS hi, min(low) FILTER (WHERE bar_no < 3) OVER s AS lo, least(max(bar_no) OVER s, 7) AS be FROM sb WINDOW s AS (PARTITION BY code, session)),
 en AS (SELECT code, session, min(bar_no) AS ei FROM bx WHERE bar_no BETWEEN 3 AND be AND (high >= hi OR low <= lo) GROUP BY ALL),
 e2 AS (SELECT b.code, b.session, ei, be, hi, lo, CASE WHEN high >= hi AND low <= lo THEN close >= open ELSE high >= hi END AS lng, open FROM bx b JOIN en ON b.code = en.code AND b.session = en.session AND b.bar_no = ei),
 e3 AS (SELECT *, CASE WHEN lng THEN greatest(open, hi) ELSE least(open, lo) END AS entry, CASE WHEN lng THEN lo ELSE hi END AS stop FROM e2),
 st AS (SELECT e.code, e.session, min(b.bar_no) AS si FROM e3 e JOIN sb b ON b.code = e.code AND b.session = e.session AND b.bar_no BETWEEN e.ei AND e.be WHERE CASE WHEN lng THEN b.low <= stop ELSE b.high >= stop END GROUP BY ALL),
 e4 AS (SELECT e3.*, si, coalesce(si, be) AS xi FROM e3 LEFT JOIN st USING (code, session)),
 orb AS (SELECT e.code, e.session, any_value(e.entry) AS entry, any_value(e.stop) AS stop, any_value(lng) AS lng, any_value(ei) AS ei, any_value(xi) AS xi, any_value(si) IS NOT NULL AS stopped,
   CASE WHEN any_value(si) IS NOT NULL THEN any_value(e.stop) ELSE arg_max(b.close, b.bar_no) END AS exit,
   max(greatest(CASE WHEN lng THEN (entry - b.low) / entry ELSE (b.high - entry) / entry END, 0)) AS mae, max(greatest(CASE WHEN lng THEN (b.high - entry) / entry ELSE (entry - b.low) / entry END, 0)) AS mfe
  FROM e4 e JOIN sb b ON b.code = e.code AND b.session = e.session AND b.bar_no BETWEEN e.ei AND e.xi GROUP BY e.code, e.session),
 tr AS (SELECT *, abs(stop - entry) / entry AS risk, CASE WHEN lng THEN (exit - entry) / entry ELSE (entry - exit) / entry END AS gross FROM orb WHERE abs(stop - entry) / entry > 0)"""


def orb(spark, sf, **kw):
    return events.opening_breakout(session_bars(spark, sf), SESS, 3, 5, **kw)


@query("orb_follow", f"""WITH {ORB} SELECT code, session, lng AS long, ei AS entry_bar, xi AS exit_bar, stopped, {r('entry')} AS entry, {r('exit')} AS exit, {r('gross')} AS gross, {r('risk')} AS risk, {r('mae')} AS mae, {r('mfe')} AS mfe FROM tr""")
def _(spark, sf):
    d = orb(spark, sf)
    return d.select("code", "session", "long", F.col("entry_bar").cast("long").alias("entry_bar"), F.col("exit_bar").cast("long").alias("exit_bar"), "stopped", *[r6_any(c).alias(c) for c in ("entry", "exit", "gross", "risk", "mae", "mfe")])


@query("trade_metrics", f"""WITH {ORB}, c AS (SELECT *, gross - 0.0005 AS net FROM tr)
 SELECT lng AS long, count(net) AS n, {r('avg((net > 0)::INT)')} AS win_rate, {r('avg(net)')} AS mean_net, {r('sum(CASE WHEN net > 0 THEN net END) / -sum(CASE WHEN net < 0 THEN net END)')} AS profit_factor, {r('avg(net / risk)')} AS mean_r FROM c GROUP BY lng""")
def _(spark, sf):
    d = orb(spark, sf).withColumn("net", F.col("gross") - 0.0005)
    return d.groupBy("long").agg(*[e.alias(k) if k == "n" else r6_any(e).alias(k) for k, e in metrics.trade_metrics("net", "risk").items()])


@query("cost_grid_grouping", f"""WITH {ORB}, g AS (SELECT unnest([0.0, 5.0, 10.0]) AS bps), c AS (SELECT bps::DOUBLE AS bps, CASE WHEN lng THEN 'LONG' ELSE 'SHORT' END AS side, gross - bps / 1e4 AS net FROM tr, g)
 SELECT bps, coalesce(side, 'BOTH') AS side, count(*) AS n, {r('avg(net)')} AS mean_net FROM c GROUP BY GROUPING SETS ((bps), (bps, side))""")
def _(spark, sf):
    d = with_grid(orb(spark, sf), bps=[0.0, 5.0, 10.0]).withColumns({"side": F.when(F.col("long"), "LONG").otherwise("SHORT"), "net": F.col("gross") - F.col("bps") / 1e4})
    out = d.groupingSets([["bps"], ["bps", "side"]], "bps", "side").agg(F.count(F.lit(1)).alias("n"), r6_any(F.avg("net")).alias("mean_net"))
    return out.select("bps", F.coalesce("side", F.lit("BOTH")).alias("side"), "n", "mean_net")


@query("trade_cost_model", f"""WITH {ORB}, g AS (SELECT unnest([5.0, 20.0]) AS sp) SELECT code, session, sp::DOUBLE AS spread_bps, {r('gross - 2 * sp / 1e4 - 0.05 * 1 / 365')} AS net FROM tr, g""")
def _(spark, sf):
    d = with_grid(orb(spark, sf), spread_bps=[5.0, 20.0]).withColumns({"direction": F.when(F.col("long"), "LONG").otherwise("SHORT"), "days": F.lit(1), "fin": F.lit(0.05)})
    return d.select("code", "session", "spread_bps", r6_any(fc.trade_net("direction", "entry", "exit", "days", "spread_bps", "fin", "gross")).alias("net"))


@query("concentration", f"""WITH {ORB}, g AS (SELECT session, sum(gross) AS s, count(*) AS m FROM tr GROUP BY session), tp AS (SELECT sum(s) AS ts, sum(m) AS tm FROM (SELECT * FROM g ORDER BY s DESC, session LIMIT 3)),
 a AS (SELECT sum(s) AS s, sum(m) AS m, count(*) FILTER (WHERE s > 0) AS n_pos, count(*) FILTER (WHERE s < 0) AS n_neg FROM g)
 SELECT {r('ts / s')} AS top_share, n_pos, n_neg, {r('(s - ts) / (m - tm)')} AS mean_ex_top FROM a, tp""")
def _(spark, sf):
    d = metrics.concentration(orb(spark, sf), "session", "gross", 3)
    return d.select(r6_any("top_share").alias("top_share"), "n_pos", "n_neg", r6_any("mean_ex_top").alias("mean_ex_top"))


@query("beta_neutral_trades", f"""WITH {ORB}, dm AS (SELECT session, avg(close / open - 1) AS mk FROM (SELECT code, session, arg_min(open, bar_no) AS open, arg_max(close, bar_no) AS close FROM sb GROUP BY ALL) GROUP BY session)
 SELECT code, session, {r('gross - CASE WHEN lng THEN 1 ELSE -1 END * mk')} AS alpha FROM tr JOIN dm USING (session)""")
def _(spark, sf):
    s = session_bars(spark, sf).groupBy(*SESS).agg(F.min_by("open", "bar_no").alias("o"), F.max_by("close", "bar_no").alias("c"))
    mk = s.groupBy("session").agg(F.avg(fc.ieee_ratio("c", "o") - 1).alias("mk"))
    d = orb(spark, sf).join(mk, "session")
    return d.select("code", "session", r6_any(F.col("gross") - F.when(F.col("long"), 1.0).otherwise(-1.0) * F.col("mk")).alias("alpha"))


@query("trades_with_state", f"""WITH {ORB}, dy AS (SELECT code, CAST(ts AS DATE) AS session, max(high) - min(low) AS rng FROM bars GROUP BY ALL), stt AS (SELECT code, session, rng / lag(avg_rng) OVER (PARTITION BY code ORDER BY session) AS state FROM (
   SELECT *, avg(rng) OVER (PARTITION BY code ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS avg_rng FROM dy))
 SELECT tr.code, tr.session, {r('gross')} AS gross, {r('state')} AS state FROM tr LEFT JOIN stt USING (code, session)""")
def _(spark, sf):
    b = t.bars(t.ticks(spark, sf), 30).withColumn("session", F.to_date("ts"))
    dy = b.groupBy(*SESS).agg((F.max("high") - F.min("low")).alias("rng"))
    w = Window.partitionBy("code").orderBy("session")
    st = dy.withColumn("avg_rng", F.avg("rng").over(w.rowsBetween(-4, 0)))
    st = st.withColumn("before", F.lag("avg_rng").over(w)).withColumn("state", fc.ieee_ratio("rng", "before")).select(*SESS, "state")
    return orb(spark, sf).join(st, SESS, "left").select("code", "session", r6_any("gross").alias("gross"), r6_any("state").alias("state"))


def day_bars(spark, sf):
    """Hourly bars of each UTC day, numbered within the day."""
    b = t.bars(t.ticks(spark, sf), 60).withColumn("session", F.to_date("ts"))
    return with_position(b, SESS, "ts", "bar_no")


def daily_ranges(spark, sf):
    """Mean true range of the 14 sessions before each (the first session has no true range)."""
    b = t.bars(t.ticks(spark, sf), 60).withColumn("session", F.to_date("ts"))
    dy = b.groupBy(*SESS).agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", "ts").alias("cl"))
    w = Window.partitionBy("code").orderBy("session")
    before = F.lag("cl").over(w)
    tr = F.when(before.isNotNull(), F.greatest(F.col("hi") - F.col("lo"), F.abs(F.col("hi") - before), F.abs(F.col("lo") - before)))
    dy = dy.withColumn("tr", tr)
    frame = w.rowsBetween(-14, -1)
    return dy.select(*SESS, F.when(F.count("tr").over(frame) == 14, F.avg("tr").over(frame)).alias("atr"))


def gated_day_bars(spark, sf):
    return day_bars(spark, sf).join(daily_ranges(spark, sf), SESS, "left")


def fade_sql(grid: str) -> str:
    """CTEs up to ``fd``, one row a (grid cell, code, session); ``grid`` selects wi, si, wick, opp, mult."""
    carry = "wi, si, code, session, i"
    return q.bars(60) + f""", db AS (SELECT code, CAST(ts AS DATE) AS session, row_number() OVER (PARTITION BY code, CAST(ts AS DATE) ORDER BY ts) - 1 AS i, open AS o, high AS h, low AS l, close AS c FROM bars),
 dy AS (SELECT code, session, max(h) AS hi, min(l) AS lo, arg_max(c, i) AS cl FROM db GROUP BY code, session),
 tr AS (SELECT *, CASE WHEN lag(cl) OVER w IS NOT NULL THEN greatest(hi - lo, abs(hi - lag(cl) OVER w), abs(lo - lag(cl) OVER w)) END AS tr FROM dy WINDOW w AS (PARTITION BY code ORDER BY session)),
 at_ AS (SELECT code, session, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM tr WINDOW w AS (PARTITION BY code ORDER BY session ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
 gr_ AS ({grid}),
 sx AS (SELECT code, session, count(*) AS n, CASE WHEN max(c) FILTER (i = 2) > max(o) FILTER (i = 0) OR count(*) < 3 THEN 1 ELSE -1 END AS sg, max(h) FILTER (i < 3) AS hi, min(l) FILTER (i < 3) AS lo, least(count(*) - 1, 17) AS last FROM db GROUP BY code, session),
 bx AS (SELECT *, CASE WHEN sg = 1 THEN hi ELSE -lo END AS top, CASE WHEN sg = 1 THEN lo ELSE -hi END AS bottom FROM sx),
 mi_ AS (SELECT db.code, db.session, i, n, sg, last, top, bottom, top - 0.5 * (top - bottom) AS trig, sg * o AS o, CASE WHEN sg = 1 THEN h ELSE -l END AS h, CASE WHEN sg = 1 THEN l ELSE -h END AS l, sg * c AS c,
    CASE WHEN sg = 1 THEN c <= o ELSE c > o END AS down FROM db JOIN bx USING (code, session)),
 nb AS (SELECT *, lag(h) OVER k AS bh, lag(l) OVER k AS bl, lag(down) OVER k AS bdown, CASE WHEN i < last THEN lead(o) OVER k END AS nx FROM mi_ WINDOW k AS (PARTITION BY code, session ORDER BY i)),
 x AS (SELECT nb.*, gr_.*, down AND h > l AND h - greatest(o, c) >= wick * abs(c - o) AND h - greatest(o, c) >= 0.5 * (h - l) AND least(o, c) - l <= opp * (h - l) AS reject,
    i > 3 AND NOT bdown AND down AND h >= bh AND l <= bl AS engulf FROM nb, gr_ WHERE n >= 5 AND i BETWEEN 3 AND last),
 st AS (SELECT wi, si, code, session, 2::BIGINT AS i, 0 AS phase, NULL::VARCHAR AS pattern, NULL::DOUBLE AS level, NULL::DOUBLE AS peak, NULL::BIGINT AS at_i, NULL::DOUBLE AS px, NULL::DOUBLE AS stop, NULL::DOUBLE AS live, false AS trailed,
    NULL::BIGINT AS k, NULL::DOUBLE AS leave, NULL::VARCHAR AS reason, 0.0::DOUBLE AS worst, 0.0::DOUBLE AS best FROM (SELECT DISTINCT wi, si, code, session FROM x)
  UNION ALL
  SELECT {carry}, CASE WHEN on_ AND (h >= live OR l <= bottom) THEN 3 ELSE phase END, pattern, level, peak, at_i, px, stop, CASE WHEN moved THEN top ELSE live END, trailed OR moved,
    CASE WHEN on_ THEN i ELSE k END, CASE WHEN on_ THEN CASE WHEN h >= live THEN live WHEN l <= bottom THEN bottom ELSE c END ELSE leave END,
    CASE WHEN on_ THEN CASE WHEN h >= live THEN CASE WHEN trailed THEN 'trail' ELSE 'stop' END WHEN l <= bottom THEN 'target' ELSE 'time' END ELSE reason END,
    CASE WHEN on_ THEN greatest(worst, h - px) ELSE worst END, CASE WHEN on_ THEN greatest(best, px - l) ELSE best END
  FROM (SELECT *, on_ AND NOT (h >= live) AND NOT (l <= bottom) AND NOT trailed AND l <= trig AS moved FROM (SELECT *, phase = 2 AND i >= at_i AS on_ FROM (
    SELECT * REPLACE (CASE WHEN star THEN 2 WHEN eng THEN 1 ELSE phase END AS phase, CASE WHEN star THEN 'star' WHEN eng THEN 'engulf' ELSE pattern END AS pattern, CASE WHEN eng THEN bl ELSE level END AS level,
        CASE WHEN eng THEN h ELSE peak END AS peak, CASE WHEN star THEN i + 1 ELSE at_i END AS at_i, CASE WHEN star THEN nx ELSE px END AS px,
        CASE WHEN star THEN nx + mult * (h - nx) ELSE stop END AS stop, CASE WHEN star THEN nx + mult * (h - nx) ELSE live END AS live)
    FROM (SELECT *, phase = 0 AND h > top AND NOT star AND engulf AND bl >= top AS eng FROM (
      SELECT *, coalesce(phase = 0 AND h > top AND reject AND nx >= top AND nx + mult * (h - nx) > nx AND nx > bottom, false) AS star FROM (
        SELECT * REPLACE (CASE WHEN good THEN 2 WHEN hit THEN 4 ELSE phase END AS phase, CASE WHEN good THEN i ELSE at_i END AS at_i, CASE WHEN good THEN fp ELSE px END AS px,
            CASE WHEN good THEN fp + mult * (peak - fp) ELSE stop END AS stop, CASE WHEN good THEN fp + mult * (peak - fp) ELSE live END AS live)
        FROM (SELECT *, hit AND fp + mult * (peak - fp) > fp AND fp > bottom AS good FROM (
          SELECT x.*, phase, pattern, level, peak, at_i, px, stop, live, trailed, k, leave, reason, worst, best, phase = 1 AND l <= level AS hit, least(o, level) AS fp
          FROM st JOIN x ON x.wi = st.wi AND x.si = st.si AND x.code = st.code AND x.session = st.session AND x.i = st.i + 1))))))))),
 en AS (SELECT st.* FROM st JOIN bx ON st.code = bx.code AND st.session = bx.session AND st.i = bx.last),
 f0 AS (SELECT gr_.wi, gr_.si, bx.code, bx.session, bx.sg, bx.top, bx.bottom, atr, CASE WHEN n < 5 THEN 'no_box' WHEN NOT coalesce(atr > 0, false) THEN 'no_atr' WHEN phase IN (2, 3) THEN 'traded' WHEN phase = 1 THEN 'no_fill' ELSE 'no_signal' END AS stage,
    en.* EXCLUDE (wi, si, code, session) FROM bx CROSS JOIN gr_ LEFT JOIN at_ USING (code, session) LEFT JOIN en ON en.wi = gr_.wi AND en.si = gr_.si AND en.code = bx.code AND en.session = bx.session),
 fd AS (SELECT wi, si, code, session, stage, CASE WHEN stage IN ('traded', 'no_fill') THEN CASE WHEN sg = 1 THEN 'short' ELSE 'long' END END AS side, CASE WHEN stage IN ('traded', 'no_fill') THEN pattern END AS pattern,
    CASE WHEN stage = 'traded' THEN at_i END AS entry_bar, CASE WHEN stage = 'traded' THEN k END AS exit_bar, CASE WHEN stage = 'traded' THEN reason END AS reason, CASE WHEN stage = 'traded' THEN sg * px END AS entry,
    CASE WHEN stage = 'traded' THEN sg * leave END AS exit, CASE WHEN stage = 'traded' THEN (px - leave) / abs(px) END AS gross, CASE WHEN stage = 'traded' THEN (px - leave) / abs(stop - px) END AS r_multiple,
    CASE WHEN stage = 'traded' THEN worst / abs(px) END AS mae, CASE WHEN stage = 'traded' THEN best / abs(px) END AS mfe, CASE WHEN stage = 'traded' THEN abs(stop - px) / abs(px) END AS risk,
    CASE WHEN stage NOT IN ('no_box', 'no_atr') THEN (top - bottom) / atr END AS liq_ratio FROM f0)"""


FADE_OUT = ("entry", "exit", "gross", "r_multiple", "mae", "mfe", "liq_ratio")


@query("fade_scalper", f"""WITH RECURSIVE {fade_sql("SELECT 0 AS wi, 0 AS si, 0.5::DOUBLE AS wick, 0.4::DOUBLE AS opp, 1.0::DOUBLE AS mult")}
 SELECT code, session, stage, side, pattern, entry_bar, exit_bar, reason, {', '.join(f'{r(c)} AS {c}' for c in FADE_OUT)} FROM fd""")
def _(spark, sf):
    params = {"wick_body": F.lit(0.5), "opp_max": F.lit(0.4)}
    d = fades.opening_fade(gated_day_bars(spark, sf), SESS, 3, 15, params=params, atr=F.col("atr"))
    bar_no = lambda c: F.col(c).cast("long").alias(c)
    return d.select(*SESS, "stage", "side", "pattern", bar_no("entry_bar"), bar_no("exit_bar"), "reason", *[r6(c).alias(c) for c in FADE_OUT])


WICKS, STOPS, LIQUID, COST_BPS = [0.5, 1.0, 2.0], [1.0, 1.5, 2.0], [0.0, 0.25, 0.5, 0.75], 5.0
FADE_GRID = "SELECT wi, si, ([0.5, 1.0, 2.0])[wi + 1]::DOUBLE AS wick, 0.4::DOUBLE AS opp, ([1.0, 1.5, 2.0])[si + 1]::DOUBLE AS mult FROM (SELECT unnest(range(3)) AS wi), (SELECT unnest(range(3)) AS si)"


def fade_grid(spark, sf):
    """All sessions at each wick and stop of the grid, in one keyed job."""
    d = with_grid(gated_day_bars(spark, sf), wi=[0, 1, 2], si=[0, 1, 2])
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(at) + 1)
    params = {"wick_body": pick(WICKS, "wi"), "opp_max": F.lit(0.4), "stop_mult": pick(STOPS, "si")}
    return fades.opening_fade(d, ["wi", "si", *SESS], 3, 15, params=params, atr=F.col("atr")).where("stage = 'traded'")


@query("fade_parameter_sweep", f"""WITH RECURSIVE {fade_sql(FADE_GRID)}, ce AS (SELECT wi, si, count(*) AS n, avg(r_multiple) AS avg_r FROM fd WHERE stage = 'traded' GROUP BY wi, si)
 SELECT a.wi, a.si, any_value(a.n) AS n, {r('any_value(a.avg_r)')} AS avg_r, {r('min(b.avg_r)')} AS nb_min, {r('max(b.avg_r)')} AS nb_max, {r('avg(b.avg_r)')} AS nb_mean, count(*) AS nb_n
 FROM ce a JOIN ce b ON abs(a.wi - b.wi) <= 1 AND abs(a.si - b.si) <= 1 GROUP BY a.wi, a.si""")
def _(spark, sf):
    """Wick x stop grid in one keyed job, and the grid neighbourhood of each cell."""
    cells = fade_grid(spark, sf).groupBy("wi", "si").agg(F.count(F.lit(1)).alias("n"), F.avg("r_multiple").alias("avg_r"))
    from ..session import materialise

    nb = grid_neighbourhood(materialise(cells), ["wi", "si"], "avg_r")  # nine cells, written once
    return nb.select(*[F.col(k).cast("long").alias(k) for k in ("wi", "si")], "n", *[r6(c).alias(c) for c in ("avg_r", "nb_min", "nb_max", "nb_mean")], "nb_n")


_net = f"(gross - {COST_BPS} / 10000) / risk"
LIQ = f""", lq AS (SELECT unnest({LIQUID}::DOUBLE[]) AS thr), ls AS (SELECT wi, si, thr, count(*) AS n, avg((gross > {COST_BPS} / 10000)::INT) AS win, avg({_net}) AS net_r FROM fd JOIN lq ON liq_ratio >= thr WHERE stage = 'traded' GROUP BY wi, si, thr)"""


@query("fade_liquidity_sweep", f"""WITH RECURSIVE {fade_sql(FADE_GRID)}{LIQ} SELECT wi, si, thr, n, {r('win')} AS win, {r('net_r')} AS net_r, thr = first_value(thr) OVER (PARTITION BY wi, si ORDER BY net_r DESC, thr) AS best FROM ls""")
def _(spark, sf):
    """Expectancy after cost for each least height of the box over the range; the best threshold of each cell."""
    d = fade_grid(spark, sf).withColumn("thr", F.explode(F.filter(F.array(*[F.lit(v) for v in LIQUID]), lambda v: F.col("liq_ratio") >= v)))
    cost = F.lit(COST_BPS / 10000)
    risk = F.abs(F.col("stop") - F.col("entry")) / F.abs(F.col("entry"))
    s = d.groupBy("wi", "si", "thr").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gross") > cost).cast("int")).alias("win"), F.avg((F.col("gross") - cost) / risk).alias("net_r"))
    first = F.first("thr").over(Window.partitionBy("wi", "si").orderBy(F.desc("net_r"), "thr"))  # a few thresholds
    return s.select(*[F.col(k).cast("long").alias(k) for k in ("wi", "si")], "thr", "n", r6("win").alias("win"), r6("net_r").alias("net_r"), (F.col("thr") == first).alias("best"))


# best cell per metric and its +-1 neighbourhood, on a grid SQL can evaluate
@query("grid_best_cell", f"""WITH {q.MONTHLY}, g AS (SELECT unnest(range(4)) AS li), h AS (SELECT unnest(range(3)) AS si),
 x AS (SELECT code, mi, ln(close / lag(close, 1) OVER k) AS f, {', '.join(f'lag(close, {n}) OVER k AS c{n}' for n in range(1, 8))} FROM monthly WINDOW k AS (PARTITION BY code ORDER BY mi)),
 m AS (SELECT li, si, f, CASE si WHEN 0 THEN c1 WHEN 1 THEN c2 ELSE c3 END / CASE li WHEN 0 THEN c4 WHEN 1 THEN c5 WHEN 2 THEN c6 ELSE c7 END - 1 AS s FROM x, g, h),
 cells AS (SELECT li, si, avg(CASE WHEN s > 0 THEN f ELSE -f END) AS y FROM m WHERE s IS NOT NULL AND f IS NOT NULL GROUP BY li, si)
 SELECT a.li, a.si, {r('any_value(a.y)')} AS y, {r('min(b.y)')} AS nb_min, {r('max(b.y)')} AS nb_max, {r('avg(b.y)')} AS nb_mean, count(*) AS nb_n, any_value(a.y) = (SELECT max(y) FROM cells) AS best
 FROM cells a JOIN cells b ON abs(a.li - b.li) <= 1 AND abs(a.si - b.si) <= 1 GROUP BY a.li, a.si""")
def _(spark, sf):
    w = Window.partitionBy("code").orderBy("mi")
    m = t.monthly_panel(spark, sf)
    m = m.withColumns({"f": F.log(F.col("close") / F.lag("close").over(w)), **{f"c{n}": F.lag("close", n).over(w) for n in range(1, 8)}})
    m = with_grid(m.select("f", *[f"c{n}" for n in range(1, 8)]), li=list(range(4)), si=list(range(3)))
    num = F.element_at(F.array(*[F.col(f"c{n}") for n in (1, 2, 3)]), F.col("si") + 1)
    den = F.element_at(F.array(*[F.col(f"c{n}") for n in (4, 5, 6, 7)]), F.col("li") + 1)
    m = m.withColumn("s", num / den - 1).where("s IS NOT NULL AND f IS NOT NULL")
    cells = m.groupBy("li", "si").agg(F.avg(F.when(F.col("s") > 0, F.col("f")).otherwise(-F.col("f"))).alias("y"))
    nb = grid_neighbourhood(cells, ["li", "si"], "y")
    best = nb.withColumn("best", F.col("y") == F.max("y").over(Window.partitionBy()))  # twelve cells
    return best.select(F.col("li").cast("long").alias("li"), F.col("si").cast("long").alias("si"), *[r6(c).alias(c) for c in ("y", "nb_min", "nb_max", "nb_mean")], "nb_n", "best")


ZF = q.RETS + f""", zs AS (SELECT *, (close - {full('avg(close)', 'close', 20)}) / {full('stddev_samp(close)', 'close', 20)} AS z, max(pos) OVER (PARTITION BY code) AS lastp,
   lead(open) OVER k AS e_px, lead(date) OVER k AS e_dt FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos)),
 cand AS (SELECT a.code, a.pos AS i, a.z, a.e_px, a.e_dt, coalesce(min(b.pos) FILTER (WHERE (a.z <= -2 AND (b.z >= 0 OR b.z <= -3.5)) OR (a.z >= 2 AND (b.z <= 0 OR b.z >= 3.5))), max(b.pos)) AS x
   FROM zs a JOIN zs b ON a.code = b.code AND b.pos BETWEEN a.pos + 1 AND a.pos + 11 WHERE abs(a.z) >= 2 AND a.pos >= 100 AND a.pos < a.lastp GROUP BY ALL),
 nx AS (SELECT c.*, n.i AS nxt, row_number() OVER (PARTITION BY c.code ORDER BY c.i) AS rn FROM cand c ASOF LEFT JOIN cand n ON c.code = n.code AND c.x < n.i),
 ch AS (SELECT code, i, x, nxt FROM nx WHERE rn = 1 UNION ALL SELECT nx.code, nx.i, nx.x, nx.nxt FROM ch JOIN nx ON nx.code = ch.code AND nx.i = ch.nxt),
 zt AS (SELECT cand.code, cand.i, cand.x, CASE WHEN cand.z <= -2 THEN 'LONG' ELSE 'SHORT' END AS direction, cand.e_px AS entry, cand.e_dt AS entry_date, b.close AS exit, b.date AS exit_date
   FROM ch JOIN cand ON cand.code = ch.code AND cand.i = ch.i JOIN zs b ON b.code = cand.code AND b.pos = cand.x),
 zg AS (SELECT *, greatest(1, datediff('day', entry_date, exit_date)) AS days, CASE WHEN direction = 'LONG' THEN exit / entry - 1 ELSE 1 - exit / entry END AS gross FROM zt)"""


def z_fades(spark, sf, **kw):
    d = t.daily_returns(spark, sf).withColumn("z", rolling.zscore(BAR, "close", 20))
    return events.zscore_fades(d, "z", ["code"], **kw)


@query("zfade_trades", f"WITH RECURSIVE {ZF} SELECT code, i AS signal_pos, x AS exit_pos, direction, entry_date, exit_date, days, {r('entry')} AS entry, {r('exit')} AS exit, {r('gross')} AS gross FROM zg")
def _(spark, sf):
    d = z_fades(spark, sf)
    return d.select("code", F.col("signal_pos").cast("long").alias("signal_pos"), F.col("exit_pos").cast("long").alias("exit_pos"), "direction", "entry_date", "exit_date", F.col("days").cast("long").alias("days"), *[r6(c).alias(c) for c in ("entry", "exit", "gross")])


ZFH = q.RETS + f""", zs AS (SELECT *, (close - {full('avg(close)', 'close', 20)}) / {full('stddev_samp(close)', 'close', 20)} AS z, max(pos) OVER (PARTITION BY code) AS lastp,
   lead(open) OVER k AS e_px, {full('stddev_samp(lret)', 'lret', 20, 1)} / {full('stddev_samp(lret)', 'lret', 100, 1)} AS vs FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos)),
 cand AS (SELECT hold, code, pos AS i, z, e_px, least(pos + 1 + hold, lastp) AS x FROM zs, (SELECT unnest([3, 8]) AS hold) WHERE abs(z) >= 2 AND vs < 1.0 AND pos >= 100 AND pos < lastp),
 nx AS (SELECT c.*, n.i AS nxt, row_number() OVER (PARTITION BY c.hold, c.code ORDER BY c.i) AS rn FROM cand c ASOF LEFT JOIN cand n ON c.hold = n.hold AND c.code = n.code AND c.x < n.i),
 ch AS (SELECT hold, code, i, x, z, e_px, nxt FROM nx WHERE rn = 1 UNION ALL SELECT nx.hold, nx.code, nx.i, nx.x, nx.z, nx.e_px, nx.nxt FROM ch JOIN nx ON nx.hold = ch.hold AND nx.code = ch.code AND nx.i = ch.nxt)"""


@query("zfade_fixed_hold", f"""WITH RECURSIVE {ZFH} SELECT hold, ch.code, i AS signal_pos, x AS exit_pos, CASE WHEN ch.z <= -2 THEN 'LONG' ELSE 'SHORT' END AS direction,
  {r("CASE WHEN ch.z <= -2 THEN b.close / ch.e_px - 1 ELSE 1 - b.close / ch.e_px END")} AS gross FROM ch JOIN zs b ON b.code = ch.code AND b.pos = ch.x""")
def _(spark, sf):
    """Fixed-hold variant gated on compressed volatility, over a hold grid as key."""
    d = t.daily_returns(spark, sf).withColumns({"z": rolling.zscore(BAR, "close", 20), "vs": rolling.vol_state(BAR, "lret")})
    out = None
    for hold in (3, 8):
        one = events.zscore_fades(d, "z", ["code"], max_hold=hold, fixed_hold=True, gate=F.col("vs") < 1.0).withColumn("hold", F.lit(hold))
        out = one if out is None else out.unionByName(one)
    return out.select("hold", "code", F.col("signal_pos").cast("long").alias("signal_pos"), F.col("exit_pos").cast("long").alias("exit_pos"), "direction", r6("gross").alias("gross"))


@query("benchmark_over_hold", f"""WITH RECURSIVE {ZF}, mk AS (SELECT date, sum(ln(1 + m)) OVER (ORDER BY date) AS lx FROM (SELECT date, avg(exp(greatest(least(lret, 0.6), -0.6)) - 1) AS m FROM rets WHERE lret IS NOT NULL GROUP BY date))
 SELECT code, i AS signal_pos, {r('b.lx - a.lx')} AS log_bench FROM zg LEFT JOIN mk a ON a.date = entry_date LEFT JOIN mk b ON b.date = exit_date""")
def _(spark, sf):
    m = market(spark, sf)
    idx = m.select("date", F.exp(F.sum(F.log1p("mret")).over(Window.orderBy("date"))).alias("level"))
    d = events.benchmark_over_hold(z_fades(spark, sf), idx)
    return d.select("code", F.col("signal_pos").cast("long").alias("signal_pos"), r6(F.log1p("bench")).alias("log_bench"))


FWD = q.RETS + f""", zs AS (SELECT *, (close - {full('avg(close)', 'close', 20)}) / {full('stddev_samp(close)', 'close', 20)} AS z, lead(open) OVER k AS entry, {', '.join(f'lead(close, {h + 1}) OVER k AS c{h}' for h in (5, 10, 20))} FROM rets WINDOW k AS (PARTITION BY code ORDER BY pos)),
 ev AS (SELECT code, pos, abs(z) AS ext, CASE WHEN z > 0 THEN 1.0 ELSE -1.0 END AS side, entry, unnest([5, 10, 20]) AS h, unnest([c5, c10, c20]) AS ex FROM zs WHERE abs(z) >= 2),
 fb AS (SELECT *, side * (ex / entry - 1) AS fwd FROM ev WHERE ex IS NOT NULL)"""


def forward_events(spark, sf):
    d = t.daily_returns(spark, sf).withColumn("z", rolling.zscore(BAR, "close", 20)).withColumn("ext", F.abs("z"))
    side = F.when(F.col("z") > 0, 1.0).otherwise(-1.0)
    return events.forward_book(d.select("code", "pos", "date", "open", "close", "z", "ext"), ["code"], F.abs("z") >= 2, side, [5, 10, 20])


@query("event_forward_returns", f"WITH {FWD} SELECT code, pos, h, {r('entry')} AS entry, {r('ex')} AS exit, {r('fwd')} AS fwd FROM fb")
def _(spark, sf):
    return forward_events(spark, sf).select("code", F.col("pos").cast("long").alias("pos"), "h", *[r6(c).alias(c) for c in ("entry", "exit", "fwd")])


@query("event_study_terciles", f"""WITH {FWD}, b AS (SELECT h, quantile_cont(ext, [1.0/3, 2.0/3]) AS e FROM fb GROUP BY h)
 SELECT h, len(list_filter(e, lambda c: c < ext)) AS tercile, count(*) AS n, {r('avg(fwd)')} AS continue_ret, {r('avg(-fwd)')} AS fade_ret FROM fb JOIN b USING (h) GROUP BY 1, 2""")
def _(spark, sf):
    d = forward_events(spark, sf).withColumn("id", F.col("code") * 100000 + F.col("pos"))
    d = xsec.qcut(d, "h", "ext", 3, "id", max(4, splits(spark, sf)), "tercile")
    return d.groupBy("h", F.col("tercile").cast("long").alias("tercile")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fwd")).alias("continue_ret"), r6(F.avg(-F.col("fwd"))).alias("fade_ret"))


def channel_panel(spark, sf, n: int = 60):
    d = t.daily_returns(spark, sf).withColumn("lp", F.log("close"))
    return rolling.channel(d, BAR, "lp", n)


CHT = CHANNEL_SQL + """, cb AS (SELECT *, exp(lm + 2 * sg) AS up, exp(lm - 2 * sg) AS lo, exp(g * 252) - 1 AS ann, max(pos) OVER (PARTITION BY code) AS lastp, lead(open) OVER (PARTITION BY code ORDER BY pos) AS e_px, lead(date) OVER (PARTITION BY code ORDER BY pos) AS e_dt FROM ch),
 ru AS (SELECT code, pos FROM cb WHERE pos < lastp AND (ann < 0 OR close >= up - 0.25 * (up - lo))),
 cd AS (SELECT code, pos AS i, ann, lastp, e_px, e_dt FROM cb WHERE pos < lastp AND ann >= 0.1 AND up > lo AND close <= lo + 0.25 * (up - lo)),
 cx AS (SELECT cd.*, ru.pos AS x0, coalesce(ru.pos, lastp) AS x FROM cd ASOF LEFT JOIN ru ON cd.code = ru.code AND cd.i < ru.pos),
 cn AS (SELECT c.*, n.i AS nxt, row_number() OVER (PARTITION BY c.code ORDER BY c.i) AS rn FROM cx c ASOF LEFT JOIN cx n ON c.code = n.code AND c.x < n.i),
 cc AS (SELECT code, i, nxt FROM cn WHERE rn = 1 UNION ALL SELECT cn.code, cn.i, cn.nxt FROM cc JOIN cn ON cn.code = cc.code AND cn.i = cc.nxt),
 ct AS (SELECT cx.code, cx.i, CASE WHEN x0 IS NULL THEN lastp ELSE least(x0 + 1, lastp) END AS xp, x0 IS NULL AS open_end, e_px, e_dt, ann FROM cc JOIN cx ON cx.code = cc.code AND cx.i = cc.i),
 ctt AS (SELECT ct.*, r.date AS x_dt, CASE WHEN open_end THEN r.close ELSE r.open END AS x_px FROM ct JOIN rets r ON r.code = ct.code AND r.pos = ct.xp)"""


@query("channel_trades_top", f"WITH RECURSIVE {CHT} SELECT code, i AS signal_pos, xp AS exit_pos, e_dt AS entry_date, x_dt AS exit_date, {r('e_px')} AS entry, {r('x_px')} AS exit FROM ctt")
def _(spark, sf):
    d = events.channel_trades(channel_panel(spark, sf), ["code"])
    return d.select("code", F.col("signal_pos").cast("long").alias("signal_pos"), F.col("exit_pos").cast("long").alias("exit_pos"), "entry_date", "exit_date", r6("entry").alias("entry"), r6("exit").alias("exit"))


@query("channel_ride", f"WITH RECURSIVE {CHT.replace('(ann < 0 OR close >= up - 0.25 * (up - lo))', '(close < lo)')} SELECT code, i AS signal_pos, xp AS exit_pos, {r('e_px')} AS entry, {r('x_px')} AS exit FROM ctt")
def _(spark, sf):
    d = events.channel_trades(channel_panel(spark, sf), ["code"], exit_rule="break", break_frac=0.0)
    return d.select("code", F.col("signal_pos").cast("long").alias("signal_pos"), F.col("exit_pos").cast("long").alias("exit_pos"), r6("entry").alias("entry"), r6("exit").alias("exit"))


def channel_atr(spark, sf):
    d = channel_panel(spark, sf)
    d = d.withColumn("tr", rolling.true_range(BAR))
    return d.withColumn("atr", BAR.full(F.avg, "tr", 22))


@query("channel_ratchet_width")
def _(spark, sf):
    d = events.channel_ratchet(channel_atr(spark, sf), ["code"], "width")
    return d.select("code", "signal_pos", "exit_pos", r6("entry").alias("entry"), r6("exit").alias("exit"))


@query("channel_ratchet_atr")
def _(spark, sf):
    d = events.channel_ratchet(channel_atr(spark, sf), ["code"], "atr")
    return d.select("code", "signal_pos", "exit_pos", r6("entry").alias("entry"), r6("exit").alias("exit"))


@query("slot_portfolio")
def _(spark, sf):
    """Slot-limited book over the channel trades for two slot counts."""
    tr = events.channel_trades(channel_panel(spark, sf), ["code"])
    tr = tr.select("code", F.col("entry_date").alias("entry"), F.col("exit_date").alias("exit"), "grad").withColumn("cell", F.lit("base"))
    out = None
    for s in (5, 10):
        one = book.slot_portfolio(tr, ["cell"], s).withColumn("slots", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.select("slots", "code", "entry", "exit")


def atr_panel(spark, sf):
    d = t.daily_returns(spark, sf).withColumn("tr", rolling.true_range(BAR))
    return recursion.wilder_atr(d, "code", "pos", "tr", 14)


@query("breakout_signals")
def _(spark, sf):
    return trendlines.breakout_signals(atr_panel(spark, sf), ["code"], min_touches=2).withColumn("break_extent", r6("break_extent"))


@query("breakout_trades")
def _(spark, sf):
    d = trendlines.breakout_trades(atr_panel(spark, sf), ["code"], min_touches=2)
    return d.select("code", "signal_pos", "exit_pos", "entry_date", "exit_date", "direction", *[r6(c).alias(c) for c in ("entry", "exit", "break_extent", "rel_volume")], "days", "touches")


@query("breakout_span_sweep")
def _(spark, sf):
    """Minimum line span as a key column of one job: trade metrics per cell."""
    tr = trendlines.breakout_trades(atr_panel(spark, sf), ["code"], min_touches=2, spans={"span": [0, 5, 20]})
    tr = tr.withColumn("net", fc.trade_net("direction", "entry", "exit", "days", F.lit(10.0), F.lit(0.05)))
    return tr.groupBy("span").agg(*[e.alias(k) if k == "n" else r6(e).alias(k) for k, e in metrics.trade_metrics("net").items()])


@query("line_duration")
def _(spark, sf):
    d = trendlines.alignment(trendlines.duration_features(trendlines.breakout_trades(atr_panel(spark, sf), ["code"], min_touches=2)))
    names = ["span", "age_a", "age_b", "touch_span", "since_touch", "n_touch"]
    return d.select("code", "signal_pos", *[r6(f"rel_{n}").alias(f"rel_{n}") for n in names], "aligned", r6("align_slope").alias("align_slope"))


@query("breakout_composite_score")
def _(spark, sf):
    """First-half standardised score of break extent and relative volume, outcome per score bucket of the rest."""
    d = trendlines.breakout_trades(atr_panel(spark, sf), ["code"], min_touches=2).where("break_extent IS NOT NULL AND rel_volume IS NOT NULL")
    from ..operators.clean import time_quantile_split
    from ..session import materialise

    d = materialise(d)  # the sequential walk runs once, everything below reads the trades table
    d = time_quantile_split(d.withColumnRenamed("entry_date", "date"), "date", 0.5)
    d = d.withColumns({"gross": fc.signed_return("direction", "entry", "exit"), "id": F.col("code") * 100000 + F.col("signal_pos")})
    st = d.where("is_train").agg(*[f(c).alias(f"{n}_{c}") for c in ("break_extent", "rel_volume") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    d = d.where("NOT is_train").join(F.broadcast(st))
    d = d.withColumn("score", sum(((F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-9) for c in ("break_extent", "rel_volume")), F.lit(0.0)))
    d = xsec.qcut(d.withColumn("g", F.lit(0)), "g", "score", 5, "id", max(4, splits(spark, sf)))
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("gross")).alias("mean_gross"))
