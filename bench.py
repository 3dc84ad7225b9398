"""Wall-clock of the headline plans; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores,
BENCH_ONLY an optional comma list of plan names (or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "panel_daily_ohlcv", "panel_wick_repair", "panel_densify", "asof_statements", "monthly_last", "phase_shift_monthly",
    "roll_std_20", "roll_quantile", "channel_ols", "corwin_schultz", "mom_12_1", "composite_score", "xs_ic",
    "mom_long_short", "tiered_cost_book", "timing_book", "macd_state", "hysteresis", "ewma_var", "hmm_filter",
    "orb_follow", "zfade_trades", "channel_trades_top", "breakout_trades", "walkforward_ols", "block_bootstrap",
    "permutation_null", "crps_coverage", "empirical_quantiles", "filtered_simulation", "shape_features", "kmeans_edge",
    "batch_sessions", "stream_bars_tumbling", "stream_ewma_state",
]


def main() -> None:
    from barloom import plans
    from barloom.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    plans.load()
    only = os.environ.get("BENCH_ONLY")
    names = list(plans.QUERIES) if only == "all" else (only.split(",") if only else HEADLINE)
    # one untimed pass starts the JVM code paths and Python workers
    plans.QUERIES["monthly_last"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_plans_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
