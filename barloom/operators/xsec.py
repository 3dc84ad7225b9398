"""Cross-sectional operators: statistics and ranks within a date.

A cross-section holds at most one row per instrument. ``splits`` says how many tasks share one
cross-section: 1 (a plain window per date) while the symbol master is small, more when it is not.
``splits_for`` derives it from the counted size of the symbol master. With more than one split,
statistics come from map-side combined aggregates joined back, and exact ranks from value-range
buckets whose counts are turned into offsets, so no task ever holds a whole cross-section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clip, col
from ..session import materialise

NAMES_PER_TASK = 1_000_000


def splits_for(n_names: int, per_task: int = NAMES_PER_TASK) -> int:
    return max(1, -(-n_names // per_task))


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _attach(df: DataFrame, found: DataFrame, by: list[str], equal: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Join columns of ``found`` on ``by``, where NULL is a group as in a window, and on equal values of ``equal``."""
    keys = [*by, *equal]
    found = found.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__key{i}") if k in equal else F.col(k).eqNullSafe(F.col(f"__key{i}")))
    return df.join(found, on, how).drop(*[f"__key{i}" for i in range(len(keys))])


def _tie_cuts(df: DataFrame, by: list[str], tie: str, splits: int) -> DataFrame:
    """splits - 1 cut points of a key of any orderable type, from a bounded sample drawn by hash; they need not be exact."""
    drawn = df.groupBy(*by, F.pmod(F.xxhash64(tie), F.lit(64 * splits)).alias("__d")).agg(F.min_by(tie, F.xxhash64(F.lit(1), tie)).alias("__t"))
    drawn = drawn.groupBy(*by).agg(F.sort_array(F.collect_list("__t")).alias("__t"))
    at = F.transform(F.sequence(F.lit(1), F.lit(splits - 1)), lambda i: F.get("__t", F.floor(i * F.size("__t") / splits).cast("int")))
    return drawn.select(*by, at.alias("__tc"))


def with_stats(df: DataFrame, by, aggs: dict[str, Column], splits: int = 1) -> DataFrame:
    """Add aggregates of the row's cross-section as columns."""
    by = _by(by)
    if splits == 1:
        w = Window.partitionBy(*by)
        return df.withColumns({k: a.over(w) for k, a in aggs.items()})
    df = materialise(df)
    return _attach(df, df.groupBy(*by).agg(*[a.alias(k) for k, a in aggs.items()]), by)


def with_row_number(df: DataFrame, by, value: str, tie: str, out: str = "rn", descending: bool = False,
                    splits: int = 1) -> DataFrame:
    """1-based position by (value, tie) within the cross-section; NULL values come last."""
    by = _by(by)
    v = F.col(value)
    order = [v.desc_nulls_last() if descending else v.asc_nulls_last(), F.col(tie).asc()]
    if splits == 1:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    df = materialise(df)
    probs = [i / splits for i in range(1, splits)]
    cuts = _attach(df.groupBy(*by).agg(F.percentile_approx(value, probs, 10_000).alias("__vc")), _tie_cuts(df, by, tie, splits), by)
    below = F.size(F.filter("__vc", lambda c: c < v))
    on_cut = F.array_contains("__vc", v)
    # values equal to a cut point form buckets of their own, which may be sub-split by the tie key
    vb = F.when(v.isNull(), F.lit(2 * splits + 2)).otherwise(below * 2 + on_cut.cast("int"))
    if descending:
        vb = F.when(v.isNull(), vb).otherwise(F.lit(2 * splits) - vb)
    tb = F.when(v.isNull() | on_cut, F.size(F.filter("__tc", lambda c: c < F.col(tie)))).otherwise(0)
    tagged = _attach(df, cuts, by).withColumns({"__vb": vb, "__tb": tb}).drop("__vc", "__tc")
    counts = tagged.groupBy(*by, "__vb", "__tb").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__vb", "__tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__vb", "__tb", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(*by, "__vb", "__tb").orderBy(*order))
    ranked = tagged.withColumn("__in", inside)
    ranked = _attach(ranked, offsets, by, ("__vb", "__tb"))
    return ranked.withColumn(out, (F.col("__in") + F.col("__off")).cast("int")).drop("__vb", "__tb", "__in", "__off")


def with_average_rank(df: DataFrame, by, value: str, tie: str, out: str = "avg_rank", splits: int = 1) -> DataFrame:
    """Ascending rank with ties averaged; NULL for NULL values."""
    by = _by(by)
    v = F.col(value)
    if splits == 1:
        order = Window.partitionBy(*by).orderBy(v.asc_nulls_last())
        same = Window.partitionBy(*by, value)
        rank = F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2.0
        return df.withColumn(out, F.when(v.isNotNull(), rank))
    rn = materialise(with_row_number(df, by, value, tie, "__rn", splits=splits))
    ties = rn.where(v.isNotNull()).groupBy(*by, value).agg(F.avg("__rn").alias(out))
    return _attach(rn, ties, by, (value,), "left").drop("__rn")


def rank_pct(df: DataFrame, by, value: str, tie: str, out: str, splits: int = 1) -> DataFrame:
    """Average rank divided by the number of valid names."""
    df = with_average_rank(df, by, value, tie, "__ar", splits)
    df = with_stats(df, by, {"__n": F.count(value)}, splits)
    return df.withColumn(out, F.col("__ar") / F.col("__n")).drop("__ar", "__n")


def rank_centred(df: DataFrame, by, value: str, tie: str, out: str, splits: int = 1) -> DataFrame:
    """(rank - 0.5)/n - 0.5, in (-0.5, 0.5)."""
    df = with_average_rank(df, by, value, tie, "__ar", splits)
    df = with_stats(df, by, {"__n": F.count(value)}, splits)
    return df.withColumn(out, (F.col("__ar") - 0.5) / F.col("__n") - 0.5).drop("__ar", "__n")


def zscore(df: DataFrame, by, value: str, out: str, splits: int = 1) -> DataFrame:
    """Sample z-score; zero where the cross-section has no spread."""
    df = with_stats(df, by, {"__m": F.avg(value), "__s": F.stddev_samp(value)}, splits)
    z = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).when(F.col(value).isNotNull(), F.lit(0.0))
    return df.withColumn(out, z).drop("__m", "__s")


def demean(df: DataFrame, by, value: str, out: str, splits: int = 1) -> DataFrame:
    df = with_stats(df, by, {"__m": F.avg(value)}, splits)
    return df.withColumn(out, F.col(value) - F.col("__m")).drop("__m")


def quantiles(df: DataFrame, by, value: str, probs: list[float], tie: str = "code", splits: int = 1, out: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles per group as an array column."""
    by = _by(by)
    df = df.where(F.col(value).isNotNull())
    if splits == 1:
        return df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias(out))
    rn = with_stats(with_row_number(df, by, value, tie, "__rn", splits=splits), by, {"__n": F.count(F.lit(1))}, splits)
    parts = []
    for p in probs:
        at = (F.col("__n") - 1) * F.lit(float(p))
        lo = F.max(F.when(F.col("__rn") - 1 == F.floor(at), F.col(value)))
        hi = F.max(F.when(F.col("__rn") - 1 == F.ceil(at), F.col(value)))
        parts.append(lo + (hi - lo) * F.max(at - F.floor(at)))
    return rn.groupBy(*by).agg(F.array(*parts).alias(out))


def winsorise_by_quantile(df: DataFrame, by, value: str, lo: float = 0.01, hi: float = 0.99, floor: float | None = None,
                          tie: str = "code", splits: int = 1) -> DataFrame:
    """Floor, then clip to the cross-section's own quantiles."""
    if floor is not None:
        df = df.withColumn(value, F.when(F.col(value).isNotNull(), F.greatest(F.col(value), F.lit(floor))))
    q = quantiles(df, by, value, [lo, hi], tie, splits, "__q")
    return _attach(df, q, _by(by), how="left").withColumn(value, clip(value, F.col("__q")[0], F.col("__q")[1])).drop("__q")


def top_n(df: DataFrame, by, value: str, n: int, tie: str, out: str = "eligible", splits: int = 1) -> DataFrame:
    """Mask of the n largest values; NULL is never eligible."""
    df = with_row_number(df, by, value, tie, "__rn", True, splits)
    return df.withColumn(out, F.col(value).isNotNull() & (F.col("__rn") <= n)).drop("__rn")


def tail_flags(df: DataFrame, by, signal: str, tie: str, frac: float, min_names: int = 1, splits: int = 1) -> DataFrame:
    """Long/short leg membership: k = max(1, floor(frac*n)) names at each end; adds leg (+1/-1/0), k and n."""
    df = df.where(F.col(signal).isNotNull())
    df = with_row_number(df, by, signal, tie, "__up", True, splits)
    df = with_row_number(df, by, signal, tie, "__dn", False, splits)
    df = with_stats(df, by, {"n": F.count(F.lit(1))}, splits).where(F.col("n") >= min_names)
    df = df.withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(frac))))
    leg = F.when(F.col("__up") <= F.col("k"), 1).when(F.col("__dn") <= F.col("k"), -1).otherwise(0)
    return df.withColumn("leg", leg).drop("__up", "__dn")


def composite(specs: list[tuple[str, bool]]) -> Column:
    """Mean of the factor columns ignoring NULLs; NULL when a required factor is NULL."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c, _ in specs), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c, _ in specs), F.lit(0))
    ok = F.lit(True)
    for c, required in specs:
        if required:
            ok = ok & F.col(c).isNotNull()
    return F.when(ok, total / n)


def cost_tier(df: DataFrame, by, liquidity: str, bps: tuple[float, float, float] = (15.0, 40.0, 80.0), tie: str = "code",
              splits: int = 1, out: str = "spread_bps") -> DataFrame:
    """Liquidity terciles of the cross-section -> spread in basis points (boundary belongs to the better tier)."""
    q = quantiles(df, by, liquidity, [1 / 3, 2 / 3], tie, splits, "__q")
    x = F.col(liquidity)
    tier = F.when(x >= F.col("__q")[1], bps[0]).when(x >= F.col("__q")[0], bps[1]).otherwise(bps[2])
    return _attach(df, q, _by(by)).withColumn(out, tier.cast("double")).drop("__q")


def qcut(df: DataFrame, by, value: str, buckets: int, tie: str = "code", splits: int = 1, out: str = "bucket") -> DataFrame:
    """Equal-frequency bucket by exact quantile edges, duplicate edges merged; right-closed intervals."""
    probs = [i / buckets for i in range(buckets + 1)]
    q = quantiles(df, by, value, probs, tie, splits, "__q")
    edges = F.array_distinct("__q")
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    v = F.col(value)
    return _attach(df, q, _by(by)).withColumn(out, F.when(v.isNotNull(), F.size(F.filter(inner, lambda e: e < v)))).drop("__q")


def equal_split(df: DataFrame, by, value: str, parts: int, tie: str, out: str = "part", splits: int = 1) -> DataFrame:
    """Argsort split into ``parts`` (larger parts first), numbered from 1."""
    by = _by(by)
    if splits == 1:
        w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), tie)
        return df.withColumn(out, F.ntile(parts).over(w))
    df = with_stats(with_row_number(df, by, value, tie, "__rn", splits=splits), by, {"__n": F.count(F.lit(1))}, splits)
    size, extra = F.floor(F.col("__n") / parts), F.col("__n") % parts
    i = F.col("__rn") - 1
    big = extra * (size + 1)
    part = F.when(i < big, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - big) / size)) + 1
    return df.withColumn(out, part.cast("int")).drop("__rn", "__n")


def spearman(df: DataFrame, by, x: str, y: str, tie: str, splits: int = 1, ordinal: bool = False) -> DataFrame:
    """Rank correlation per cross-section over pairs where both values exist."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if ordinal:
        both = with_row_number(both, by, x, tie, "__rx", splits=splits)
        both = with_row_number(both, by, y, tie, "__ry", splits=splits)
    else:
        both = with_average_rank(both, by, x, tie, "__rx", splits)
        both = with_average_rank(both, by, y, tie, "__ry", splits)
    a, b = F.col("__rx").cast("double"), F.col("__ry").cast("double")
    # moment form: NULL instead of a division error for a constant side
    n = F.count(F.lit(1))
    cov = F.covar_pop(a, b)
    sd = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return both.groupBy(*_by(by)).agg(n.alias("n"), F.try_divide(cov, F.when(sd > 0, sd)).alias("ic"))


def top_share_lift(df: DataFrame, score: str, label: str, share: float, tie: str, splits: int = 1) -> DataFrame:
    """Positive rate among the top share of scores minus the base rate (one row)."""
    df = df.withColumn("__g", F.lit(0))
    df = with_row_number(df, "__g", score, tie, "__rn", True, splits)
    df = with_stats(df, "__g", {"__n": F.count(F.lit(1))}, splits)
    top = F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(share)))
    y = F.col(label).cast("double")
    return df.agg(F.avg(F.when(top, y)).alias("top_rate"), F.avg(y).alias("base_rate"), F.count_if(top).alias("n_top")).withColumn(
        "lift", F.col("top_rate") - F.col("base_rate")
    )
