"""Bootstrap, permutation and surrogate operators.

A replica is a key column. Draws come from a hash of (seed, replica, row key), so any task can recompute
them, a lost executor changes nothing, and another engine can reproduce them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

RANGE = 16**12


def hash_int(*parts) -> Column:
    """Uniform integer in [0, 16^12) from the md5 of the parts joined by '|'."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 12), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """Uniform double in (0, 1)."""
    return (hash_int(*parts) + 0.5) / float(RANGE)


def with_replicas(df: DataFrame, n: int, out: str = "rep") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def block_bootstrap(spark: SparkSession, df: DataFrame, block: str, value: str, replicas: int, seed: int, probs: list[float]) -> DataFrame:
    """Mean and its quantiles when whole blocks are resampled with replacement (one row).

    Rows are first reduced to (sum, n) per block; a replica then only touches the block table.
    """
    b = df.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    b = materialise(b)  # one row per block, read for the draws, the sums and the point estimate
    b = b.withColumns({"idx": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(block)) - 1})
    size = b.agg(F.count(F.lit(1)).alias("k"))
    reps = spark.range(replicas).withColumnRenamed("id", "rep").join(F.broadcast(size))
    draws = reps.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    draws = draws.withColumn("idx", (hash_int(seed, F.col("rep"), F.col("draw")) % F.col("k")).cast("int"))
    means = draws.join(b.select("idx", "s", "n"), "idx").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("m"))
    q = means.agg(F.percentile("m", F.array(*[F.lit(p) for p in probs])).alias("q"), F.avg((F.col("m") > 0).cast("double")).alias("share_positive"))
    return q.join(F.broadcast(b.agg((F.sum("s") / F.sum("n")).alias("mean"))))


def permute_within(df: DataFrame, keys: list[str], pos: str, value: str, seed: int, rep: str = "rep", out: str | None = None, row_id: Column | None = None,
                   splits: int = 1) -> DataFrame:
    """Shuffle the non-null values inside each (replica, key), leaving NULL positions in place.

    The i-th valid row takes the value whose hash ranks i-th. ``splits`` above one spreads each group's
    ranking over several tasks (numeric ``pos`` only), for groups that are whole cross-sections.
    """
    from . import xsec

    rid = row_id if row_id is not None else F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col(pos).cast("string"))
    part = [rep, *keys]
    name = out or value
    if splits == 1:
        # a row goes to the place it has and its value to the place it takes, so no join and no shuffle but that of the groups
        w = Window.partitionBy(*part, "__ok")
        d = df.withColumns({"__ok": F.col(value).isNotNull(), "__h": hash_int(seed, F.col(rep), rid)})
        d = d.withColumns({"__slot": F.row_number().over(w.orderBy(pos)), "__pick": F.row_number().over(w.orderBy("__h", pos))})
        row, new = F.struct(*df.columns), F.struct(F.col(value).alias("v"))
        own = F.struct(F.col("__slot").alias("k"), row.alias("row"), F.lit(None).cast(df.select(new).schema[0].dataType).alias("new"))
        sent = F.struct(F.col("__pick").alias("k"), F.lit(None).cast(df.schema).alias("row"), new.alias("new"))
        both = d.select(*part, "__ok", F.explode(F.array(own, sent)).alias("__e")).select(*part, "__ok", "__e.*")
        met = both.groupBy(*part, "__ok", "k").agg(F.first("row", True).alias("row"), F.first("new", True).alias("new"))
        # the keys are those of the groups, whose partitioning is known
        return met.select(*[F.col(c) if c in part else F.col(f"row.`{c}`").alias(c) for c in df.columns], F.col("new.v").alias("__new")).withColumn(name, F.col("__new")).drop("__new")
    ok = df.where(F.col(value).isNotNull())
    d = ok.select(*part, pos, value, hash_int(seed, F.col(rep), rid).alias("__h"))
    d = xsec.with_row_number(d, part, pos, pos, "__slot", splits=splits)
    d = xsec.with_row_number(d, part, "__h", pos, "__pick", splits=splits)
    d = materialise(d)
    took = d.select(*part, F.col("__pick").alias("__slot"), F.col(value).alias("__new"))
    new = d.join(took, [*part, "__slot"]).select(*part, pos, "__new")
    res = df.join(new, [*part, pos], "left")
    return res.withColumn(name, F.col("__new")).drop("__new")


def random_sign(*parts) -> Column:
    """+1 or -1 from one hash bit."""
    return F.when(hash_int(*parts) % 2 == 0, 1.0).otherwise(-1.0)


def hash_normal(*parts) -> Column:
    """Standard normal by the Box-Muller transform of two hashed uniforms."""
    return F.sqrt(F.log(hash_unit("u", *parts)) * -2.0) * F.cos(hash_unit("v", *parts) * (2 * math.pi))


def rebuild_path(df: DataFrame, keys: list[str], pos: str, ret: str, start: str | Column = 0.0, out: str = "logp") -> DataFrame:
    s = F.lit(start) if isinstance(start, float) else (F.col(start) if isinstance(start, str) else start)
    return df.withColumn(out, s + F.sum(ret).over(Window.partitionBy(*keys).orderBy(pos)))


def surrogates(df: DataFrame, keys: list[str], pos: str, ret: str, kind: str, seed: int, halflife: float = 20.0) -> DataFrame:
    """Surrogate returns per (replica, key): ``shuffle``, ``signflip``, ``normal`` or ``fhs``.

    ``fhs`` shuffles volatility-standardised residuals and re-applies the volatility path; ``signflip``
    keeps magnitudes in place and matches the variance. Needs a ``rep`` column and a gapless ``pos``.
    """
    from .recursion import ewma, halflife_lambda

    part = ["rep", *keys]
    s = Window.partitionBy(*part)
    rid = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col(pos).cast("string"))
    d = df.withColumn("__m", F.avg(ret).over(s)).withColumn("__d", F.col(ret) - F.col("__m"))
    if kind == "shuffle":
        return permute_within(d, keys, pos, ret, seed, out="sur").drop("__m", "__d")
    if kind == "normal":
        sd = F.stddev_pop(ret).over(s)
        return d.withColumn("sur", F.col("__m") + sd * hash_normal(seed, F.col("rep"), rid)).drop("__m", "__d")
    if kind == "signflip":
        d = d.withColumn("__f", F.abs("__d") * random_sign(seed, F.col("rep"), rid))
        scale = F.stddev_pop("__d").over(s) / (F.stddev_pop("__f").over(s) + 1e-12)
        return d.withColumn("sur", F.col("__m") + F.col("__f") * scale).drop("__m", "__d", "__f")
    if kind != "fhs":
        raise ValueError(kind)
    lam = halflife_lambda(halflife)
    warm = F.avg(F.when(F.col(pos) < 20, F.col("__d") * F.col("__d"))).over(s) + 1e-8
    d = d.withColumn("__warm", warm)
    first = F.col(pos) == 0
    x = F.when(first, F.col("__warm") * lam + F.col("__d") * F.col("__d") * (1 - lam)).otherwise(F.col("__d") * F.col("__d"))
    d = ewma(d.withColumn("__x", x), part, pos, [("__v", F.col("__x"), lam)])
    d = d.withColumn("__z", F.col("__d") / F.sqrt("__v"))
    d = permute_within(d, keys, pos, "__z", seed, out="__zs")
    return d.withColumn("sur", F.col("__m") + F.sqrt("__v") * F.col("__zs")).drop("__m", "__d", "__warm", "__x", "__v", "__z", "__zs")
