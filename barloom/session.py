"""Session settings and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``master`` is left to spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder under /tmp, because there driver and executors are one process.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/barloom-{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder once and reading it back.

    Used before a plan reads the same expensive input several times; the files outlive executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
