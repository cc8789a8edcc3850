"""Session helpers: sensible defaults and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults we want on every session we create ourselves.  A session handed to
# us by a cluster keeps its own settings; we only fill gaps.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


#: HotSpot never compiles a method of more than 8000 bytes of code.  Spark's default lets whole-stage code
#: grow to 65535, so the projections of 70 features ran interpreted, row after row; beyond this limit
#: Spark takes the operators one by one, whose code is split into methods that are compiled.
SESSION_GAPS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def fill_gaps(spark: SparkSession) -> None:
    """Sets what a session handed to us leaves open."""
    for key, value in SESSION_GAPS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def get_spark(app_name: str = "permea", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    fill_gaps(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder comes from the session (a shared file system).
    Only when it is unset (local runs and tests) do we make a scratch folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="permea-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df, name: str):
    """Write ``df`` to a fresh folder under the shared checkpoint folder and
    read it back: cuts the lineage (a lost executor recomputes from the
    written files, not from the raw scan) and lets later jobs prune columns
    and push filters into the Parquet scan."""
    import uuid
    spark = df.sparkSession
    path = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
