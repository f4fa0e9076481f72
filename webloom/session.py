"""Session settings and table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **confs: str) -> SparkSession:
    """A session with the engine's settings; confs are added, with _ for . in names."""
    builder = SparkSession.builder.appName("webloom")
    if master:
        builder = builder.master(master)
    for key, value in (CONFS | {k.replace("_", "."): v for k, v in confs.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stored steps that all executors share: the one that spark.checkpoint.dir names; in local mode, where it is unset, one of our own."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="webloom-checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, worked out once; its partitions and their order stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark sends to Python at once, where the session allows more: ten thousand long pages would be held whole by each task. It changes no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
