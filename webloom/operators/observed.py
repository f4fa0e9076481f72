"""Metrics that are taken while jobs run: observed aggregates of batch and stream plans, and a listener that appends them to a table."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "name string, run string, batch long, at timestamp, metric string, value double"


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that has the metrics (aggregates) once an action on it has run; no job of their own."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


class MetricsTable(StreamingQueryListener):
    """Appends what streams observe to a table: a row for each metric of each micro-batch, in a folder named by run and micro-batch, so a progress report that comes again overwrites itself."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        at = datetime.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        rows = [(name, str(p.runId), p.batchId, at, metric, float(value)) for name, row in p.observedMetrics.items() for metric, value in row.asDict().items() if value is not None]
        if rows:
            self.spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/part={p.runId}-{p.batchId}")

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass

    def table(self) -> DataFrame:
        """The rows so far, once reports that are on their way have come in."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        return self.spark.read.schema(METRICS).parquet(self.path)


def rates(events: DataFrame, ts: str, width: str) -> DataFrame:
    """window_start, n, per_second: how many rows come in each window of time."""
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("per_second"))
