"""Crawl metrics over fetch logs and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import folds, machines
from webloom.operators.replay import replay as ordered

#: Upper bounds of 15 buckets that double.
LATENCY = [0.01 * 2**k for k in range(15)]
PAUSE = [0.0001 * 2**k for k in range(15)]


def histogram(df: DataFrame, value: str, keys: list[str], bounds: list[float]) -> DataFrame:
    """keys, le, count, total, sum: cumulative buckets. One aggregation of conditional sums; the buckets are unfolded from its few rows."""
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    rows = df.groupBy(*keys).agg(*sums, F.count(value).alias("total"), F.sum(value).alias("sum"))
    buckets = F.array(*[F.struct(F.lit(b).alias("le"), F.coalesce(f"b{i}", F.lit(0)).alias("count")) for i, b in enumerate(bounds)])
    return rows.select(*keys, "total", "sum", F.explode(buckets).alias("b")).select(*keys, "b.le", "b.count", "total", "sum")


def sliding_ratio(df: DataFrame, flag: Column, width: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """window_start, n, ratio: the share of rows with the flag in sliding windows of ts."""
    return df.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("ratio")).select(F.col("w.start").alias("window_start"), "n", "ratio")


def last_value(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """A gauge: the last value of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def failure_streaks(df: DataFrame, key: str, order: list[str], ok: str) -> DataFrame:
    """df with streak: failures in a row up to each event, 0 after a success."""
    by = Window.partitionBy(key).orderBy(*order)
    island = df.withColumn("__island", F.sum(F.col(ok).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum((~F.col(ok)).cast("long")).over(within)).drop("__island")


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with changed: whether value differs from the key's row before; null for the first."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("changed", F.col(value) != before)


def replay(df: DataFrame, key: str, order: list[str], fields: list[str], fold: Column) -> DataFrame:
    """key and result: a fold (an expression on the column events) of each key's events in order, gathered in one row; for keys of any size see operators.replay."""
    return df.groupBy(key).agg(folds.history(order, fields).alias("events")).select(key, fold.alias("result"))


def cache_outcomes(df: DataFrame, key: str, order: list[str], ttl_s: float) -> DataFrame:
    """outcome, n over all keys: lookups (t, in seconds) by outcome, counted in each key's state."""
    found = ordered(df, key, order, machines.cache_outcomes(ttl_s))
    names = ("hit", "stale_revalidate", "miss")
    sums = found.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(x).alias("outcome"), F.col(x).alias("n")) for x in names])).alias("x")).select("x.*").where("n > 0")


def totals(results: DataFrame) -> DataFrame:
    """Sums over page results: pages, links, images, words."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return results.agg(F.count("*").alias("pages"), whole(F.size("links")).alias("links"), whole(F.size("images")).alias("images"), whole("word_count").alias("words"))
