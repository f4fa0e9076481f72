"""The crawl frontier: pushes, global and domain-fair batches, sizes and the seen-set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls


def latest(pushes: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The last push of each url; a later push overwrites the score."""
    rest = [c for c in pushes.columns if c != key]
    return pushes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def scored(urls_df: DataFrame, weights: DataFrame | None, now: Column) -> DataFrame:
    """url, domain, score for rows (url, importance, last_seen); weights: (domain, weight), 1 where there is none."""
    rows = urls_df.withColumn("domain", urls.frontier_domain(F.col("url")))
    if weights is not None:
        rows = rows.join(weights.select("domain", "weight"), "domain", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    weight = F.coalesce("weight", F.lit(1.0))
    return rows.select("url", "domain", urls.priority(F.col("importance"), F.col("last_seen"), now, weight).alias("score"))


def top(frontier: DataFrame, n: int) -> DataFrame:
    """The n best by score, ties to the url that sorts last; planned as a top-k per partition and a merge."""
    return frontier.orderBy(F.desc("score"), F.desc("url")).limit(n)


def remaining(frontier: DataFrame, batch: DataFrame) -> DataFrame:
    return frontier.join(batch.select("url").distinct(), "url", "left_anti")


def fair(frontier: DataFrame, n: int) -> DataFrame:
    """Domain-fair batch: each domain gives its best max(1, floor(size / total x n)) urls. frontier: url, domain, score.

    Sizes are aggregated first (a row per domain), so that no total needs all rows in one place. A hot domain's rows are cut to n
    before the join: no domain can give more.
    """
    sizes = frontier.groupBy("domain").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    budget = F.greatest(F.lit(1), F.floor(F.col("size").cast("double") / total.cast("double") * F.lit(float(n))))
    budgets = sizes.select("domain", budget.alias("budget"))
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), F.desc("url")))
    best = frontier.withColumn("rank", rank).where(F.col("rank") <= n)
    return best.join(budgets, "domain").where(F.col("rank") <= F.col("budget")).select("domain", "url", "score", "rank")


def sizes(frontier: DataFrame) -> DataFrame:
    """domain, size: largest first."""
    return frontier.groupBy("domain").agg(F.count("*").alias("size")).where("size > 0").orderBy(F.desc("size"), "domain")


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Candidates that the seen-set lacks. It is exact, where a probabilistic filter may drop new urls too."""
    return candidates.join(seen.select(key).distinct(), key, "left_anti")


def add_seen(seen: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    return seen.select(key).union(new.select(key)).distinct()


def delete_seen(seen: DataFrame, gone: DataFrame, key: str = "url") -> DataFrame:
    return seen.join(gone.select(key), key, "left_anti")
