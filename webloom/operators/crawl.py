"""A crawl over stored pages that goes on until nothing is left, step by step in a folder.

A step pops a batch from the frontier, decides what becomes of each url, takes the links of those that were crawled and pushes what is new. Its results and the frontier after it are written
before the next begins, so a crawl that was stopped, or lost its executors, goes on after its last finished step. The driver only learns whether a frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import frontier as frontiers
from webloom.operators import joins
from webloom.session import checkpoint, new_folder

RESULTS = "url string, step int, outcome string, reason string"
FRONTIER = "url string, score double"
IMPORTANCE, LINK_IMPORTANCE = 1.0, 0.5


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def finished_steps(spark: SparkSession, folder: str) -> int:
    """How many steps of a crawl are written in full; the frontier of a step is written last."""
    n = 0
    while _exists(spark, f"{folder}/step={n + 1}/frontier"):
        n += 1
    return n


def decided(batch: DataFrame, pages: DataFrame, robots: DataFrame | None, agent: str) -> DataFrame:
    """url, outcome (crawled or dropped), reason for each url of a batch (pages: url, once each, and error): robots forbid it, there is no snapshot of it, or the snapshot is an error (its text)."""
    known = pages.select(F.col("url").alias("__page"), F.lit(True).alias("__there"), F.col("error").alias("__error"))
    rows = batch.join(known, F.col("url") == F.col("__page"), "left")
    rows = joins.allowed(rows, robots, agent) if robots is not None else rows.withColumn("allowed", F.lit(True))
    reason = F.when(~F.col("allowed"), "robots").when(F.col("__there").isNull(), "missing").when(F.col("__error").isNotNull(), F.concat(F.lit("fetch: "), "__error"))
    return rows.select("url", F.when(reason.isNull(), "crawled").otherwise("dropped").alias("outcome"), reason.alias("reason"))


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, robots: DataFrame | None = None, agent: str = "*", batch: int | None = None, folder: str | None = None, most_steps: int | None = None) -> DataFrame:
    """url, step, outcome, reason of every url that seeds lead to. pages: url (canonical), maybe error; links: src, dst (canonical; as extracted once); seeds: url.

    batch: how many urls a step pops, best first (None: all that there are). A url is taken up once: one that was dropped isn't tried again when another page links to it. Links to
    what is known already are given up without a row. folder: where the steps are, new or with steps of the same crawl to go on from. most_steps: stop after so many more steps.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "crawl")
    if not _exists(spark, f"{folder}/step=0/frontier"):
        first = seeds.select(F.col("url"), F.lit(IMPORTANCE).alias("score")).where("url is not null").distinct()
        first.write.mode("overwrite").parquet(f"{folder}/step=0/frontier")
    step = done = finished_steps(spark, folder)
    # what every step reads is worked out once
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    pages = checkpoint(pages.select("url", error.alias("error")).dropDuplicates(["url"]))
    robots = None if robots is None else checkpoint(robots)
    while most_steps is None or step < done + most_steps:
        frontier = _read(spark, FRONTIER, [f"{folder}/step={step}/frontier"])
        if frontier.isEmpty():
            break
        step += 1
        here = f"{folder}/step={step}"
        popped = frontier if batch is None else frontiers.top(frontier, batch)
        results = decided(popped.select("url"), pages, robots, agent).withColumn("step", F.lit(step)).select("url", "step", "outcome", "reason")
        results.write.mode("overwrite").parquet(f"{here}/results")
        new = _read(spark, RESULTS, [f"{here}/results"])
        known = _read(spark, RESULTS, [f"{folder}/step={i}/results" for i in range(1, step + 1)]).select("url")
        crawled = new.where("outcome = 'crawled'").select(F.col("url").alias("src"))
        found = links.join(crawled, "src", "left_semi").select(F.col("dst").alias("url")).where("url is not null and url <> ''").distinct()
        left = frontier.join(new.select("url"), "url", "left_anti")
        # a url that is found again while it waits takes the score of a link, as the last push counts
        pushed = frontiers.unseen(found, known).withColumn("score", F.lit(LINK_IMPORTANCE))
        after = left.join(pushed.select("url"), "url", "left_anti").unionByName(pushed)
        after.write.mode("overwrite").parquet(f"{here}/frontier")
    return _read(spark, RESULTS, [f"{folder}/step={i}/results" for i in range(1, step + 1)])


def canonical_links(page_links: DataFrame) -> DataFrame:
    """src, dst: the links (url, href) of pages, resolved and in canonical form; those that resolve to nothing go."""
    dst = urls.resolve_link(F.col("url"), F.col("href"))
    return page_links.select(urls.canonical(F.col("url")).alias("src"), F.when(dst != "", urls.canonical(dst)).alias("dst")).where("dst is not null").distinct()
