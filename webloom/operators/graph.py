"""Crawl expansion over a link graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.session import checkpoint


def bounded_bfs(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, depth: nodes within depth levels of the roots (which have depth 1), at the least depth. edges: src, dst; roots: node.

    A join and an anti join per level, so what is visited is shuffled on the node and never gathered. Edges and levels are stored, so that no level repeats another's work.
    """
    edges = checkpoint(edges.select("src", "dst"))
    levels = [checkpoint(roots.select("node").distinct().withColumn("depth", F.lit(1)))]
    for d in range(2, depth + 1):
        near = levels[-1].select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        visited = reduce(DataFrame.unionByName, levels)
        levels.append(checkpoint(near.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))))
    return reduce(DataFrame.unionByName, levels)


def same_domain(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) within one domain."""
    return edges.where(urls.web_domain(F.col("src")) == urls.web_domain(F.col("dst")))


def crawl(pages: DataFrame, links: DataFrame, root: str, depth: int, most: int = 50) -> DataFrame:
    """Pages that a visit of root finds within depth (1 to 3) levels on its domain, at most ``most`` by depth and url.

    pages: url, status_code; links: src, pos, href. Pages with a status outside 200-399 are not expanded.
    """
    root, depth = root if root.startswith(("http://", "https://")) else f"https://{root}", min(max(depth, 1), 3)
    ok = pages.where("status_code >= 200 and status_code < 400").select(F.col("url").alias("src"))
    dst = urls.resolve_link(F.col("src"), F.col("href"))
    edges = same_domain(links.join(ok, "src", "left_semi").select("src", dst.alias("dst")).where("dst <> ''")).distinct()
    start = pages.sparkSession.createDataFrame([(root,)], "node string")
    reached = bounded_bfs(edges, start, depth)
    return reached.select(F.col("node").alias("url"), "depth").join(pages, "url", "left").orderBy("depth", "url").limit(most)


def next_frontier(frontier: DataFrame, seen: DataFrame, links: DataFrame, n: int, importance: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One crawl step: the batch of unseen urls, the seen-set after it, and the frontier with the batch's links. links: src, href."""
    from webloom.operators import frontier as f

    batch = f.top(frontier, n)
    fresh = f.unseen(batch, seen)
    found = links.join(fresh.select(F.col("url").alias("src")), "src", "left_semi")
    new = found.select(urls.canonical(urls.resolve_link(F.col("src"), F.col("href"))).alias("url"), F.length(urls.resolve_link(F.col("src"), F.col("href"))).alias("n")).where("n > 0")
    pushed = new.select("url").distinct().withColumn("score", F.lit(importance))
    kept = f.remaining(frontier.select("url", "score"), batch).join(pushed.select("url"), "url", "left_anti")
    return fresh, f.add_seen(seen, fresh), kept.unionByName(pushed)
