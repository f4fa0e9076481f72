"""The engine's calls: search, crawl and the tool dispatch over stored pages."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import machines, urls
from webloom.operators import crawl as crawling
from webloom.operators import graph, joins, metrics, replay
from webloom.session import checkpoint
from webloom.sources import documents


class RequestError(ValueError):
    """A request that can't be served, with a status like HTTP's."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


@dataclass
class Config:
    batch_size: int = 100
    max_failures: int = 5
    open_timeout_s: float = 30.0
    min_in_flight: int = 10
    max_in_flight: int = 500
    cache_ttl_s: float = 300.0


class Engine:
    """hits: query, rank, title, url, snippet (and source 1 or 2); pages: url, status_code, html."""

    TOOLS = ({"name": "search", "arguments": {"query": "string", "count": "1 to 15"}}, {"name": "scrape", "arguments": {"url": "string", "depth": "1 to 3"}})

    def __init__(self, pages: DataFrame, hits: DataFrame | None = None, config: Config | None = None) -> None:
        self.pages, self.hits, self.config = pages, hits, config or Config()

    def search(self, query: str, count: int = 10) -> DataFrame:
        """The first hits of a query with their pages. The second source serves only if the first failed, not if it found nothing.

        A source that failed has a row with its reason in hits' column error; without that column none has.
        """
        if not query.strip():
            raise RequestError(400, "query is empty")
        if self.hits is None:
            raise RequestError(500, "there is no source of hits")
        count = 10 if count < 1 else min(count, 15)
        found = self.hits.where(F.col("query") == query)
        if "error" in found.columns:
            failed = F.col("error").isNotNull()
            one, two = (F.coalesce(F.bool_or((F.col("source") == n) & failed), F.lit(False)) for n in (1, 2))
            first, second = found.agg(one, two).first()  # one row
            if first and second:
                raise RequestError(500, "both sources failed")
            found = found.where(~failed & (F.col("source") == (2 if first else 1))).drop("error")
        elif "source" in found.columns:
            found = found.where("source = 1")
        if found.isEmpty():
            raise RequestError(404, "no hits")
        wanted = self.pages.join(found.select("url").distinct(), "url", "left_semi")
        return joins.search_results(found, documents.page_results(wanted), count)

    def crawl(self, url: str, depth: int = 1) -> DataFrame:
        """Pages within depth levels of a url, on its domain: only that domain's pages are read, and their links once."""
        if not url.strip():
            raise RequestError(400, "url is empty")
        root = url if url.startswith(("http://", "https://")) else f"https://{url}"
        pages = self.pages.where(urls.web_domain(F.col("url")) == urls.web_domain(F.lit(root)))
        links = checkpoint(documents.page_links(pages).withColumnRenamed("url", "src"))
        found = checkpoint(graph.crawl(pages.select("url", "status_code"), links, root, depth))
        wanted = pages.join(found.where("status_code is not null").select("url"), "url", "left_semi").where("html is not null")
        return found.select("url", "depth", "status_code").join(documents.page_results(wanted), "url", "left")

    def crawl_all(self, seeds: list[str], robots: DataFrame | None = None, agent: str = "*", folder: str | None = None) -> DataFrame:
        """url, step, outcome, reason of all that the seeds lead to over the stored pages, config.batch_size urls a step."""
        pages = self.pages.select(urls.canonical(F.col("url")).alias("url"), *(["error"] if "error" in self.pages.columns else []))
        links = checkpoint(crawling.canonical_links(documents.page_links(self.pages)))
        start = self.pages.sparkSession.createDataFrame([(s,) for s in seeds], "url string").select(urls.canonical(F.col("url")).alias("url"))
        return crawling.crawl(pages, links, start, robots, agent, self.config.batch_size, folder)

    def breakers(self, log: DataFrame) -> DataFrame:
        """key, state, failures, allowed, rejected after a log of requests (key, event_id, t, ok), by the configured thresholds."""
        return replay.replay(log, "key", ["t", "event_id"], machines.breaker(self.config.max_failures, self.config.open_timeout_s)).drop("failed_at")

    def ceilings(self, log: DataFrame) -> DataFrame:
        """key, ceiling after a log of results (key, event_id, t, ok)."""
        return replay.replay(log, "key", ["t", "event_id"], machines.aimd(self.config.min_in_flight, self.config.max_in_flight))

    def lookups(self, log: DataFrame) -> DataFrame:
        """outcome, n of a log of cache lookups (key, event_id, t)."""
        return metrics.cache_outcomes(log, "key", ["t", "event_id"], self.config.cache_ttl_s)

    def totals(self, results: DataFrame) -> DataFrame:
        return metrics.totals(results)

    def tools(self) -> list[dict]:
        return list(self.TOOLS)

    def call(self, tool: str, arguments: str | dict) -> list[dict]:
        """A tool by name, as JSON rows; a search without hits is an empty list here."""
        args = json.loads(arguments) if isinstance(arguments, str) else arguments
        if tool == "search":
            try:
                return [json.loads(x) for x in self.search(args.get("query", ""), int(args.get("count", 10))).toJSON().collect()]
            except RequestError as e:
                if e.status == 404:
                    return []
                raise
        if tool == "scrape":
            return [json.loads(x) for x in self.crawl(args.get("url", ""), int(args.get("depth", 1))).toJSON().collect()]
        raise RequestError(400, f"unknown tool {tool}")

    @staticmethod
    def health() -> dict:
        return {"status": "ok"}
