"""Joins with dimensions: search results, robots rules, extraction rules, weights and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.session import checkpoint


def search_results(hits: DataFrame, pages: DataFrame, count: int = 10) -> DataFrame:
    """The first hits with the page of each. hits: rank, title, url, snippet; pages: url, title and more.

    A page without a title, or whose title is an error, takes the hit's; the snippet is always the hit's.
    """
    few = hits.where((F.col("url") != "") & (F.col("title") != "") & (F.col("rank") <= min(max(count, 1), 15)))
    few = few.select("rank", "url", F.col("title").alias("hit_title"), "snippet")
    bad = F.coalesce("title", F.lit("")) == ""
    bad = bad | F.col("title").startswith("Error:") | F.col("title").startswith("Fetch error:")
    joined = few.join(pages, "url", "left").withColumn("title", F.when(bad, F.col("hit_title")).otherwise(F.col("title")))
    return joined.drop("hit_title")


def _pattern(path: Column) -> Column:
    """The regular expression of a robots path with * or a last $; null for a plain path."""
    plain = F.regexp_replace(path, r"([\\.\[\]{}()+?^|])", r"\\$1")
    open_ = F.regexp_replace(F.regexp_replace(plain, r"\$(?!$)", r"\\\$"), r"\*+", ".*")
    return F.when(path.contains("*") | path.endswith("$"), F.concat(F.lit("(?s)^"), open_))


def _literal(path: Column) -> Column:
    """What a robots path has before its first * or its last $."""
    return F.regexp_replace(path, r"(?s)\*.*$|\$$", "")


def allowed(df: DataFrame, robots: DataFrame, agent: str = "*", compat_full_url: bool = False, at: str | None = None) -> DataFrame:
    """df (url) with allowed: the longest robots rule that fits the url's path decides; allow on a tie and where there is none.

    robots: domain, agent, path, allow. A rule fits if it begins the path; in it * stands for any characters, and $ at its end for the path's end. A group's agent
    fits if it begins the given one, in any case; the longest such group's rules count, else those of *. compat_full_url matches rules with the whole url.
    at: a time column of df; then robots has valid_from and valid_to (null: without end), and rules count from the one until before the other.

    Rules are looked up by the beginnings of the path that are as long as rules of the domain are before their first sign, so a domain may have any number of rules:
    what is gathered of a domain are the lengths that occur. Each distinct url (and time) is decided once, and equal rules are met once, however often they are given.
    """
    target = F.col("url") if compat_full_url else F.concat(F.regexp_extract("url", r"(?s)^(?:[^:/?#]+:)?(?://[^/?#]*)?([^#]*)", 1))
    time = F.lit(None).cast("timestamp") if at is None else F.col(at).cast("timestamp")
    name = F.lower("agent")
    named = robots.where(((name == "*") | F.lit(agent.lower()).startswith(name)) & (F.col("path") != "")).withColumn("own", F.when(name == "*", 0).otherwise(F.length("agent")))
    valid = [F.col(c).cast("timestamp") if at else F.lit(None).cast("timestamp") for c in ("valid_from", "valid_to")]
    rules = named.select("domain", "own", "allow", "path", _literal(F.col("path")).alias("begin"), _pattern(F.col("path")).alias("pattern"), valid[0].alias("since"), valid[1].alias("until")).distinct()
    groups = robots.where((name == "*") | F.lit(agent.lower()).startswith(name)).groupBy(F.col("domain").alias("__domain")).agg(F.max(F.when(name == "*", 0).otherwise(F.length("agent"))).alias("__own"))
    lengths = rules.groupBy(F.col("domain").alias("__domain")).agg(F.collect_set(F.length("begin")).alias("__lengths"))
    asked = df.select("url", urls.crawler_domain(F.col("url")).alias("__domain"), target.alias("__target"), time.alias("__at")).distinct()
    begins = asked.join(groups, "__domain").join(lengths, "__domain").select("*", F.explode(F.filter("__lengths", lambda n: n <= F.length("__target"))).alias("__n"))
    begins = begins.withColumn("__begin", F.expr("substring(__target, 1, __n)")).drop("__lengths")
    found = begins.join(rules, (begins["__domain"] == rules["domain"]) & (begins["__begin"] == rules["begin"]) & (begins["__own"] == rules["own"]))
    fits = F.col("pattern").isNull() | F.regexp_like("__target", F.coalesce("pattern", F.lit("")))
    holds = (F.col("since").isNull() | (F.col("since") <= F.col("__at"))) & (F.col("until").isNull() | (F.col("__at") < F.col("until")))
    best = found.where(fits & holds).groupBy("url", "__at").agg(F.max(F.struct(F.length("path"), "allow"))["allow"].alias("__allow"))
    rows = df.withColumn("__when", time)
    joined = rows.join(best.withColumnRenamed("url", "__url"), (rows["url"] == F.col("__url")) & rows["__when"].eqNullSafe(F.col("__at")), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("__allow", F.lit(True)).alias("allowed"))


def as_of(requests: DataFrame, states: DataFrame, key: str, ts: str, order: str, before: bool = False, blocks: int | None = None) -> DataFrame:
    """requests with the columns of the last state of their key at or before ts (before: only before it); null where there is none. Both have key and ts; order breaks ties of requests.

    Both sides are dealt out together by ranges of (key, ts) into blocks, so a key may fill any number of them. A request looks for a state in its own block first; else it takes
    the last one of the key's earlier blocks, which are compared by one row a block. There is no join on a range. Requests without key or ts find none. Of states that share key
    and ts, the greatest by the rest of their columns counts as the last.
    """
    spark = requests.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in states.columns if c not in (key, ts)]
    state = F.struct(*rest)
    left = requests.select(F.col(key).alias("__key"), F.col(ts).alias("__ts"), F.lit(0 if before else 2).alias("__side"), F.struct(*requests.columns).alias("__row"), F.lit(None).cast(states.select(state.alias("s")).schema["s"].dataType).alias("__state"))
    right = states.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("__key"), F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), state.alias("__state"))
    tie = F.when(F.col("__side") == 1, F.xxhash64("__state")).otherwise(F.xxhash64(f"__row.{order}"))  # spreads what shares key and ts
    both = left.where("__key is not null and __ts is not null").unionByName(right).withColumn("__tie", tie)
    dealt = checkpoint(both.repartitionByRange(blocks, "__key", "__ts", "__side", "__tie").withColumn("__block", F.spark_partition_id()))
    by = Window.partitionBy("__key", "__block").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("__side") == 1, F.struct("__ts", "__state"))
    within = dealt.withColumn("__last", F.max(own).over(by)).where("__side <> 1")
    ends = dealt.groupBy("__key", "__block").agg(F.max(own).alias("__end"))
    earlier = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.max("__end").over(earlier)).select("__key", "__block", "__carried").where("__carried is not null")
    # states that share key and ts may lie in two blocks: the greater one counts
    found = within.join(carried, ["__key", "__block"], "left").withColumn("__last", F.greatest("__last", "__carried")["__state"])
    lost = requests.where(F.col(key).isNull() | F.col(ts).isNull())
    matched = found.select(*[F.col(f"__row.{c}").alias(c) for c in requests.columns], *[F.col(f"__last.{c}").alias(c) for c in rest])
    return matched.unionByName(lost, allowMissingColumns=True)


def cumulative(pool: DataFrame, order: str = "pos", blocks: int | None = None) -> DataFrame:
    """pool (order, weight and more), a table of any size, with lo and hi: the sums of the weights before each row and with it, in order.

    Rows are dealt out by ranges into blocks; sums run over the blocks, a row each, and within them.
    """
    blocks = blocks or int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(pool.repartitionByRange(blocks, order).withColumn("__block", F.spark_partition_id()))
    sums = dealt.groupBy("__block").agg(F.sum("weight").alias("__sum"))
    every = sums.select("__block", F.coalesce(F.sum("__sum").over(Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    upto = F.sum("weight").over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(every), "__block").withColumn("hi", F.col("__before") + upto).withColumn("lo", F.col("hi") - F.col("weight")).drop("__block", "__before")  # blocks rows


def weight_sum(pool: DataFrame) -> Column:
    return pool.agg(F.coalesce(F.sum("weight"), F.lit(0))).scalar()


def range_pick(df: DataFrame, pool: DataFrame, at: str, order: str = "pos", blocks: int | None = None) -> DataFrame:
    """df with the columns of the pool's first row whose cumulative weight reaches df's number ``at``: the first row for numbers up to 0, the last for those above the sum.

    The pool is a table of any size. Both sides are merged along the number line, block by block, so no row is compared with a range that isn't its neighbour. Rows of
    weight 0 or less, or none, are never picked.
    """
    rest = [c for c in pool.columns if c not in (order, "weight")]
    placed = cumulative(pool.where("weight > 0"), order, blocks).select(F.lit(0).alias("__all"), F.col("lo").cast("double").alias("__at"), F.struct(*rest).alias("__picked"))
    numbers = df.withColumns({"__all": F.lit(0), "__at": F.greatest(F.col(at).cast("double"), F.lit(5e-324))})  # what isn't above 0 meets the first row
    return as_of(numbers, placed, "__all", "__at", at, before=True, blocks=blocks).select(*df.columns, *[F.col(f"__picked.{c}").alias(c) for c in rest])


def weighted_pick(df: DataFrame, pool: list[tuple[str, float]], uniform: str = "u") -> DataFrame:
    """df with label: the first of pool whose cumulative weight reaches the row's uniform number, else the last.

    The pool is a fixed list, so this is one expression and needs no range join.
    """
    pick, total = F.lit(pool[-1][0]), 0.0
    sums = []
    for _, w in pool:
        total += w
        sums.append(total)
    for (label, _), s in reversed(list(zip(pool, sums, strict=True))):
        pick = F.when(F.col(uniform) <= s, label).otherwise(pick)
    return df.withColumn("label", pick)


def sticky_pick(df: DataFrame, pool: list[str], key: str) -> DataFrame:
    """df with label: always the same of pool for a key."""
    return df.withColumn("label", F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.xxhash64(key), F.lit(len(pool))) + 1).cast("int")))
