"""URL filter: rules first, else gradient-boosted trees on lexical features. DataFrame and SQL functions only.

Features of a url: length, host length, path depth, digit ratio, entropy of its characters, numbers of query parameters, of host
labels and of hyphens in the host, and for the host's last one, two and three labels how many labelled urls end so and what share of them is bad.

Labels: the caller gives urls with a label (1 bad, 0 good). The suffix statistics count all labelled urls. The trees are trained on at most ``TRAIN_ROWS``
distinct ones, by a hash of the url (a documented bound). A training row's own host never counts in its suffix statistics: they leave out the ``FOLDS``-th
part of all hosts that its host is in, so that the trees learn what suffixes tell of other hosts, and else from the url. Each split chooses from a third of the features, so that no one feature stands for all. ``seed_labels`` makes labels where a
corpus has none: bad are hosts with a word of ``BAD_WORDS``, good all others. The trees become one column expression, so scoring is a scan and joins with the statistics.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path; the longest wins, ties go to the rule that sorts
first. Null urls and those without :// have an empty host and path and features like any text; very long ones are read whole. A null page_id stays null. Repeated
rows stay repeated; of several labels of a url the largest counts. With labels of one class only, or none, the trees allow everything. ``judged`` ignores other columns;
``Filter.bad`` returns them as they are, whatever their names, but for host, path and p_bad, which it replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint, packed, unpacked

TRAIN_ROWS, FOLDS = 20_000, 5
TREES, TREE_DEPTH = 20, 3
BROADCAST_BYTES = 16 << 20
#: The rules of the registered query, as (verdict, rule).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that mark a bad host where no labels are given.
BAD_WORDS = ("casino", "poker", "bet", "bets", "pills", "viagra", "loan", "loans", "porn", "xxx", "ads", "track", "tracker", "spam", "adult")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://, the host up to /, ? or # with A-Z in lower case, and the path from there up to ? or #."""
    part = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _match(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> list[tuple[Column, str, str]]:
    """(condition, rule, verdict), the longest rule first."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        found.append(((F.concat(F.lit("."), host).endswith("." + name)) & path.startswith(slash + rest), rule, verdict))
    return found


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _entropy(text: Column) -> Column:
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    each = F.transform(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), lambda c: -share(c) * F.log2(share(c)))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


PLAIN = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens")
LEARNT = tuple(f"{what}_{k}" for k in (1, 2, 3) for what in ("seen", "bad"))


def featured(df: DataFrame) -> DataFrame:
    """df (with url) with host, path and the features that need no labels."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(url)
    df = df.withColumn("host", host).withColumn("path", path)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    exprs = {
        "length": F.length(url), "host_length": F.length("host"), "depth": _count(F.col("path"), "/"),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)), "entropy": _entropy(url),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1), "host_labels": _count(F.col("host"), ".") + 1, "hyphens": _count(F.col("host"), "-"),
    }
    return df.withColumns({k: v.cast("double") for k, v in exprs.items()})


def _suffixes(host: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), _suffix(host, k).alias("suffix")) for k in (1, 2, 3)])


def _fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def _statistics(seen: Column, bad: Column) -> tuple[Column, Column]:
    """What a suffix tells: how many labelled urls end so, and the smoothed share of bad ones, -1 if there are none."""
    return F.log1p(F.coalesce(seen, F.lit(0))).cast("double"), F.when(F.coalesce(seen, F.lit(0)) > 0, (bad + 1) / (seen + 20)).otherwise(-1.0)


def _with_suffixes(df: DataFrame, stats: DataFrame, small: bool) -> DataFrame:
    """df (with host) with the suffix statistics. stats: k, suffix, seen, bad."""
    for k in (1, 2, 3):
        own = stats.where(F.col("k") == k).select(F.col("suffix").alias("__suffix"), F.col("seen").alias("__seen"), F.col("bad").alias("__bad"))
        joined = df.join(F.broadcast(own) if small else own, _suffix(F.col("host"), k) == F.col("__suffix"), "left")
        seen, bad = _statistics(F.col("__seen"), F.col("__bad"))
        df = joined.withColumns({f"seen_{k}": seen, f"bad_{k}": bad}).drop("__suffix", "__seen", "__bad")
    return df


def seed_labels(pages: DataFrame) -> DataFrame:
    """url, label: labels by the words of the host."""
    host, _ = host_and_path(F.col("url"))
    words = F.split(host, "[^a-z0-9]+")
    return pages.where("url is not null").select("url", F.arrays_overlap(words, F.array(*map(F.lit, BAD_WORDS))).cast("int").alias("label"))


class Filter:
    """Trees and suffix statistics learnt from labelled urls (url, label)."""

    def __init__(self, labelled: DataFrame, rows: int = TRAIN_ROWS) -> None:
        urls = labelled.where("url is not null and label is not null").groupBy("url").agg((F.max("label") > 0).cast("int").alias("label"))
        counted = urls.select("label", host_and_path(F.col("url"))[0].alias("host")).select("label", _fold(F.col("host")).alias("fold"), F.explode(_suffixes(F.col("host"))).alias("s"))
        folds = checkpoint(counted.groupBy("s.k", "s.suffix", "fold").agg(F.count("*").alias("seen"), F.sum("label").alias("bad")))
        self.stats = checkpoint(folds.groupBy("k", "suffix").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")))
        size = self.stats.agg(F.coalesce(F.sum(F.octet_length("suffix") + 48), F.lit(0)).alias("bytes")).first()["bytes"]
        self.small, self.names, self.model = size <= BROADCAST_BYTES, [*PLAIN, *LEARNT], None
        sample = featured(urls.orderBy(F.xxhash64("url"), "url").limit(rows)).cache()
        if sample.agg(F.countDistinct("label").alias("n")).first()["n"] == 2:
            train = VectorAssembler(inputCols=self.names, outputCol="features").transform(self.held_out(sample, folds)).select("features", F.col("label").cast("double").alias("label"))
            self.model = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, featureSubsetStrategy="onethird", seed=7).fit(train)

    def held_out(self, sample: DataFrame, folds: DataFrame) -> DataFrame:
        """The training rows with suffix statistics of the other folds' hosts."""
        own = folds.withColumnsRenamed({"seen": "own_seen", "bad": "own_bad"})
        others = self.stats.join(own, ["k", "suffix"]).select("k", "suffix", "fold", (F.col("seen") - F.col("own_seen")).alias("seen"), (F.col("bad") - F.col("own_bad")).alias("bad"))
        for k in (1, 2, 3):
            part = others.where(F.col("k") == k).select(F.col("suffix").alias("__suffix"), F.col("fold").alias("__fold"), F.col("seen").alias("__seen"), F.col("bad").alias("__bad"))
            joined = sample.join(part, (_suffix(F.col("host"), k) == F.col("__suffix")) & (_fold(F.col("host")) == F.col("__fold")), "left")
            seen, bad = _statistics(F.col("__seen"), F.col("__bad"))
            sample = joined.withColumns({f"seen_{k}": seen, f"bad_{k}": bad}).drop("__suffix", "__fold", "__seen", "__bad")
        return sample

    def _tree(self, node: object) -> Column:
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.col(self.names[split.featureIndex()]) <= float(split.threshold()), self._tree(node.leftChild())).otherwise(self._tree(node.rightChild()))

    def bad(self, df: DataFrame) -> DataFrame:
        """df (with url) with host, path and p_bad."""
        apart = featured(df.select(packed(df).alias("rest"), "url"))
        columns = [c for c, name in zip(unpacked(df.columns), df.columns, strict=True) if name not in ("host", "path", "p_bad")]
        if self.model is None:
            return apart.select(*columns, "host", "path", F.lit(0.0).alias("p_bad"))
        margin = reduce(lambda a, b: a + b, [F.lit(float(w)) * self._tree(t._call_java("rootNode")) for t, w in zip(self.model.trees, self.model.treeWeights, strict=True)])
        return _with_suffixes(apart, self.stats, self.small).select(*columns, "host", "path", (1 / (1 + F.exp(-2 * margin))).alias("p_bad"))


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, at: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_bad: a row per row of pages."""
    scored = Filter(labelled).bad(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"))
    found = _match(rules, F.col("host"), F.col("path"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("p_bad") >= at, "block").otherwise("allow")
    for fits, name, says in reversed(found):
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "p_bad")
