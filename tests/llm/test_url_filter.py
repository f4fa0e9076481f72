"""The URL filter's trees: features that decide, evaluation by hand, any column names."""

import math

import pytest
from pyspark.sql import functions as F

from webloom.llm import url_filter
from webloom.llm.common import table


@pytest.fixture(scope="module")
def learnt(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    return pages, url_filter.Filter(url_filter.seed_labels(pages))


def test_several_features_decide(spark, learnt):
    pages, model = learnt
    weights = dict(zip(model.names, model.model.featureImportances.toArray().tolist(), strict=True))
    assert sum(w > 0.001 for w in weights.values()) >= 4 and max(weights.values()) < 0.95
    judged = url_filter.judged(pages, url_filter.seed_labels(pages))
    assert judged.select("p_bad").distinct().count() > 10
    free = judged.where("rule is null").withColumn("seed", F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*map(F.lit, url_filter.BAD_WORDS))))
    counts = {(r["seed"], r["verdict"]): r["count"] for r in free.groupBy("seed", "verdict").count().collect()}
    assert counts.get((True, "allow"), 0) <= 0.1 * counts[True, "block"] and counts.get((False, "block"), 0) <= 0.05 * counts[False, "allow"]


def walk(node, x):
    while node.numDescendants():
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_trees_by_hand(spark, learnt):
    pages, model = learnt
    some = pages.select("url").where("page_id % 40 = 0")
    rows = url_filter._with_suffixes(url_filter.featured(some), model.stats, True).collect()
    got = {r["url"]: r["p_bad"] for r in model.bad(some).collect()}
    assert len(rows) > 50
    for r in rows:
        margin = sum(w * walk(t._call_java("rootNode"), [r[n] for n in model.names]) for t, w in zip(model.model.trees, model.model.treeWeights, strict=True))
        assert got[r["url"]] == pytest.approx(1 / (1 + math.exp(-2 * margin)))


def test_features_by_hand(spark):
    url = "https://a-b.Example.org/x/y1?q=1&r=22#f"
    r = url_filter.featured(spark.createDataFrame([(url,)], "url string")).first()
    shares = [url.count(c) / len(url) for c in set(url)]
    assert (r["host"], r["path"], r["length"], r["depth"], r["parameters"], r["host_labels"], r["hyphens"]) == ("a-b.example.org", "/x/y1", len(url), 2, 2, 3, 1)
    assert r["digit_ratio"] == pytest.approx(4 / len(url)) and r["entropy"] == pytest.approx(-sum(s * math.log2(s) for s in shares))


def test_any_column_names(spark, learnt):
    pages, model = learnt
    df = spark.createDataFrame([("http://a.org/x", "mine", 1, 2, "h", "d")], "url string, length string, seen_1 int, k int, host string, `a.b` string")
    r = model.bad(df).first()
    assert (r["length"], r["seen_1"], r["k"], r["host"], r["a.b"], r["path"]) == ("mine", 1, 2, "a.org", "d", "/x") and 0 <= r["p_bad"] <= 1


def test_a_row_never_sees_its_own_host(spark):
    rows = [(f"http://bad-one.org/{i}", 1) for i in range(30)] + [(f"http://h{j}.net/{i}", 0) for i in range(9) for j in range(9)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    f = url_filter.Filter(labelled)
    folds = labelled.select("label", url_filter.host_and_path(F.col("url"))[0].alias("host")).select("label", url_filter._fold(F.col("host")).alias("fold"), F.explode(url_filter._suffixes(F.col("host"))).alias("s"))
    folds = folds.groupBy("s.k", "s.suffix", "fold").agg(F.count("*").alias("seen"), F.sum("label").alias("bad"))
    held = f.held_out(url_filter.featured(labelled), folds).where("label = 1").select("seen_2", "bad_2").distinct().collect()
    assert [(r["seen_2"], r["bad_2"]) for r in held] == [(0.0, -1.0)]
