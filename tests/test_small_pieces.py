"""Documents go through Python in pieces of bounded size, and trees are free once they have been read."""

import gc

import pyarrow as pa

from webloom.session import BATCH_BYTES
from webloom.sources import documents, dom


def test_trees_are_freed():
    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            documents.read_html("<html><body><p>a<b>b</b></p></body></html>")
            documents.read_page("u", "<html><body><article><p>a<b>b</b></p></article></body></html>")
        assert sum(isinstance(x, dom.Node) for x in gc.get_objects()) < 20
    finally:
        gc.enable()


def test_pieces(spark):
    assert [b.num_rows for b in documents.few([pa.RecordBatch.from_pydict({"x": list(range(250))})])] == [100, 100, 50]
    df = spark.range(250).selectExpr("cast(id as string) as url", "'text/html' as content_type", "concat('<title>', id, '</title>') as body").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    got = {(r.url, r.title) for r in documents.parse(df).collect()}
    assert got == {(str(i), str(i)) for i in range(250)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
