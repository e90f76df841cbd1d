from pyspark.sql import functions as F

from quillon.sources.catalog import Catalog
from quillon.streaming import jobs


def test_delta_in_several_batches(spark, tmp_path):
    """Changes in three files: the last change of a key wins, a deleted key is gone, a later one brings it back."""
    parts = [[(1, 1, "a", False), (2, 2, "b", False)], [(1, 3, "c", True), (2, 4, "d", False)], [(1, 5, "e", False), (3, 6, "f", True)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "k long, n long, v string, gone boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    c = Catalog(spark, f"file://{tmp_path}/c")
    for i in range(3):
        jobs.apply_delta(c, "t", jobs.stream(spark, f"{tmp_path}/in/{i}"), "k", "n", "gone")
    assert sorted(map(tuple, c.scan("t").select("k", "v").collect())) == [(1, "e"), (2, "d")]
    assert c.version("t") == 3 and c.scan("t", 1).count() == 2


def test_rate_limit_keeps_state(spark, tmp_path):
    spark.createDataFrame([(1, i, float(i)) for i in range(5)], "s long, n long, at double").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = jobs.run(jobs.rate_limited(jobs.stream(spark, f"{tmp_path}/in"), "s", "n", "at", 2))
    assert sorted(r["key"] for r in out.where("accepted").collect()) == [0, 1]


def test_empty_stream(spark, small):
    e = jobs.stream(spark, f"{small}/events.parquet").where(F.lit(False))
    assert jobs.run(jobs.tumbling(e, "ts", "1 hour", ["event_type"]), "complete").count() == 0
