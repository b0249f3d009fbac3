from reviewloom.common import table
from reviewloom.streaming import appends


def test_arrivals(spark, sf, tmp_path):
    n = table(spark, sf, "normalized_output_example").select("rec_id", "project", "response_text", "loaded_at")
    n.union(n.where("rec_id % 5 = 0")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = appends.arrivals(appends.read(spark, str(tmp_path / "in"), n.schema)).writeStream.outputMode("update").format("memory").queryName("arr").start()
    try:
        q.processAllAvailable()
        assert spark.sql("select sum(n) from arr").first()[0] == n.count()
    finally:
        q.stop()
