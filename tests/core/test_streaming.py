from pyspark.sql import functions as F

from millrace.operators import bands as B
from millrace.streaming import jobs


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), events)
    counts = jobs.banded_counts(stream, "ts", "value", *B.OPERATOR_SPEED, "1 day", "1 day")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("banded").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = jobs.banded_counts(events, "ts", "value", *B.OPERATOR_SPEED, "1 day", "1 day")
    key = lambda r: (r.start, str(r.band))
    assert sorted(spark.table("banded").collect(), key=key) == sorted(batch.collect(), key=key)
    assert batch.agg(F.sum("n")).first()[0] == events.count()
