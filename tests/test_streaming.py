import datetime as dt

from pyspark.sql import functions as F

from gridmill.streaming import ingest


def test_sessions_close_after_the_gap(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", at(0)), ("a", at(1)), ("a", at(5)), ("b", at(0)), ("c", at(50))]
    spark.createDataFrame(rows, "session_id string, ts timestamp").write.parquet(str(tmp_path / "m"))
    s = spark.readStream.schema("session_id string, ts timestamp").parquet(str(tmp_path / "m"))
    q = ingest.session_counts(s).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session_id, r.messages) for r in spark.table("sessions").collect()}
    assert got == {("a", 2), ("a", 1), ("b", 1)}


def test_batch_form_counts_the_same(spark):
    d = spark.sql("select 's' session_id, timestamp'2024-01-01 00:00:00' ts union all select 's', timestamp'2024-01-01 01:00:00'")
    assert ingest.session_counts(d).agg(F.sum("messages")).first()[0] == 2
