from quern.streaming import evaluation as E

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    log = E.read_log(spark, str(tmp_path / "in"), events.schema, 10)
    q = E.windowed(log, late="3650 days").writeStream.format("memory").queryName("quern_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(spark.table("quern_windows")) == key(E.windowed(events))
    f = E.flush_by(E.read_log(spark, str(tmp_path / "in"), events.schema).select("event_id", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"))
    f.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
