"""Streams over the event table give what the batch forms give."""

import uuid

from pyspark.sql import functions as F

from quarry.streaming import events as E


def _stream(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    folder = f"{tmp_path}/events"
    batch.orderBy("ts").coalesce(1).write.parquet(folder)
    return E.event_stream(spark, folder, batch.schema), batch.withColumn("ts", F.col("ts").cast("timestamp"))


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def _name():
    return "t" + uuid.uuid4().hex


def test_windows(spark, sf, tmp_path):
    stream, batch = _stream(spark, sf, tmp_path)
    for extra in ({}, {"width": "12 hours", "slide": "6 hours"}):
        got = E.run_once(E.windowed(stream, "event_type", **extra), _name(), "complete")
        assert _rows(got) == _rows(E.windowed(batch, "event_type", **extra))


def test_debounce_emits_closed_bursts(spark, sf, tmp_path):
    stream, batch = _stream(spark, sf, tmp_path)
    got = set(_rows(E.run_once(E.debounce(stream, "user_id", quiet="10 minutes", late="1 minute"), _name())))
    every = set(_rows(E.debounce(batch, "user_id", quiet="10 minutes")))
    assert got <= every and len(got) > 0.9 * len(every)


def test_duplicates(spark, sf, tmp_path):
    stream, batch = _stream(spark, sf, tmp_path)
    got = E.run_once(E.without_duplicates(stream.select("event_id", "ts"), ["event_id"]), _name())
    assert got.count() == batch.select("event_id").distinct().count()


def test_quota(spark, sf, tmp_path):
    stream, batch = _stream(spark, sf, tmp_path)
    log = lambda df: df.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 50).alias("tokens"))
    got = E.run_once(E.quota_gate(log(stream), "day", "tokens", 300), _name())
    assert got.count() == batch.count()
    assert got.groupBy("day").agg(F.max("used").alias("m")).where("m > 300").count() == 0
    assert got.where("granted").groupBy("day").agg(F.sum("asked").alias("s")).where("s > 300").count() == 0
