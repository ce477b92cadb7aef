import json

import pytest
from helpers import bars
from pyspark.sql import functions as F

from wickwork.sources import bars as B
from wickwork.sources.pages import Refused, fetch, register


def test_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Data,Open,High,Low,Close,Volume,Extra\n2024-01-02 00:00:00,1,2,0.5,1.5,10,x\n2024-01-01 00:00:00,1,2,0.5,1.2,10,x\n")
    got = B.read_csv(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()
    assert [r.Close for r in got] == [1.2, 1.5] and "Extra" not in got[0].asDict()
    (tmp_path / "b.csv").write_text("Data,Open\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="Volume"):
        B.read_csv(spark, str(tmp_path / "b.csv"))


def test_pages_overlap_by_a_bar(spark):
    row = lambda ms, c: [str(ms), "1", "2", "0.5", str(c), "10", "more"]
    pages = spark.createDataFrame([([row(0, 1), row(1000, 2)],), ([row(1000, 2), row(2000, 3)],)], "rows array<array<string>>")
    assert [r.Close for r in B.parse_pages(pages).orderBy("seq").collect()] == [1.0, 2.0, 3.0]


def test_page_source_reads_a_window_per_partition(spark, tmp_path):
    (tmp_path / "0-2000.json").write_text(json.dumps([[0, 1, 1, 1, 1, 1], [1000, 1, 1, 1, 2, 1]]))
    (tmp_path / "2000-3000.json").write_text(json.dumps([[2000, 1, 1, 1, 3, 1]]))
    register(spark)
    df = spark.read.format("candle_pages").option("path", str(tmp_path)).option("start", 0).option("end", 3000).option("step", 1000).option("size", 2).load()
    assert df.rdd.getNumPartitions() == 2
    assert B.parse_pages(df).count() == 3


def test_fetch_retries_and_gives_up():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        return [] if len(calls) < 3 else [1]

    assert fetch(flaky, sleep=waits.append) == [1] and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(ValueError, match="empty"):
        fetch(list, tries=2, sleep=waits.append)

    def refuse():
        calls.append("x")
        raise Refused

    with pytest.raises(Refused):
        fetch(refuse, sleep=waits.append)
    assert calls.count("x") == 1


def test_batches_share_their_boundary():
    assert B.batches(0, 500, 1, 200) == [(0, 200), (200, 400), (400, 500)]
    assert B.batches(5, 5, 1) == []


def test_completeness_gate(spark):
    _, df = bars(spark, 50, symbols=("A", "B"))
    thin = df.filter((F.col("symbol") == "A") | (F.col("seq") % 10 == 1) | (F.col("seq") == 50))
    assert [r.symbol for r in B.completeness_gate(thin, 3600, 0.7).select("symbol").distinct().collect()] == ["A"]


def test_empty_bars(spark):
    _, df = bars(spark, 10)
    assert B.completeness_gate(df.limit(0), 3600).count() == 0


def test_streamed_bars(spark, tmp_path):
    from wickwork.streaming.bars import stream_bars

    ticks = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", float(10 * h + m)) for h in range(3) for m in (0, 20, 40)], "ts string, value double").select(F.to_timestamp("ts").alias("ts"), "value")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.Data.hour: r for r in spark.table("bars_out").collect()}
    assert got[0].Open == 0.0 and got[0].Close == 40.0 and got[0].Volume == 3.0
