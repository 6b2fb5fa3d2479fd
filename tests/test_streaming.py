import pytest

from siftlake.config import DedupConfig
from siftlake.streaming import dedup as S

SCHEMA = "doc_id bigint, text string, ts timestamp"


def put(spark, path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, ts string").selectExpr("doc_id", "text", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(path)


def test_restart_keeps_state(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    put(spark, src, [(0, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 00:00:01"), (2, "a", "2024-01-01 00:00:02")])
    run = lambda: S.run_to_table(S.distinct(S.source(spark, src, SCHEMA), DedupConfig()).select("doc_id", "text"), out, chk)
    run()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b"]
    put(spark, src, [(3, "b", "2024-01-01 00:00:03"), (4, "c", "2024-01-01 00:00:04")])
    run()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_within_watermark_and_leading(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [(0, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:05")])
    out = str(tmp_path / "w")
    S.run_to_table(S.within(S.source(spark, src, SCHEMA), DedupConfig(), "ts", "1 hour").select("doc_id", "text"), out, str(tmp_path / "c1"))
    assert spark.read.parquet(out).count() == 1
    q = S.leading(S.source(spark, src, SCHEMA), DedupConfig()).writeStream.format("memory").queryName("lead").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["first"], r.seen) for r in spark.table("lead").collect()] == [(0, False)]


def test_chunks_and_types(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [(i, f"t{i % 7}", "2024-01-01 00:00:00") for i in range(20)])
    S.write_chunks(S.create(spark, lambda: src, DedupConfig(), SCHEMA), DedupConfig(), out, str(tmp_path / "c"), 3).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 7 and got.groupBy("batch", "chunk").count().where("count > 3").count() == 0
    with pytest.raises(TypeError):
        S.create(spark, 5, DedupConfig())
