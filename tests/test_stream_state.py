"""Streams that keep state: restarts, repeated and late rows, tails that close."""

import time

import pytest
from pyspark.sql import functions as F

from cargolore.streaming import state

OUTCOMES = "batch_id string, total long, row_index long, status string"


def run(stream, path, mode="update"):
    """All there is, once; each micro-batch's rows are kept under its number."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/n={n}"))
    writer.option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()


def test_batch_progress_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed = spark.readStream.schema(OUTCOMES).json(f"{tmp_path}/in")
    steps = [
        [("a", 3, 0, "completed"), ("a", 3, 1, "failed"), ("b", 2, 0, "failed")],
        [("a", 3, 1, "completed"), ("a", 3, 0, "completed"), ("b", 2, 1, "failed"), ("b", 2, 7, "completed"), (None, 1, 0, "failed")],
        [("a", 3, 2, "failed"), ("b", 2, 1, "completed"), ("c", 0, 0, "completed")],
    ]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, OUTCOMES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        run(state.batch_states(feed), tmp_path)  # a new query each time, from its checkpoint
    found = spark.read.parquet(f"{tmp_path}/out").groupBy("batch_id").agg(F.max_by(F.struct("total", "completed", "failed", "repeated", "state"), "n").alias("s"))
    got = {r.batch_id: tuple(r.s) for r in found.collect()}
    assert got == {"a": (3, 1, 2, 2, "done"), "b": (2, 0, 2, 2, "failed"), "c": (0, 0, 0, 1, "failed")}
    first = {r.batch_id: r.state for r in spark.read.parquet(f"{tmp_path}/out/n=0").collect()}
    assert first == {"a": "running", "b": "running"}


def test_log_tail_closes_two_ticks_after_the_end(spark, tmp_path):
    schema = "run_id string, log_id long, line string, status string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    put([("r", 2, "two", None), ("r", 1, "one", None), ("r", None, None, "running"), ("s", 1, "x", None)])
    seen = []
    stream = state.log_tails(spark.readStream.schema(schema).json(f"{tmp_path}/in"), tick_ms=300)
    query = stream.writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="100 milliseconds").start()

    def wait(done):
        end = time.time() + 60
        while not done() and time.time() < end:
            assert query.exception() is None
            time.sleep(0.1)
        assert done()

    try:
        wait(lambda: len(seen) >= 3)
        put([("r", 2, "two again", None), ("r", 3, "three", "success")])
        wait(lambda: any(x[1] == "done" for x in seen))
        put([("r", 4, "after the end", None), ("s", 2, "y", None)])
        wait(lambda: ("s", "log", 2, "y", None) in seen)
    finally:
        query.stop()
    assert [x for x in seen if x[0] == "r"] == [("r", "log", 1, "one", None), ("r", "log", 2, "two", None), ("r", "log", 3, "three", None), ("r", "done", None, None, "success")]
    assert not any(x[:2] == ("s", "done") for x in seen)


def test_a_batch_that_fails_midway_gives_each_result_once(spark, tmp_path):
    schema = "query_id long, text string"
    (tmp_path / "in").mkdir()
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    for i in range(3):
        spark.createDataFrame([(10 * i + k, f"text {k}") for k in range(4)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    asked = []

    def policy():
        asked.append(len(asked))
        return f"policy {len(asked)}"

    failed = []

    def screen(batch, version):
        out = batch.select("query_id", F.lit(version).alias("policy"))
        if len(asked) == 2 and not failed:
            failed.append(True)
            out.limit(2).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=1")  # half a result is left behind
            raise RuntimeError("lost")
        return out

    with pytest.raises(Exception, match="lost"):
        state.screen_batches(feed, policy, screen, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    state.screen_batches(feed, policy, screen, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.query_id for r in rows) == sorted(10 * i + k for i in range(3) for k in range(4))
    assert len({(r.batch, r.policy) for r in rows}) == 3 and len(asked) == 4
