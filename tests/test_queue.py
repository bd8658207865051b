"""The work queue: its rules by hand and at random, the stream against its batch twin over several starts."""

import random
import time

import pytest

from tessera.streaming import queue as Q
from tessera.streaming.status import FOLLOWS

EVENTS = "queue string, seq long, kind string, file string, total long"


def made(seed, n=120, queues=("p", "q")):
    rng = random.Random(seed)
    return [(rng.choice(queues), k, rng.choice(["request", "request", "batch", "batch", "batch", "cancel", "fail"]), f"f{rng.randrange(6)}", rng.choice([5, 20, 45])) for k in range(n)]


def test_by_hand():
    steps = Q.Steps(1, {}, {}, {}, set(), {})
    assert steps.take("request", "a", 45) == [("a", "New", 0, 45, True), ("a", "Processing", 0, 45, True)]
    assert steps.take("request", "b", 5) == [("b", "New", 0, 5, True)]  # no slot is free
    assert steps.take("request", "a", 45) == [("a", "New", 0, 45, False)]
    assert steps.take("batch", "a", 0) == [("a", "Processing", 20, 45, True)]
    assert steps.take("cancel", "a", 0) == []  # it stops after its batch
    assert steps.take("batch", "a", 0) == [("a", "Cancelled", 40, 45, True), ("b", "Processing", 0, 5, True)]
    assert steps.take("batch", "b", 0) == [("b", "Completed", 5, 5, True)]
    assert steps.take("fail", "b", 5) == [("b", "Failed", 0, 5, False)]
    assert steps.take("request", "b", 5) == [("b", "Ready to Reprocess", 0, 5, True), ("b", "Processing", 0, 5, True)]


@pytest.mark.parametrize("seed", range(5))
def test_no_forbidden_step_and_no_more_than_the_slots(spark, seed):
    rows = Q.work_in_batch(spark.createDataFrame(made(seed), EVENTS).repartition(3)).collect()
    state, running = {}, {}
    order = {}
    for r in rows:
        order.setdefault(r.queue, []).append(r)
    for queue, own in order.items():
        for r in own:
            if not r.accepted:
                continue
            old = state.get((queue, r.file))
            if not (old == r.status == "Processing"):
                assert r.status in (FOLLOWS[old] if old else ("New",)), (old, r)
            state[queue, r.file] = r.status
            (running.setdefault(queue, set()).add if r.status == "Processing" else running.setdefault(queue, set()).discard)(r.file)
            assert len(running[queue]) <= Q.SLOTS and r.processed <= r.total


def test_stream_equals_its_batch_twin(spark, tmp_path):
    """Three starts from one checkpoint; each goes on with the state of the last."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = made(11)
        for part in (events[:30], events[30:31], events[31:]):
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            time.sleep(1)
            stream = Q.work(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"))
            run = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
            ended = run.awaitTermination(60)
            run.stop()
            assert ended and run.exception() is None
        got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))
        assert got == sorted(map(tuple, Q.work_in_batch(spark.createDataFrame(events, EVENTS)).collect()))
    finally:
        spark.conf.set(provider, before)
