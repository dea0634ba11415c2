"""Retention in the store, and the chain from a stream of frames to store, messages and gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.operators import store
from tremorline.operators.crop import CropParams
from tremorline.session import scratch_path
from tremorline.streaming import alarm_chain as chain
from tremorline.streaming.crop_stream import stream_events

P = CropParams(threshold=2.0, indent=3, cooling=10, max_time=30, frame_len=5)


# --- retention -----------------------------------------------------------------------------------------------------


def alarms(spark, seconds, zone=1):
    rows = [(zone, i, float(i), None) for i in seconds]
    df = spark.createDataFrame(rows, "zone int, alarm_id long, value double, label string")
    return df.withColumn("date_time", F.timestamp_seconds(F.col("alarm_id") * 60 + 1_700_000_000))


def hours(spark, path):
    found = store.read_store(spark, path).groupBy(*store.PARTITIONS).agg(F.sort_array(F.collect_list("alarm_id")).alias("ids"))
    return {(r.date, r.hour): list(r.ids) for r in found.collect()}


def newest(ids, keep):
    """By hour of their minute, the last ``keep``."""
    out = {}
    for i in sorted(ids):
        out.setdefault((1_700_000_000 + 60 * i) // 3600, []).append(i)
    return sorted(v[-keep:] for v in out.values())


@pytest.mark.parametrize("keep", [1, 4, 250])
def test_a_zone_hour_holds_the_newest_whatever_the_batches(spark, keep):
    path = scratch_path(spark, "retention")
    write = store.sink_batch(path, keep)
    rng = np.random.default_rng(keep)
    ids = rng.permutation(200)
    for batch, some in enumerate(np.array_split(ids, 5)):
        for _ in range(2 if batch in (1, 3) else 1):  # some batches are repeated after a failure
            write(alarms(spark, [int(i) for i in some]), batch)
    assert sorted(hours(spark, path).values()) == newest(range(200), keep)


def test_batches_before_and_after_a_merge_are_kept(spark):
    path = scratch_path(spark, "retention")
    write = store.sink_batch(path, 250)
    for batch in range(store.MERGE_FOLDERS + 3):
        write(alarms(spark, [batch]), batch)
    assert sorted(i for ids in hours(spark, path).values() for i in ids) == list(range(store.MERGE_FOLDERS + 3))
    folders = store._read(spark, path).groupBy(*store.PARTITIONS).agg(F.countDistinct(store.BATCH).alias("n"))
    assert max(r.n for r in folders.collect()) < store.MERGE_FOLDERS


def test_failure_between_writing_and_deleting_loses_nothing(spark, monkeypatch):
    path = scratch_path(spark, "retention")
    write = store.sink_batch(path, 3)
    write(alarms(spark, range(3)), 0)
    real, calls = store._file_system, []

    def broken(spark, where):
        calls.append(where)
        raise OSError("lost")

    monkeypatch.setattr(store, "_file_system", broken)
    with pytest.raises(OSError):
        write(alarms(spark, range(3, 6)), 1)
    monkeypatch.setattr(store, "_file_system", real)
    assert calls and {3, 4, 5} <= {i for ids in hours(spark, path).values() for i in ids}
    write(alarms(spark, range(3, 6)), 1)
    assert sorted(hours(spark, path).values()) == newest(range(6), 3)


def test_labels_survive_merges(spark):
    path = scratch_path(spark, "retention")
    write = store.sink_batch(path, 3)
    write(alarms(spark, range(3)), 0)
    edits = store.read_store(spark, path).filter("alarm_id = 2").select(*store.PARTITIONS, "alarm_id")
    store.save_labels(spark, path, edits.withColumns({"label": F.lit("hit"), "edit_time": F.lit(1)}))
    write(alarms(spark, [3]), 1)
    write(alarms(spark, [2]), 2)  # an unlabelled copy of it
    found = {r.alarm_id: r.label for r in store.read_store(spark, path).collect()}
    assert found == {1: None, 2: "hit", 3: None}


def test_probabilities_are_stored_as_json(spark):
    path = scratch_path(spark, "json")
    rows = alarms(spark, [0, 1]).withColumn("probabilities", F.create_map(F.lit("a"), F.lit(0.25), F.lit("b"), F.lit(0.75)))
    store.alarm_sink(rows, path)
    back = store.read_store(spark, path)
    assert dict(back.dtypes)["probabilities"] == "string"
    assert [r.p for r in back.select(store.decode_probabilities("probabilities").alias("p")).collect()] == [{"a": 0.25, "b": 0.75}] * 2


def test_retention_of_nothing(spark):
    path = scratch_path(spark, "retention")
    write = store.sink_batch(path, 3)
    write(alarms(spark, [1]), 0)
    write(alarms(spark, []), 1)
    assert sum(map(len, hours(spark, path).values())) == 1


# --- chain ---------------------------------------------------------------------------------------------------------


def scorer(signals):
    """Long alarms are ``dig``, short ones ``step``."""
    share = F.when(F.count(F.lit(1)) > 31, 0.75).otherwise(0.25)
    both = F.create_map(F.lit("dig"), share, F.lit("step"), 1 - share)
    return signals.groupBy("id").agg(both.alias("probabilities"))


def frames(spark):
    rng = np.random.default_rng(11)
    rows = []
    for zone in range(3):
        loud = False
        for no in range(90):
            loud = no > 0 and rng.random() < (0.7 if loud else 0.15)
            x = rng.normal(size=5).round(3)
            if loud:
                x = x * 0.1
                x[rng.integers(5)] += 40
            if not (zone == 1 and no in (20, 21, 50)):
                rows.append((zone, no, [float(v) for v in x]))
    schema = "zone int, frame_no long, samples array<double>"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("date_time", F.timestamp_seconds(F.col("frame_no") * 100 + 1_700_000_000))


def run_chain(spark, source, schema, state, write):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream_events(stream, P, lateness=8).writeStream.foreachBatch(write)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def contents(spark, root):
    read = chain.read_chain(spark, root)
    plain = {k: sorted(map(tuple, v.drop("signal").collect()), key=repr) for k, v in read.items()}
    signals = {(r.zone, r.alarm_id): list(r.signal) for r in read[chain.STORE].collect()}
    return plain | {"signals": signals}


def test_chain_restarted_after_failures_equals_an_undisturbed_one(spark, monkeypatch):
    data = frames(spark)
    source = scratch_path(spark, "frames")
    for part in range(3):
        some = data.filter(F.floor(F.col("frame_no") / 30) == part)
        some.coalesce(1).write.mode("append").parquet(source)
    whole, broken = scratch_path(spark, "chain"), scratch_path(spark, "chain")
    run_chain(spark, source, data.schema, scratch_path(spark, "state"), chain.alarm_chain(scorer, whole, keep=3))

    state, scored = scratch_path(spark, "state"), []

    def counted(signals):
        scored.append(1)
        return scorer(signals)

    write = chain.alarm_chain(counted, broken, keep=3)
    real_message, real_retain = chain.alarm_message, store.retain
    left = {"message": 2, "retain": 1}

    def fails(name, real):
        def run(*args, **kwargs):
            if left[name]:
                left[name] -= 1
                raise OSError("lost")
            return real(*args, **kwargs)

        return run

    monkeypatch.setattr(chain, "alarm_message", fails("message", real_message))
    monkeypatch.setattr(store, "retain", fails("retain", real_retain))
    for _ in range(6):
        try:
            run_chain(spark, source, data.schema, state, write)
            break
        except Exception:
            continue
    assert left == {"message": 0, "retain": 0} and len(scored) == 3  # no batch was scored twice
    got, want = contents(spark, broken), contents(spark, whole)
    assert got == want
    assert len(want["messages"]) > 10 and len(want["messages"]) >= len(want["store"])
    assert {m[2] for m in want["messages"]} == {"dig", "step"}
    assert all(t is not None and t > 1_700_000_000 for *_, t in want["messages"])
    assert [g[:4] for g in want["gaps"]] == [(1, "gap", 20, 21), (1, "gap", 50, 50)]
