"""Files on disk, label edits, retention and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.operators import curate, model, store
from tremorline.session import scratch_path
from tremorline.sources import stores, traces
from tremorline.streaming.score_stream import score_batch


def test_trace_files_on_disk(spark, tmp_path):
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, (n, 6)) for n in (3, 1, 4)]
    for i, m in enumerate(blocks):
        (tmp_path / f"t{i}.rtd").write_bytes(traces.encode_trace_file(m))
    files = traces.read_trace_files(spark, str(tmp_path))
    got = traces.decode_trace_files(files).orderBy("trace_no").collect()
    assert [r["trace_no"] for r in got] == list(range(8))
    assert [r["samples"] for r in got] == np.vstack(blocks).tolist()
    assert traces.trace_inventory(files).collect()[0].asDict() == {"files": 3, "traces": 8, "trace_size": 6}


def test_simple_directory_by_file_name(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for label, series in (("hit", [[1.0, 2.0], [3.0]]), ("saw", [[4.0, 5.0, 6.0]])):
        table = pa.table({"key": list(range(len(series))), "signal": series})
        pq.write_table(table, tmp_path / f"{label}.parquet")
    ds = stores.read_simple_dir(spark, str(tmp_path))
    assert {r["id"]: r["label"] for r in ds.labels.collect()} == {0: "hit", 1: "hit", 2: "saw"}
    got = [tuple(r) for r in ds.signals.orderBy("id", "time").collect()]
    assert got == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (2, 0, 4.0), (2, 1, 5.0), (2, 2, 6.0)]


def alarms(spark, n=40):
    rows = [(i % 2, i, float(i), None) for i in range(n)]
    df = spark.createDataFrame(rows, "zone int, alarm_id long, value double, label string")
    return df.withColumn("date_time", F.timestamp_seconds(F.col("alarm_id") * 600 + 1_700_000_000))


def test_label_edits_rewrite_only_their_partitions(spark):
    path = scratch_path(spark, "labels-test")
    store.alarm_sink(alarms(spark), path)
    before = store.read_store(spark, path)
    edits = before.filter("alarm_id IN (3, 17)").select(*store.PARTITIONS, "alarm_id").withColumns(
        {"label": F.lit("hit"), "edit_time": F.lit(1)}
    )
    edits = edits.unionByName(edits.filter("alarm_id = 3").withColumns({"label": F.lit("saw"), "edit_time": F.lit(2)}))
    store.save_labels(spark, path, edits)
    got = {r["alarm_id"]: r["label"] for r in store.read_store(spark, path).collect()}
    assert len(got) == 40
    assert {k: v for k, v in got.items() if v} == {3: "saw", 17: "hit"}


def test_streamed_alarms_can_be_edited_and_written_again(spark):
    path = scratch_path(spark, "stream-test")
    write = store.sink_batch(path)
    write(alarms(spark).filter("alarm_id < 20"), 0)
    for _ in range(2):  # a batch repeated after a failure
        write(alarms(spark).filter("alarm_id >= 20"), 1)
    store.alarm_sink(alarms(spark, 42).filter("alarm_id >= 40"), path)
    before = store.read_store(spark, path)
    edits = before.filter("alarm_id IN (3, 18, 21, 40)").select(*store.PARTITIONS, "alarm_id")
    store.save_labels(spark, path, edits.withColumns({"label": F.lit("hit"), "edit_time": F.lit(1)}))
    write(alarms(spark, 43).filter("alarm_id >= 42"), 2)
    got = sorted((r["alarm_id"], r["label"]) for r in store.read_store(spark, path).collect())
    assert [a for a, _ in got] == list(range(43))
    assert [a for a, label in got if label] == [3, 18, 21, 40]


def test_ring_keeps_the_newest(spark):
    kept = store.hour_ring_buffer(store.alarm_path_parts(alarms(spark)), keep=2)
    per = kept.groupBy(*store.PARTITIONS).agg(F.max("alarm_name").alias("last"), F.count("*").alias("n")).collect()
    assert all(r["n"] <= 2 and r["last"] == f"alarm {r['n']:05d}" for r in per)


def test_downsampling_takes_the_smallest_class(spark):
    sizes = {"a": 90, "b": 40, "c": 15, "d": 30}
    labels = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    labels = spark.createDataFrame(labels, "id long, label string")
    signals = labels.select("id", F.lit(0).alias("time"), F.lit(1.0).alias("signal_raw"))
    out = curate.downsample_classes(curate.Dataset(signals, labels))
    assert {r["label"]: r["n"] for r in curate.class_counts(out.labels).collect()} == dict.fromkeys(sizes, 15)
    assert out.signals.count() == 60


def test_forest_learns_and_survives_saving(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    rows = [(i, "pos" if v[0] + v[1] > 0 else "neg", *map(float, v)) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, "id long, label string, f0 double, f1 double, f2 double")
    fitted = model.train_tuned_rf(data, seed=3, numTrees=20)
    path = scratch_path(spark, "model")
    model.save_model(fitted, path)
    loaded = model.load_model(path)
    assert model.classes_of(loaded) == ["neg", "pos"]
    scored = model.predict_proba(loaded, data).join(data.select("id", "label"), "id")
    right = scored.select((model.top_class("probabilities") == F.col("label")).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.85
    total = scored.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert total.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 0.03


def test_folds_are_stratified(spark):
    labels = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(400)], "id long, label string")
    folds = model.stratified_folds(labels, 3, 1).join(labels, "id").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r["label"] == "a"} == {100}
    assert {r["count"] for r in folds if r["label"] == "b"} <= {33, 34}


def test_scored_stream_batch(spark):
    from tremorline.operators.preprocess import TimePreprocessing
    from tremorline.operators.score import features_of
    from tremorline.operators.spectrum import FreqPreprocessing

    rng = np.random.default_rng(4)
    time, freq = TimePreprocessing(std_window=8, mean_window=16), FreqPreprocessing(n_bins=10)
    series = [(i % 3, i, rng.normal(size=60).tolist()) for i in range(12)]
    batch = spark.createDataFrame(series, "zone int, close_frame long, samples array<double>")
    signals = batch.select(
        F.expr("CAST(zone AS BIGINT) * 1000000000 + close_frame").alias("id"),
        F.posexplode("samples").alias("time", "signal_raw"),
    )
    table = features_of(signals, time, freq).withColumn("label", F.when(F.col("id") % 2 == 0, "hit").otherwise("saw"))
    fitted = model.train_baseline_rf(table, trees=3)
    seen = []
    score_batch(fitted, lambda df, no: seen.append((no, df.collect())), time, freq)(batch, 7)
    assert seen[0][0] == 7 and len(seen[0][1]) == 12
    assert all(set(r["probabilities"]) == {"hit", "saw"} for r in seen[0][1])


def test_rename_chain(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, label string")
    out = curate.rename_classes(curate.Dataset(labels, labels), {"a": "b", "b": "c", "c": "d"})
    assert {r["label"] for r in out.labels.collect()} == {"d"}


@pytest.mark.parametrize("text", ['{"a": 1.5}', '"{\\"a\\": 1.5}"'])
def test_probabilities_once_or_twice_encoded(spark, text):
    df = spark.createDataFrame([(text,)], "p string")
    assert df.select(store.decode_probabilities("p")).first()[0] == {"a": 1.5}


def test_the_saved_pipeline_numbers_the_signals_once(spark, monkeypatch):
    """Fitting and scoring read the series several times, which are numbered and sorted once."""
    from tremorline.plans import model_queries

    numbered = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            numbered.add(batch.num_rows)
            yield batch

    rows = [(i, t, float((t * (i + 3)) % 11) + 0.1 * i) for i in range(6) for t in range(150)]
    signals = spark.createDataFrame(rows, "id long, time int, signal_raw double").repartition(2)
    monkeypatch.setattr(model_queries.b, "signal", lambda *_: signals.mapInArrow(counted, signals.schema))
    monkeypatch.setattr(model_queries, "TREES", 2)
    out = model_queries.fit_save_pipeline(spark, "").collect()
    assert sorted(r.id for r in out) == list(range(6)) and numbered.value == len(rows)
