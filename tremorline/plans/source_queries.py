"""Registered queries: stores, buffers, traces and replayed recordings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tremorline.operators import store
from tremorline.plans import bindings as b
from tremorline.plans.registry import query
from tremorline.session import scratch_path
from tremorline.sources import stores, trace_source, traces
from tremorline.streaming import framer

def joined(ds):
    return b.rounded(ds.signals.join(ds.labels, "id"), "signal_raw")


@query("src_simple_dir", """WITH ids AS (
  SELECT row_number() OVER (ORDER BY CAST(label AS VARCHAR), vec_id) - 1 AS id, CAST(label AS VARCHAR) AS label, embedding
  FROM embeddings)
SELECT id, label, t - 1 AS time, round(CAST(embedding[t] AS DOUBLE), 6) AS signal_raw
FROM ids, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS t) t""")
def src_simple_dir(spark, sf):
    path = scratch_path(spark, "simple")
    vecs = b.vectors(spark, sf).select(F.col("id").alias("key"), F.col("samples").alias("signal"), "label")
    vecs.write.partitionBy("label").parquet(path)
    return joined(stores.read_simple_dir(spark, path, label_from="folder"))


LABELLED = """alarms AS (
  SELECT vec_id AS alarm_id, CAST(vec_id % 8 AS INTEGER) AS zone, embedding,
         TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS date_time,
         CASE WHEN label > 0 THEN 'c' || label END AS label
  FROM embeddings)"""


def labelled_alarms(spark, sf):
    vecs = b.vectors(spark, sf)
    minutes = F.make_dt_interval(mins=F.col("id").cast("int"))
    return vecs.select(
        F.col("id").alias("alarm_id"),
        (F.col("id") % 8).cast("int").alias("zone"),
        F.col("samples").alias("signal"),
        (F.lit("2024-01-01").cast("timestamp") + minutes).alias("date_time"),
        F.when(F.col("label") > 0, F.concat(F.lit("c"), "label")).alias("label"),
    )


@query("src_nested_store", f"""WITH {LABELLED}, ids AS (
  SELECT row_number() OVER (ORDER BY zone, date_time, alarm_id) - 1 AS id, coalesce(label, 'unknown') AS label, embedding
  FROM alarms)
SELECT id, label, t - 1 AS time, round(CAST(embedding[t] AS DOUBLE), 6) AS signal_raw
FROM ids, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS t) t""")
def src_nested_store(spark, sf):
    path = scratch_path(spark, "nested")
    store.alarm_sink(labelled_alarms(spark, sf), path)
    return joined(stores.read_nested_store(spark, path))


@query("unknown_label_report", f"""WITH {LABELLED}
SELECT zone, strftime(date_time, '%d/%m/%Y %H:%M:%S') AS date_time FROM alarms WHERE label IS NULL""")
def unknown_label_report(spark, sf):
    out = stores.unknown_label_report(labelled_alarms(spark, sf))
    return out.withColumn("date_time", F.date_format("date_time", store.STAMP_FORMAT))


@query("alarm_sink", f"""WITH {LABELLED}
SELECT zone, strftime(date_time, '%Y_%m_%d') AS date, strftime(date_time, '%Hh') AS hour, alarm_id, label,
       CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 2) AS first,
       round(CAST(embedding[2] AS DOUBLE), 2) AS second FROM alarms""")
def alarm_sink(spark, sf):
    alarms = labelled_alarms(spark, sf)
    shares = [F.round(F.get("signal", F.lit(i)), 2) for i in range(2)]
    shares = F.create_map(F.lit("first"), shares[0], F.lit("second"), shares[1])
    out = store.stored(spark, alarms.withColumn("probabilities", shares))
    read = store.decode_probabilities("probabilities")  # stored as JSON text
    return out.select(
        "zone", "date", "hour", "alarm_id", "label", F.size("signal").alias("n"), read["first"].alias("first"),
        read["second"].alias("second"),
    )


@query("demux_channel", """SELECT vec_id AS id, CAST(t AS INTEGER) AS tick, round(CAST(embedding[8 * t + 4] AS DOUBLE), 6) AS value
FROM embeddings, LATERAL (SELECT unnest(range(0, 8)) AS t) t""")
def demux_channel(spark, sf):
    out = traces.demux_channel(b.vectors(spark, sf), "id", "samples", stride=8, offset=3, size=64)
    return b.rounded(out, "value")


# --- binary traces -------------------------------------------------------------------------------------------------

COUNTS = "[CAST(floor((CAST(x AS DOUBLE) + 1) * 8000) AS INTEGER) FOR x IN embedding]"


def counts(spark, sf):
    """Vectors as traces of 14-bit counts."""
    scaled = F.transform("samples", lambda x: F.floor((x + 1) * 8000).cast("int"))
    return b.vectors(spark, sf).select("id", scaled.alias("samples"))


def _encoder(encode, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [encode(np.array(v).reshape(-1, width)) for v in batch["values"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(blobs, pa.binary())], names=["key", "content"])

    return run


@query("decode_trace_message", f"""SELECT vec_id AS id, t AS trace, c[32 * t + 1 : 32 * t + 32] AS samples
FROM (SELECT vec_id, {COUNTS} AS c FROM embeddings), LATERAL (SELECT unnest(range(0, 2)) AS t) t""")
def decode_trace_message(spark, sf):
    rows = counts(spark, sf).select(F.col("id").alias("key"), F.col("samples").alias("values"))
    sent = rows.mapInArrow(_encoder(traces.encode_trace_message, 32), "key long, content binary")
    return traces.decode_trace_message(sent.withColumnRenamed("key", "id"), "id", "content")


def trace_files(spark, sf):
    """Files of five traces each, as the binary file source returns them."""
    groups = counts(spark, sf).groupBy(F.expr("id div 5").alias("f")).agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("id", "samples")))["samples"]).alias("values")
    )
    rows = groups.select(F.format_string("/traces/%08d.rtd", "f").alias("key"), "values")
    files = rows.mapInArrow(_encoder(traces.encode_trace_file, 64), "key string, content binary")
    return files.withColumnRenamed("key", "path")


def _write_files(folder: str):
    """Write the contents of files to the shared folder; the attempt that ends last leaves the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = trace_source.open_folder(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                with fs.open_output_stream(f"{root}/{path.rpartition('/')[2]}") as out:
                    out.write(content)
            yield batch.select(["path"])

    return run


@query("decode_trace_files", f"""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS trace_no, vec_id % 5 AS trace,
       printf('/traces/%08d.rtd', vec_id // 5) AS path, {COUNTS} AS samples FROM embeddings""")
def decode_trace_files(spark, sf):
    """Files written to the shared folder and read by the trace source."""
    folder = scratch_path(spark, "traces")
    trace_files(spark, sf).mapInArrow(_write_files(folder), "path string").count()
    name = F.concat(F.lit("/traces/"), F.substring_index("path", "/", -1))
    return trace_source.read_traces(spark, folder, 1 << 20).withColumn("path", name)


@query("stream_frames", f"""SELECT z AS zone, vec_id // 20 AS frame_no, list(CAST(c[z + 1] AS DOUBLE) ORDER BY vec_id) AS samples
FROM (SELECT vec_id, {COUNTS} AS c FROM embeddings), LATERAL (SELECT unnest([33, 44, 55]) AS z) z
GROUP BY z, vec_id // 20 HAVING count(*) = 20""")
def stream_frames(spark, sf):
    """Messages of seven traces, dealt to files at random, streamed into frames of twenty samples."""
    groups = counts(spark, sf).groupBy((F.expr("id div 7") * 7).alias("key")).agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("id", "samples")))["samples"]).alias("values")
    )
    sent = groups.mapInArrow(_encoder(traces.encode_trace_message, 64), "key long, content binary")
    source, sink = scratch_path(spark, "messages"), scratch_path(spark, "frames")
    sent.toDF("first_trace", "payload").repartition(3, F.xxhash64("first_trace")).write.parquet(source)
    schema = "first_trace long, payload binary"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    frames = framer.stream_frames(framer.message_samples(stream), 20)
    running = frames.writeStream.format("parquet").option("path", sink).trigger(availableNow=True)
    running.option("checkpointLocation", scratch_path(spark, "state")).start().awaitTermination()
    return spark.read.schema(frames.schema).parquet(sink)


@query("trace_inventory", """SELECT count(DISTINCT vec_id // 5) AS files, count(*) AS traces, CAST(64 AS INTEGER) AS trace_size
FROM embeddings""")
def trace_inventory(spark, sf):
    return traces.trace_inventory(trace_files(spark, sf))


ZONES = f"""zones AS (
  SELECT z AS zone, vec_id AS trace_no, c[z + 1] AS value
  FROM (SELECT vec_id, {COUNTS} AS c FROM embeddings), LATERAL (SELECT unnest([33, 44, 55]) AS z) z)"""


def zones(spark, sf):
    return traces.fanout_zones(counts(spark, sf).withColumnRenamed("id", "trace_no"))


@query("fanout_zones", f"WITH {ZONES} SELECT zone, trace_no, value FROM zones")
def fanout_zones(spark, sf):
    return zones(spark, sf)


@query("recent_trace_window", f"""WITH {ZONES} SELECT zone, trace_no, value FROM zones
QUALIFY row_number() OVER (PARTITION BY zone ORDER BY trace_no DESC) <= 100""")
def recent_trace_window(spark, sf):
    return traces.recent_trace_window(zones(spark, sf), keep=100)


@query("replay_frames", f"""WITH {b.ZONE_SAMPLES}
SELECT zone, sample_idx // 20 AS frame_no, list(value ORDER BY sample_idx) AS samples
FROM (SELECT *, count(*) OVER (PARTITION BY zone) AS n FROM samples) WHERE sample_idx < n - 1
GROUP BY zone, sample_idx // 20""")
def replay_frames(spark, sf):
    return traces.replay_frames(b.zone_samples(spark, sf), step=b.FRAME)
