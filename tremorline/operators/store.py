"""The alarm store: zone / date / hour partitions, retention, labels, counts and navigation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.blocks import attach, block_window, core, number_rows, with_halo
from tremorline.session import materialize, scratch_path

PARTITIONS = ["zone", "date", "hour"]
# Innermost folder: the micro-batch that wrote it, or a merge.
BATCH, NO_BATCH = "batch", -1
MERGE_FOLDERS = 16  # folders of a zone-hour that are merged into one
UNKNOWN = "unknown"  # fixed value: label of an alarm nobody labelled
MAX_ALARMS = 250  # fixed value: alarms kept per zone and hour

# fixed values: time formats of the store
DATE_FORMAT = "yyyy_MM_dd"
STAMP_FORMAT = "dd/MM/yyyy HH:mm:ss"


def hour_name(ts: str | Column) -> Column:
    return F.concat(F.date_format(ts, "HH"), F.lit("h"))


def alarm_path_parts(alarms: DataFrame) -> DataFrame:
    """Add date, hour, file_name and the printed time of ``date_time``."""
    ts = F.col("date_time")
    name = F.concat_ws("_", F.col("zone"), F.date_format(ts, "yyyy_MM_dd_HH"), F.lit("00_00_000"))
    return alarms.withColumns({
        "date": F.date_format(ts, DATE_FORMAT),
        "hour": hour_name(ts),
        "file_name": name,
        "stamp": F.date_format(ts, STAMP_FORMAT),
    })


def alarm_name(no: str | Column) -> Column:
    return F.format_string("alarm %05d", no)


def _write(parts: DataFrame, path: str, mode: str) -> None:
    """The rows of a zone-hour, of which time bounds the number, are written by one task; many small ones are spread."""
    if "probabilities" in parts.columns and isinstance(parts.schema["probabilities"].dataType, T.MapType):
        parts = parts.withColumn("probabilities", F.to_json("probabilities"))
    spread = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PARTITIONS)
    writer = spread.write.partitionBy(*PARTITIONS, BATCH).mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def alarm_sink(alarms: DataFrame, path: str, mode: str = "append", batch: int = NO_BATCH) -> None:
    """Write alarms (zone, date_time, ...) below zone=/date=/hour=/batch=; ``overwrite`` replaces the folders it writes.

    A map of probabilities is stored as JSON text, which ``decode_probabilities`` reads.
    """
    parts = alarms if "hour" in alarms.columns else alarm_path_parts(alarms).drop("file_name", "stamp")
    _write(parts.withColumn(BATCH, F.lit(batch)), path, mode)


def sink_batch(path: str, keep: int | None = None):
    """``foreachBatch`` writer: every micro-batch owns folders it can write again after a failure.

    With ``keep``, the zone-hours that the batch touched hold their newest ``keep`` alarms afterwards.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = materialize(alarm_path_parts(batch).drop("file_name", "stamp"), "batch")
        alarm_sink(parts, path, mode="overwrite", batch=batch_id)
        if keep is not None:
            retain(batch.sparkSession, path, parts.select(*PARTITIONS).distinct(), keep)

    return write


# --- retention -----------------------------------------------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM's own file access, which knows every scheme that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def _of(spark: SparkSession, path: str, touched: DataFrame) -> DataFrame | None:
    """Stored rows of the touched zone-hours; folders outside their dates are not listed to tasks."""
    first, last = touched.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return None
    return _read(spark, path).filter(F.col("date").between(first, last)).join(touched, PARTITIONS, "left_semi")


def retain(spark: SparkSession, path: str, touched: DataFrame, keep: int, folders: int = MERGE_FOLDERS) -> None:
    """Keep the newest ``keep`` alarms of the ``touched`` zone-hours (zone, date, hour); older ones are deleted.

    A zone-hour that has more, or some alarm twice, or ``folders`` folders, is merged: its newest alarms are written to a
    new folder, and only then its other folders go. After a failure in between, alarms are there twice, never missing, and
    the next call merges them again. A labelled copy wins over one without label. A merge reads and writes at most
    ``keep`` alarms per zone-hour and what came since the last one.
    """
    touched = materialize(touched, "touched")
    rows = _of(spark, path, touched)
    if rows is None:
        return
    counts = rows.groupBy(*PARTITIONS).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("alarm_id").alias("alarms"), F.countDistinct(BATCH).alias("folders")
    )
    due = counts.filter((F.col("alarms") > keep) | (F.col("n") > F.col("alarms")) | (F.col("folders") >= folders))
    due = materialize(due.select(*PARTITIONS), "due")
    if due.isEmpty():
        return
    stored = _of(spark, path, due)
    old = [tuple(r) for r in stored.select(*PARTITIONS, BATCH).distinct().collect()]  # folder names
    labelled = F.col("label").isNotNull().cast("int") if "label" in stored.columns else F.lit(0)
    copies = Window.partitionBy(*PARTITIONS, "alarm_id").orderBy(labelled.desc())
    newest = Window.partitionBy(*PARTITIONS).orderBy(F.desc("date_time"), F.desc("alarm_id"))
    once = stored.withColumn("__c", F.row_number().over(copies)).filter("__c = 1").drop("__c")
    kept = once.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= keep).drop("__r")
    _write(kept.withColumn(BATCH, F.lit(f"merged-{uuid.uuid4().hex}")), path, "append")
    for zone, date, hour, batch in old:
        fs, folder = _file_system(spark, f"{path}/zone={zone}/date={date}/hour={hour}/{BATCH}={batch}")
        fs.delete(folder, True)


def stored(spark: SparkSession, alarms: DataFrame, name: str = "store") -> DataFrame:
    """Write alarms to a new store and read it back; partition filters prune folders."""
    path = scratch_path(spark, name)
    alarm_sink(alarms, path)
    return read_store(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.parquet(path)
    kinds = {"zone": "int", "date": "string", BATCH: "string"}
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).drop(BATCH)


def hour_ring_buffer(alarms: DataFrame, keep: int = MAX_ALARMS) -> DataFrame:
    """The newest ``keep`` alarms of each zone and hour, numbered from 1 by age.

    ``row_number <= keep`` limits the groups before the shuffle, so a busy hour costs at most ``keep`` rows per task.
    """
    newest = Window.partitionBy(*PARTITIONS).orderBy(F.desc("date_time"), F.desc("alarm_id"))
    kept = alarms.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= keep).drop("__r")
    oldest = Window.partitionBy(*PARTITIONS).orderBy("date_time", "alarm_id")
    return kept.withColumn("alarm_name", alarm_name(F.row_number().over(oldest)))


def set_label(alarms: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply label edits (alarm_id, label, edit_time); the last edit of an alarm wins."""
    last = edits.groupBy("alarm_id").agg(F.max(F.struct("edit_time", "label"))["label"].alias("__new"))
    out = alarms.join(last, "alarm_id", "left")
    return out.withColumn("label", F.coalesce("__new", "label")).drop("__new")


def save_labels(spark: SparkSession, path: str, edits: DataFrame) -> None:
    """Rewrite only the zone/date/hour partitions with edited alarms, each batch in its own folder.

    ``edits`` carry (zone, date, hour, alarm_id, label, edit_time). The new rows are written beside the store first, so
    that the partitions are not read and overwritten at once.
    """
    touched = edits.select(*PARTITIONS).distinct()
    store = _read(spark, path)
    changed = set_label(store.join(touched, PARTITIONS, "left_semi"), edits.select("alarm_id", "label", "edit_time"))
    staged = scratch_path(spark, "labels")
    changed.select(*store.columns).write.parquet(staged)
    _write(spark.read.parquet(staged), path, "overwrite")


def parse_label_list(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, label): the lines of a text without its outer white space."""
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    return texts.select(key, F.posexplode(F.split(trimmed, r"\r?\n")).alias("pos", "label"))


def decode_probabilities(col: str | Column) -> Column:
    """Map from JSON text, also if the text was encoded a second time as a JSON string."""
    text = F.col(col) if isinstance(col, str) else col
    inner = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]
    once = F.when(F.startswith(F.ltrim(text), F.lit('"')), inner).otherwise(text)
    return F.from_json(once, "map<string,double>")


# --- counts --------------------------------------------------------------------------------------------------------


def alarm_counts_hour(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n"))


def alarm_counts_rollup(alarms: DataFrame) -> DataFrame:
    """Counts per hour, date and zone; ``level`` is 0 for hours, 1 for dates, 3 for zones.

    Hours are counted first, so only one row per hour is expanded into the levels.
    """
    hours = alarm_counts_hour(alarms)
    out = hours.rollup(*PARTITIONS).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    return out.filter(F.col("zone").isNotNull())


def date_status(alarms: DataFrame, first: str, last: str) -> DataFrame:
    """Alarms of each zone on every date from ``first`` to ``last``, 0 where there are none."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    grid = alarms.select("zone").distinct().select("zone", days.alias("day"))
    grid = grid.select("zone", F.date_format("day", DATE_FORMAT).alias("date"))
    counts = alarms.groupBy("zone", "date").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["zone", "date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calendar_intensity(counts: DataFrame) -> DataFrame:
    """Colour strength of a calendar cell: the count, held between 10 and 255."""
    return counts.withColumn("intensity", F.greatest(F.lit(10), F.least(F.col("n"), F.lit(255))))


def non_empty_partitions(alarms: DataFrame) -> DataFrame:
    return alarms.select(*PARTITIONS).distinct()


# --- navigation ----------------------------------------------------------------------------------------------------


def first_alarm_of_date(alarms: DataFrame) -> DataFrame:
    """First alarm of each zone and date, in the order of hour and alarm: one pre-aggregated minimum."""
    first = F.min(F.struct("hour", "date_time", "alarm_id")).alias("f")
    return alarms.groupBy("zone", "date").agg(first).select("zone", "date", "f.hour", "f.alarm_id")


def first_alarm_of_hour(alarms: DataFrame) -> DataFrame:
    first = F.min(F.struct("date_time", "alarm_id")).alias("f")
    return alarms.groupBy(*PARTITIONS).agg(first).select(*PARTITIONS, "f.alarm_id")


def next_prev_alarm(alarms: DataFrame) -> DataFrame:
    """Neighbours of every alarm of a zone in time order; the last is followed by the first and vice versa."""
    micros = F.unix_micros("date_time")
    placed = number_rows(alarms.select("zone", "date_time", "alarm_id"), "zone", micros, ["alarm_id"], "place")
    ends = alarms.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(micros, "alarm_id"))["alarm_id"].alias("__first"),
        F.max(F.struct(micros, "alarm_id"))["alarm_id"].alias("__last"),
    )
    near = attach(with_halo(placed, "zone", "place", 1, 1), ends, "zone")
    w = block_window("zone", "place")
    near = near.withColumns({"__next": F.lead("alarm_id").over(w), "__prev": F.lag("alarm_id").over(w)})
    return core(near, "place").select(
        "zone",
        "alarm_id",
        F.coalesce("__next", "__first").alias("next_id"),
        F.coalesce("__prev", "__last").alias("prev_id"),
    )


def alarm_detail(alarms: DataFrame) -> DataFrame:
    """What the viewer shows of an alarm: title, label (``-`` if none) and probabilities."""
    title = F.concat_ws(" ", F.concat(F.lit("zone "), F.col("zone")), F.date_format("date_time", STAMP_FORMAT))
    return alarms.withColumns({"title": title, "label": F.coalesce("label", F.lit("-"))})
