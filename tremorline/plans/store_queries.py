"""Registered queries: the alarm store, its labels, counts and navigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorline.operators import store
from tremorline.plans import bindings as b
from tremorline.plans.registry import query
from tremorline.session import scratch_path


def alarms(spark, sf):
    return store.alarm_path_parts(b.alarms(spark, sf))


@query("alarm_path_parts", f"""WITH {b.ALARMS}
SELECT alarm_id, date, hour, zone || '_' || strftime(date_time, '%Y_%m_%d_%H') || '_00_00_000' AS file_name,
       strftime(date_time, '%d/%m/%Y %H:%M:%S') AS stamp FROM alarms""")
def alarm_path_parts(spark, sf):
    return alarms(spark, sf).select("alarm_id", "date", "hour", "file_name", "stamp")


@query("hour_ring_buffer", f"""WITH {b.ALARMS}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY zone, date, hour ORDER BY date_time DESC, alarm_id DESC) AS r FROM alarms)
SELECT zone, date, hour, alarm_id, printf('alarm %05d', row_number()
       OVER (PARTITION BY zone, date, hour ORDER BY date_time, alarm_id)) AS alarm_name
FROM kept WHERE r <= 250""")
def hour_ring_buffer(spark, sf):
    """Written to a store in two batches with retention, the last day after the others, and read back from it."""
    path = scratch_path(spark, "ring")
    write = store.sink_batch(path, store.MAX_ALARMS)
    base = b.alarms(spark, sf).select("zone", "date_time", "alarm_id", "label", "value")
    last = base.select((F.max("date_time") - F.expr("INTERVAL 1 DAY")).alias("t")).first()["t"]
    for batch, some in enumerate((F.col("date_time") <= F.lit(last), F.col("date_time") > F.lit(last))):
        write(base.filter(some), batch)
    out = store.hour_ring_buffer(store.read_store(spark, path))
    return out.select("zone", "date", "hour", "alarm_id", "alarm_name")


EDITS = """edits AS (
  SELECT event_id AS alarm_id, 'wind' AS label, ts AS edit_time FROM events WHERE value > 50
  UNION ALL SELECT event_id, 'saw', ts + INTERVAL 1 HOUR FROM events WHERE value > 75)"""


@query("set_label", f"""WITH {b.ALARMS}, {EDITS}
SELECT a.alarm_id, a.zone, coalesce(e.label, a.label) AS label FROM alarms a
LEFT JOIN (SELECT alarm_id, arg_max(label, edit_time) AS label FROM edits GROUP BY alarm_id) e USING (alarm_id)""")
def set_label(spark, sf):
    base = b.alarms(spark, sf)
    edit = base.select("alarm_id", F.lit("wind").alias("label"), F.col("date_time").alias("edit_time"))
    edits = edit.filter(base["value"] > 50).unionByName(
        base.filter("value > 75").select(
            "alarm_id", F.lit("saw").alias("label"), (F.col("date_time") + F.expr("INTERVAL 1 HOUR")).alias("edit_time")
        )
    )
    return store.set_label(base, edits).select("alarm_id", "zone", "label")


@query("parse_label_list", r"""SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS label
FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r?\n') AS l FROM documents)""")
def parse_label_list(spark, sf):
    return store.parse_label_list(b.table(spark, sf, "documents"), "doc_id", "text")


@query("decode_probabilities", """SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS share
FROM events""")
def decode_probabilities(spark, sf):
    events = b.table(spark, sf, "events").select("event_id", "props")
    # every second map is encoded twice
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(quoted)
    return events.select("event_id", F.explode(store.decode_probabilities(text)).alias("name", "share"))


@query("alarm_counts_hour", f"WITH {b.ALARMS} SELECT zone, date, hour, count(*) AS n FROM alarms GROUP BY ALL")
def alarm_counts_hour(spark, sf):
    return store.alarm_counts_hour(alarms(spark, sf))


@query("alarm_counts_rollup", f"""WITH {b.ALARMS}
SELECT zone, date, hour, count(*) AS n, grouping_id(zone, date, hour) AS level
FROM alarms GROUP BY ROLLUP (zone, date, hour) HAVING zone IS NOT NULL""")
def alarm_counts_rollup(spark, sf):
    return store.alarm_counts_rollup(alarms(spark, sf))


DATES = f"""{b.ALARMS}, status AS (
  SELECT g.zone, g.date, count(a.alarm_id) AS n
  FROM (SELECT zone, strftime(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-05', INTERVAL 1 DAY)), '%Y_%m_%d') AS date
        FROM (SELECT DISTINCT zone FROM alarms)) g
  LEFT JOIN alarms a ON a.zone = g.zone AND a.date = g.date GROUP BY g.zone, g.date)"""


def status(spark, sf):
    return store.date_status(alarms(spark, sf), "2023-12-30", "2024-02-05")


@query("date_status", f"WITH {DATES} SELECT zone, date, n FROM status")
def date_status(spark, sf):
    return status(spark, sf)


@query("calendar_intensity", f"WITH {DATES} SELECT zone, date, n, greatest(10, least(n, 255)) AS intensity FROM status")
def calendar_intensity(spark, sf):
    return store.calendar_intensity(status(spark, sf))


@query("first_alarm_of_date", f"""WITH {b.ALARMS}
SELECT zone, date, hour, alarm_id FROM alarms
QUALIFY row_number() OVER (PARTITION BY zone, date ORDER BY hour, date_time, alarm_id) = 1""")
def first_alarm_of_date(spark, sf):
    return store.first_alarm_of_date(alarms(spark, sf))


@query("first_alarm_of_hour", f"""WITH {b.ALARMS}
SELECT zone, date, hour, alarm_id FROM alarms
QUALIFY row_number() OVER (PARTITION BY zone, date, hour ORDER BY date_time, alarm_id) = 1""")
def first_alarm_of_hour(spark, sf):
    return store.first_alarm_of_hour(alarms(spark, sf))


@query("next_prev_alarm", f"""WITH {b.ALARMS}
SELECT zone, alarm_id, coalesce(lead(alarm_id) OVER w, first_value(alarm_id) OVER (PARTITION BY zone ORDER BY date_time, alarm_id)) AS next_id,
       coalesce(lag(alarm_id) OVER w, first_value(alarm_id) OVER (PARTITION BY zone ORDER BY date_time DESC, alarm_id DESC)) AS prev_id
FROM alarms WINDOW w AS (PARTITION BY zone ORDER BY date_time, alarm_id)""")
def next_prev_alarm(spark, sf):
    return store.next_prev_alarm(b.alarms(spark, sf))


@query("non_empty_partitions", f"WITH {b.ALARMS} SELECT DISTINCT zone, date, hour FROM alarms")
def non_empty_partitions(spark, sf):
    return store.non_empty_partitions(alarms(spark, sf))


@query("alarm_detail", f"""WITH {b.ALARMS}
SELECT alarm_id, 'zone ' || zone || ' ' || strftime(date_time, '%d/%m/%Y %H:%M:%S') AS title,
       CASE WHEN label = 'error' THEN '-' ELSE label END AS label, CAST(json_extract(props, '$.k') AS DOUBLE) AS k
FROM alarms""")
def alarm_detail(spark, sf):
    base = b.alarms(spark, sf).withColumn("label", F.nullif("label", F.lit("error")))
    out = store.alarm_detail(base)
    return out.select("alarm_id", "title", "label", store.decode_probabilities("props")["k"].alias("k"))
