"""Registered queries: curation, splits and batches of labelled series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorline.operators import curate
from tremorline.operators.curate import Dataset
from tremorline.operators.spectrum import FreqPreprocessing
from tremorline.plans import bindings as b
from tremorline.plans.registry import query
from tremorline.plans.signal_queries import SPEC

SEED = 42
DELETE = ["9"]
RENAME = {"1": "2", "2": "3"}


def dataset(spark, sf, part: int | None = None) -> Dataset:
    """The vectors as series; ``part`` 0 or 1 takes the even or odd ones and renumbers them."""
    vecs = b.vectors(spark, sf)
    if part is not None:
        vecs = vecs.filter(F.col("id") % 2 == part).withColumn("id", F.expr("id div 2"))
    signals = vecs.select("id", F.posexplode("samples").alias("time", "signal_raw"))
    signals = signals.withColumn("time", F.col("time").cast("long"))
    return Dataset(signals, vecs.select("id", F.col("label").cast("string").alias("label")))


def both(spark, sf) -> list[Dataset]:
    return [dataset(spark, sf, 0), dataset(spark, sf, 1)]


def summary(ds: Dataset):
    """(id, label, n, total): both tables of a dataset in one result."""
    sums = ds.signals.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("signal_raw").alias("total"))
    return b.rounded(ds.labels.join(sums, "id").select("id", "label", "n", "total"), "total")


BASE = """base AS (
  SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, len(embedding) AS n,
         list_sum([CAST(x AS DOUBLE) FOR x IN embedding]) AS total
  FROM embeddings)"""
JOINED = f"""{BASE}, shift AS (SELECT max(id // 2) + 1 AS s FROM base WHERE id % 2 = 0),
joined AS (
  SELECT CASE WHEN id % 2 = 0 THEN id // 2 ELSE id // 2 + s END AS id, label, n, total FROM base, shift)"""
FIELDS = "id, label, n, round(total, 6) AS total"


@query("concat_datasets", f"WITH {JOINED} SELECT {FIELDS} FROM joined")
def concat_datasets(spark, sf):
    return summary(curate.concat_datasets(both(spark, sf)))


@query("drop_classes", f"WITH {BASE} SELECT {FIELDS} FROM base WHERE label <> '9'")
def drop_classes(spark, sf):
    return summary(curate.drop_classes(dataset(spark, sf), DELETE))


RENAMED = "CASE WHEN label IN ('1', '2') THEN '3' ELSE label END"


@query("rename_classes", f"WITH {BASE} SELECT id, {RENAMED} AS label, n, round(total, 6) AS total FROM base")
def rename_classes(spark, sf):
    return summary(curate.rename_classes(dataset(spark, sf), RENAME))


@query("densify_ids", f"""WITH {BASE}
SELECT row_number() OVER (ORDER BY id) - 1 AS id, label, n, round(total, 6) AS total FROM base WHERE label <> '9'""")
def densify_ids(spark, sf):
    return summary(curate.densify_ids(curate.drop_classes(dataset(spark, sf), DELETE)))


@query("downsample_classes", f"""WITH {BASE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM base)
SELECT {FIELDS} FROM ranked WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM base GROUP BY label))""")
def downsample_classes(spark, sf):
    return summary(curate.downsample_classes(dataset(spark, sf)))


@query("curate_dataset", f"""WITH {JOINED}, dense AS (
  SELECT row_number() OVER (ORDER BY id) - 1 AS id, {RENAMED} AS label, n, total FROM joined WHERE label <> '9'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM dense)
SELECT {FIELDS} FROM ranked WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM dense GROUP BY label))""")
def curate_dataset(spark, sf):
    joiner = curate.LongJoiner(DELETE, RENAME, downsample=True)
    return summary(joiner.concat(both(spark, sf)))


@query("class_counts", f"WITH {BASE} SELECT label, count(*) AS n FROM base GROUP BY label")
def class_counts(spark, sf):
    return curate.class_counts(b.class_labels(spark, sf))


@query("label_index_sorted", f"""WITH {BASE}
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_idx FROM (SELECT DISTINCT label FROM base)""")
def label_index_sorted(spark, sf):
    return curate.label_index_sorted(b.class_labels(spark, sf))


@query("label_index_seen", f"""WITH {BASE}
SELECT label, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS class_idx
FROM (SELECT label, min(id) AS first FROM base GROUP BY label)""")
def label_index_seen(spark, sf):
    return curate.label_index_seen(b.class_labels(spark, sf))


@query("sample_series", f"""WITH {BASE}, chosen AS (
  SELECT id FROM base ORDER BY md5(id || ':{SEED}'), id LIMIT 20)
SELECT v.id, t - 1 AS time, round(CAST(e.embedding[t] AS DOUBLE), 6) AS signal_raw
FROM chosen v JOIN embeddings e ON e.vec_id = v.id, LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS t) t""")
def sample_series(spark, sf):
    return b.rounded(curate.sample_series(dataset(spark, sf), 20, SEED), "signal_raw")


@query("spectra_by_class", f"""WITH {SPEC}
SELECT 'c' || (id % 5) AS label, freq_num, count(*) AS n, round(avg(signal_binned_fft), 6) AS mean,
       round(min(signal_binned_fft), 6) AS lowest, round(max(signal_binned_fft), 6) AS highest
FROM spec GROUP BY 1, 2""")
def spectra_by_class(spark, sf):
    sig = b.signal(spark, sf)
    spec = FreqPreprocessing(n_bins=10, fs=1000).transform(sig)
    return b.rounded(curate.spectra_by_class(spec, b.signal_labels(sig)), "mean", "lowest", "highest")


RANKED = f"""{BASE}, ranked AS (
  SELECT id, row_number() OVER (ORDER BY md5(id || ':{SEED}'), id) - 1 AS r, count(*) OVER () AS n FROM base)"""


@query("split_train_test", f"""WITH {RANKED}
SELECT id, CASE WHEN r >= n - ceil(0.25 * n) THEN 'test' ELSE 'train' END AS split FROM ranked""")
def split_train_test(spark, sf):
    return curate.split_train_test(b.class_labels(spark, sf), SEED)


THREE = f"""{RANKED}, three AS (
  SELECT id, r, CASE WHEN r < floor(0.7 * n) THEN 'train' WHEN r < floor(0.7 * n) + floor(0.15 * n) THEN 'validation'
                     ELSE 'test' END AS split FROM ranked)"""


@query("split_3way", f"WITH {THREE} SELECT id, split FROM three")
def split_3way(spark, sf):
    return curate.split_3way(b.class_labels(spark, sf), SEED)


@query("batch_ids", f"""WITH {THREE}, placed AS (
  SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY r) - 1 AS place FROM three)
SELECT split, place // 8 AS batch_no, list(id ORDER BY place) AS ids FROM placed GROUP BY split, place // 8""")
def batch_ids(spark, sf):
    return curate.batch_ids(b.class_labels(spark, sf), SEED)


@query("series_tensor", f"""WITH {b.SIG}, sizes AS (SELECT id, count(*) AS n FROM sig GROUP BY id),
outs AS (SELECT id, n, unnest(range(0, 30)) AS pos FROM sizes),
pooled AS (
  SELECT o.id, o.pos, round(avg(s.signal_raw), 6) AS v
  FROM outs o JOIN sig s ON s.id = o.id AND s.time >= (o.pos * o.n) // 30 AND s.time < ((o.pos + 1) * o.n + 29) // 30
  GROUP BY o.id, o.pos),
classes AS (
  SELECT label, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS class_idx
  FROM (SELECT 'c' || (id % 5) AS label, min(id) AS first FROM sig GROUP BY 1))
SELECT p.id, list(p.v ORDER BY p.pos) AS signal, any_value(c.class_idx) AS class_idx
FROM pooled p JOIN classes c ON c.label = 'c' || (p.id % 5) GROUP BY p.id""")
def series_tensor(spark, sf):
    sig = b.signal(spark, sf)
    out = curate.series_tensor(Dataset(sig, b.signal_labels(sig)), 30)
    return out.withColumn("signal", F.transform("signal", lambda v: b.rounded_value(v)))
