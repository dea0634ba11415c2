"""Importance resampling towards a target: hashed features, log-ratio gains, a cutoff by counting, ranks by ranges."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.common import prefix_sums, table, text_of
from tremorline.llm.registry import query
from tremorline.session import materialize

BUCKETS = 10_000
SEED = 2024
MIN_WORDS, PERCENT = 20, 10

PROBES = 15  # thresholds counted by one job, which narrows the range to a sixteenth
KNOWN = 500_000  # features whose bucket a task remembers

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


class Buckets(dict):
    """The bucket of each feature (bytes), remembered for those seen last."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.n
        return bucket

    def of(self, text: bytes, runs: int) -> np.ndarray:
        """The bucket of every run of 1 to ``runs`` words of a text, repeats included."""
        words = WORDS.findall(text.translate(LOWER))
        features = list(words)
        for n in range(2, runs + 1):
            features += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        return np.fromiter(map(self.__getitem__, features), dtype=np.int64, count=len(features))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = 1) -> np.ndarray:
    """Features per bucket in the texts; each task sends one row per bucket, the driver gets ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch[0].to_pylist():
                out += np.bincount(known.of(text, runs), minlength=buckets)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used])], names=["bucket", "n"])

    counted = texts.select(text_of().cast("binary")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: a thousand times the log-ratio of its smoothed share in the target to that in the corpus, floored."""
    n = len(corpus)
    ratio = (target + 1.0) * float(corpus.sum() + n) / ((corpus + 1.0) * float(target.sum() + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a hash of the document's id."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, runs: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; ``gain`` is an array of one number per bucket."""
    where = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, known = where.value, Buckets(len(where.value))
        for batch in batches:
            ids = batch[0].to_pylist()
            words, sizes, weights = [], [], []
            for text in batch[1].to_pylist():
                found = known.of(text, runs)
                words.append(len(WORDS.findall(text.translate(LOWER))) if runs > 1 else len(found))
                sizes.append(len(found))
                weights.append(int(value[found].sum()))
            scores = [w + noise(i, seed) for i, w in zip(ids, weights)]
            columns = [batch[0], *(pa.array(c, pa.int64()) for c in (words, sizes, weights, scores))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return read.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def largest_with(rows: DataFrame, value: Column, wanted: int) -> int | None:
    """The largest whole number c for which at least ``wanted`` rows have ``value`` >= c; None if no c has.

    Bisection: each round is one exact count of the rows at several thresholds, which are then the new bounds.
    """
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < wanted or n == 0:
        return None
    while low < high:
        cuts = sorted({low + (high - low) * k // (PROBES + 1) + 1 for k in range(PROBES + 1)} | {high})
        counts = rows.agg(*[F.count(F.when(value >= c, 1)).alias(str(c)) for c in cuts]).first()
        enough = [c for c, k in zip(cuts, counts) if k >= wanted]
        fewer = [c for c, k in zip(cuts, counts) if k < wanted]
        low = max(enough, default=low)
        high = min(fewer, default=high + 1) - 1
    return low


def draw(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add ``rank`` (1, 2, ...) to the ``percent`` of the rows of ``min_words`` words or more with the highest scores.

    ``scored`` must be a stored table with a column ``row`` that no two rows share. Equal scores go to the smaller doc_id,
    null ones last, then to fewer features, then to the smaller ``row`` (such rows differ in nothing that is returned).
    """
    able = F.col("n_words") >= min_words
    rows = scored.filter(able)
    wanted = percent * rows.count() // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cutoff = largest_with(rows, F.col("score"), wanted)
    tied = rows.filter(F.col("score") == cutoff)
    left = wanted - rows.filter(F.col("score") > cutoff).count()
    lowest = largest_with(tied, -F.col("doc_id"), left)
    # where the ids do not suffice, rows without one compete too
    first = F.lit(True) if lowest is None else F.coalesce(-F.col("doc_id") >= lowest, F.lit(False))
    chosen = F.coalesce(able & ((F.col("score") > cutoff) | ((F.col("score") == cutoff) & first)), F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    ranked = prefix_sums(scored.filter(chosen), [], order, F.lit(1), "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    return ranked.union(scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    runs: int = 1,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; drawn rows have a rank.

    Null and empty texts have no features and weight 0; null ids have the noise of an empty name and come last among
    ties; repeated rows are drawn each; an empty table gives no rows, an empty target only smoothed gains; other columns
    are ignored. Two passes over the texts (bucket counts, scores); everything later reads the stored scores.
    """
    gain = gains(bucket_counts(docs, buckets, runs), bucket_counts(target, buckets, runs))
    scored = score_documents(docs, gain, runs, seed).withColumn("row", F.monotonically_increasing_id())
    drawn = draw(materialize(scored, "scores"), min_words, percent)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLE_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0],
              lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(0, 256) t(i)),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
goals AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
used AS (SELECT row, unnest(words) AS w FROM docs),
known AS (SELECT DISTINCT w, hex(w) AS h FROM (SELECT w FROM used UNION ALL SELECT w FROM goals)),
bytes AS (
  SELECT w, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b
  FROM known),
bucket AS (
  SELECT w, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)
            % 10000 AS k
  FROM bytes, crc),
source AS (SELECT k, count(*) AS n FROM used JOIN bucket USING (w) GROUP BY k),
target AS (SELECT k, count(*) AS n FROM goals JOIN bucket USING (w) GROUP BY k),
gain AS (
  SELECT k, CAST(floor(1000 * ln(
           (coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM source), 0) + 10000)::DOUBLE
         / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM target), 0) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM source s FULL JOIN target t USING (k)),
weights AS (
  SELECT row, CAST(sum(g) AS BIGINT) AS weight FROM used JOIN bucket USING (w) JOIN gain USING (k) GROUP BY row),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(
           sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT)
           AS score
  FROM docs LEFT JOIN weights USING (row)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r,
         10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS wanted
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= wanted THEN r END AS rank FROM ranked"""


@query("op12_importance_resampling", RESAMPLE_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
