"""Substring deduplication: runs of several consecutive sentences that occurred before, anywhere in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.common import table, text_of
from tremorline.llm.registry import query
from tremorline.llm.words import BASE, INVERSE, Chunk, chunks, mix

# A run is the shortest one with that many sentences and words, from each sentence on and back from each sentence.
SENTENCES, WORDS = 2, 20

_up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(1 << 18, BASE, dtype=np.uint64)])
_down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(1 << 18, INVERSE, dtype=np.uint64)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) <= n:
        _up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, BASE, dtype=np.uint64)])
        _down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, INVERSE, dtype=np.uint64)])
    return _up, _down


class Sentences:
    """Sentences of a chunk of texts: words up to one that ends in . ! or ?, to a line break or to the end of the text.

    ``begin`` and ``stop`` are word numbers, ``doc`` the text, ``number`` the sentence's number in it.
    """

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        n = len(chunk.start)
        lines = np.r_[0, np.cumsum(chunk.raw == 10)]
        last = np.zeros(n, dtype=bool)
        if n:
            last = np.isin(chunk.raw[chunk.end - 1], np.frombuffer(b".!?", np.uint8))
            last[:-1] |= (chunk.doc[1:] != chunk.doc[:-1]) | (lines[chunk.start[1:]] > lines[chunk.end[:-1]])
            last[-1] = True
        self.stop = np.flatnonzero(last) + 1
        self.begin = np.r_[0, self.stop[:-1]][: len(self.stop)]
        self.doc = chunk.doc[self.begin] if n else np.zeros(0, dtype=np.int64)
        self.counts = np.bincount(self.doc, minlength=chunk.last - chunk.first)
        self.number = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first sentence, last sentence) of the shortest runs forth and back from every sentence, each once."""
        m = len(self.begin)
        at = np.arange(m)
        forth = np.maximum(at + SENTENCES - 1, np.searchsorted(self.stop, self.begin + WORDS, "left"))
        back = np.minimum(at - SENTENCES + 1, np.searchsorted(self.begin, self.stop - WORDS, "right") - 1)
        a, b = np.r_[at, back], np.r_[forth, at]
        real = (a >= 0) & (b < m)
        a, b = a[real], b[real]
        real = self.doc[a] == self.doc[b]
        code = np.unique(a[real] * max(m, 1) + b[real])
        a, b = np.divmod(code, max(m, 1))
        words = self.chunk.words()
        up, down = _powers(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        x, y = self.begin[a], self.stop[b]
        return mix((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64)), a, b


def sentence_runs(docs: DataFrame) -> DataFrame:
    """(run, doc_id, tie, first, last, again): every run of every text; ``again``: the text had it before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"]):
                own = Sentences(chunk)
                run, a, b = own.runs()
                doc = own.doc[a]
                order = np.lexsort((a, run, doc))
                run, a, b, doc = run[order], a[order], b[order], doc[order]
                again = np.zeros(len(run), dtype=bool)
                again[1:] = (run[1:] == run[:-1]) & (doc[1:] == doc[:-1])
                rows = pa.array(doc + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(run.view(np.int64)), batch["doc_id"].take(rows), batch["tie"].take(rows),
                        pa.array(own.number[a].astype(np.int32)), pa.array(own.number[b].astype(np.int32)), pa.array(again),
                    ],
                    names=["run", "doc_id", "tie", "first", "last", "again"],
                )

    return docs.mapInArrow(find, "run long, doc_id long, tie long, first int, last int, again boolean")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, text: one row per row of ``docs``, without the sentences of any repeated run.

    The run in the smallest doc_id (null last), there the first, is the one that stays. Rows of one doc_id do not remove
    each other's sentences, and equal rows fare equally. Null texts are empty; texts shorter than a run stay as they are;
    what stays of a text keeps its spaces and lines. An empty table gives no rows; other columns are ignored.

    Runs are counted with map-side combine and joined back by their hash; a run in very many documents is one row on the
    smaller side of that join, so its partition can be split.
    """
    nowhere = F.lit(2**63 - 1)
    plain = docs.select(
        F.col("doc_id").cast("long"), text_of().alias("text"), F.xxhash64(text_of()).alias("tie"),
        F.coalesce(F.col("doc_id").cast("long"), nowhere).alias("at"),
    )
    runs = sentence_runs(plain.select(F.col("at").alias("doc_id"), "tie", "text"))
    seen = runs.filter(~F.col("again")).groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    repeated = seen.filter("low < high").select("run", "low")
    later = runs.filter(~F.col("again")).join(repeated, "run").filter("doc_id > low")
    covered = later.select("doc_id", "tie", "first", "last").union(
        runs.filter("again").select("doc_id", "tie", "first", "last")
    )
    span = F.struct("first", "last")
    marks = covered.distinct().groupBy(F.col("doc_id").alias("at"), "tie").agg(F.collect_list(span).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [np.zeros(0, dtype=np.int64)], []
            for chunk in chunks(batch["text"]):
                own = Sentences(chunk)
                counts.append(own.counts)
                ends = np.cumsum(own.counts)
                for k in range(chunk.last - chunk.first):
                    spans = batch["spans"][chunk.first + k]
                    raw = chunk.raw[chunk.edges[k] : chunk.edges[k + 1]]
                    gone = np.zeros(own.counts[k] + 1, dtype=np.int64)
                    if spans.is_valid:
                        for s in spans.values.to_pylist():
                            gone[s["first"]] += 1
                            gone[s["last"] + 1] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    if gone.any():
                        base = ends[k] - own.counts[k]
                        starts = chunk.start[own.begin[base : ends[k]]] - chunk.edges[k]
                        sizes = np.diff(np.r_[starts, len(raw)])
                        raw = raw[np.r_[np.ones(starts[0], dtype=bool), np.repeat(~gone, sizes)]]
                    texts.append(raw.tobytes())
                    removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(np.concatenate(counts)), pa.array(removed, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_sentences", "n_removed", "text"],
            )

    joined = plain.join(marks, ["at", "tie"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, text string")


@query("op4_repeated_spans")
def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences that stood in an earlier span."""
    return without_repeats(table(spark, sf_dir, "documents"))
