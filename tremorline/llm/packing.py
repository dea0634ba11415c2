"""Best-fit packing of token sequences: patterns fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.llm.common import table, text_of
from tremorline.llm.registry import query
from tremorline.session import materialize

CAPACITY = 1024
END_ID = 2
ROUNDS = 400
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, place long"


class ByteTokenizer:
    """Ids of the byte-level vocabulary: merges by rank; the few texts that need it go through the JSON model."""

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken"):
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks_name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(json_name))

    def ids(self, text: str) -> list[int]:
        # a special token written in a text is one id; the rank files know no special tokens
        if SPECIAL in text:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut those above ``capacity``: the first piece takes the remainder, the others are full.

    ``place`` numbers the pieces of one length within their task (``pid``).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer()
        pid = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                ids = tokenizer.ids(text)
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4").tobytes()
                n = len(ids)
                a, b, k = 0, (n - 1) % capacity + 1, 0
                while a < n:
                    out.append((doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), pid, seen[b - a]))
                    seen[b - a] += 1
                    a, b, k = b, b + capacity, k + 1
            columns = list(zip(*out)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, PIECES)


def patterns(counts: np.ndarray) -> np.ndarray:
    """All multisets of one, two or three present lengths that fill a sequence; unused places hold 0."""
    capacity = len(counts) - 1
    present = np.flatnonzero(counts)
    rows = [np.array([[capacity, 0, 0]])] if counts[capacity] else []
    pairs = present[(2 * present <= capacity)]
    pairs = pairs[counts[capacity - pairs] > 0]
    rows.append(np.stack([pairs, capacity - pairs, 0 * pairs], 1))
    for a in present[3 * present <= capacity]:
        b = present[(present >= a) & (2 * present <= capacity - a)]
        b = b[counts[capacity - a - b] > 0]
        rows.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(rows).astype(np.int64)


def fit_counts(found: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x of the patterns with the least squared error of A x = counts.

    Errors weigh as the length, since a long piece that is left over opens a sequence of its own and short ones fill gaps.
    Accelerated projected gradient; A has at most three entries per pattern and is never formed.
    """
    target = counts.astype(float).copy()
    target[0] = 0.0
    weight = (np.arange(len(counts)) / (len(counts) - 1)) ** 2
    x = np.zeros(len(found))
    if not len(found):
        return x

    def apply(v: np.ndarray) -> np.ndarray:
        out = np.bincount(found.ravel(), np.repeat(v, 3), len(counts))
        out[0] = 0.0
        return out

    probe = np.ones(len(found))
    for _ in range(30):
        probe = (weight * apply(probe))[found].sum(1)
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1.0 / (1.05 * norm)
    y, t = x, 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - step * (weight * (apply(y) - target))[found].sum(1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Pack the remaining pieces, longest first, into the fullest sequences that take them: (pattern, repeats).

    Works on the histogram: sequences with equal content are one entry with a count, so the work depends on the number
    of different lengths and not on the number of pieces.
    """
    capacity = len(left) - 1
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        room = length
        while todo and room < capacity:
            bins = open_bins.get(room)
            if not bins:
                room += 1
                continue
            content, n = next(iter(bins.items()))
            each = min(room // length, todo)
            use = min(n, todo // each)
            bins[content] -= use
            if not bins[content]:
                del bins[content]
            to = open_bins.setdefault(room - each * length, {})
            grown = content + (length,) * each
            to[grown] = to.get(grown, 0) + use
            todo -= each * use
        each = capacity // length
        for size, n in ((each, todo // each), (todo % each, 1)):
            if size and n:
                to = open_bins.setdefault(capacity - size * length, {})
                to[(length,) * size] = to.get((length,) * size, 0) + n
    return [(content, n) for bins in open_bins.values() for content, n in bins.items()]


def pack_plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold exactly ``counts[n]`` pieces of each length n.

    Fitted counts are rounded down and limited to the pieces there are; what is left is packed best-fit.
    """
    found = patterns(counts)
    x = fit_counts(found, counts)
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan = []
    for i in np.argsort(-x, kind="stable"):
        n = int(x[i] + 1e-6)
        if n < 1:
            break
        row = [int(v) for v in found[i] if v]
        n = min(n, *(int(left[v]) // row.count(v) for v in row))
        if n > 0:
            for v in row:
                left[v] -= n
            plan.append((tuple(row), n))
    return plan + best_fit(left)


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, place in it), one for each position of each pattern."""
    out: dict[int, list] = {}
    ranks = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for content, n in plan:
        offset = 0
        for length in content:
            out.setdefault(length, []).append((ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Empty and null texts are the end token alone; repeated
    rows are packed each; null doc_ids are kept; an empty table gives no rows; other columns are ignored. The driver sees
    the histogram of at most ``capacity`` lengths only; the plan it makes has a bounded number of patterns, whatever the
    number of documents, and is sent to the tasks. Pieces find their place by their number among those of equal length.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, capacity, end_id), "pieces")
    per_task = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    where = spark.sparkContext.broadcast(slots(pack_plan(counts), capacity))
    earlier = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = pieces.join(shift, ["pid", "length"]).withColumn("rank", F.col("place") + F.col("before"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = where.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                slot = at[int(k)]
                i = np.searchsorted(slot[:, 0], rank[rows], "right") - 1
                sequence[rows] = slot[i, 1] + rank[rows] - slot[i, 0]
                offset[rows] = slot[i, 2]
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, schema)


@query("op6_pack_documents")
def op6_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
