"""Near-duplicate texts: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.llm.common import table, text_of
from tremorline.llm.components import components
from tremorline.llm.registry import query
from tremorline.llm.words import BASE, Chunk, chunks, mix
from tremorline.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
# Words in fewer than this share of the documents all have the largest weight, so the table of weights is bounded: at
# most (mean distinct words per document) / share entries, and the share is raised where that would exceed TABLE_ROWS.
RARE_SHARE, TABLE_ROWS = 1e-3, 250_000
# Leaves of one verification task group, and documents of one block of a bucket.
LEAVES, BLOCK = 256, 128

DRAWS = 1 << 16
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def _draw_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed random variates: gamma(2, 1), log of gamma(2, 1), uniform."""
    rng = np.random.default_rng(7)
    r = rng.gamma(2.0, 1.0, DRAWS)
    return r.astype(np.float32), np.log(rng.gamma(2.0, 1.0, DRAWS)).astype(np.float32), rng.random(DRAWS, np.float32)


class Weights:
    """Inverse document frequencies between 1 (a word of all documents) and 2 (a rare one)."""

    def __init__(self, words: np.ndarray, share: np.ndarray, floor: float):
        order = np.argsort(words)
        self.words = words[order]
        self.weight = 1.0 + np.log(np.clip(share[order], floor, 1.0)) / np.log(floor)

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), 2.0)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.weight[at], 2.0)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(word, df): in how many documents a word (its hash) occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.zeros(0, dtype=np.uint64)]
            for chunk in chunks(batch[0]):
                words = chunk.words()
                distinct, code = np.unique(words, return_inverse=True)
                pairs = np.unique(chunk.doc * max(len(distinct), 1) + code)
                seen.append(distinct[pairs % max(len(distinct), 1)])
            words, df = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(df)], names=["word", "df"])

    counted = docs.select(text_of().alias("text")).mapInArrow(count, "word long, df long")
    return counted.groupBy("word").agg(F.sum("df").alias("df"))


def word_weights(docs: DataFrame, share: float = RARE_SHARE, most: int = TABLE_ROWS) -> Weights:
    """Document frequencies over all documents; the driver receives the common words only, at most ``most``."""
    found = materialize(document_frequencies(docs), "frequencies")
    n = docs.count()
    total = found.agg(F.sum("df")).first()[0] or 0
    floor = min(max(share, total / (max(n, 1) * most)), 0.5)
    common = found.filter(F.col("df") >= floor * n).toArrow()
    words, df = common["word"].to_numpy().view(np.uint64), common["df"].to_numpy()
    return Weights(words, df / max(n, 1), floor)


def weighted_shingles(chunk: Chunk, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted by text and shingle: the count in the text times the mean weight of its words."""
    shingle, doc, first = chunk.shingles(SHINGLE)
    idf = np.r_[0.0, np.cumsum(weights.of(chunk.words()))]
    last = np.minimum(first + SHINGLE, np.cumsum(chunk.counts)[doc]) if len(doc) else first
    unit = (idf[last] - idf[first]) / np.maximum(last - first, 1)
    order = np.lexsort((shingle, doc))
    shingle, doc, unit = shingle[order], doc[order], unit[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    # single precision makes equal shingles weigh the same wherever they stand in a text
    return doc[at], shingle[at], (np.diff(np.r_[at, len(doc)]) * unit[at].astype(np.float32)).astype(np.float32)


def band_keys(chunk: Chunk, weights: Weights, tables: tuple) -> np.ndarray:
    """Improved consistent weighted sampling: one row of band keys per text that has words, in the order of the texts.

    Every sample is the shingle with the smallest log a = log c - r (t - beta) - r, where t = floor(log w / r + beta),
    together with its t; two texts share a sample with the probability of their weighted Jaccard similarity.
    """
    doc, shingle, weight = weighted_shingles(chunk, weights)
    if not len(doc):
        return np.zeros((0, BANDS), dtype=np.uint64)
    gamma, log_c, beta = tables
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    log_w = np.log(weight)
    row = np.arange(len(doc), dtype=np.uint64)
    keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        z = shingle * _FACTORS[k]
        z ^= z >> np.uint64(29)
        r = gamma[z & np.uint64(0xFFFF)]
        b = beta[(z >> np.uint64(16)) & np.uint64(0xFFFF)]
        t = np.floor(log_w / r + b)
        log_a = log_c[(z >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - b) - r
        bits = log_a.view(np.uint32)  # made to sort as the floats do
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        best = np.minimum.reduceat((bits << np.uint64(32)) | row, starts) & np.uint64(0xFFFFFFFF)
        sample = mix(shingle[best] + t[best].astype(np.int64).view(np.uint64) * np.uint64(BASE))
        band = k // ROWS
        keys[:, band] = keys[:, band] * np.uint64(BASE) + sample
    return mix(keys)


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, digest, bands): the MD5 of the text and its band keys, null where the text has no words."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _draw_tables()
        for batch in batches:
            keys, counts = [np.zeros((0, BANDS), dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for chunk in chunks(batch["text"]):
                keys.append(band_keys(chunk, held.value, tables))
                counts.append(chunk.counts)
            some = np.concatenate(counts) > 0
            ends = np.r_[0, np.cumsum(some) * BANDS]
            flat = pa.array(np.concatenate(keys).ravel().view(np.int64))
            mask = pa.array(np.r_[~some, False]) if len(some) else None
            offsets = pa.array(ends, pa.int32(), mask=mask.to_numpy(zero_copy_only=False)) if mask else pa.array(ends, pa.int32())
            bands = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], bands], names=["doc_id", "digest", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), digest().alias("digest"), text_of().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, digest binary, bands array<long>")


def digest():
    return F.unhex(F.md5(text_of().cast("binary")))


def _sparse(texts: pa.Array, weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for chunk in chunks(texts):
        doc, shingle, weight = weighted_shingles(chunk, weights)
        cut = np.searchsorted(doc, np.arange(chunk.last - chunk.first + 1))
        out += [(shingle[a:b], weight[a:b].astype(float)) for a, b in zip(cut[:-1], cut[1:])]
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two sorted sparse vectors; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - both
    return float(both / whole) if whole > 0 else 0.0


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar. A text with many partners ``b`` is repeated per LEAVES."""
    held = pairs.sparkSession.sparkContext.broadcast(weights)
    stars = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / LEAVES).cast("int").alias("parts"))
    centres = stars.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    centres = centres.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    leaves = pairs.join(stars, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    leaves = leaves.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    both = leaves.select("a", "b", "part", "text_a").join(centres.select("b", "part", "text_b"), ["b", "part"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _sparse(batch["text_a"], held.value), _sparse(batch["text_b"], held.value)
            good = pa.array([weighted_jaccard(x, y) >= similarity for x, y in zip(left, right)], pa.bool_())
            kept = pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"])
            yield kept.filter(good)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(test, "a binary, b binary")


def _block_edges(blocks: list[tuple], similarity: float, same: bool) -> list[tuple[bytes, bytes]]:
    """Links that join different components among the documents of two blocks (or of one)."""
    left, right = blocks[0], blocks[-1]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shingle = np.concatenate([x[0] for x in right[2]] + [np.zeros(0, dtype=np.uint64)])
    weight = np.concatenate([x[1] for x in right[2]] + [np.zeros(0)])
    owner = np.repeat(np.arange(len(right[2])), [len(x[0]) for x in right[2]])
    order = np.argsort(shingle, kind="stable")
    shingle, weight, owner = shingle[order], weight[order], owner[order]
    total = np.array([x[1].sum() for x in right[2]])
    out = []
    for i, (s, w) in enumerate(left[2]):
        a, b = np.searchsorted(shingle, s, "left"), np.searchsorted(shingle, s, "right")
        n = b - a
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        shared = np.bincount(owner[at], np.minimum(weight[at], np.repeat(w, n)), len(total))
        close = shared >= similarity * (total + w.sum() - shared)
        for j in np.flatnonzero(close & (shared > 0)):
            if same and j <= i:
                continue
            x, y = find(left[1][i]), find(right[1][j])
            if x != y:
                parent[x] = y
                out.append((left[0][i], right[0][j]))
    return out


def rest_of_buckets(members: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Links (a, b) between different components among the members (bucket, digest, root) of unsettled buckets.

    A bucket is cut into blocks of about BLOCK documents; each task compares the documents of one pair of blocks in
    memory and returns no more links than it has documents, never the pairs. Nothing is capped: more members make more
    pairs of blocks.
    """
    held = members.sparkSession.sparkContext.broadcast(weights)
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("bucket", "digest", "root", "block", other)
    spread = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    spread = spread.join(texts, "digest").select("bucket", "i", "j", "block", "digest", "root", "text")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        out = []
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        blocks = []
        for k in dict.fromkeys((i, j)):
            part = group.filter(pa.compute.equal(group["block"], k)).combine_chunks()
            text = part["text"].combine_chunks()
            blocks.append((part["digest"].to_pylist(), part["root"].to_pylist(), _sparse(text, held.value)))
        if all(b[0] for b in blocks):
            out = _block_edges(blocks, similarity, i == j)
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return spread.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")


def text_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(digest, class_id, keep): every different text, the smallest doc_id of its class, and the digest of the text kept.

    Links are tested in three steps, each leaving fewer documents that are not yet joined: within every bucket of a band
    a member against the smallest member, first the one it shares most bands with, then the others; then, exactly, all
    pairs of different components of a bucket. Two texts are in one class if a chain of verified links joins them.
    """
    docs = docs.select("doc_id", "text")
    weights = word_weights(docs)
    signed = materialize(signatures(docs, weights), "signatures")
    nodes = materialize(signed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "nodes")
    members = nodes.filter(F.col("bands").isNotNull()).select("digest", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("digest").alias("head"), F.count(F.lit(1)).alias("n"))
    members = materialize(members.join(buckets.filter("n > 1"), ["band", "key"]), "members")
    stars = members.filter(F.col("digest") != F.col("head")).groupBy(F.col("digest").alias("a"), F.col("head").alias("b"))
    stars = materialize(stars.agg(F.count(F.lit(1)).alias("bands")), "stars")

    wanted = members.select("digest").distinct()
    rows = docs.select(digest().alias("digest"), text_of().alias("text"))
    # one text of many copies leaves each task, so copies do not meet in one
    texts = rows.groupBy("digest").agg(F.min("text").alias("text")).join(wanted, "digest")
    texts = materialize(texts, "texts")

    best = Window.partitionBy("a").orderBy(F.col("bands").desc(), "b")
    first = stars.withColumn("turn", F.row_number().over(best)).filter("turn = 1").select("a", "b")
    roots = components(verified(first, texts, weights, similarity))

    def joined_by(links: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))

    def rooted(df: DataFrame, name: str, out: str) -> DataFrame:
        joined = df.join(roots.select(F.col("node").alias(name), F.col("root").alias("__r")), name, "left")
        return joined.withColumn(out, F.coalesce("__r", name)).drop("__r")

    open_stars = rooted(rooted(stars.join(first, ["a", "b"], "left_anti"), "a", "ra"), "b", "rb").filter("ra != rb")
    roots = joined_by(verified(open_stars.select("a", "b"), texts, weights, similarity))

    placed = rooted(members, "digest", "root")
    bucket = placed.groupBy("band", "key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max("n").alias("n"),
        F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("content"),
    )
    # buckets of two were settled by their star; the same members in several bands are looked at once
    unsettled = bucket.filter("low != high and n > 2").groupBy("content", "n").agg(F.min(F.struct("band", "key")).alias("at"))
    unsettled = unsettled.select("at.band", "at.key")
    left = placed.join(unsettled, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "digest", "root")
    roots = joined_by(rest_of_buckets(left, texts, weights, similarity))

    nodes = rooted(nodes.select("digest", "id"), "digest", "root")
    kept = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    classes = materialize(nodes.groupBy("root").agg(kept.alias("k")), "kept")  # see components: a large class can be split
    return nodes.join(classes, "root").select("digest", F.col("k.id").alias("class_id"), F.col("k.digest").alias("keep"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept: one row per row of ``docs``.

    ``class_id`` is the smallest doc_id of the class. Equal texts are one class, null texts being empty; a text of fewer
    than five words is one shingle; texts without words are equal to their exact copies only. Rows without doc_id take
    part, but name a class only if it has no other rows (class_id is then null). Repeated rows repeat. Words are
    lower-cased (ASCII) runs of non-space characters. Other columns are ignored; an empty table gives no rows.
    """
    classes = materialize(text_classes(docs, similarity), "classes")
    mine = docs.select("doc_id", digest().alias("digest"))
    out = mine.join(classes, "digest").select("doc_id", "class_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs``, all columns, per class: the one with the smallest doc_id (of equal rows any)."""
    classes = materialize(text_classes(docs, similarity), "classes")
    kept = classes.filter(F.col("digest") == F.col("keep")).select(F.col("keep").alias("__digest"), "class_id")
    kept = kept.withColumnRenamed("class_id", "__class")
    rows = docs.withColumn("__digest", digest()).join(kept, "__digest")
    rows = rows.filter(F.col("doc_id").eqNullSafe(F.col("__class")))
    order = Window.partitionBy("__digest").orderBy("doc_id", *[c for c in ("source", "lang") if c in docs.columns])
    return rows.withColumn("__turn", F.row_number().over(order)).filter("__turn = 1").select(*docs.columns)


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
