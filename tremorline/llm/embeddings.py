"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, with probes of several buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.common import table
from tremorline.llm.components import components
from tremorline.llm.registry import query
from tremorline.llm.words import BASE, mix
from tremorline.session import materialize

SIMILARITY = 0.98
TABLES, HASHES, PROBES = 6, 2, 3
# Tables and hashes as the vectors of a label grow; a table has at least SPARE buckets for every vector.
LEVELS = ((TABLES, HASHES), (8, 3), (12, 4))
SPARE = 64
# Vectors of one block of a bucket; larger buckets are compared block by block.
BLOCK = 512
# Rows of buckets compared in one call, about; buckets of up to SMALL rows are multiplied together.
ROWS, SMALL = 8192, 64
PAIRS = 1 << 18  # pairs whose keys are looked at together


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the length is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """(vectors, tables, probes) bucket keys, the vector's own bucket first.

    Each hash rotates by three rounds of random signs and Hadamard transforms and takes the nearest signed axis. A table
    joins ``hashes`` of them. Probes are the most likely other buckets: one hash replaced by its second-nearest axis, in
    the order of the gap between the two.
    """
    n, dim = unit.shape
    size = 1 << max(dim - 1, 0).bit_length()
    padded = np.zeros((n, size))
    padded[:, :dim] = unit
    rng = np.random.default_rng(11)
    out = np.zeros((n, tables, probes), dtype=np.uint64)
    for t in range(tables):
        axes = np.zeros((n, hashes, 2), dtype=np.int64)
        gaps = np.zeros((n, hashes))
        for k in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size))
            both = np.concatenate([x, -x], 1)
            top = np.argpartition(-both, 1, axis=1)[:, :2] if 2 * size > 2 else np.argsort(-both, 1)[:, :2]
            value = np.take_along_axis(both, top, 1)
            swap = (value[:, 0] < value[:, 1]) | ((value[:, 0] == value[:, 1]) & (top[:, 0] > top[:, 1]))
            top[swap], value[swap] = top[swap][:, ::-1], value[swap][:, ::-1]
            axes[:, k], gaps[:, k] = top, value[:, 0] - value[:, 1]
        order = np.argsort(gaps, axis=1, kind="stable")
        for p in range(probes):
            pick = axes[:, :, 0].copy()
            if p:
                where = order[:, min(p, hashes) - 1]
                pick[np.arange(n), where] = axes[np.arange(n), where, 1]
            key = np.full(n, t + 1, dtype=np.uint64)
            for k in range(hashes):
                key = key * np.uint64(BASE) + pick[:, k].astype(np.uint64)
            out[:, t, p] = mix(key)
    return out


def can_link() -> Column:
    """Whether a row has a label and a vector that is not empty or zero and has finite components throughout."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(x, lambda v: v != 0)
    return F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    x = values.reshape(len(column), -1)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def _block_pairs(units: list[np.ndarray], similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in both blocks of the vectors that are similar; each pair of one block once."""
    x, y = units
    close = x @ y.T >= similarity
    return np.nonzero(np.triu(close, 1) if same else close)


def _small_pairs(unit: np.ndarray, start: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[tuple]:
    """Places of the similar pairs in runs of ``size`` rows from ``start``, runs of one size multiplied together."""
    for m in np.unique(size):
        runs = start[size == m]
        step = max(1, (1 << 20) // (int(m) * max(unit.shape[1], int(m))))
        for s in range(0, len(runs), step):
            at = runs[s : s + step, None] + np.arange(m)
            x = unit[at]
            g, i, j = np.nonzero(np.triu(np.matmul(x, x.transpose(0, 2, 1)) >= similarity, 1))
            yield at[g, i], at[g, j]


def _in_first_bucket(left: np.ndarray, right: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether ``here`` is the smallest common key of two rows of keys."""
    out = np.zeros(len(left), dtype=bool)
    for s in range(0, len(left), 1 << 14):
        a, b = left[s : s + (1 << 14)], right[s : s + (1 << 14)]
        common = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.uint64(0xFFFFFFFFFFFFFFFF))
        out[s : s + (1 << 14)] = common.min(1) == here[s : s + (1 << 14)]
    return out


def _bucket_links(unit: np.ndarray, keys: np.ndarray, here: np.ndarray, place: list[np.ndarray], similarity: float) -> tuple:
    """Places of the linked pairs of many buckets of vectors of one length.

    ``here`` is the key of each row's bucket, ``place`` its label, key, block pair and block. A pair found in several
    buckets counts in the one with the smallest common key only.
    """
    label, key, i, j, block = place
    order = np.lexsort((block, j, i, key, label))
    sort = [c[order] for c in (label, key, i, j)]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in sort], 0)
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(order)])
    unit, block = unit[order], block[order]
    whole = sort[2][start] == sort[3][start]
    small = whole & (size <= SMALL)
    found = list(_small_pairs(unit, start[small], size[small], similarity))
    for s, n, same in zip(start[~small].tolist(), size[~small].tolist(), whole[~small].tolist()):
        # the rows of the smaller block come first
        cut = 0 if same else int(np.searchsorted(block[s : s + n], sort[3][s]))
        parts = [unit[s : s + n]] * 2 if same else [unit[s : s + cut], unit[s + cut : s + n]]
        a, b = _block_pairs(parts, similarity, same)
        found.append((a + s, b + s + cut))
    none = np.zeros(0, dtype=np.int64)
    a, b = (order[np.concatenate([none, *[f[k] for f in found]])] for k in range(2))
    first = np.concatenate([np.zeros(0, dtype=bool), *[
        _in_first_bucket(keys[a[s : s + PAIRS]], keys[b[s : s + PAIRS]], here[a[s : s + PAIRS]]) for s in range(0, len(a), PAIRS)
    ]])
    return a[first], b[first]


def _links_of(ids: list, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[dict, list]:
    """Copies linked to each class by the pairs of rows (a, b), and links that join their classes."""
    counts: dict = {}
    parent: dict = {}
    edges = []

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    linked = np.bincount(a, sizes[b], len(ids)) + np.bincount(b, sizes[a], len(ids))
    for k in np.flatnonzero(linked).tolist():
        counts[ids[k]] = counts.get(ids[k], 0) + int(linked[k])
    for p, q in zip(a.tolist(), b.tolist()):
        u, v = find(ids[p]), find(ids[q])
        if u != v:
            parent[u] = v
            edges.append((ids[p], ids[q]))
    return counts, edges


def table_sizes(classes: int, dim: int) -> tuple[int, int]:
    """(tables, hashes) for vectors of one length of which ``classes`` share a label.

    Buckets are SPARE times as many as vectors, so that vectors that are not alike keep meeting rarely however many there
    are. More hashes come with more tables: a pair at SIMILARITY is missed no more often than with few vectors.
    """
    axes = 2 << max(dim - 1, 0).bit_length()
    for tables, hashes in LEVELS:
        if axes**hashes >= SPARE * classes:
            break
    return tables, hashes


def embedding_links(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Vectors of one label with a cosine (double precision) of at least ``similarity`` are linked if they meet in a bucket.
    Equal vectors are one class, hashed once and counted with all their copies. Tables grow by ``table_sizes``. A bucket
    above BLOCK classes is compared in pairs of blocks, all of them; buckets and pairs of blocks are dealt to groups of
    about ROWS rows, compared in one call each, which returns counts and joining links, never the pairs. Rows whose vector is null,
    empty, zero or not finite throughout, or whose label is null, have no links and are their own component. Vectors of
    different lengths never link. A repeated vec_id is a vector for each of its rows. A null vec_id takes part; its
    component is named by another row if there is one. An empty table gives no rows; other columns are ignored.
    """
    vectors = vectors.select("vec_id", "label", "embedding")
    good = vectors.filter(can_link()).withColumn("vector", F.col("embedding").cast("array<double>"))
    plain = F.transform("vector", lambda v: v + F.lit(0.0))  # 0.0 and -0.0 are one value
    good = good.withColumn("class", F.unhex(F.md5(F.to_json(F.struct("label", plain.alias("v"))).cast("binary"))))
    rows = materialize(good.select("vec_id", "class"), "vectors")
    classes = good.groupBy("class", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("id"), F.first("vector").alias("vector")
    )
    classes = materialize(classes, "vector-classes")
    dimension = F.size("vector")
    labels = classes.groupBy("label", dimension.alias("dim")).agg(F.count(F.lit(1)).alias("m"))
    most = {d: table_sizes(m, d) for d, m in labels.groupBy("dim").agg(F.max("m")).collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch["vector"]).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                unit = _matrix(part["vector"])
                # a few vectors at a time, as the rotations go over them many times
                keys = np.concatenate([bucket_keys(unit[s : s + 1024], *most[dim]) for s in range(0, len(unit), 1024)])
                keys = keys.reshape(part.num_rows, -1)
                width = keys.shape[1]
                flat = pa.array(keys.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), flat)
                names = ["class", "label", "n", "vector", "keys"]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names[:-1]], lists], names=names)

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("class", "label", "n", "vector").mapInArrow(
        place, f"class binary, label {label}, n long, vector array<double>, keys array<long>"
    )
    placed = materialize(placed, "placed")
    spread = placed.select("class", "label", dimension.alias("dim"), F.explode(F.array_distinct("keys")).alias("key"))
    filled = spread.groupBy("label", "dim", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
    spread = spread.join(filled.filter("m > 1").drop("m"), ["label", "dim", "key"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "class", "label", "dim", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    spread = materialize(spread, "buckets")
    groups = max(1, spread.count() // ROWS)
    spread = spread.withColumn("group", F.pmod(F.xxhash64("label", "key", "i", "j"), F.lit(groups)))
    full = spread.join(placed.select("class", "n", "vector", "keys"), "class")

    def compare(group: pa.Table) -> pa.Table:
        column = lambda c: group[c].combine_chunks()
        label = column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place = [label, *[column(c).to_numpy() for c in ("key", "i", "j", "block")]]
        keys = column("keys").flatten().to_numpy().view(np.uint64).reshape(group.num_rows, -1)
        a, b = _bucket_links(_matrix(column("vector")), keys, place[1].view(np.uint64), place, similarity)
        counts, edges = _links_of(group["class"].to_pylist(), group["n"].to_numpy(), a, b)
        left = [*counts, *[e[0] for e in edges]]
        right = [None] * len(counts) + [e[1] for e in edges]
        n = [*counts.values(), *[0] * len(edges)]
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary()), "n": pa.array(n, pa.int64())})

    found = full.groupBy("dim", "group").applyInArrow(compare, "a binary, b binary, n long")
    found = materialize(found, "vector-links")
    linked = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked"))
    roots = components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    known = classes.select("class", "n", "id").join(linked, "class", "left")
    known = known.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    # written first: then both sides of the join are plain shuffles, and a large component can be split
    named = materialize(known.groupBy("root").agg(F.min("id").alias("component_id")), "components")
    known = known.join(named, "root").select("class", "component_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = rows.join(known, "class").select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~can_link())
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op7_embedding_duplicates")
def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_links(table(spark, sf_dir, "embeddings"))
