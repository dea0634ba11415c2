"""Source divergence audit: joint tables of count levels from blocked one-hot matrix products."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.llm.common import table, text_of
from tremorline.llm.registry import query
from tremorline.session import materialize

SCALE = 1_000_000_000
MIN_DOCUMENTS = 10
TOP_TERMS = 10

# Entries a task holds before it sends its counts on, non-zero counts per block of terms, terms per product at most and
# at least, columns of one factor of a product.
HELD_ENTRIES = 400_000
BLOCK_COUNTS = 1 << 16
MOST_TERMS, LEAST_TERMS = 4096, 64
COLUMNS = 1024

DOCUMENT = 1 << 40  # above any count of one task
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))

_COUNTS = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64()),
])
_PRICES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of documents per (lang, source), a row without a term for each group that occurs."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # one number per term: its count, and its documents times DOCUMENT
    entries = 0

    def flush() -> pa.RecordBatch:
        sizes = [len(counts) for counts in held.values()]
        names = [pa.array([group[k] for group in held], pa.string()) for k in range(2)]
        owner = pa.array(np.r_[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(sizes))].astype(np.int64))
        alone = [None] * len(sizes)
        terms = pa.array([*(t for counts in held.values() for t in counts), *alone], pa.binary()).cast(pa.string())
        both = np.array([*(n for counts in held.values() for n in counts.values()), *([0] * len(sizes))], dtype=np.int64)
        held.clear()
        columns = [*(n.take(owner) for n in names), terms, pa.array(both % DOCUMENT), pa.array(both // DOCUMENT)]
        return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts = held.setdefault((lang, source), {})
            before = len(counts)
            for term, n in Counter(LETTERS.findall(text.translate(LOWER))).items():
                counts[term] = counts.get(term, 0) + n + DOCUMENT
            entries += len(counts) - before
            if entries >= HELD_ENTRIES:
                yield flush()
                entries = 0
    yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) summed over all documents; one row with a null term per (lang, source)."""
    read = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().cast("binary"))
    counted = read.mapInArrow(_count_terms, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def level(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """p = 1 + floor(SCALE (count + 2) / (total + 2 kept)), by long division in steps of a thousand: no step overflows."""
    whole = np.asarray(total, dtype=np.int64) + 2 * kept
    out, rest = np.divmod(np.asarray(count, dtype=np.int64) + 2, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f = floor((p - q)^2 / (p + q)); p and q are at most 10**9 + 1, so nothing overflows."""
    gap = p - q
    return gap * gap // (p + q)


def _runs(widths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut groups of columns into runs of at most ``limit`` columns (at least one group each)."""
    start, used = 0, 0
    for g, w in enumerate(widths):
        if g > start and used + w > limit:
            yield start, g
            start, used = g, 0
        used += w
    if len(widths):
        yield start, len(widths)


def price_block(counts: np.ndarray, totals: np.ndarray, kept: int, value: np.ndarray) -> None:
    """Add the terms of ``counts`` (terms x sources) to ``value`` (sources x sources).

    X has one indicator column per (source, count level that occurs here, zero included). An entry of X'X is the number of
    terms with level a in one source and b in the other: the joint table, which is then priced by level and summed per
    pair. X is cut into runs of sources; entries are at most the number of terms, so single floats are exact.
    """
    terms = len(counts)
    widths, codes, prices = [], [], []
    for g in range(counts.shape[1]):
        levels, code = np.unique(counts[:, g], return_inverse=True)
        widths.append(len(levels))
        codes.append(code)
        prices.append(level(levels, totals[g], kept))
    if sum(widths) > COLUMNS and terms > LEAST_TERMS:
        half = terms // 2
        price_block(counts[:half], totals, kept, value)
        price_block(counts[half:], totals, kept, value)
        return

    row = np.arange(terms)
    runs = []
    for a, b in _runs(np.array(widths), COLUMNS):
        first = np.cumsum([0, *widths[a:b]])
        x = np.zeros((terms, first[-1]), dtype=np.float32)
        for k, code in enumerate(codes[a:b]):
            x[row, first[k] + code] = 1
        owner = np.repeat(np.arange(a, b), widths[a:b])
        runs.append((x, owner, np.concatenate(prices[a:b])))
    for i, (x, mine, p) in enumerate(runs):
        for y, yours, q in runs[i:]:
            joint = x.T @ y
            a, b = np.nonzero(joint)
            cost = joint[a, b].astype(np.int64) * distance(p[a], q[b])
            np.add.at(value, (mine[a], yours[b]), cost)
            if x is not y:
                np.add.at(value, (yours[b], mine[a]), cost)


def _price_pairs(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of terms of a language: what it adds to the value of every ordered pair of its sources."""
    lang = key[0].as_py()
    names = groups["source"].combine_chunks()
    totals, kept = groups["n"].to_numpy(), int(groups["kept"][0].as_py())
    value = np.zeros((len(names), len(names)), dtype=np.int64)
    if len(counts):
        term = counts["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        where = {s: i for i, s in enumerate(names.to_pylist())}
        source = np.array([where[s] for s in counts["source"].to_pylist()])
        count = counts["count"].to_numpy()
        # terms of like size share their levels, so that a product has few columns
        size = np.bincount(term, count)
        rank = np.empty(len(size), dtype=np.int64)
        rank[np.argsort(size, kind="stable")] = np.arange(len(size))
        term = rank[term]
        step = max(1, min(MOST_TERMS, (1 << 20) // len(names)))
        by_term = np.argsort(term, kind="stable")
        term, source, count = term[by_term], source[by_term], count[by_term]
        for a in range(0, len(size), step):
            lo, hi = np.searchsorted(term, [a, a + step])
            dense = np.zeros((min(step, len(size) - a), len(names)), dtype=np.int64)
            dense[term[lo:hi] - a, source[lo:hi]] = count[lo:hi]
            price_block(dense, totals, kept, value)
    mine, yours = np.nonzero(~np.eye(len(names), dtype=bool))
    columns = [pa.array([lang] * len(mine), pa.string()), names.take(pa.array(mine)), names.take(pa.array(yours))]
    return pa.Table.from_arrays([*columns, pa.array(value[mine, yours])], schema=_PRICES)


def _level(count: Column, total: Column, kept: Column) -> Column:
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide, (total + 2 * kept).cast("decimal(20,0)"))


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart, and by which terms.

    A language keeps the terms that are in at least ``min_documents`` of its rows. Part ``pair``: every other source of the
    language, with the divergence summed over all kept terms. Part ``term``: the ``top`` kept terms that a source uses more
    than its language does. All arithmetic is on whole numbers.

    Null text, lang and source are empty; groups without terms have pairs and no terms; repeated rows count each; ties are
    ranked by item; an empty table gives no rows; other columns are ignored. Counts are summed in the tasks before they
    are shuffled, so a source or language of any size is spread; the pairs of a language are summed over blocks of its
    terms. The result has a row per ordered pair of sources of a language, and each block holds one number per such pair.
    """
    counted = materialize(term_counts(docs), "term-counts")
    per_term = Window.partitionBy("lang", "term")  # at most one row per source
    kept = counted.filter(F.col("term").isNotNull()).withColumns({
        "in_docs": F.sum("docs").over(per_term),
        "whole": F.sum("count").over(per_term),
        "first": (F.row_number().over(per_term.orderBy("source")) == 1).cast("int"),
    })
    kept = materialize(kept.filter(F.col("in_docs") >= min_documents).drop("in_docs", "docs"), "kept-terms")

    langs = kept.groupBy("lang").agg(
        F.sum("count").alias("lang_n"), F.sum("first").cast("long").alias("kept"), F.count(F.lit(1)).alias("rows")
    )
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counted.filter(F.col("term").isNull()).select("lang", "source")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_COUNTS), F.lit(1)).cast("int")
    groups = materialize(groups.withColumn("blocks", blocks), "groups")

    by_lang = groups.select("lang", "blocks").distinct()
    placed = kept.join(by_lang, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    priced = (
        placed.select("lang", "block", "term", "source", "count")
        .groupBy("lang", "block")
        .cogroup(spread.select("lang", "block", "source", "n", "kept").groupBy("lang", "block"))
        .applyInArrow(_price_pairs, "lang string, source string, item string, value long")
    )
    pairs = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    p = _level(F.col("count"), F.col("n"), F.col("kept"))
    q = _level(F.col("whole"), F.col("lang_n"), F.col("kept"))
    used = kept.join(groups.select("lang", "source", "n", "kept", "lang_n"), ["lang", "source"])
    used = used.withColumns({"p": p, "q": q}).filter("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    terms = used.select("lang", "source", F.col("term").alias("item"), value.alias("value"), F.lit("term").alias("part"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    names = ["lang", "source", "part", "item", "value", "rank"]
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).select(names).union(terms.select(names))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
used AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS whole FROM used GROUP BY ALL HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, CAST(sum(whole) AS HUGEINT) AS lang_n, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM used SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
levels AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(s.n, 0)::HUGEINT + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.whole + 2)) // (l.lang_n + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM levels a JOIN levels b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM levels WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 10"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that mark each source."""
    return source_divergence(table(spark, sf_dir, "documents"))
