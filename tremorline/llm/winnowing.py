"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.llm.common import let, partitions, table, text_of
from tremorline.llm.registry import query

# Words of a gram and grams of a window: any run of GRAM + WINDOW - 1 words that two texts share is found in both.
GRAM, WINDOW = 3, 4
# A selected gram is one number: the hash above, the place below, counted down so that the smaller number of two equal
# hashes is the one further right. A string has fewer than 2 ** 30 words.
PLACE_BITS = 30
PLACES = (1 << PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    """The words of a text, in lower case."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _from(column: Column, start: int) -> Column:
    """The entries from ``start`` on."""
    return F.slice(column, start + 1, F.greatest(F.size(column) - start, F.lit(0)))


def gram_hashes(words: Column, k: int = GRAM) -> Column:
    """Hashes of every run of ``k`` words; of all words together where there are fewer; none without words."""

    def rolled(hashes: Column) -> Column:
        out = hashes
        for j in range(1, k):  # an entry without a partner is cut off below
            out = F.zip_with(out, _from(hashes, j), lambda a, b: F.xxhash64(a, b))
        return F.slice(out, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0)))

    full = let(F.transform(words, lambda w: F.xxhash64(w)), rolled)
    few = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) >= k, full).when(F.size(words) > 0, few).otherwise(F.array().cast("array<bigint>"))


def select_minima(hashes: Column, w: int = WINDOW) -> Column:
    """The smallest gram of every window of ``w``, the rightmost of equals, each once: hash and place in one number.

    Minima are taken over 2, 4, ... neighbours in turn. Fewer grams than a window are one window.
    """
    packed = F.transform(
        hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS) + (F.lit(PLACES) - i)
    )

    def lower(column: Column, step: int) -> Column:
        return let(column, lambda c: F.zip_with(c, _from(c, step), lambda a, b: F.least(a, b)))

    def minima(p: Column) -> Column:
        out, span = p, 1
        while span < w:
            out = lower(out, min(span, w - span))
            span += min(span, w - span)
        windows = F.array_distinct(F.slice(out, 1, F.greatest(F.size(p) - (w - 1), F.lit(0))))
        return F.when(F.size(p) >= w, windows).when(F.size(p) > 0, F.array(F.array_min(p))).otherwise(p)

    return let(packed, minima)


def fingerprint(text: Column) -> Column:
    """Array of the selected grams of a text, in the order of their places."""
    return let(words_of(text), lambda words: select_minima(gram_hashes(words)))


def hashes_of(selected: Column) -> Column:
    """The different hashes of a fingerprint."""
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, PLACE_BITS)))


def written(selected: Column) -> Column:
    """hash:word, ... with hexadecimal hashes and the number of the gram's first word."""
    one = lambda x: F.concat(
        F.hex(F.shiftright(x, PLACE_BITS)), F.lit(":"), (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("string")
    )
    return F.array_join(F.transform(selected, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes; two texts without words are alike."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / whole)


def with_next(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Add ``next``: a struct of ``text`` and ``carried`` of the row with the next doc_id (after the last: the first).

    Rows go to ranges of doc_id, cut at measured quantiles and found by binary search; the first rows of a range are
    repeated in the range before it. So texts are shuffled once, and a range is all that a task sorts.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    cuts, low, nulls = docs.agg(
        F.percentile_approx("doc_id", [k / n for k in range(n)], 100 * n), F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))
    ).first()
    cuts = sorted(set(cuts or []))
    starts = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length(), -1, -1)])
    own = F.col("doc_id")
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(cuts)) & (F.get(starts, F.least(at + step, F.lit(len(cuts))) - 1) <= own), at + step
        ).otherwise(at),
    )
    place = F.when(own.isNull(), 0).otherwise(found)
    none = F.lit(None).cast("struct<range:int,wrap:int,halo:boolean>")
    at = lambda where, wrap, halo: F.struct(where.alias("range"), F.lit(wrap).alias("wrap"), F.lit(halo).alias("halo"))
    first = own.isNull() if nulls else own.eqNullSafe(F.lit(low))
    copies = F.array(
        at(F.col("__own"), 0, False),
        F.when((F.col("__own") > 0) & (own == F.get(starts, F.col("__own") - 1)), at(F.col("__own") - 1, 0, True)).otherwise(none),
        F.when(first, at(F.lit(len(cuts)), 1, True)).otherwise(none),
    )
    rows = docs.withColumn("__own", place.cast("int")).withColumn("__at", F.explode(F.array_compact(copies)))
    rows = rows.select(*docs.columns, F.col("__at.range").alias("__range"), F.col("__at.wrap").alias("__wrap"), F.col("__at.halo").alias("__halo"))
    rows = rows.repartition("__range").withColumns(carried)
    order = Window.partitionBy("__range").orderBy("__wrap", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("next", F.lead(F.struct("text", *carried)).over(order)).filter(~F.col("__halo")).drop(
        "__range", "__wrap", "__halo"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the beginning of the next document. Null texts are empty and have no grams; texts of fewer
    words than a gram have one. Rows of one doc_id follow each other by their text, null doc_ids come first, and equal
    rows are each other's next. An empty table gives no rows; other columns, among them a given n_chars, are ignored.
    """
    plain = docs.select("doc_id", text_of().alias("text"))
    rows = with_next(plain, {"selected": fingerprint(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next.text"), F.lit(1), half)))
    rows = rows.select(
        "doc_id", "n_chars", "selected", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("edited")).alias("edited_selected"), F.col("next.selected").alias("next_selected"),
    )
    own, edited, following = (hashes_of(F.col(c)) for c in ("selected", "edited_selected", "next_selected"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("selected")).alias("fingerprint"),
        written(F.col("edited_selected")).alias("edited_fingerprint"),
        let(own, lambda o: let(edited, lambda e: likeness(o, e))).alias("near_edited"),
        let(own, lambda o: let(following, lambda f: likeness(o, f))).alias("near_next"),
    )


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
