"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.llm.common import table, text_of
from tremorline.llm.registry import query
from tremorline.llm.words import PUNCTUATION, Chunk, chunks, mix

# Labelled rows of either class that lexicons and classifier are fitted on; the only bounded sample here.
SAMPLE_PER_CLASS = 10_000
# Features kept of the labelled rows: the most telling ones for label 1 and for label 0.
TOXIC_FEATURES, CLEAN_FEATURES = 16384, 4096
FOLDS, HELD_OUT = 5, 0

# Common insults, by language.
INSULTS = {
    "en": "idiot moron stupid dumb scum trash loser pathetic worthless disgusting clown fool jerk imbecile",
    "de": "idiot dummkopf depp trottel abschaum versager arschloch blödmann widerlich erbärmlich",
    "fr": "idiot imbécile crétin abruti connard ordure minable débile dégueulasse pauvre-type",
    "es": "idiota imbécil estúpido basura perdedor patético asqueroso gilipollas payaso cretino",
}

# A word gives its whole form, its first 4 to 8 bytes and its last 5; the number of the kind tells them apart.
PREFIXES, SUFFIX = (4, 5, 6, 7, 8), 5
KINDS = 2 + len(PREFIXES)
PARTS = 2  # lexicon voters per kind
PATTERNS = ("shouting", "exclaiming", "symbols")
VOTERS = KINDS * PARTS + len(INSULTS) + len(PATTERNS)
MISSING = np.uint64(0xFFFFFFFFFFFFFFFF)


def held_out(folds: int = FOLDS, kept_back: int = HELD_OUT) -> Column:
    """Whether a document may not be learned from; a null doc_id may not either, but is not called held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == kept_back, F.lit(False))


def word_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of the chunk's distinct words: one row per word, MISSING where a word is too short; word and text of
    each distinct (word, text) pair)."""
    words = chunk.words()
    distinct, first, inverse = np.unique(words, return_index=True, return_inverse=True)
    start, end = chunk.start[first], chunk.end[first]
    columns = [distinct]
    for k, n in enumerate(PREFIXES):
        long = end - start >= n
        columns.append(np.where(long, chunk.hash(start, np.minimum(start + n, end)), MISSING))
    columns.append(np.where(end - start >= SUFFIX, chunk.hash(np.maximum(end - SUFFIX, start), end), MISSING))
    salted = [np.where(c == MISSING, MISSING, mix(c + np.uint64(k))) for k, c in enumerate(columns)]
    pairs = np.unique(chunk.doc.astype(np.int64) * max(len(distinct), 1) + inverse)
    return np.stack(salted, 1), pairs % max(len(distinct), 1), pairs // max(len(distinct), 1)


def surface(chunk: Chunk) -> np.ndarray:
    """Per text: shares of capitals, of exclamation marks and of other ASCII symbols among its bytes."""
    raw, edges = chunk.raw, chunk.edges
    marks = np.isin(raw, np.frombuffer(b"!", np.uint8))
    symbols = np.isin(raw, np.frombuffer(b"#$%&*@^~", np.uint8))
    capitals = (raw >= 65) & (raw < 91)
    size = np.maximum(np.diff(edges), 1)
    return np.stack([np.diff(np.r_[0, np.cumsum(x)][edges]) / size for x in (capitals, marks, symbols)], 1)


def insult_hashes() -> list[np.ndarray]:
    """Whole-word features of the fixed lexicons."""
    out = []
    for words in INSULTS.values():
        column = pa.array(words.split())
        out.append(np.sort(np.concatenate([mix(c.words()) for c in chunks(column, PUNCTUATION)])))
    return out


def contains(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each x is among the values, its place)."""
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


class Lexicon:
    """Chosen features, sorted; ``voter`` of each toxic one, -1 of the others; ``sure``: one word with it is a vote."""

    def __init__(self, features: np.ndarray, voter: np.ndarray, sure: np.ndarray):
        order = np.argsort(features)
        self.features, self.voter, self.sure = features[order], voter[order], sure[order]
        self.insults = insult_hashes()

    @classmethod
    def mine(cls, rows: np.ndarray, toxic: int, clean: int) -> Lexicon:
        """From (feature, toxic texts, clean texts): the best smoothed log-odds on either side."""
        feature, t, c = rows["feature"], rows["toxic"].astype(float), rows["clean"].astype(float)
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        often = t >= max(3, 0.002 * toxic)
        hot = np.flatnonzero(often & (odds > np.log(3)))
        hot = hot[np.lexsort((feature[hot], -odds[hot] * np.log1p(t[hot])))][:TOXIC_FEATURES]
        cold = np.flatnonzero((c >= max(3, 0.02 * clean)) & (odds < 0))
        cold = cold[np.lexsort((feature[cold], odds[cold] * np.log1p(c[cold])))][:CLEAN_FEATURES]
        kind = rows["kind"][hot].astype(np.int64)
        voter = kind * PARTS + (feature[hot] % np.uint64(PARTS)).astype(np.int64)
        sure = np.r_[odds[hot] > np.log(30), np.zeros(len(cold), dtype=bool)]
        return cls(np.r_[feature[hot], feature[cold]], np.r_[voter, np.full(len(cold), -1)], sure)

    def read(self, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """(text, place in the lexicon, log of 1 + words with the feature); votes, one row of 0/1 per text; surface figures."""
        features, word, doc = word_features(chunk)
        n = chunk.last - chunk.first
        hit, at = contains(self.features, features.ravel())
        place = np.where(hit, at, -1).reshape(features.shape)[word]
        owner = np.repeat(doc, features.shape[1])[place.ravel() >= 0]
        place = place.ravel()[place.ravel() >= 0]
        pairs, times = np.unique(owner * max(len(self.features), 1) + place, return_counts=True)
        owner, place = np.divmod(pairs, max(len(self.features), 1))
        value = np.log1p(times)
        votes = np.zeros((n, VOTERS), dtype=np.int8)
        if len(place):
            mined = (self.voter[place] >= 0) & ((times > 1) | self.sure[place])
            votes[owner[mined], self.voter[place[mined]]] = 1
        for k, insults in enumerate(self.insults):
            known, _ = contains(insults, features[:, 0])
            votes[doc[known[word]], KINDS * PARTS + k] = 1
        figures = surface(chunk)
        votes[:, KINDS * PARTS + len(INSULTS) :] = figures > np.array([0.3, 0.02, 0.05])
        return owner, place, value, votes, figures


class LabelModel:
    """Voters fire or abstain given the hidden label; rates by expectation maximisation over counted vote patterns.

    Votes are not independent: the correlation that two voters keep within a label is estimated from the same counts,
    and each voter's evidence is divided by the number of voters it moves with. Silence counts once, through a voter
    that fires where no lexicon does. The annotators of the labelled rows are one more voter, of given accuracy.
    """

    ANNOTATORS = 0.98

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 50):
        votes, counts = self._with_silence(votes), counts.astype(float)
        p = np.where(votes[:, -1] > 0, 0.02, 0.9)
        self.weight = np.ones(votes.shape[1])
        for i in range(rounds):
            self.rates = np.stack([self._rate(votes, counts * (1 - p)), self._rate(votes, counts * p)])
            self.prior = float(np.clip((counts * p).sum() / max(counts.sum(), 1), 1e-3, 0.5))
            if i == 4:
                self.weight = self._independence(votes, counts, p)
            p = self._posterior(votes)

    @staticmethod
    def _with_silence(votes: np.ndarray) -> np.ndarray:
        lexical = votes[:, : KINDS * PARTS + len(INSULTS)]
        return np.c_[votes.astype(float), ~lexical.any(1)]

    @staticmethod
    def _rate(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
        return np.clip((mass @ votes + 0.5) / (mass.sum() + 1.0), 1e-4, 1 - 1e-4)

    def _independence(self, votes: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        moves = np.zeros(votes.shape[1])
        for mass, rate in ((counts * (1 - p), self.rates[0]), (counts * p, self.rates[1])):
            centred = votes - rate
            cov = (centred * mass[:, None]).T @ centred / max(mass.sum(), 1.0)
            scale = np.sqrt(np.clip(rate * (1 - rate), 1e-6, None))
            moves = np.maximum(moves, np.clip(cov / scale[:, None] / scale, 0, 1).sum(1))
        return 1.0 / np.maximum(moves, 1.0)

    def _posterior(self, votes: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        fired = np.log(self.rates[1]) - np.log(self.rates[0])
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (fired * self.weight) + more
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def posterior(self, votes: np.ndarray, annotated: np.ndarray) -> np.ndarray:
        """Of labelled rows."""
        sure = np.log(self.ANNOTATORS / (1 - self.ANNOTATORS)) - np.log(self.prior / (1 - self.prior))
        against = np.log((1 - self.ANNOTATORS) / self.ANNOTATORS)
        return self._posterior(self._with_silence(votes), np.where(annotated == 1, sure, against))


def pack_votes(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (1 << np.arange(votes.shape[1], dtype=np.int64))


def unpack_votes(packed: np.ndarray) -> np.ndarray:
    return (packed[:, None] >> np.arange(VOTERS)) & 1


class Linear:
    """Logistic regression on lexicon features and surface figures with soft labels; full-batch, in numpy."""

    def __init__(self, n_features: int):
        self.w, self.u, self.b = np.zeros(n_features), np.zeros(len(PATTERNS)), 0.0

    def logit(self, n: int, owner: np.ndarray, place: np.ndarray, value: np.ndarray, figures: np.ndarray) -> np.ndarray:
        return self.b + np.bincount(owner, self.w[place] * value, n)[:n] + figures @ self.u

    def fit(self, owner, place, value, figures, label, rounds: int = 300, rate: float = 0.1, shrink: float = 1e-4) -> Linear:
        n = len(label)
        params = [self.w, self.u, np.zeros(1)]
        first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        for t in range(1, rounds + 1):
            self.b = float(params[2][0])
            error = (1 / (1 + np.exp(-np.clip(self.logit(n, owner, place, value, figures), -30, 30))) - label) / max(n, 1)
            grads = [
                np.bincount(place, error[owner] * value, len(self.w)) + shrink * self.w,
                error @ figures + shrink * self.u,
                np.array([error.sum()]),
            ]
            for x, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.b = float(params[2][0])
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(toxic, text) of at most ``per_class`` labelled documents per class outside the held-out fold, by a hash."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc_id"))
    taken = [
        known.filter(F.col("toxic") == k).orderBy("turn", "doc_id").limit(per_class).select("doc_id", "toxic")
        for k in (0, 1)
    ]
    some = F.broadcast(taken[0].unionByName(taken[1]))  # at most 2 * per_class rows of two numbers
    return docs.select("doc_id", text_of().alias("text")).join(some, "doc_id").select("toxic", "text").distinct()


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, kind, toxic, clean): texts of the sample with the feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch["toxic"].to_numpy()
            for chunk in chunks(batch["text"], PUNCTUATION):
                features, word, doc = word_features(chunk)
                flat, owner = features[word].ravel(), np.repeat(doc, KINDS)
                kind = np.tile(np.arange(KINDS, dtype=np.int32), len(word))
                real = flat != MISSING
                flat, owner, kind = flat[real], owner[real], kind[real]
                order = np.lexsort((flat, owner))
                flat, owner, kind = flat[order], owner[order], kind[order]
                once = np.ones(len(flat), dtype=bool)
                once[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
                flat, kind = flat[once], kind[once]
                toxic = label[chunk.first + owner[once]] == 1
                distinct, at, inverse = np.unique(flat, return_index=True, return_inverse=True)
                t = np.bincount(inverse, toxic, len(distinct)).astype(np.int64)
                n = np.bincount(inverse, minlength=len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct.view(np.int64)), pa.array(kind[at]), pa.array(t), pa.array(n - t)],
                    names=["feature", "kind", "toxic", "clean"],
                )

    counted = sample.mapInArrow(count, "feature long, kind int, toxic long, clean long")
    return counted.groupBy("feature", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def vote_counts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(votes, n): how many documents vote in each way; at most 2 ** VOTERS rows, in practice a few hundred."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"], PUNCTUATION):
                packed, n = np.unique(pack_votes(held.value.read(chunk)[3]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(n)], names=["votes", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(vote, "votes long, n long")
    return counted.groupBy("votes").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[Lexicon, Linear]:
    """Lexicon voters and classifier.

    The label model sees the votes of all documents that have a doc_id and are not held out; lexicons are mined from, and the classifier is
    fitted on, the bounded labelled sample, the latter with the label model's posterior as its labels.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, per_class).persist()
    sizes = dict(sample.groupBy("toxic").count().collect())
    counts = feature_counts(sample)
    useful = (F.col("toxic") >= max(3, 0.002 * sizes.get(1, 0))) | (F.col("clean") >= max(3, 0.02 * sizes.get(0, 0)))
    found = counts.filter(useful).toArrow()  # bounded by the sample: a text has few features that a 50th of texts share
    kinds = [("feature", np.uint64), ("kind", np.int32), ("toxic", np.int64), ("clean", np.int64)]
    rows = np.zeros(found.num_rows, dtype=kinds)
    for name, _ in kinds:
        values = found[name].to_numpy()
        rows[name] = values.view(np.uint64) if name == "feature" else values
    lexicon = Lexicon.mine(rows, sizes.get(1, 0), sizes.get(0, 0))
    votes = vote_counts(docs.filter(F.col("doc_id").isNotNull() & ~held_out()), lexicon).toPandas()
    patterns = unpack_votes(votes["votes"].to_numpy(np.int64))
    model = LabelModel(patterns, votes["n"].to_numpy(np.int64)) if len(votes) else None
    held = spark.sparkContext.broadcast((lexicon, model))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = held.value
        for batch in batches:
            for chunk in chunks(batch["text"], PUNCTUATION):
                owner, place, value, votes, figures = lexicon.read(chunk)
                n = chunk.last - chunk.first
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value))
                flat = pa.array(figures.ravel())
                figure = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3), pa.int32()), flat)
                annotated = batch["toxic"].to_numpy()[chunk.first : chunk.last]
                p = pa.array(model.posterior(votes, annotated))
                names = ["place", "value", "figures", "label"]
                yield pa.RecordBatch.from_arrays([lists, values, figure, p], names=names)

    linear = Linear(len(lexicon.features))
    if model is not None and sizes:
        fitted = sample.mapInArrow(
            describe, "place array<int>, value array<double>, figures array<double>, label double"
        )
        got = fitted.orderBy("label", "figures", "place").toPandas()  # the bounded sample, as numbers
        owner = np.repeat(np.arange(len(got)), got["place"].map(len))
        place = np.concatenate([*got["place"], np.zeros(0)]).astype(np.int64)
        value = np.concatenate([*got["value"], np.zeros(0)])
        linear.fit(owner, place, value, np.stack(got["figures"]), got["label"].to_numpy())
    sample.unpersist()
    return lexicon, linear


def score(docs: DataFrame, trained: tuple[Lexicon, Linear]) -> DataFrame:
    """Add ``__score`` to documents; whole texts, nothing else of a document is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(trained)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, linear = held.value
        for batch in batches:
            out = [np.zeros(0)]
            for chunk in chunks(batch["text"].fill_null(""), PUNCTUATION):
                owner, place, value, _, figures = lexicon.read(chunk)
                logit = linear.logit(chunk.last - chunk.first, owner, place, value, figures)
                out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            names = [*batch.schema.names, "__score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=names)

    return docs.mapInArrow(rate, T.StructType([*docs.schema, T.StructField("__score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null and empty texts have no words and get the score of the constant. Rows without doc_id are scored and not learned
    from; a doc_id labelled twice is toxic if any label says so; without usable labels all scores are 0.5. Repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    scored = score(docs, train(docs, labels.select("doc_id", "toxic"), per_class))
    out = scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score is below 0.5."""
    trained = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return score(docs, trained).filter(F.col("__score") < 0.5).drop("__score")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
