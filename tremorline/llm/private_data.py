"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.common import table, text_of
from tremorline.llm.registry import query
from tremorline.llm.words import chunks

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DAMPING = 10, 0.3

# The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# IP from the start of a run of digits, which it takes whole: a match can start nowhere else, and nothing is tried twice
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
CANDIDATE = re.compile(r"[0-9@]")
EDGES = " .,;:!?\"'()[]{}<>$&*#%|"

CHAIN, SAME, SIMILAR = 0, 1, 2
LABELS = len(KINDS) + 1  # 0: none


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def address_parts(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL; anchored at the signs, so that a long run without one is passed once."""
    stop = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > stop and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            yield match.span()
            stop = match.end()
        at = text.find("@", max(at + 1, stop))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in order; each kind leftmost and non-overlapping, failing matches dropped."""
    out = [(a, b, 0) for a, b in email_spans(text)]
    out += [(*m.span(), 1) for m in ADDRESS.finditer(text) if address_parts(m.group())]
    for m in CARD.finditer(text):
        digits = only_digits(m.group()) if m.end() - m.start() <= 37 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def features(core: str) -> tuple[int, ...]:
    """What a token looks like, in a few small numbers."""
    digits = only_digits(core[:64])
    n = len(digits)
    at = "@" in core
    return (
        int(at) + int(at and "." in core.rpartition("@")[2]),
        min(core.count("."), 4),
        sum(n > k for k in (0, 3, 8, 11, 15, 16, 19)),
        int(12 <= n <= 19 and luhn(digits)),
        int(core.startswith("+")),
        int("(" in core or "-" in core),
        int(any(c.isalpha() for c in core[:64])),
        int(core.count(".") == 3 and core.replace(".", "").isdigit() and len(core) <= 15 and core.isascii()
            and all(p and int(p) <= 255 for p in core.split("."))),
    )


# Values each feature takes.
SIZES = (3, 5, 8, 2, 2, 2, 2, 2)
OFFSETS = np.r_[0, np.cumsum(SIZES)[:-1]]


class Graph:
    """The candidate tokens of one text: spans, features and links.

    Neighbours in the text are linked in a chain; a token is linked to the next one of the same form, and to the next one
    of similar form (same shape and same beginning), so that a form repeated any number of times has one link each.
    """

    def __init__(self, text: str):
        self.spans, self.features, self.links = [], [], []
        same: dict[str, int] = {}
        similar: dict[tuple, int] = {}
        before = -2
        for place, match in enumerate(TOKEN.finditer(text)):
            token = match.group()
            if not CANDIDATE.search(token):
                continue
            left = len(token) - len(token.lstrip(EDGES.replace("(", "")))
            right = len(token) - len(token.rstrip(EDGES.replace(")", "")))
            if left + right >= len(token):
                continue
            core = token[left : len(token) - right]
            i = len(self.spans)
            self.spans.append((match.start() + left, match.end() - right))
            self.features.append(features(core))
            if before == place - 1 and i:
                self.links.append((i - 1, i, CHAIN))
            before = place
            form = core.lower()
            shape = (form[:3], tuple(self.features[i]), len(form))
            if form in same:
                self.links.append((same[form], i, SAME))
            elif shape in similar:
                self.links.append((similar[shape], i, SIMILAR))
            same[form] = similar[shape] = i

    def labels(self, base: list[tuple[int, int, int]]) -> np.ndarray:
        """The kind of the base span a token lies in, else 0."""
        out = np.zeros(len(self.spans), dtype=np.int64)
        if base and self.spans:
            starts = np.array([s for s, _ in self.spans])
            ends = np.array([e for _, e in self.spans])
            for a, b, kind in reversed(base):
                out[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = kind + 1
        return out


class Field:
    """Unary weights per feature value and log potentials per kind of link."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    @classmethod
    def fit(cls, tokens: list[tuple[str, int, int]], pairs: list[tuple[int, int, int]], rounds: int = 400) -> Field:
        """Piecewise training: a softmax for the tokens by their features; for links the pointwise mutual information of
        the labels at their ends. Both from counts."""
        unary = np.zeros((sum(SIZES), LABELS))
        pair = np.zeros((3, LABELS, LABELS))
        if tokens:
            tokens = sorted(tokens)
            rows = np.array([[int(v) for v in key.split(",")] for key, _, _ in tokens]) + OFFSETS
            label, n = np.array([t[1] for t in tokens]), np.array([t[2] for t in tokens], dtype=float)
            # kinds are rare beside other numbers: the root of a count keeps them from being drowned
            mass = np.sqrt(n)
            mass /= mass.sum()
            m, v = np.zeros_like(unary), np.zeros_like(unary)
            for t in range(1, rounds + 1):
                z = unary[rows].sum(1)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(p)), label] -= 1
                g = 1e-4 * unary
                np.add.at(g, rows.ravel(), np.repeat(p * mass[:, None], rows.shape[1], 0))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                unary -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        counts = np.full((3, LABELS, LABELS), 0.5)
        for kind, code, n in pairs:
            counts[kind, code // LABELS, code % LABELS] += n
        for kind in (SAME, SIMILAR):
            counts[kind] = (counts[kind] + counts[kind].T) / 2
        share = counts / counts.sum((1, 2), keepdims=True)
        expected = share.sum(2, keepdims=True) * share.sum(1, keepdims=True)
        pair = np.clip(np.log(share / expected), -2.0, 2.0)
        return cls(unary, pair)

    def marginals(self, feature_rows: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Sum-product messages along all links at once, damped, a fixed number of rounds."""
        local = self.unary[feature_rows + OFFSETS].sum(1)
        local -= local.max(1, keepdims=True)
        n = len(local)
        belief = local
        if len(links):
            source = np.r_[links[:, 0], links[:, 1]]
            target = np.r_[links[:, 1], links[:, 0]]
            potential = np.concatenate([self.pair[links[:, 2]], self.pair[links[:, 2]].transpose(0, 2, 1)])
            back = np.r_[np.arange(len(links), 2 * len(links)), np.arange(len(links))]
            message = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                belief = local + _gather(target, message, n)
                outgoing = belief[source] - message[back]
                scores = outgoing[:, :, None] + potential
                top = scores.max(1, keepdims=True)
                fresh = np.log(np.exp(scores - top).sum(1)) + top[:, 0]
                fresh -= fresh.max(1, keepdims=True)
                message = DAMPING * message + (1 - DAMPING) * fresh
            belief = local + _gather(target, message, n)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _gather(target: np.ndarray, message: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(target, message[:, k], n) for k in range(message.shape[1])], 1)


def flagged(column: pa.Array) -> np.ndarray:
    """Which texts hold a digit or an at sign; only these can hold a span."""
    out = [np.zeros(0, dtype=bool)]
    for chunk in chunks(column):
        raw = chunk.raw
        marks = np.r_[0, np.cumsum(((raw >= 48) & (raw < 58)) | (raw == 64))]
        out.append(np.diff(marks[chunk.edges]) > 0)
    return np.concatenate(out)


def train_field(docs: DataFrame) -> Field:
    """Fit the field to the base spans of all documents: each task counts its tokens and links by features and labels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            column = batch["text"]
            for i in np.flatnonzero(flagged(column)).tolist():
                text = column[i].as_py()
                graph = Graph(text)
                label = graph.labels(base_spans(text)).tolist()
                seen.update(("token", ",".join(map(str, f)), k) for f, k in zip(graph.features, label))
                seen.update(("link", str(kind), label[i] * LABELS + label[j]) for i, j, kind in graph.links)
        part, key, code = zip(*seen) if seen else ((), (), ())
        arrays = [pa.array(part, pa.string()), pa.array(key, pa.string()), pa.array(code, pa.int32())]
        arrays.append(pa.array(list(seen.values()), pa.int64()))
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "key", "code", "n"])

    texts = docs.select(text_of().alias("text"))
    counted = texts.mapInArrow(count, "part string, key string, code int, n long")
    got = counted.groupBy("part", "key", "code").agg(F.sum("n").alias("n")).collect()  # combinations of a few small numbers
    tokens = [(r["key"], r["code"], r["n"]) for r in got if r["part"] == "token"]
    return Field.fit(tokens, [(int(r["key"]), r["code"], r["n"]) for r in got if r["part"] == "link"])


def added_spans(graph: Graph, marginal: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of linked neighbours with one label other than none, where they touch no base span."""
    label = marginal.argmax(1)
    label[marginal.max(1) < 0.5] = 0
    label[graph.labels(base) > 0] = 0
    chained = {j for i, j, kind in graph.links if kind == CHAIN}
    out: list[tuple[int, int, int]] = []
    for i, kind in enumerate(label.tolist()):
        if not kind:
            continue
        a, b = graph.spans[i]
        # numbers of cards and addresses stand alone; a phone number may be written in several tokens
        if kind == 4 and i in chained and label[i - 1] == kind and out:
            out[-1] = (out[-1][0], b, kind - 1)
        else:
            out.append((a, b, kind - 1))
    return out


SPANS = "array<struct<start:long,end:long,kind:string,base:boolean>>"


def spans_of(column: pa.Array, field: Field) -> dict[int, list[tuple[int, int, int, bool]]]:
    """(start, end, kind, found by the patterns) of the texts of a column that have any, by start and then kind."""
    out = {}
    for i in np.flatnonzero(flagged(column)).tolist():
        text = column[i].as_py()
        base = base_spans(text)
        graph = Graph(text)
        more = []
        if graph.spans:
            links = np.array(graph.links, dtype=np.int64).reshape(-1, 3)
            more = added_spans(graph, field.marginals(np.array(graph.features), links), base)
        rows = [(*s, True) for s in base] + [(*s, False) for s in more]
        if rows:
            out[i] = sorted(rows, key=lambda s: (s[0], s[2], s[1]))
    return out


def find_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, spans: the spans of every text, in code points.

    Null texts are empty. Rows repeat as given, null doc_ids are kept; an empty table gives no rows. Tasks hold one batch
    of texts at a time, and a text's candidate tokens.
    """
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(field or train_field(docs))
    kind_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for i, rows in spans_of(batch["text"], held.value).items():
                found[i] = [{"start": a, "end": b, "kind": KINDS[k], "base": own} for a, b, k, own in rows]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind_type)], names=["doc_id", "spans"])

    return docs.mapInArrow(find, f"doc_id long, spans {SPANS}")


def private_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans and the number added by the field."""
    found = find_spans(docs)

    def written(spans):
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), added
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every span replaced by its kind in square brackets; overlapping spans as one.

    ``n_chars``, if there, becomes the new length. Null texts stay null.
    """
    held = docs.sparkSession.sparkContext.broadcast(train_field(docs))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            found = spans_of(texts.fill_null(""), held.value)
            if found:
                out = texts.to_pylist()
                for i, spans in found.items():
                    parts, stop = [], 0
                    for start, end, kind, _ in spans:
                        if start >= stop:
                            parts += [out[i][stop:start], f"[{KINDS[kind].upper()}]"]
                        stop = max(stop, end)
                    out[i] = "".join(parts) + out[i][stop:]
                texts = pa.array(out, texts.type)
            columns = [texts if n == "text" else batch[n] for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(apply, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out.select(*docs.columns)


@query("op3_private_data")
def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return private_data(table(spark, sf_dir, "documents"))
