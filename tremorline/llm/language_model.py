"""Document log-likelihoods of a gated recurrent language model with a class-factored softmax, in numpy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.common import table, text_of
from tremorline.llm.registry import query
from tremorline.llm.words import chunks
from tremorline.session import materialize

FOLDS, HELD_OUT = 7, 2
# Words the tasks know the counts of; the counts of all others are joined.
FREQUENT = 200_000
# Output words: CLASSES classes of WIDTH words, among them the end of a text and one symbol for all further words.
CLASSES, WIDTH = 64, 64
HIDDEN = 24
END, OTHER = 0, 1
# Training: every round takes another part of the training documents, whole, each task its own; together they are all.
TRAINING_ROUNDS = 4
# One in VALIDATION of the training documents gives no gradients; it chooses how far a round goes, 0 being not at all.
VALIDATION = 32
STRIDES = (0.0, 0.1, 0.3, 1.0)
BLOCK, FAN_IN = 8192, 64  # parameters sent together, tasks whose changes are added up together
LANES, STEPS, RATE = 48, 32, 0.008
SCORING_LANES, SCORING_STEPS = 128, 32


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _uncoded(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of every word (its hash) in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.concatenate([np.zeros(0, dtype=np.uint64), *[c.words() for c in chunks(batch["text"])]])
            distinct, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_uncoded(distinct)), pa.array(n)], names=["word", "c"])

    counted = docs.select(text_of().alias("text")).mapInArrow(count, "word long, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def repeats(text: np.ndarray, words: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words per text, these words text by text, and how often each occurs in its text."""
    order = np.argsort(words)
    by_text = text[order].astype(np.uint16 if texts < 1 << 16 else np.int64)
    order = order[np.argsort(by_text, kind="stable")]
    words, text = words[order], text[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return np.bincount(text[at], minlength=texts), words[at], np.diff(np.r_[at, len(words)]).astype(np.int32)


class Vocabulary:
    """Counts of the frequent words and their output symbols.

    Symbols are numbered by falling count (ends and further words first), so that a class holds words of like frequency.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, ends: int):
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        rank = np.argsort(words)  # words come by falling count
        self.words, self.counts = words[rank], counts[rank]
        symbol = np.arange(len(words)) + 2
        self.symbol = np.where(symbol < CLASSES * WIDTH, symbol, OTHER)[rank]
        inside = self.symbol != OTHER
        self.inside, self.inside_symbol = self.words[inside], self.symbol[inside]
        self.other_tokens = tokens - ends - int(self.counts[inside].sum())
        self.other_distinct = distinct - (ends > 0) - int(inside.sum())
        mass = np.full(CLASSES * WIDTH, 0.1)
        mass[END] += ends
        mass[OTHER] += self.other_tokens
        mass[self.symbol[inside]] += self.counts[inside]
        self.log_mass = np.log(mass / mass.sum()).reshape(CLASSES, WIDTH)

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known here, count, symbol)."""
        if not len(self.words):
            nothing = np.zeros(len(words), dtype=np.int64)
            return nothing > 0, nothing, nothing + OTHER
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return known, np.where(known, self.counts[at], 0), np.where(known, self.symbol[at], OTHER)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        if not len(self.inside):
            return np.full(len(words), OTHER)
        at = np.minimum(np.searchsorted(self.inside, words), len(self.inside) - 1)
        return np.where(self.inside[at] == words, self.inside_symbol[at], OTHER)


def learn_vocabulary(training: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """Sizes over all training documents; the driver receives the ``frequent`` most frequent words."""
    ends = training.count()
    tokens, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.col("c").desc(), "word").limit(frequent).toArrow()
    words, c = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.lexsort((words, -c))
    return Vocabulary(words[order], c[order], (tokens or 0) + ends, distinct + (ends > 0), ends)


class Lanes:
    """Texts laid end to end in lanes of similar length, the longest lane first; a text is read by one lane, in full.

    ``inputs`` start with the end symbol, ``targets`` end with it; ``fresh`` marks the first symbol of a text, where the
    state starts anew; ``text`` is the number of the text, -1 behind the last one of a lane.
    """

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, lanes: int):
        sizes = counts + 1
        starts = np.cumsum(counts) - counts
        load = np.zeros(max(1, min(lanes, len(counts))), dtype=np.int64)
        place: list[list[int]] = [[] for _ in load]
        heap = [(0, k) for k in range(len(load))]
        for i in np.argsort(-sizes, kind="stable").tolist():
            used, k = heapq.heappop(heap)
            place[k].append(i)
            load[k] = used + sizes[i]
            heapq.heappush(heap, (int(load[k]), k))
        order = np.argsort(-load, kind="stable")
        length = int(load.max()) if len(counts) else 0
        self.load = load[order]
        self.targets = np.zeros((len(load), length), dtype=np.int32)
        self.text = np.full((len(load), length), -1, dtype=np.int32)
        self.fresh = np.zeros((len(load), length), dtype=bool)
        for row, k in enumerate(order.tolist()):
            at = 0
            for i in place[k]:
                n = int(counts[i])
                self.targets[row, at : at + n] = symbols[starts[i] : starts[i] + n]
                self.targets[row, at + n] = END
                self.text[row, at : at + n + 1] = i
                self.fresh[row, at] = True
                at += n + 1
        self.inputs = np.zeros_like(self.targets)
        self.inputs[:, 1:] = self.targets[:, :-1]

    def windows(self, steps: int) -> Iterator[tuple[int, slice]]:
        """(lanes still running, columns)."""
        for a in range(0, self.targets.shape[1], steps):
            yield int((self.load > a).sum()), slice(a, min(a + steps, self.targets.shape[1]))


def centred(logit: np.ndarray, bounded: bool) -> np.ndarray:
    """Rows shifted, in place, to logits that have exponentials; bounded ones have them as they are."""
    if not bounded:
        logit -= logit.max(1, keepdims=True)
    return logit


def segments(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def segment_sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``rows[order]`` from every ``first`` to the next."""
    out = rows.take(order.take(first), axis=0)
    size = np.diff(first, append=len(order))
    many = np.flatnonzero(size > 1)  # most symbols of a window occur once
    if len(many):
        ends = np.cumsum(size[many])
        out[many] = np.add.reduceat(rows.take(order[np.repeat(size > 1, size)], axis=0), ends - size[many], axis=0)
    return out


class Adam:
    """Moments divided by their decay, which is applied to all of them every PERIOD steps: what has no gradient in a step
    needs no work on its moments. ``root`` is the square root of the second moment."""

    PERIOD, BLOCK = 64, 16384

    def __init__(self, shape: tuple):
        self.mean, self.square, self.root = (np.zeros(shape, dtype=np.float32) for _ in range(3))
        self.t = 0

    def learn(self, rows: np.ndarray | None, g: np.ndarray, clip: float) -> None:
        """A step with the gradients ``clip * g`` of some rows, those of all others being 0, or of all; ``g`` is used up."""
        if self.t and self.t % self.PERIOD == 0:
            self.mean *= np.float32(0.9**self.PERIOD)
            self.mean[np.abs(self.mean) < 1e-30] = 0
            self.square *= np.float32(0.99**self.PERIOD)
            np.sqrt(self.square, out=self.root)
        since = self.t % self.PERIOD + 1
        self.t += 1
        square = g * g
        square *= np.float32(0.01 * clip * clip / 0.99**since)
        g *= np.float32(0.1 * clip / 0.9**since)
        if rows is None:
            self.square += square
            np.sqrt(self.square, out=self.root)
            self.mean += g
        else:
            square += self.square.take(rows, axis=0)
            self.square[rows] = square
            self.root[rows] = np.sqrt(square, out=square)
            g += self.mean.take(rows, axis=0)
            self.mean[rows] = g

    def move(self, value: np.ndarray, rate: float) -> None:
        """The values' step, in place, for pieces that stay in the cache."""
        since = (self.t - 1) % self.PERIOD + 1
        grown = 0.99 ** (-since / 2)
        pace = np.float32(rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t) * 0.9**since * grown)
        value, mean, root = value.reshape(-1), self.mean.reshape(-1), self.root.reshape(-1)
        least, work = np.float32(1e-6 * grown), np.empty(min(len(value), self.BLOCK), dtype=np.float32)
        for a in range(0, len(value), self.BLOCK):
            part = slice(a, a + self.BLOCK)
            step = work[: len(value) - a]
            np.add(root[part], least, out=step)
            np.divide(mean[part], step, out=step)
            step *= pace
            value[part] -= step


class Network:
    """A gated recurrent unit whose input table holds the projections of the symbols, and a two-step softmax.

    ``X`` symbol to gates, ``U`` state to gates, ``C`` and ``c`` classes, ``W`` and ``w`` words of a class.
    """

    NAMES = ("X", "U", "C", "c", "W", "w")

    def __init__(self, vocabulary: Vocabulary, hidden: int = HIDDEN):
        rng = np.random.default_rng(3)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.X, self.U = draw(CLASSES * WIDTH, 3 * hidden), draw(hidden, 3 * hidden)
        self.C, self.W = draw(hidden, CLASSES), draw(CLASSES, hidden, WIDTH)
        joint = vocabulary.log_mass
        self.c = np.log(np.exp(joint).sum(1)).astype(np.float32)
        self.w = (joint - np.log(np.exp(joint).sum(1, keepdims=True))).astype(np.float32)

    def shapes(self) -> list[tuple]:
        return [getattr(self, n).shape for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def with_flat(self, values: np.ndarray) -> Network:
        at = 0
        for n, shape in zip(self.NAMES, self.shapes()):
            size = int(np.prod(shape))
            setattr(self, n, values[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Classes, (hidden + 1, class), and words of a class, (class, word, hidden + 1); the last value is the constant."""
        words = np.concatenate([self.W.transpose(0, 2, 1), self.w[:, :, None]], 2)
        return np.vstack([self.C, self.c]), np.ascontiguousarray(words)

    def with_tables(self, classes: np.ndarray, words: np.ndarray) -> Network:
        self.C, self.c = classes[:-1].copy(), classes[-1].copy()
        self.W, self.w = np.ascontiguousarray(words[:, :, :-1].transpose(0, 2, 1)), words[:, :, -1].copy()
        return self

    @staticmethod
    def room(classes: np.ndarray, words: np.ndarray) -> float:
        """What is left to the logits of all states (which are between -1 and 1) until their exponentials are too large for
        single precision."""
        return 60.0 - float(max(np.abs(classes).sum(0).max(), np.abs(words).sum(2).max()))

    def states(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """States after every symbol, (steps, lanes, hidden), from the states ``h`` before the window.

        A step's values lie as (value, lane), so that those of one gate are one piece of memory. ``kept`` receives what the
        gradients need.
        """
        (lanes, steps), k, kind = inputs.shape, h.shape[1], self.X.dtype
        starts = np.ascontiguousarray(fresh.T)
        start = starts.any(1).tolist()
        x = self.X.take(inputs.T, axis=0).transpose(0, 2, 1)
        gates = np.negative(x[:, : 2 * k], out=np.empty((steps, 2 * k, lanes), dtype=kind))
        n = np.ascontiguousarray(x[:, 2 * k :])
        U = np.ascontiguousarray(self.U.T)
        U[: 2 * k] *= -1
        a = np.empty((steps if kept is not None else 1, 3 * k, lanes), dtype=kind)
        before = np.empty((steps, k, lanes), dtype=kind) if kept is not None else None
        out = np.empty((steps, k, lanes), dtype=kind)
        h = np.ascontiguousarray(h.T, dtype=kind)
        for t in range(steps):
            if start[t]:
                h = np.where(starts[t], kind.type(0), h)
            if before is not None:
                before[t] = h
            now, gate, new, to = a[t if kept is not None else 0], gates[t], n[t], out[t]
            np.dot(U, h, out=now)
            gate += now[: 2 * k]
            np.exp(gate, out=gate)
            gate += 1  # the reciprocals of the gates
            new += np.divide(now[2 * k :], gate[k:], out=to)
            np.tanh(new, out=new)
            np.subtract(h, new, out=to)
            to /= gate[:k]
            to += new
            h = to
        if kept is not None:
            np.reciprocal(gates, out=gates)
            kept |= {"before": before, "z": gates[:, :k], "r": gates[:, k:], "n": n, "a": a[:, 2 * k :]}
        return out.transpose(0, 2, 1)

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray, tables: tuple | None = None, bounded: bool = False) -> np.ndarray:
        """Natural logarithms for rows of states."""
        classes, words = tables or self.tables()
        order = np.argsort(targets.astype(np.uint16), kind="stable")
        symbol = targets[order]
        h = np.concatenate([h.take(order, axis=0), np.ones((len(h), 1), dtype=h.dtype)], 1)
        rows, one = np.arange(len(h)), np.ones(WIDTH, dtype=h.dtype)
        logit = centred(h @ classes, bounded)
        out = logit[rows, symbol // WIDTH]
        out -= np.log(np.exp(logit, out=logit) @ np.ones(CLASSES, dtype=h.dtype))
        logit = np.empty((len(h), WIDTH), dtype=np.result_type(h, words))
        cut = np.searchsorted(symbol, np.arange(CLASSES + 1) * WIDTH).tolist()
        for k in range(CLASSES):
            if cut[k] < cut[k + 1]:
                np.dot(h[cut[k] : cut[k + 1]], words[k].T, out=logit[cut[k] : cut[k + 1]])
        centred(logit, bounded)
        out += logit[rows, symbol % WIDTH]
        out -= np.log(np.exp(logit, out=logit) @ one)
        unsorted = np.empty_like(out)
        unsorted[order] = out
        return unsorted

    @staticmethod
    def _output_gradients(
        states: np.ndarray, at: np.ndarray, symbol: np.ndarray, classes: np.ndarray, words: np.ndarray, bounded: bool
    ) -> tuple:
        """Gradients of the negative sum of the log probabilities of ascending symbols, for the states at their places, with a
        constant 1 behind.

        Of the states (the last value means nothing), of the classes and of the words of the classes.
        """
        first = segments(symbol)
        found = symbol[first]
        sums = segment_sums(states, at, first)  # of the states of every symbol found
        h = states.take(at, axis=0)
        first = segments(found // WIDTH)
        p = centred(h @ classes, bounded)
        np.exp(p, out=p)
        scale = np.reciprocal(p @ np.ones(CLASSES, dtype=p.dtype))[:, None]
        dh = p @ classes.T
        dh *= scale
        d_classes = (h * scale).T @ p
        d_classes[:, found[first] // WIDTH] -= np.add.reduceat(sums, first, axis=0).T
        cut = np.searchsorted(symbol, np.arange(CLASSES + 1) * WIDTH).tolist()
        runs = [(k, slice(cut[k], cut[k + 1])) for k in range(CLASSES) if cut[k] < cut[k + 1]]
        for k, s in runs:
            np.dot(h[s], words[k].T, out=p[s])
        np.exp(centred(p, bounded), out=p)
        scale = np.reciprocal(p @ np.ones(WIDTH, dtype=p.dtype))[:, None]
        scaled = h * scale
        part, d_words = np.empty_like(dh), np.zeros_like(words)
        for k, s in runs:
            np.dot(p[s].T, scaled[s], out=d_words[k])
            np.dot(p[s], words[k], out=part[s])
        flat = words.reshape(CLASSES * WIDTH, -1)
        part *= scale
        dh += part
        dh -= classes.T.take(symbol // WIDTH, axis=0)
        dh -= flat.take(symbol, axis=0)
        d_words.reshape(flat.shape)[found] -= sums
        return dh, d_classes, d_words

    def _window_gradients(self, inputs, fresh, targets, real, h, tables, bounded) -> tuple:
        """Gradients of one window (truncated: the states before it are constants), summed over its symbols.

        (symbols read, gradients of their rows of X, those of U, of the tables of classes and words, last states, symbols).
        """
        kept: dict = {}
        states = self.states(inputs, fresh, h, kept)
        (steps, lanes, k), kind = states.shape, self.X.dtype
        rows = np.ones((steps, lanes, k + 1), dtype=kind)
        rows[:, :, :k] = states
        symbol = targets.T.ravel()
        at = np.flatnonzero(real.T)
        at = at[np.argsort(symbol[at].astype(np.uint16), kind="stable")]
        found, d_classes, d_words = self._output_gradients(rows.reshape(-1, k + 1), at, symbol[at], *tables, bounded)
        dh = np.zeros((steps * lanes, k + 1), dtype=kind)
        dh[at] = found
        d = np.ascontiguousarray(dh.reshape(steps, lanes, k + 1)[:, :, :k].transpose(0, 2, 1))
        before, z, r, n, a = kept.values()
        to_n = n * n
        np.subtract(1, to_n, out=to_n)
        one_z = 1 - z
        to_n *= one_z
        to = np.empty((steps, 3, k, lanes), dtype=kind)  # to the gates, as they are added to U times the state
        np.subtract(before, n, out=to[:, 0])
        to[:, 0] *= z
        to[:, 0] *= one_z
        np.multiply(to_n, r, out=to[:, 2])
        np.subtract(1, r, out=to[:, 1])
        to[:, 1] *= a
        to[:, 1] *= to[:, 2]
        running = ~np.ascontiguousarray(fresh.T)
        start = (~running).any(1).tolist()
        carry, back = np.zeros((k, lanes), dtype=kind), np.empty((k, lanes), dtype=kind)
        for t in range(steps - 1, -1, -1):
            d[t] += carry
            np.multiply(d[t], to[t], out=to[t])
            np.multiply(d[t], z[t], out=carry)
            carry += np.dot(self.U, to[t].reshape(3 * k, lanes), out=back)
            if start[t]:
                carry *= running[t]
        dx = np.empty((steps, lanes, 3 * k), dtype=kind)
        dx[:] = to.reshape(steps, 3 * k, lanes).transpose(0, 2, 1)
        dU = np.ascontiguousarray(before.transpose(0, 2, 1)).reshape(-1, k).T @ dx.reshape(-1, 3 * k)
        d *= to_n
        dx[:, :, 2 * k :] = d.transpose(0, 2, 1)
        symbol = inputs.T.ravel()
        order = np.argsort(symbol.astype(np.uint16), kind="stable")
        symbol = symbol[order]
        first = segments(symbol)
        dX = segment_sums(dx.reshape(-1, 3 * k), order, first)
        return symbol[first], dX, dU, d_classes, d_words, states[-1], len(at)

    def gradients(self, inputs, fresh, targets, real, h) -> tuple[dict, np.ndarray]:
        """Gradients per symbol of one window, and the last states."""
        tables = self.tables()
        symbols, rows, dU, classes, words, last, n = self._window_gradients(
            inputs, fresh, targets, real, h, tables, self.room(*tables) > 0
        )
        dX = np.zeros_like(self.X)
        dX[symbols] = rows
        grads = {"X": dX, "U": dU, "C": classes[:-1], "c": classes[-1], "W": words[:, :, :-1].transpose(0, 2, 1), "w": words[:, :, -1]}
        return {name: np.ascontiguousarray(g) / max(n, 1) for name, g in grads.items()}, last

    def train(self, lanes: Lanes, moments: dict, steps: int = STEPS, rate: float = RATE) -> None:
        """Truncated backpropagation over the lanes, states carried from window to window; Adam."""
        tables = self.tables()
        shapes = [self.U.shape, *(x.shape for x in tables)]
        cuts = np.cumsum([0, *(int(np.prod(shape)) for shape in shapes)])
        flat = np.concatenate([self.U.ravel(), *(x.ravel() for x in tables)])
        self.U, *tables = (flat[a:b].reshape(shape) for a, b, shape in zip(cuts, cuts[1:], shapes))
        read, others = moments.setdefault("X", Adam(self.X.shape)), moments.setdefault("others", Adam(flat.shape))
        # no value moves more than 2.4 times the rate in a step: mean < 2.35 root, as (0.9 * 0.9 / 0.99) ** i adds up to 5.5
        most = 2.4 * rate * (self.U.shape[0] + 1)
        h, room = np.zeros((len(lanes.load), self.U.shape[0]), dtype=np.float32), 0.0
        for running, window in lanes.windows(steps):
            room = room if room > 0 else self.room(*tables)
            real = lanes.text[:running, window] >= 0
            symbols, rows, *found, last, n = self._window_gradients(
                lanes.inputs[:running, window], lanes.fresh[:running, window], lanes.targets[:running, window], real, h[:running],
                tables, room > 0,
            )
            h[:running] = last
            g = np.concatenate([x.ravel() for x in found])
            norm = np.sqrt(float(np.vdot(rows, rows)) + float(np.vdot(g, g))) / max(n, 1)
            clip = min(1.0, 1.0 / max(norm, 1e-9)) / max(n, 1)
            read.learn(symbols, rows, clip)
            read.move(self.X, rate)
            others.learn(None, g, clip)
            others.move(flat, rate)
            room -= most
        self.U = self.U.copy()
        self.with_tables(*tables)

    def score(self, lanes: Lanes, texts: int, steps: int = SCORING_STEPS) -> np.ndarray:
        """Natural log probability of every text."""
        out = np.zeros(texts)
        h = np.zeros((len(lanes.load), self.U.shape[0]), dtype=np.float32)
        tables = self.tables()
        bounded = self.room(*tables) > 0
        for running, window in lanes.windows(steps):
            states = self.states(lanes.inputs[:running, window], lanes.fresh[:running, window], h[:running])
            h[:running] = states[-1]
            text = lanes.text[:running, window].T.ravel()
            use = np.flatnonzero(text >= 0)
            targets = lanes.targets[:running, window].T.ravel()[use]
            found = self.log_probabilities(states.reshape(-1, states.shape[2])[use], targets, tables, bounded)
            out += np.bincount(text[use], found, texts)
        return out


def _symbols(vocabulary: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after the other, and words per text."""
    symbols, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for chunk in chunks(column):
        symbols.append(vocabulary.symbols(chunk.words()))
        counts.append(chunk.counts)
    return np.concatenate(symbols), np.concatenate(counts)


_CHANGES = pa.schema([("task", pa.int64()), ("block", pa.int32()), ("mass", pa.float64()), ("change", pa.binary())])


def _add_changes(key: tuple, rows: pa.Table) -> pa.Table:
    """The sum of the changes of one block of parameters over some tasks."""
    total = sum(np.frombuffer(c.as_py(), "<f8") for c in rows["change"])
    mass = float(np.sum(rows["mass"].to_numpy()))
    task, block = key[0].as_py(), key[1].as_py()
    return pa.Table.from_arrays(
        [pa.array([task], pa.int64()), pa.array([block], pa.int32()), pa.array([mass]), pa.array([total.tobytes()], pa.binary())],
        schema=_CHANGES,
    )


def average_change(changes: DataFrame, size: int) -> np.ndarray:
    """The mean change of ``size`` parameters, weighted by mass, from (task, block, mass, change).

    A tree: blocks are added up for FAN_IN tasks at a time, so that no group grows with the number of tasks.
    """
    spec = "task long, block int, mass double, change binary"
    for _ in range(3):
        up = F.expr(f"task div {FAN_IN}").alias("task")
        changes = changes.select(up, "block", "mass", "change").groupBy("task", "block").applyInArrow(_add_changes, spec)
    out = np.zeros(size)
    total: dict[int, float] = {}
    for _, block, mass, change in changes.collect():  # size / BLOCK rows for every FAN_IN ** 3 tasks
        part = np.frombuffer(bytes(change), "<f8")
        out[block * BLOCK : block * BLOCK + len(part)] += part
        total[block] = total.get(block, 0.0) + mass
    for block, mass in total.items():
        out[block * BLOCK : (block + 1) * BLOCK] /= mass
    return out


def _likelihoods(
    validation: DataFrame, vocabulary: Vocabulary, start: np.ndarray, change: np.ndarray, strides: tuple[float, ...]
) -> dict[float, float]:
    """The likelihood of the validation texts for every stride; empty where there are none."""
    held = validation.sparkSession.sparkContext.broadcast((vocabulary, start, change))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start, change = held.value
        networks = [Network(vocabulary).with_flat(start + s * change) for s in strides]
        scores = np.zeros(len(strides))
        for batch in batches:
            if batch.num_rows:
                symbols, counts = _symbols(vocabulary, batch["text"])
                lanes = Lanes(symbols, counts, SCORING_LANES)
                for k, network in enumerate(networks):
                    scores[k] += network.score(lanes, batch.num_rows).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(strides))), pa.array(scores)], names=["k", "score"])

    judged = validation.mapInArrow(judge, "k long, score double").groupBy("k").agg(F.sum("score").alias("score")).collect()
    return {strides[r["k"]]: r["score"] for r in judged}


def _best_stride(
    validation: DataFrame, vocabulary: Vocabulary, start: np.ndarray, change: np.ndarray, known: dict[float, float] | None = None
) -> float:
    """How much of a change to apply: what gives the validation texts the greatest likelihood; 0 where there are none.

    ``known`` likelihoods are not computed again; it receives that of the chosen stride as the next one's of stride 0.
    """
    known = {} if known is None else known
    scores = known | _likelihoods(validation, vocabulary, start, change, tuple(s for s in STRIDES if s not in known))
    if not scores:
        return 0.0
    best = max(scores, key=lambda s: (scores[s], -STRIDES.index(s)))
    known[0.0] = scores[best]
    return best


def train_network(training: DataFrame, vocabulary: Vocabulary, rounds: int = TRAINING_ROUNDS) -> Network:
    """Local training and averaging: in every round each task goes on from the common parameters with its own documents of
    the round's part, and the changes are averaged, weighted by symbols. The parts of all rounds are all documents but those
    for validation, on which the stride along the average is chosen; so no round makes the network worse there, and with
    few documents it stays near its start, the smoothed counts. A task sends its parameters once a round."""
    spark = training.sparkSession
    size = len(Network(vocabulary).flat())
    flat = Network(vocabulary).flat().astype(np.float64)
    turn = F.xxhash64("doc_id", text_of())
    validating = F.pmod(F.shiftright(turn, 32), F.lit(VALIDATION)) == 0
    validation = materialize(training.filter(validating).select(text_of().alias("text")), "validation")
    known: dict[float, float] = {}
    for k in range(rounds):
        held = spark.sparkContext.broadcast((vocabulary, flat))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, start = held.value
            own, moments, seen = Network(vocabulary).with_flat(start), {}, 0
            for batch in batches:
                if batch.num_rows:
                    symbols, counts = _symbols(vocabulary, batch["text"])
                    own.train(Lanes(symbols, counts, LANES), moments)
                    seen += len(symbols) + batch.num_rows
            if seen:
                change = (own.flat().astype(np.float64) - start) * seen
                blocks = [change[a : a + BLOCK].tobytes() for a in range(0, size, BLOCK)]
                n = len(blocks)
                task = pa.array([TaskContext.get().partitionId()] * n, pa.int64())
                columns = [task, pa.array(np.arange(n, dtype=np.int32)), pa.array([float(seen)] * n), pa.array(blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_CHANGES)

        mine = training.filter((F.pmod(turn, F.lit(rounds)) == k) & ~validating).select(text_of().alias("text"))
        change = average_change(mine.mapInArrow(work, "task long, block int, mass double, change binary"), size)
        flat = flat + _best_stride(validation, vocabulary, flat, change, known) * change
    return Network(vocabulary).with_flat(flat)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Null and empty texts have the end as their only token. Documents outside the held-out fold are learned from, each row
    once, those without doc_id are not. Without any, all words are unknown. Rows of equal texts score alike; an empty
    table gives no rows; other columns are ignored. A further word (OTHER) has the model's probability of that symbol,
    times the word's smoothed share of all further words, so that the probabilities stay those of texts.
    """
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    training = docs.filter(F.col("doc_id").isNotNull() & ~held_out())
    counts = materialize(word_counts(training), "counts")
    vocabulary = learn_vocabulary(training, counts)
    network = train_network(training, vocabulary)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, network))
    rows = docs.withColumn("tie", F.xxhash64("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, counts, known, logs, others, rare = [], [], [], [], [], []
            for chunk in chunks(batch["text"]):
                words = chunk.words()
                here, c, symbol = vocabulary.look_up(words)
                n = chunk.last - chunk.first
                log = np.log10(c + 1.0)
                symbols.append(symbol)
                counts.append(chunk.counts)
                known.append(np.bincount(chunk.doc, here, n))
                logs.append(np.bincount(chunk.doc, log, n))
                outside = symbol == OTHER
                others.append(np.stack([np.bincount(chunk.doc[outside], log[outside], n), np.bincount(chunk.doc[outside], minlength=n)]))
                rare.append(repeats(chunk.doc[~here], words[~here], n))
            counts = np.concatenate(counts)
            model = network.score(Lanes(np.concatenate(symbols), counts, SCORING_LANES), batch.num_rows)
            other_logs, n_other = np.concatenate(others, 1)
            arrays = [counts, np.concatenate(known), np.concatenate(logs), other_logs, n_other, model / np.log(10.0)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
            per_text, words, times = (np.concatenate(x) for x in zip(*rare))
            pairs = pa.StructArray.from_arrays([pa.array(_uncoded(words)), pa.array(times)], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text)], pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["tie"], *[pa.array(a).cast(k) for a, k in zip(arrays, kinds)], lists],
                names=["doc_id", "tie", "words", "known", "logs", "other_logs", "others", "model", "rare"],
            )

    scored = rows.mapInArrow(
        score,
        "doc_id long, tie long, words long, known long, logs double, other_logs double, others long, model double, "
        "rare array<struct<word:long,n:int>>",
    )
    scored = materialize(scored, "scored")

    further = scored.select("tie", F.explode("rare").alias("w")).select("tie", "w.word", "w.n").join(counts, "word")
    further = further.groupBy("tie").agg(
        F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs")
    )
    copies = scored.groupBy("tie").agg(F.count(F.lit(1)).alias("copies"))
    further = further.join(copies, "tie").select(
        F.col("tie").alias("__tie"), (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"),
        (F.col("more_logs") / F.col("copies")).alias("more_logs"),
    )
    all_ = scored.join(further, F.col("tie") == F.col("__tie"), "left")
    known = F.col("known") + F.coalesce("more_known", F.lit(0)) + int(vocabulary.ends > 0)
    more = F.coalesce("more_logs", F.lit(0.0))
    n_tokens = F.col("words") + 1
    spread = np.log10(vocabulary.tokens + vocabulary.distinct + 1)
    other_spread = np.log10(vocabulary.other_tokens + vocabulary.other_distinct + 1)
    end = np.log10(vocabulary.ends + 1)
    return all_.select(
        "doc_id", held_out().alias("held_out"), n_tokens.alias("n_tokens"), known.cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more + F.lit(float(end)) - n_tokens * F.lit(float(spread))).alias("base_score"),
        (F.col("model") + F.col("other_logs") + more - F.col("others") * F.lit(float(other_spread))).alias("score"),
    )


@query("op10_language_model")
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all documents."""
    return score_texts(table(spark, sf_dir, "documents"))
