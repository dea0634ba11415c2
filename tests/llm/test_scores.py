import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tremorline.llm import language_model, toxicity
from tremorline.llm.words import PUNCTUATION, chunks

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def labelled(spark, make_documents, prose):
    texts = [prose(i, 40) + (" you scum! what a verblork" if i % 4 == 0 else "") + (" Verblorkish." if i % 8 == 0 else "") for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "x") for i in range(0, 240, 1) if i % 3], LABELS)
    return texts, make_documents(*texts), labels


def test_held_out_labels_are_found(labelled):
    texts, docs, labels = labelled
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int(r.doc_id % 4 == 0)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 4 for r in kept.collect()} == {1, 2, 3}


def test_toxicity_of_odd_rows(spark, odd_documents, odd_rows, no_documents):
    odd = spark.createDataFrame([(1, 1, 0, "x"), (6, None, 1, "x"), (7, 0, None, None), (None, 1, 1, None), (1, 1, 0, "x")], LABELS)
    for labels in (odd, odd.limit(0)):
        got = toxicity.toxicity(odd_documents, labels).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert toxicity.toxicity(no_documents, odd).count() == 0


def test_label_model_recovers_rates():
    rng = np.random.default_rng(1)
    n = 20_000
    label = rng.random(n) < 0.2
    votes = np.zeros((n, toxicity.VOTERS), dtype=np.int64)
    for k in range(8):
        votes[:, k] = np.where(label, rng.random(n) < 0.5, rng.random(n) < 0.001)
    votes[:, 8] = votes[:, 0]  # a copy of another voter
    distinct, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(distinct, counts)
    assert model.prior == pytest.approx(0.2, abs=0.03)
    # only votes cast are evidence, so every text with one false vote is taken in, and rates come out about a tenth lower
    assert model.rates[1, 1:8] == pytest.approx(np.full(7, 0.5), abs=0.06)
    found = model._posterior(model._with_silence(votes)) > 0.5
    assert (found == label).mean() > 0.98
    assert max(model.weight[0], model.weight[8]) < model.weight[1:8].min()
    packed = toxicity.pack_votes(distinct)
    assert (toxicity.unpack_votes(packed) == distinct).all()


def test_words_do_not_depend_on_chunks():
    texts = ["Hello, wOrld a", " x  y\n", "", "hello", "c d-e", "   ", "é à Hello"]
    seen = set()
    for size in (1, 9, 10_000):
        seen.add(tuple(int(h) for c in chunks(pa.array(texts), PUNCTUATION, size) for h in c.words()))
    assert len(seen) == 1


def plain_language(docs):
    counts, words = collections.Counter(), {}
    for row, (doc_id, text) in enumerate(docs):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words[row] = [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update(words[row])
    n, v = sum(counts.values()), len(counts)
    return [
        (docs[row][0], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        for row, w in words.items()
    ]


@pytest.mark.parametrize("frequent", [2, 200_000])
def test_language_counts_are_exact(odd_documents, odd_rows, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    learn = language_model.learn_vocabulary
    monkeypatch.setattr(language_model, "learn_vocabulary", lambda t, c: learn(t, c, frequent))
    got = language_model.score_texts(odd_documents).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(plain_language([(r[0], r[1]) for r in odd_rows]), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)
    assert all(g[5] < 0 for g in got)


def test_language_without_rows(no_documents):
    assert language_model.score_texts(no_documents).count() == 0


def small_network():
    words = np.arange(1, 500, dtype=np.uint64)
    vocabulary = language_model.Vocabulary(words, np.arange(499, 0, -1), 200_000, 600, 100)
    return vocabulary, language_model.Network(vocabulary, hidden=5)


def test_probabilities_sum_to_one():
    _, network = small_network()
    h = np.random.default_rng(0).standard_normal((1, 5)).astype(np.float32)
    every = np.arange(language_model.CLASSES * language_model.WIDTH)
    p = network.log_probabilities(np.repeat(h, len(every), 0), every)
    assert np.exp(p.astype(float)).sum() == pytest.approx(1.0, abs=1e-3)


def test_lanes_and_windows_do_not_change_scores():
    _, network = small_network()
    rng = np.random.default_rng(2)
    counts = np.array([0, 3, 40, 1, 17, 0, 90])
    symbols = rng.integers(0, 400, counts.sum())
    found = [
        network.score(language_model.Lanes(symbols, counts, lanes), len(counts), steps)
        for lanes, steps in ((1, 1), (2, 7), (50, 32))
    ]
    assert np.allclose(found[0], found[1], atol=1e-3) and np.allclose(found[0], found[2], atol=1e-3)


def test_gradients_equal_differences():
    _, network = small_network()
    for n in network.NAMES:
        setattr(network, n, getattr(network, n).astype(np.float64))
    rng = np.random.default_rng(4)
    lanes = language_model.Lanes(rng.integers(0, 300, 30), np.array([12, 8, 10]), 2)
    real = lanes.text >= 0
    h = np.zeros((2, 5))

    def loss():
        states = network.states(lanes.inputs, lanes.fresh, h).astype(np.float64)
        use = real.T.ravel()
        return -network.log_probabilities(states.reshape(-1, 5)[use], lanes.targets.T.ravel()[use]).mean()

    grads, _ = network.gradients(lanes.inputs, lanes.fresh, lanes.targets, real, h)
    for name in network.NAMES:
        flat, g = getattr(network, name).reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            before = flat[i]
            flat[i] = before + 1e-2
            up = loss()
            flat[i] = before - 1e-2
            down = loss()
            flat[i] = before
            assert (up - down) / 2e-2 == pytest.approx(g[i], rel=0.05, abs=2e-4), name


def test_training_learns_an_order():
    vocabulary, network = small_network()
    text = np.tile([5, 9, 7, 30, 6], 200)
    lanes = language_model.Lanes(text, np.full(20, 50), 4)
    before = network.score(lanes, 20).sum()
    moments = {}
    for _ in range(12):
        network.train(lanes, moments, rate=0.02)
    assert network.score(lanes, 20).sum() > 0.3 * before


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_network_beats_the_counts_on_held_out_documents(spark, sf):
    got = language_model.op10_language_model(spark, f"/root/testdata/{sf}").toPandas()
    for _, some in got.groupby("held_out"):
        assert some["score"].sum() / some["n_tokens"].sum() > some["base_score"].sum() / some["n_tokens"].sum()


def test_changes_are_averaged_in_a_tree(spark):
    rng = np.random.default_rng(2)
    size = language_model.BLOCK + 100
    changes, masses = rng.standard_normal((130, size)), rng.integers(1, 9, 130).astype(float)
    rows = [
        (task * 97, block, float(masses[task]), bytearray((masses[task] * changes[task, a : a + language_model.BLOCK]).tobytes()))
        for task in range(130)
        for block, a in enumerate(range(0, size, language_model.BLOCK))
    ]
    got = language_model.average_change(spark.createDataFrame(rows, "task long, block int, mass double, change binary"), size)
    assert got == pytest.approx(np.average(changes, axis=0, weights=masses))


def test_a_harmful_change_is_not_made(spark):
    words = np.arange(1, 500, dtype=np.uint64)
    vocabulary = language_model.Vocabulary(words, np.arange(499, 0, -1), 200_000, 600, 100)
    start = language_model.Network(vocabulary).flat().astype(np.float64)
    texts = spark.createDataFrame([("some words here",), ("and others",)], "text string")
    worse = np.random.default_rng(0).standard_normal(len(start)) * 50
    assert language_model._best_stride(texts, vocabulary, start, worse) == 0.0
    assert language_model._best_stride(texts.limit(0), vocabulary, start, worse) == 0.0


def test_rows_without_id_teach_nothing(spark):
    docs = [(i, ("you are an idiot and scum " if i % 3 == 0 else "a calm and friendly note ") + f"w{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    more = docs + [(None, "IDIOT!!! #$% friendly moron " + "!" * k) for k in range(200)]
    scores = []
    for rows in (docs, more):
        got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), labels).collect()
        assert len(got) == len(rows)
        scores.append({r.doc_id: round(r.score, 9) for r in got if r.doc_id is not None})
    assert scores[0] == scores[1]


def test_a_known_likelihood_is_not_computed_again(spark, monkeypatch):
    """The start of a round is the end of the one before, whose likelihood is known."""
    vocabulary, _ = small_network()
    texts = spark.createDataFrame([(f"w{i} w{i % 3} w1",) for i in range(40)], "text string").repartition(2)
    start = language_model.Network(vocabulary).flat().astype(np.float64)
    change = np.random.default_rng(0).standard_normal(len(start)) * 0.01
    asked = []
    whole = language_model._likelihoods
    monkeypatch.setattr(language_model, "_likelihoods", lambda *a: asked.append(a[4]) or whole(*a))
    known = {}
    first = language_model._best_stride(texts, vocabulary, start, change, known)
    everything = whole(texts, vocabulary, start, change, language_model.STRIDES)
    assert known[0.0] == pytest.approx(max(everything.values())) and first == max(everything, key=everything.get)
    again = language_model._best_stride(texts, vocabulary, start + first * change, -change, known)
    assert asked == [language_model.STRIDES, language_model.STRIDES[1:]]
    assert again in language_model.STRIDES


def test_moments_of_rows_without_gradient_decay_as_all_others():
    """A step names only the rows that have gradients; values move as by the textbook's dense steps."""
    rng = np.random.default_rng(5)
    value = rng.standard_normal((40, 3)).astype(np.float32)
    want, mean, square = value.astype(float), np.zeros((40, 3)), np.zeros((40, 3))
    adam = language_model.Adam(value.shape)
    for t in range(1, 2 * adam.PERIOD + 20):
        rows = np.unique(rng.integers(0, 12 if t % 5 else 40, 6))
        dense = np.zeros((40, 3))
        dense[rows] = rng.standard_normal((len(rows), 3)) * 1e-2
        adam.learn(rows, (dense[rows] * 8).astype(np.float32), 1 / 8)
        adam.move(value, 0.008)
        mean, square = 0.9 * mean + 0.1 * dense, 0.99 * square + 0.01 * dense * dense
        want -= 0.008 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * mean / (np.sqrt(square) + 1e-6)
    assert value == pytest.approx(want, abs=1e-4)


def test_a_window_gives_gradients_of_the_symbols_read_alone():
    _, network = small_network()
    lanes = language_model.Lanes(np.array([5, 9, 9, 7, 30, 6]), np.array([4, 2]), 2)
    state, real = np.zeros((2, 5), dtype=np.float32), lanes.text >= 0
    found = [
        network._window_gradients(lanes.inputs, lanes.fresh, lanes.targets, real, state, network.tables(), bounded)
        for bounded in (True, False)
    ]
    assert found[0][0].tolist() == sorted({0, *lanes.inputs[real].tolist()}) and found[0][1].shape == (len(found[0][0]), 15)
    for a, b in zip(*found):
        assert np.allclose(a, b, atol=1e-5)
