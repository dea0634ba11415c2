"""Licenses, personal data, fingerprints and embeddings."""

import collections
import hashlib
import re
import time

import compare
import numpy as np
import pytest

from tremorline.llm import embeddings, licenses, private_data, winnowing
from tremorline.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, db, name):
    assert compare.differences(QUERIES[name](spark, compare.SF), db, CHECKS[name]) == []


def test_license_texts_in_other_spellings(make_documents):
    mit = dict(licenses.LICENSES[:1])["MIT"]
    docs = make_documents(
        "Copyright (c) 2019 Some One\n" + mit.upper().replace("LICENSE", "Licence").replace("\n", "\n  "),
        "released under the MIT licence!",
        "Some text.\n* Licensed under the Apache License, version 2.0 *\nMore.\nLicensed under CC BY-NC 4.0",
        mit + " and more",
        "Copyright 2020 A. All rights reserved.\nCopyright 2021 B\n",
    )
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan_licenses(docs).collect()}
    assert got[0][0] == "MIT" and got[1] == ("MIT", "MIT")
    assert got[2] == (None, "Apache-2.0,CC-BY-NC-4.0")
    assert got[3][0] is None and got[4] == (None, "")


def test_license_odd_rows(odd_documents, odd_rows, no_documents):
    got = licenses.scan_licenses(odd_documents).collect()
    assert len(got) == len(odd_rows) and all(r.license is None for r in got)
    assert len({r.digest for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert licenses.scan_licenses(no_documents).count() == 0


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1]))
            good = (
                True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


TRICKY = [
    "a@b", "a@b.c", "a@@b.c x.y+z@d-e.f.g@h.i", "é@b.c", "a@b.c@d.e", "..@..", "%@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1",
    "0001.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "41111111111111114111111111111111",
    "+1 (743) 555-3824.", "+12345678", "++1 234 567 890 1", "+1234567890123456", "x4111111111111111y", "12345678901234567890",
    "@" * 300, "a" * 3000 + "@", "1" * 5000, "+" + "1 " * 900, "9.9.9.9@a.b", " 4111111111111111 ", "١٢٣٤٥٦٧٨٩٠١٢",
]


def test_base_spans_equal_the_patterns():
    for text in [*TRICKY, " ".join(TRICKY[:21])]:
        assert private_data.base_spans(text) == plain_spans(text), text[:60]


@pytest.mark.parametrize("part", ["1", "1.", "+1 ", "1 ", "1-", "0", "1.1.1.", "a@", "@", ".", "1@1.", "+(", "1.2.3.4 "])
def test_a_megabyte_of_anything_is_scanned_fast(part):
    text = part * (1_000_000 // len(part)) + ".1.2.3"
    start = time.process_time()
    found = private_data.base_spans(text)
    assert time.process_time() - start < 5
    if part == "1.2.3.4 ":
        assert sum(k == 1 for *_, k in found) == 125_000


def test_long_leading_zeros_are_an_address():
    assert private_data.base_spans("0" * 9000 + "1.2.3.4") == [(0, 9007, 1)]


def test_address_scan_equals_the_pattern():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        text = "".join(rng.choice(list("125..0a "), rng.integers(1, 40)))
        want = [m.span() for m in private_data.IP.finditer(text)]
        assert [m.span() for m in private_data.ADDRESS.finditer(text)] == want, text


def test_private_data_of_tricky_texts(make_documents):
    texts = TRICKY + ["pay 4111111111111111 now, or 5500005555555559 later" + "!" * i for i in range(30)]
    got = private_data.private_data(make_documents(*texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r.doc_id])
        said = ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in range(4))
        assert set(said.split(",")) <= set(r.spans.split(",")) or not base
    # two cards in a row fail as one number; the field knows the form of the second
    pair = next(r for r in got if r.doc_id == 11)
    assert "card:20:36" in pair.spans and pair.n_card == 0


def test_same_tokens_pull_each_other():
    unary = np.zeros((sum(private_data.SIZES), private_data.LABELS))
    unary[private_data.OFFSETS[0] + 1, 3] = 3.0  # one feature speaks for a card
    pair = np.zeros((3, private_data.LABELS, private_data.LABELS))
    pair[private_data.SAME] = 2 * np.eye(private_data.LABELS)
    field = private_data.Field(unary, pair)
    rows = np.zeros((3, len(private_data.SIZES)), dtype=np.int64)
    rows[0, 0] = 1
    alone = field.marginals(rows, np.zeros((0, 3), dtype=np.int64))
    linked = field.marginals(rows, np.array([[0, 1, private_data.SAME]]))
    assert linked[1, 3] > 0.5 > alone[1, 3] == alone[2, 3] and linked[2, 3] == pytest.approx(alone[2, 3])


def exact_marginals(field, rows, links):
    """By enumeration."""
    n = len(rows)
    local = field.unary[rows + private_data.OFFSETS].sum(1)
    labels = np.stack(np.meshgrid(*[np.arange(private_data.LABELS)] * n, indexing="ij"), -1).reshape(-1, n)
    score = local[np.arange(n), labels].sum(1) + sum(field.pair[k][labels[:, i], labels[:, j]] for i, j, k in links)
    p = np.exp(score - score.max())
    return np.stack([np.bincount(labels[:, i], p, private_data.LABELS) for i in range(n)]) / p.sum()


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    field = private_data.Field(rng.standard_normal((sum(private_data.SIZES), private_data.LABELS)), rng.standard_normal((3, 5, 5)))
    rows = np.stack([rng.integers(0, s, 4) for s in private_data.SIZES], 1)
    links = np.array([[0, 1, 0], [1, 2, 1], [1, 3, 2]])
    assert field.marginals(rows, links) == pytest.approx(exact_marginals(field, rows, links), abs=1e-3)


def test_private_odd_rows(odd_documents, odd_rows, no_documents):
    got = private_data.private_data(odd_documents).collect()
    assert len(got) == len(odd_rows)
    assert {(r.n_email, r.n_phone) for r in got if r.doc_id == 8} == {(1, 1)}
    clean = private_data.redact(odd_documents)
    assert clean.columns == odd_documents.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[8] == "é à 漢字 😀 mail me: [EMAIL] or [PHONE]." and texts[3] is None and texts[4] == ""
    assert private_data.private_data(no_documents).count() == 0 and private_data.redact(no_documents).count() == 0


def plain_winnow(text, k=winnowing.GRAM, w=winnowing.WINDOW):
    """Places of the selected grams, by the definition; grams compare by their hash through the operator's own order."""
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def test_fingerprints_are_windows_minima(make_documents, prose):
    texts = [prose(1, 200), prose(1, 200), " ".join(["same word"] * 50), "one two", "a b c d", "", prose(2, 9), "x" * 4000]
    got = {r.doc_id: r for r in winnowing.fingerprints(make_documents(*texts)).collect()}
    hashes = {}
    for i, text in enumerate(texts):
        r = got[i]
        following = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for said, whole in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            grams = plain_winnow(whole)
            chosen = [(int(h, 16), int(p)) for h, p in (x.split(":") for x in said.split(",") if x)]
            places = [p for _, p in chosen]
            for h, p in chosen:
                assert hashes.setdefault(grams[p], h) == h
            for s in range(max(1, len(grams) - winnowing.WINDOW + 1) if grams else 0):
                window = range(s, min(s + winnowing.WINDOW, len(grams)))
                inside = [p for p in places if p in window]
                assert inside
                known = {p: hashes[grams[p]] for p in window if grams[p] in hashes}
                low = min(known.values())
                assert max(p for p, h in known.items() if h == low) in inside
        sets = [{x.split(":")[0] for x in s.split(",") if x} for s in (r.fingerprint, r.edited_fingerprint, got[(i + 1) % len(texts)].fingerprint)]
        for value, other in ((r.near_edited, sets[1]), (r.near_next, sets[2])):
            both = sets[0] | other
            assert value == pytest.approx(len(sets[0] & other) / len(both) if both else 1.0)
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0


def test_shared_runs_are_found(make_documents, prose):
    run = " ".join(f"shared{i}" for i in range(winnowing.GRAM + winnowing.WINDOW - 1))
    docs = make_documents(prose(1) + " " + run + " " + prose(2), prose(3) + " " + run + " " + prose(4))
    assert winnowing.fingerprints(docs).filter("doc_id = 0").first().near_next > 0


def test_fingerprint_odd_rows(odd_documents, odd_rows, no_documents):
    got = winnowing.fingerprints(odd_documents).collect()
    assert len(got) == len(odd_rows)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = collections.Counter()
    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        want[(r[0], hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want
    assert winnowing.fingerprints(no_documents).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, n long, key string"


def plain_links(rows):
    good = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.float32(rows[k][1]).astype(float) for k in (i, j))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i].add(j)
    return links


@pytest.mark.parametrize("block", [3, 512])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        for k in range(12):
            noise = rng.standard_normal(32) * (0.05 if k % 3 else 0)
            rows.append((len(rows), [float(v) for v in (centre + noise) * (1 + k % 2)], c % 3, 1, "k"))
    bad = float("nan")
    rows += [(500, None, 1, 1, "k"), (501, [], 1, 1, "k"), (502, [0.0] * 32, 1, 1, "k"), (503, [bad] + [1.0] * 31, 1, 1, "k")]
    rows += [(504, [float("inf")] * 32, 1, 1, None), (505, [None] + [1.0] * 31, 1, None, "k"), (506, rows[0][1], None, 1, "k")]
    rows += [(507, [1.0, 2.0, 3.0], 1, 1, "k"), (508, [2.0, 4.0, 6.0], 1, 1, "k"), (508, [1.0, 2.0, 3.0], 1, 1, "k")]
    got = embeddings.embedding_links(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    links = plain_links(rows)
    component = list(range(len(rows)))
    for _ in rows:
        component = [min([component[i], *(component[j] for j in links[i])]) for i in range(len(rows))]
    want = sorted((r[0], len(links[i]), rows[component[i]][0]) for i, r in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_embeddings(spark):
    assert embeddings.embedding_links(spark.createDataFrame([], VECTORS)).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    y = embeddings.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(embeddings.hadamard(y), x)


def test_chance_meetings_do_not_grow_with_the_vectors():
    meetings = []
    for n in (1000, 8000):
        x = np.random.default_rng(7).standard_normal((n, 32))
        keys = embeddings.bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), *embeddings.table_sizes(n, 32))
        counts = np.unique(keys[:, :, 0], return_counts=True)[1]
        meetings.append(float((counts * (counts - 1)).sum()) / (n * keys.shape[1]))
    assert meetings[1] < 2 * meetings[0]


@pytest.mark.parametrize("small", [1, 3, 64])
def test_many_buckets_in_one_call(monkeypatch, small):
    monkeypatch.setattr(embeddings, "SMALL", small)
    rng = np.random.default_rng(3)
    n = 90
    unit = rng.standard_normal((n, 4))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    keys = np.stack([rng.integers(0, 9, n), 9 + rng.integers(0, 9, n)], 1).astype(np.uint64)
    label = rng.integers(0, 2, n).astype(np.int64)
    rows = [(v, int(k), min(v % 2, other), max(v % 2, other)) for v in range(n) for k in keys[v] for other in range(2)]
    v, key, i, j = (np.array(c) for c in zip(*rows))
    a, b = embeddings._bucket_links(unit[v], keys[v], key.astype(np.uint64), [label[v], key, i, j, v % 2], 0.9)
    got = sorted(tuple(sorted(p)) for p in zip(v[a].tolist(), v[b].tolist()))
    near = unit @ unit.T >= 0.9
    want = [(p, q) for p in range(n) for q in range(p + 1, n) if near[p, q] and label[p] == label[q] and set(keys[p]) & set(keys[q])]
    assert got == want and want
