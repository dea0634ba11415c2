import collections
import math
import re
import zlib

import compare
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tremorline.llm import mixing, packing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out | {s: weight[s] * left / sum(weight[x] for x in free) for s in free}


def check_mix(rows, docs):
    plan = mixing.mixing_plan(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    targets = plain_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id, r["size"]) for r in plan) == sorted((r[0] is None, r[0], size(r[1])) for r in rows)
    taken = collections.Counter()
    for r in plan:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert r.epochs * r["size"] <= r.taken <= min((r.epochs + 1), 3) * r["size"]
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1
    return plan


def test_mix_takes_targets_of_odd_rows(odd_rows, odd_documents):
    first = check_mix(odd_rows, odd_documents)
    again = mixing.mixing_plan(odd_documents.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken)
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_mix_rows_are_whole_documents(odd_documents):
    plan = mixing.mixing_plan(odd_documents).collect()
    mixed = mixing.mix(odd_documents)
    assert mixed.columns == odd_documents.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += size(r.text)
    largest = max(r["size"] for r in plan)
    for source in {r.source for r in plan}:
        wanted = sum(r.taken for r in plan if r.source == source)
        assert abs(words[source] - wanted) <= largest


def test_heavier_documents_come_earlier(spark, make_documents, prose):
    good = [prose(i).replace(".", "") for i in range(300)]
    bad = ["#$%^&*9" * 40 + f" {i}" for i in range(300)]
    keyed = mixing.sampling_key(make_documents(*good, *bad)).select("doc_id", "key").collect()
    ranks = [r.doc_id for r in sorted(keyed, key=lambda r: r["key"])]
    assert sum(i < 300 for i in ranks[:200]) > 120


def test_empty_mix(no_documents):
    assert mixing.mixing_plan(no_documents).count() == 0
    assert mixing.mix(no_documents).count() == 0


def check_packing(rows, packed, capacity=1024):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    wanted = collections.Counter()
    for r in rows:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [2]
        n, a = len(ids), 0
        b = (n - 1) % capacity + 1
        k = 0
        while a < n:
            wanted[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
            a, b, k = b, b + capacity, k + 1
    got = packed.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(r.length for r in got)


def test_pack_odd_rows(odd_rows, odd_documents):
    rows = odd_rows + [(99, "a <|endoftext|> inside", "en", "b", 0, 1, "k", "x")]
    docs = odd_documents.union(odd_documents.sparkSession.createDataFrame(rows[-1:], odd_documents.schema))
    n, tokens = check_packing(rows, packing.pack(docs))
    assert n <= math.ceil(tokens / 1024) + 1


def test_pack_small_capacity(make_documents, prose):
    texts = [prose(i, 1 + i % 13) for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)]
    n, tokens = check_packing(rows, packing.pack(make_documents(*texts), capacity=64), 64)
    assert n <= math.ceil(tokens / 64) * 1.1 + 1


def test_pack_nothing(no_documents):
    assert packing.pack(no_documents).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 64, 200]))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[1:] = rng.integers(0, 2000, capacity) * (rng.random(capacity) < 0.7)
    plan = packing.pack_plan(counts)
    held = np.zeros_like(counts)
    for content, n in plan:
        assert sum(content) <= capacity and n > 0
        for length in content:
            held[length] += n
    assert (held == counts).all()
    tokens = int(counts @ np.arange(capacity + 1))
    assert sum(n for _, n in plan) <= 1.05 * max(tokens / capacity, counts[capacity // 2 + 1 :].sum()) + 2


def test_fit_reproduces_a_mix_of_patterns():
    counts = np.zeros(11, dtype=np.int64)
    counts[[2, 3, 5, 6, 7]] = [600, 300, 500, 300, 300]  # 300 of (2, 2, 6), 300 of (3, 7), 250 of (5, 5)
    found = packing.patterns(counts)
    x = packing.fit_counts(found, counts, 3000)
    made = np.bincount(found.ravel(), np.repeat(x, 3), 11)
    assert (x >= 0).all() and np.abs(made[1:] - counts[1:]).max() < 1


def test_packed_ids_are_those_of_the_tokenizer_for_every_document(spark):
    docs = spark.read.parquet(f"{compare.SF}/documents.parquet").select("doc_id", "text").collect()
    packed = packing.op6_pack_documents(spark, compare.SF)
    n, tokens = check_packing([tuple(r) for r in docs], packed)
    assert n <= math.ceil(tokens / 1024) * 1.02 + 1
