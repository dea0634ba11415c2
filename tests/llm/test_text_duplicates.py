import re

import pytest

from tremorline.llm import components, near_text, repeated_spans


def near(text, k):
    """Every k-th word changed."""
    words = text.split(" ")
    return " ".join("changed" + w if i % k == k - 1 else w for i, w in enumerate(words))


def classes(df):
    return {r.doc_id: r.class_id for r in near_text.near_duplicates(df).collect()}


def test_classes_of_copies(make_documents, prose):
    base = [prose(i, 300) for i in range(6)]
    texts = [base[0], base[0], near(base[0], 150), base[1], near(base[1], 100), base[2], prose(50, 300), "", "", "two words", "two words"]
    got = classes(make_documents(*texts))
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9}


def jaccard(a, b):
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_chains_and_large_groups(make_documents, prose, monkeypatch):
    monkeypatch.setattr(near_text, "LEAVES", 4)
    monkeypatch.setattr(near_text, "BLOCK", 5)
    text = prose(7, 400).split(" ")
    chain = []
    for i in range(30):  # each is near its neighbours only
        text = [f"step{i}" if k % 400 in (13 * i % 400, (13 * i + 200) % 400) else w for k, w in enumerate(text)]
        chain.append(" ".join(text))
    assert jaccard(chain[0], chain[1]) > 0.9 and jaccard(chain[0], chain[-1]) < 0.6
    got = classes(make_documents(*chain, *chain[:3], prose(99, 400)))
    assert {got[i] for i in range(33)} == {0} and got[33] == 33


def test_rest_of_buckets_finds_what_stars_miss(spark, prose):
    """Two pairs in one bucket whose smallest member is like none of them."""
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    texts = {b"0": c, b"1": a, b"2": near(a, 150), b"3": b, b"4": near(b, 150)}
    rows = spark.createDataFrame([(bytearray(k), t) for k, t in texts.items()], "digest binary, text string")
    members = spark.createDataFrame([(1, bytearray(k), bytearray(k)) for k in texts], "bucket long, digest binary, root binary")
    weights = near_text.word_weights(rows.select("text"))
    for block in (1, 2, 100):
        near_text.BLOCK, before = block, near_text.BLOCK
        links = near_text.rest_of_buckets(members, rows, weights, 0.8).collect()
        near_text.BLOCK = before
        assert {frozenset((bytes(r.a), bytes(r.b))) for r in links} == {frozenset((b"1", b"2")), frozenset((b"3", b"4"))}


def test_near_odd_rows(odd_documents, odd_rows):
    got = near_text.near_duplicates(odd_documents).collect()
    assert len(got) == len(odd_rows)
    by = {(r.doc_id, r.class_id, r.kept) for r in got}
    assert {(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True), (8, 8, True), (None, None, True)} <= by
    kept = near_text.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in odd_rows})


def test_near_nothing(no_documents):
    assert near_text.near_duplicates(no_documents).count() == 0
    assert near_text.keep_one(no_documents).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(3, i) for i in range(4, 60)]
    loops = [(7000, 7000)]
    edges = spark.createDataFrame(path + star + loops, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 3 for i in range(4, 60)}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(docs):
    """Sentence by sentence, in Python."""
    seen, out = {}, {}
    for doc_id, text in docs:
        found = list(WORD.finditer(text))
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), m.group()) for m in found]
        parts, begin = [], 0
        for k, m in enumerate(found):
            if k == len(found) - 1 or m.group()[-1] in ".!?" or "\n" in text[m.end() : found[k + 1].start()]:
                parts.append((begin, k + 1))
                begin = k + 1
        runs = set()
        for k in range(len(parts)):
            e = k + 1
            while e < len(parts) and parts[e][1] - parts[k][0] < 20:
                e += 1
            if e < len(parts):
                runs.add((k, e))
            e = k - 1
            while e >= 0 and parts[k][1] - parts[e][0] < 20:
                e -= 1
            if e >= 0:
                runs.add((e, k))
        gone = set()
        for a, b in sorted(runs):
            key = tuple(words[parts[a][0] : parts[b][1]])
            if seen.setdefault(key, (doc_id, a)) != (doc_id, a):
                gone.update(range(a, b + 1))
        starts = [found[p[0]].start() for p in parts] + [len(text)]
        head = text[: starts[0]] if parts else text
        kept = "".join(text[starts[k] : starts[k + 1]] for k in range(len(parts)) if k not in gone)
        out[doc_id] = (len(parts), len(gone), head + kept)
    return out


@pytest.mark.parametrize("own", [False, True])
def test_repeated_spans_equal_plain(make_documents, prose, own):
    passage = prose(77, 60)
    texts = [
        prose(1) + "\n" + passage + "\n" + prose(2),
        " " + passage + " " + prose(3),
        prose(4),
        prose(5) + (" " + prose(5) if own else ""),
        "Short. One. Two! é? Three",
        prose(1) + "\n" + passage + "\n" + prose(2),
        "",
        "\n\n",
        prose(6, 7),
    ]
    got = repeated_spans.without_repeats(make_documents(*texts)).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in got} == plain_repeats(list(enumerate(texts)))


def test_repeated_spans_odd_rows(odd_documents, odd_rows, no_documents):
    got = repeated_spans.without_repeats(odd_documents).collect()
    assert len(got) == len(odd_rows)
    assert {r.text for r in got if r.doc_id in (3, 4)} == {""}
    assert sorted(r.n_removed > 0 for r in got if r.doc_id == 2) == [False, True]
    assert all(r.n_removed == 0 for r in got if r.doc_id in (None, 8))
    assert repeated_spans.without_repeats(no_documents).count() == 0
