"""Source divergence, importance resampling and token files against check SQL, plain versions and round trips."""

import collections
import hashlib
import math
import re
import zlib

import compare
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tremorline.llm import divergence, importance, token_files
from tremorline.llm.registry import CHECKS, QUERIES
from tremorline.session import scratch_path

SF = compare.SF
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, label string"


def small_database(rows, target=()):
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT, size BIGINT, "
        "key VARCHAR, label VARCHAR)"
    )
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [list(r) for r in rows])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    if target:
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(r) for r in target])
    return con


def many_rows(odd_rows, prose):
    """The odd rows ten times (so that terms are kept) and short texts of several sources and languages."""
    rows = list(odd_rows) * 10
    for i in range(120):
        text = " ".join(prose(i % 30, 5 + i % 40).split()[: 3 + i % 29]) + " ÄÖ Straße naïve ЖЖ" * (i % 3)
        rows.append((100 + i // 2, text, ["en", "de", None][i % 3], f"s{i % 7}", 0, 0, "k", "x"))
    rows.append((900, "unkept words only", "xx", "s1", 0, 0, "k", "x"))
    rows.append((901, None, "xx", "s2", 0, 0, "k", "x"))
    rows.append((902, "12 34", "yy", "alone", 0, 0, "k", "x"))
    return rows


# --- divergence ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [None, (8, 4, 2, 6)])
def test_divergence_of_odd_rows(spark, odd_rows, prose, monkeypatch, limits):
    if limits:  # many blocks, products and runs of columns
        for name, value in zip(("BLOCK_COUNTS", "MOST_TERMS", "LEAST_TERMS", "COLUMNS"), limits):
            monkeypatch.setattr(divergence, name, value)
    rows = many_rows(odd_rows, prose)
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    got = divergence.source_divergence(docs)
    assert compare.differences(got, small_database(rows), CHECKS["op11_source_divergence"]) == []
    assert {(r.lang, r.source, r.item, r.value) for r in got.collect() if r.lang == "xx"} == {
        ("xx", "s1", "s2", 0),
        ("xx", "s2", "s1", 0),
    }


def test_divergence_of_nothing(no_documents):
    assert divergence.source_divergence(no_documents).count() == 0


def test_level_is_exact_for_large_counts():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 1 << 52, 2000)
    count = (total * rng.random(2000)).astype(np.int64)
    kept = 12345
    want = [1 + 10**9 * (int(c) + 2) // (int(n) + 2 * kept) for c, n in zip(count, total)]
    assert [int(divergence.level(c, n, kept)) for c, n in zip(count, total)] == want
    gap = [int(divergence.distance(np.int64(a), np.int64(b))) for a, b in zip(want, reversed(want))]
    assert gap == [(a - b) ** 2 // (a + b) for a, b in zip(want, reversed(want))]


def test_joint_tables_price_every_term(monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.poisson(rng.exponential(4, (300, 1)), (300, 9)).astype(np.int64)
    totals, kept = counts.sum(0), len(counts)
    p = divergence.level(counts, totals, kept)
    want = np.array([[divergence.distance(p[:, a], p[:, b]).sum() for b in range(9)] for a in range(9)])
    for columns in (1 << 20, 40, 5):
        monkeypatch.setattr(divergence, "COLUMNS", columns)
        value = np.zeros((9, 9), dtype=np.int64)
        divergence.price_block(counts, totals, kept, value)
        off = ~np.eye(9, dtype=bool)
        assert (value[off] == want[off]).all()


# --- resampling ----------------------------------------------------------------------------------------------------


def plain_resample(rows, target, buckets=10_000, runs=1, seed=2024, min_words=20, percent=10):
    def words(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def features(w):
        return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = collections.Counter(bucket(f) for r in rows for f in features(words(r[1])))
    t = collections.Counter(bucket(f) for r in target for f in features(words(r[1])))
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        w = words(r[1])
        f = features(w)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1.0) * (ns + buckets) / ((s[b] + 1.0) * (nt + buckets)))) for b in map(bucket, f)
        )
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return collections.Counter(tuple(x[:5]) for x in out)


TARGET = [(1, "alpha1 beta2 Alpha1"), (2, None), (3, ""), (4, "Straße naïve 12")]


@pytest.mark.parametrize("runs,percent", [(1, 10), (1, 37), (3, 10), (1, 100), (1, 0)])
def test_resampling_of_odd_rows(spark, odd_rows, prose, runs, percent):
    rows = many_rows(odd_rows, prose)
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = importance.resample(docs, target, runs=runs, percent=percent).collect()
    assert collections.Counter(map(tuple, got)) == plain_resample(rows, TARGET, runs=runs, percent=percent)


def test_resampling_matches_sql_on_odd_rows(spark, odd_rows, prose):
    rows = many_rows(odd_rows, prose)
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = importance.resample(docs, spark.createDataFrame(TARGET, "item_id long, text string"))
    assert compare.differences(got, small_database(rows, TARGET), CHECKS["op12_importance_resampling"]) == []


def test_resampling_of_nothing(spark, no_documents, odd_documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(no_documents, empty).count() == 0
    assert importance.resample(odd_documents, empty).count() == odd_documents.count()


@pytest.mark.parametrize("wanted", [1, 2, 17, 99, 100, 101])
def test_bisection_finds_the_cutoff(spark, wanted):
    from pyspark.sql import functions as F

    values = [(int(v),) for v in np.random.default_rng(wanted).integers(-(10**12), 10**12, 70)] + [(5,)] * 30
    rows = spark.createDataFrame(values, "v long")
    want = sorted((v for (v,) in values), reverse=True)
    assert importance.largest_with(rows, F.col("v"), wanted) == (want[wanted - 1] if wanted <= 100 else None)


def test_equal_rows_on_the_cutoff_are_drawn_each(spark):
    rows = [(None, "same words " * 20, "en", "s", 0, 0, "k", "x")] * 50 + [(1, "x " * 30, "en", "s", 0, 0, "k", "x")] * 7
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    got = importance.resample(docs, spark.createDataFrame(TARGET, "item_id long, text string"), percent=40).collect()
    assert collections.Counter(map(tuple, got)) == plain_resample(rows, TARGET, percent=40)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 23))


# --- token files ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 20, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_bits_round_trip(width, n):
    ids = np.random.default_rng(width * n).integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
    words = token_files.pack_ids(ids, width)
    assert len(words) * 64 >= n * width and len(words) == -(-n // 64) * width
    assert (token_files.unpack_ids(words, width)[:n] == ids).all()


def test_least_bits():
    assert [token_files.id_bits(v) for v in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_file_is_read_at_any_place(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_257, n) for n in (0, 1, 5000, 63, 64, 129, 1, 700)]
    path = f"file://{tmp_path}/a/b.ids"
    writer = token_files.IdWriter(path, 16, 128)
    for k, ids in enumerate(docs):
        writer.add(None if k == 3 else k - 2, ids)
    n_docs, n_ids, size = writer.close()
    flat = np.concatenate(docs)
    assert (n_docs, n_ids, size) == (8, len(flat), (tmp_path / "a/b.ids").stat().st_size)
    assert size < 2 * len(flat) + 128 * 2 + 8 * (len(flat) // 128 + 20) + 17 * 9
    found = token_files.IdFile(path)
    assert [int(i) if ok else None for i, ok in zip(found.doc_ids, found.named)] == [-2, -1, 0, None, 2, 3, 4, 5]
    for a, b in [(0, 0), (0, 1), (127, 129), (128, 256), (0, len(flat)), (len(flat) - 1, len(flat)), (len(flat),) * 2]:
        assert (found.read(a, b) == flat[a:b]).all()
    for k, ids in enumerate(docs):
        assert (found.document(k) == ids).all()
    with pytest.raises(IndexError):
        found.read(0, len(flat) + 1)


def test_cut_off_file_is_refused(tmp_path):
    writer = token_files.IdWriter(str(tmp_path / "x.ids"), 16)
    writer.add(1, np.arange(500))
    writer.close()
    whole = (tmp_path / "x.ids").read_bytes()
    (tmp_path / "y.ids").write_bytes(whole[:-3])
    with pytest.raises(ValueError):
        token_files.IdFile(str(tmp_path / "y.ids"))


def expected(rows):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    return out


def check_files(got, rows):
    """Contents are right, documents follow each other without gaps, ids ascend with null last."""
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert collections.Counter((d, n, c) for d, _, n, c in got) == collections.Counter(expected(rows))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    keys = [(d is None, d or 0) for d, *_ in got]
    assert keys == sorted(keys)
    return got


@pytest.mark.parametrize("block,file_ids,read_ids", [(4096, 1 << 24, 1 << 20), (64, 500, 100)])
def test_token_files_of_odd_rows(spark, odd_rows, odd_documents, monkeypatch, block, file_ids, read_ids):
    monkeypatch.setattr(token_files, "READ_IDS", read_ids)
    rows = odd_rows + [(99, "a <|endoftext|> inside", "en", "b", 0, 1, "k", "x")]
    docs = odd_documents.union(spark.createDataFrame(rows[-1:], odd_documents.schema))
    folders = [scratch_path(spark, "test-ids") for _ in range(2)]
    runs = []
    for folder, some in zip(folders, (docs, docs.repartition(5))):
        manifest = token_files.write_token_files(some, folder, block=block, file_ids=file_ids)
        runs.append(check_files(token_files.read_token_files(manifest, folder).collect(), [r[:2] for r in rows]))
    assert runs[0] == runs[1]  # whatever the partitions were


@pytest.mark.parametrize("known", [200_000, 3])
def test_encoder_gives_the_ids_of_whole_texts(prose, monkeypatch, known):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", known)
    rng = np.random.default_rng(7)
    texts = [chr(c) + "a " + chr(c) + chr(c) + " b1" + chr(c) for c in range(128)]
    texts += ["", " ", "  a  b\n\n c \t", "it's I'LL 've don't", "x<|endoftext|>y", "<|endoftext|", prose(1, 50), "a\u00a0b\u3000c"]
    # characters of all planes, also those on which versions of Unicode differ
    points = [*range(0x20, 0x3000, 7), *range(0xA000, 0xD800, 31), *range(0xF900, 0x32000, 97)]
    odd = [chr(p) for p in points] + [chr(p) for p in (1368, 1419, 2191, 8349, 42958, 67515)]
    for k in range(0, len(odd), 40):
        texts.append("".join(c + [" ", "", "a", "1", ". ", "  "][rng.integers(6)] for c in odd[k : k + 40]))
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = token_files.Encoder()
    for part in (texts[:5], texts[5:40], texts[40:], texts):
        want = [e.ids for e in model.encode_batch(part, add_special_tokens=False)]
        assert [list(ids) for ids in encoder.encode(part)] == want
    assert encoder.by_piece and all(other for _, _, other in encoder.cuts)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.Encoder(path)
    model = Tokenizer.from_file(path)
    texts = ["Hello World's  end", "", "é 12"]
    assert not encoder.by_piece
    assert [list(i) for i in encoder.encode(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_nothing(spark, no_documents):
    folder = scratch_path(spark, "test-ids")
    manifest = token_files.write_token_files(no_documents, folder)
    assert token_files.read_token_files(manifest, folder).count() == 0


def test_token_query_holds_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_files(QUERIES["op13_token_files"](spark, SF).collect(), [tuple(r) for r in docs])
