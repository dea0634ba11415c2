"""Token ids in files of fixed-width bits.

A file holds whole documents one after the other::

    magic       8 bytes
    width       u32, bits per id: the least that hold every id of the vocabulary
    block       u32, ids per block
    blocks      64 ids take ``width`` words of 64 bits, lowest bits first; the last block is filled up with zeros
    offsets     u64 per block and one for the end: where each block starts in the file
    documents   per document: id (i64), whether it has one (u8); u64 per document and one for the end: its first id
    footer      u64 each: blocks, documents, ids, place of ``offsets``; magic

All numbers are little-endian. Any run of ids is read from the blocks it lies in and unpacked by numpy as a whole. The
folder of a corpus has such files in ascending order of doc_id; a table (the manifest) names them with the number of ids
before each, so that files left by lost or repeated tasks are never read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.common import partitions, prefix_sums, table, text_of
from tremorline.llm.registry import query
from tremorline.session import materialize, scratch_path

MAGIC = b"BITIDS01"
HEAD = struct.Struct("<8sII")
FOOT = struct.Struct("<QQQQ8s")

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
# Pieces of byte-level tokenizers with Python's classes; 1C to 1F are no white space to the tokenizers.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|[_\x1c-\x1f])+"
    r"|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+"
)
BLOCK_IDS = 4096
FILE_IDS = 1 << 24  # a file ends with the document that reaches this
READ_IDS = 1 << 20  # ids unpacked at a time
BATCH_CHARS = 1 << 20  # characters tokenized at a time
KNOWN_PIECES = 200_000  # pieces whose ids a worker remembers, and as many older ones


WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def id_bits(vocabulary: int) -> int:
    """The least bits that tell the ids 0 to ``vocabulary`` - 1 apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as 64-bit words of ``width`` bits each; filled up to a multiple of 64 ids."""
    rows = -(-len(ids) // 64)
    if width in WHOLE:  # plain numbers of 1, 2 or 4 bytes
        plain = np.zeros(rows * 64, dtype=WHOLE[width])
        plain[: len(ids)] = ids
        return plain.view("<u8")
    full = np.zeros(rows * 64, dtype=np.uint64)
    full[: len(ids)] = ids
    full = full.reshape(rows, 64)
    words = np.zeros((rows, width), dtype="<u8")
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= full[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= full[:, j] >> np.uint64(64 - shift)
    return words.ravel()


def unpack_ids(words: np.ndarray, width: int) -> np.ndarray:
    """The ids in words made by ``pack_ids``, the filling included."""
    if width in WHOLE:
        return words.view(WHOLE[width]).astype("<u4")
    words = words.reshape(-1, width)
    out = np.empty((len(words), 64), dtype="<u4")
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, at + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.ravel()


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """(file system, path in it) of a path or URI that the tasks can reach."""
    if "://" in uri or uri.startswith("file:"):
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), os.path.abspath(uri)


class IdWriter:
    """Writes one file; holds some blocks of ids and the table of its documents."""

    def __init__(self, uri: str, width: int, block: int = BLOCK_IDS):
        if block % 64:
            raise ValueError("a block must hold a multiple of 64 ids")
        self.width, self.block = width, block
        fs, path = file_system(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out = fs.open_output_stream(path)
        self.out.write(HEAD.pack(MAGIC, width, block))
        self.at, self.offsets = HEAD.size, []
        self.rest: list[np.ndarray] = []
        self.held = 0
        self.ids: list[int | None] = []
        self.starts = [0]

    def _blocks(self, ids: np.ndarray) -> None:
        """Packs whole blocks, or the last one: a block is a whole number of words, so blocks can be packed together."""
        words = pack_ids(ids, self.width)
        self.out.write(words.tobytes())
        self.offsets += range(self.at, self.at + words.nbytes, self.block // 64 * self.width * 8)
        self.at += words.nbytes

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block:
            joined = np.concatenate(self.rest)
            whole = len(joined) // self.block * self.block
            self._blocks(joined[:whole])
            self.rest, self.held = [joined[whole:]], len(joined) - whole

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes)."""
        if self.held:
            self._blocks(np.concatenate(self.rest))
        tables = [
            np.array([*self.offsets, self.at], dtype="<u8"),
            np.array([i or 0 for i in self.ids], dtype="<i8"),
            np.array([i is not None for i in self.ids], dtype="u1"),
            np.array(self.starts, dtype="<u8"),
        ]
        place = self.at
        for values in tables:
            self.out.write(values.tobytes())
            self.at += values.nbytes
        self.out.write(FOOT.pack(len(self.offsets), len(self.ids), self.starts[-1], place, MAGIC))
        self.out.close()
        return len(self.ids), self.starts[-1], self.at + FOOT.size


class IdFile:
    """Random access to one file: ``read(a, b)`` gives the ids a to b - 1, from the blocks that hold them."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.block = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a file of token ids")
        blocks, docs, self.n_ids, place, magic = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is cut off")
        tables = self.file.read_at(size - FOOT.size - place, place)
        self.offsets = np.frombuffer(tables, "<u8", blocks + 1)
        after = 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(tables, "<i8", docs, after)
        self.named = np.frombuffer(tables, "u1", docs, after + 8 * docs).astype(bool)
        self.starts = np.frombuffer(tables, "<u8", docs + 1, after + 9 * docs).astype(np.int64)

    def read(self, a: int, b: int) -> np.ndarray:
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError(f"ids {a} to {b} of {self.n_ids}")
        if a == b:
            return np.zeros(0, dtype="<u4")
        first, last = a // self.block, (b - 1) // self.block
        start, end = int(self.offsets[first]), int(self.offsets[last + 1])
        words = np.frombuffer(self.file.read_at(end - start, start), "<u8")
        skip = first * self.block
        return unpack_ids(words, self.width)[a - skip : b - skip]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


class Encoder:
    """Ids of texts from a tokenizer's JSON file, by default the public byte-level vocabulary of 50k entries.

    A byte-level tokenizer cuts a text into pieces by a pattern and encodes each alone, so pieces met before need not be
    encoded again. The pieces are found by Python's ``re`` (or ``regex``, which knows more classes but is slower). Their
    Unicode tables may be of another version than the tokenizer's, or see other classes: every character beyond ASCII is
    tried once in a probe, and a text with one that both read differently than the tokenizer is encoded whole. So are texts
    that contain a special token, and all texts of other kinds of tokenizers.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        self.model = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.size = self.model.get_vocab_size()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # (pattern, characters that it sees as the tokenizer does, others)
        self.cuts = [(re.compile(PIECES), set(), set()), (regex.compile(public_tokenizers.PATTERN), set(), set())]
        self.known: dict[str, bytes] = {}  # ids of pieces met since the last turn, and of those of the turn before
        self.older: dict[str, bytes] = {}
        cutter = self.model.pre_tokenizer
        kind = json.loads(cutter.__getstate__()) if cutter is not None else {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
        self.by_piece = bool(plain) and self.model.normalizer is None

    def _alike(self, pattern, char: str) -> bool:
        """Whether the pattern and the tokenizer see the character as the same of letter, digit, space and other."""
        probe = f"a{char}1{char} {char}{char}.{char}"
        return [at for _, at in self.model.pre_tokenizer.pre_tokenize_str(probe)] == [m.span() for m in pattern.finditer(probe)]

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text; None if it has to be encoded whole."""
        if not self.by_piece or any(t in text for t in self.special):
            return None
        if text.isascii():
            return self.cuts[0][0].findall(text)
        chars = set(text)
        for pattern, same, other in self.cuts:
            for char in chars - same - other:
                (same if self._alike(pattern, char) else other).add(char)
            if other.isdisjoint(chars):
                return pattern.findall(text)
        return None

    def _all(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KNOWN_PIECES:
            self.known, self.older = {}, self.known
        cut = [self.pieces(t) for t in texts]
        missing = set(chain.from_iterable(some for some in cut if some)).difference(self.known)
        again = {p for p in missing if p in self.older}
        self.known.update((p, self.older[p]) for p in again)
        new = list(missing - again)
        self.known.update(zip(new, self._all(new)))
        whole = iter(self._all([t for t, some in zip(texts, cut) if some is None]))
        get = self.known.__getitem__
        raw = [next(whole) if some is None else b"".join(map(get, some)) for some in cut]
        return [np.frombuffer(r, "<u4") for r in raw]


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder per tokenizer and process: a worker keeps it, and the pieces it knows, from task to task."""
    return Encoder(path)


def _some(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_CHARS characters, a longer text alone."""
    a = size = 0
    for i, text in enumerate(texts):
        if i > a and size + len(text) > BATCH_CHARS:
            yield a, i
            a, size = i, 0
        size += len(text)
    if texts:
        yield a, len(texts)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    block: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write all documents to ``folder`` in ascending doc_id; returns the manifest: file, first, n_docs, n_ids, bytes, width.

    ``first`` counts the ids in all files before. Null texts are empty and hold the end id alone; null ids come last;
    rows of one doc_id are ordered by a hash of their text, equal rows are written each; an empty table gives no files;
    other columns are ignored. Texts are sorted by ranges of (doc_id, hash, row): no two rows share that key, so a group of
    equal rows can be split. A task streams its range through the tokenizer into files.
    """
    spark = docs.sparkSession
    vocabulary = encoder(tokenizer).size
    width = id_bits(vocabulary)
    if end_id >= vocabulary:
        raise ValueError("the end id is outside the vocabulary")
    text = text_of()
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
        text.alias("text"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    ranged = read.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    end = np.array([end_id], dtype="<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        model = encoder(tokenizer)
        done: list[tuple] = []
        writer, name = None, ""
        for batch in batches:
            ids, texts = batch[0].to_pylist(), batch[1].to_pylist()
            for a, b in _some(texts):
                for doc_id, found in zip(ids[a:b], model.encode(texts[a:b])):
                    if writer is None:
                        name = f"part-{pid:06d}-{len(done):06d}-{attempt}.ids"
                        writer = IdWriter(f"{folder}/{name}", width, block)
                    writer.add(doc_id, np.concatenate([found, end]))
                    if writer.starts[-1] >= file_ids:
                        done.append((name, pid, len(done), *writer.close(), width))
                        writer = None
        if writer is not None:
            done.append((name, pid, len(done), *writer.close(), width))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        columns = list(zip(*done)) or [[]] * 7
        names = ["file", "pid", "part", "n_docs", "n_ids", "bytes", "width"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "file string, pid long, part long, n_docs long, n_ids long, bytes long, width int"
    files = materialize(ranged.mapInArrow(write, schema), "manifest")
    counted = prefix_sums(files, [], [F.col("pid"), F.col("part")], F.col("n_ids"), "upto")
    first = (F.col("upto") - F.col("n_ids")).alias("first")
    return materialize(counted.select("file", first, "n_docs", "n_ids", "bytes", "width"), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest; ``start`` counts all ids before.

    Files are spread over the tasks, which hold about a megabyte of ids at a time, however long a document is.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                source = IdFile(f"{folder}/{name}")
                starts = source.starts
                a = 0
                while a < len(source.doc_ids):
                    b = max(a + 1, int(np.searchsorted(starts, starts[a] + READ_IDS, "right")) - 1)
                    sums = np.zeros(b - a, dtype=np.int64)
                    for lo in range(int(starts[a]), int(starts[b]), READ_IDS):  # one step, but for a very long document
                        hi = min(lo + READ_IDS, int(starts[b]))
                        raw = memoryview(source.read(lo, hi).astype("<u4", copy=False).tobytes())
                        for k in range(a, b):
                            x, y = max(int(starts[k]), lo) - lo, min(int(starts[k + 1]), hi) - lo
                            sums[k - a] = zlib.crc32(raw[4 * x : 4 * y], int(sums[k - a]))
                    ids = pa.array(source.doc_ids[a:b], mask=~source.named[a:b])
                    columns = [ids, pa.array(starts[a:b] + first), pa.array(np.diff(starts[a : b + 1])), pa.array(sums)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    a = b
                source.close()

    spread = manifest.select("file", "first").repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op13_token_files")
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as 16-bit ids and read back."""
    folder = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder)
