"""Token ids in binary files: adaptive range coding in checksummed blocks, written in doc_id order and read back.

A file is a magic word and segments. A segment holds whole documents: their
ids and lengths, the table of numbers that occur, and blocks of `BLOCK_IDS`
ids, each coded on its own (range_coder) with a CRC-32 of its ids.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosefold.llm.common import file_system, slices, stored, word_dictionary
from dosefold.llm.range_coder import decode_blocks, encode_blocks, frequencies
from dosefold.session import scratch_folder

MAGIC, MARK = b"TOKENS1\n", b"SEGM"
BLOCK_IDS = 2048
#: A segment ends with the document that reaches so many ids, a file with the segment that does.
SEGMENT_IDS, FILE_IDS = 8 << 20, 64 << 20
#: Words of which the pre-tokenizer makes one piece each, whatever stands around them.
SIMPLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
#: Words whose ids a worker remembers: 36 bytes each and their ids.
CACHE_WORDS = 3_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Known:
    """Ids of words by a 128-bit hash of the word, in sorted arrays: a new part is merged when it has grown."""

    def __init__(self):
        self.parts = [self._part(np.empty((0, 2), np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))] * 2

    @staticmethod
    def _part(keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys[:, 0], kind="stable")
        starts = np.cumsum(sizes) - sizes
        return keys[order, 0].copy(), keys[order, 1].copy(), starts[order], sizes[order].astype(np.int32), ids

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part or -1, start, number of ids) of each key."""
        part, start, size = np.full(len(keys), -1), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, (first, second, starts, sizes, _) in enumerate(self.parts):
            if len(first):
                at = np.minimum(np.searchsorted(first, keys[:, 0]), len(first) - 1)
                hit = np.flatnonzero((first[at] == keys[:, 0]) & (second[at] == keys[:, 1]))
                part[hit], start[hit], size[hit] = k, starts[at[hit]], sizes[at[hit]]
        return part, start, size

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if len(self.parts[0][0]) + len(self.parts[1][0]) + len(keys) > CACHE_WORDS:
            self.__init__()
        new = self._merged(self.parts[1], self._part(keys, sizes, ids))
        if len(new[0]) > len(self.parts[0][0]) // 4:
            self.parts = [self._merged(self.parts[0], new), Known().parts[1]]
        else:
            self.parts = [self.parts[0], new]

    @classmethod
    def _merged(cls, a, b):
        first, second, starts, sizes = (np.concatenate(x) for x in zip(a[:2] + (a[2], a[3]), b[:2] + (b[2] + len(a[4]), b[3])))
        order = np.argsort(first, kind="stable")
        return first[order], second[order], starts[order], sizes[order], np.concatenate([a[4], b[4]])


class Encoder:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    The tokenizer's pre-tokenizer drops white space and lower-cases, so a text's
    ids are those of its words; and marks `.,` behind a letter are tokens of
    their own. Words that hold `<|`, as special tokens do, go in as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = Known()

    def encode_new(self, texts: list[str], simple: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids); of the first `simple` words the ASCII ones go to the library's model at once, as
        no step before it changes them, the others many to a text."""
        sizes, ids, model = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], self.library.model
        for start in range(0, simple, 1000):
            group = texts[start : min(start + 1000, simple)]
            if all(map(str.isascii, group)):
                found = [[token.id for token in model.tokenize(x)] for x in group]
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
                ids.append(np.fromiter((i for f in found for i in f), np.int32, int(sizes[-1].sum())))
            else:
                found = self.library.encode(" ".join(group), add_special_tokens=False)
                sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(group)))
                ids.append(np.array(found.ids, np.int32))
        for start in range(simple, len(texts), 20_000):
            found = [e.ids for e in self.library.encode_batch_fast(texts[start : start + 20_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((i for f in found for i in f), np.int32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(ids)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids one after the other)."""
        from xxhash import xxh3_128_digest

        keys = np.frombuffer(b"".join([xxh3_128_digest(w) for w in words]), np.uint64).reshape(-1, 2)
        part, _, _ = self.known.find(keys)
        new = np.flatnonzero(part < 0)
        if len(new):
            if len(new) + len(self.known.parts[0][0]) + len(self.known.parts[1][0]) > CACHE_WORDS:
                new = np.arange(len(words))  # the memory starts anew
            texts = [words[k].decode() for k in new.tolist()]
            simple = np.fromiter((SIMPLE(x) is not None for x in texts), bool, len(texts))
            ascii_ = np.fromiter(map(str.isascii, texts), bool, len(texts))
            order = np.concatenate([np.flatnonzero(simple & ascii_), np.flatnonzero(simple & ~ascii_), np.flatnonzero(~simple)])
            sizes, ids = self.encode_new([texts[k] for k in order.tolist()], int(simple.sum()))
            self.known.add(keys[new[order]], sizes, ids)
        part, start, size = self.known.find(keys)
        return size, np.concatenate([self.known.parts[0][4], self.known.parts[1][4]])[_places(start + part * len(self.known.parts[0][4]), size)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets by text)."""
        offsets, codes, words = word_dictionary(texts)
        stem, mark, distinct = _stems(words)
        each, flat = self.ids_of(distinct)
        first = np.cumsum(each) - each
        pairs = np.stack([stem, mark], 1)
        sizes = each[pairs].sum(1)
        flat = flat[_places(first[pairs].ravel(), each[pairs].ravel())]
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        return flat[_places(starts[codes], n)], np.concatenate([[0], ends])[offsets]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1 of each i, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((starts - (ends - sizes)).astype(np.int32), sizes) + np.arange(total, dtype=np.int32)


def _stems(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of the stem, code of the mark of each word, distinct stems and marks); stems are in lower case, but for words that hold `<|`."""
    special = pc.match_substring(words, "<|")
    whole = pc.ascii_lower(words.cast(pa.large_string()))
    short = pc.ascii_rtrim(whole, characters=".,")
    size, left = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (whole, short))
    ends = np.frombuffer(short.buffers()[1], np.int64)[: len(short) + 1][1:]
    data = np.frombuffer(short.buffers()[2] or b"", np.uint8)
    last = np.zeros(len(words), np.uint8)  # the stem's last byte
    last[left > 0] = data[ends[left > 0] - 1] | 32
    marked = (size > left) & (last >= ord("a")) & (last <= ord("z")) & ~special.to_numpy(zero_copy_only=False)
    stem = pc.if_else(special, words.cast(pa.large_string()), pc.if_else(pa.array(marked), short, whole))
    marks, mark = {"": 0}, np.zeros(len(words), np.int64)
    for k in np.flatnonzero(marked & (size > left + 1)).tolist():
        mark[k] = marks.setdefault(whole[k].as_py()[left[k] - size[k] :], len(marks))
    one = np.flatnonzero(marked & (size == left + 1))
    tail = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[np.frombuffer(whole.buffers()[1], np.int64)[one + 1] - 1]
    for byte in ".,":
        mark[one[tail == ord(byte)]] = marks.setdefault(byte, len(marks))
    found = pa.concat_arrays([stem, pa.array(list(marks), pa.large_string())]).cast(pa.large_binary()).dictionary_encode()
    place = found.indices.to_numpy(zero_copy_only=False)
    return place[: len(words)], place[len(words) :][mark], found.dictionary.to_pylist()


_LOADED: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


# --- the file format -------------------------------------------------------


def _pack(arrays: list[np.ndarray]) -> bytes:
    parts = []
    for a in arrays:
        data = zlib.compress(a.tobytes(), 1)
        parts.append(struct.pack("<2sII", a.dtype.str[1:].encode(), len(data), zlib.crc32(data)) + data)
    return b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, crc = struct.unpack_from("<2sII", data, at)
        part = data[at + 10 : at + 10 + n]
        if zlib.crc32(part) != crc:
            raise ValueError("a header doesn't match its checksum")
        out.append(np.frombuffer(zlib.decompress(part), f"<{kind.decode()}"))
        at += 10 + n
    return out


def _block_sizes(n: int, block: int) -> np.ndarray:
    return np.minimum(block, n - np.arange(0, n, block)) if n else np.zeros(0, np.int64)


def _sums(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    data, ends = ids.astype("<u4"), np.cumsum(sizes)
    return np.array([zlib.crc32(data[e - n : e].tobytes()) for e, n in zip(ends, sizes)], np.uint32)


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    table = np.flatnonzero(counts)
    sizes = _block_sizes(len(ids), block)
    if len(ids):
        freq = frequencies(counts[table])
        place = np.zeros(len(counts), np.int64)
        place[table] = np.arange(len(table))
        words, each = encode_blocks(place[ids], sizes, freq)
    else:
        freq, words, each = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    head = _pack([
        np.array([x or 0 for x in doc_ids], np.int64), np.array([x is None for x in doc_ids], np.int8), lengths.astype(np.int64),
        table.astype(np.uint32), freq.astype(np.uint32), each.astype(np.uint32), _sums(ids, sizes), np.array([block], np.int64),
    ])
    return struct.pack("<4sQQ", MARK, len(head), 4 * len(words)) + head + words.astype("<u4").tobytes()


def read_segment(head: bytes, payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids); every block is checked."""
    doc_ids, none, lengths, table, freq, each, sums, block = _unpack(head)
    sizes = _block_sizes(int(lengths.sum()), int(block[0]))
    ids = np.zeros(0, np.int32)
    if len(sizes):
        symbols = decode_blocks(np.frombuffer(payload, "<u4"), each.astype(np.int64), sizes, freq.astype(np.int64))
        ids = table[symbols].astype(np.int32)
    if (_sums(ids, sizes) != sums).any():
        raise ValueError("a block doesn't match its checksum")
    return [None if x else int(d) for d, x in zip(doc_ids, none)], lengths, ids


def read_file(fs, path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    with fs.open_input_stream(path) as source:
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        while start := source.read(20):
            mark, head, payload = struct.unpack("<4sQQ", start)
            if mark != MARK:
                raise ValueError("broken segment")
            yield read_segment(source.read(head), source.read(payload))


class TokenFile:
    """Renamed into place when whole: a lost task leaves no half file under the final name."""

    def __init__(self, folder: str, part: int):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.n_ids, self.n_docs = f"tokens-{part:06d}-{uuid.uuid4().hex}.bin", 0, 0
        self.path, self.hidden = f"{base}/{self.name}", f"{base}/.{self.name}.part"
        self.out = self.fs.open_output_stream(self.hidden)
        self.out.write(MAGIC)

    def add(self, doc_ids: list, lengths: list[np.ndarray], ids: list[np.ndarray]) -> None:
        n, found = np.concatenate(lengths), np.concatenate(ids)
        self.out.write(write_segment(doc_ids, n, found))
        self.n_ids, self.n_docs = self.n_ids + len(found), self.n_docs + len(n)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.hidden, self.path)


PACKED = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, np.diff(offsets) + 1


def _writer(folder: str, path: str, end_id: int, segment_ids: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, file, size = TaskContext.get().partitionId(), 0, None, 0
        doc_ids, lengths, found = [], [], []

        def closed() -> pa.RecordBatch:
            file.close()
            return pa.RecordBatch.from_pylist([{"part": part, "place": place, "name": file.name, "n_docs": file.n_docs, "n_ids": file.n_ids}], PACKED)

        for whole in batches:
            for batch in slices(whole, "text", 16 << 20):
                ids, n = _with_end(*load(path).encode(batch.column("text")), end_id)
                doc_ids += batch.column("doc_id").to_pylist()
                lengths.append(n)
                found.append(ids)
                size += len(ids)
                if size >= segment_ids:
                    file = file or TokenFile(folder, part)
                    file.add(doc_ids, lengths, found)
                    doc_ids, lengths, found, size = [], [], [], 0
                    if file.n_ids >= file_ids:
                        yield closed()
                        file, place = None, place + 1
        if doc_ids:
            file = file or TokenFile(folder, part)
            file.add(doc_ids, lengths, found)
        if file:
            yield closed()

    return write


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, segment_ids: int = SEGMENT_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of every text and `end_id` behind each, in ascending doc_id order; returns the list of files.

    Rows are dealt by ranges of doc_id (and a hash of the text, so that a
    repeated id doesn't meet in one task); rows without doc_id come first.
    Files of tasks that did not end are not in the list and never read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    writer = _writer(folder, path or default_tokenizer(), end_id, segment_ids, file_ids)
    return stored(ordered.mapInArrow(writer, "part long, place long, name string, n_docs long, n_ids long"), "token-files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the listed files, from the ids read back.

    Only the list of files, one row per tens of millions of ids, is summed in one task.
    """
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                for doc_ids, lengths, ids in read_file(fs, f"{base}/{name}"):
                    ends = np.cumsum(lengths)
                    columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(_sums(ids, lengths).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += len(ids)

    n = 4 * files.sparkSession.sparkContext.defaultParallelism
    return placed.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, path: str | None = None, segment_ids: int = SEGMENT_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty and has the end id alone. Rows without doc_id
    come first; rows that repeat a doc_id stand one after the other. An empty
    table writes no file. A segment of over 131,072 different ids does not fit
    the coder's table and is refused.
    """
    folder = scratch_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, path, segment_ids=segment_ids, file_ids=file_ids), folder)
