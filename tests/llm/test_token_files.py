import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dosefold.llm import range_coder, token_files
from dosefold.llm.queries import QUERIES, table

SCHEMA = "doc_id long, text string, tie string, start long"
FOLDER = "/root/testdata/sf0.001"


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "made"):
        library_ids.made = Tokenizer.from_file(token_files.default_tokenizer())
    return library_ids.made.encode(text or "", add_special_tokens=False).ids


def coded(values, block):
    values = np.array(values, np.int64)
    counts = np.bincount(values)
    table_ = np.flatnonzero(counts)
    freq, sizes = range_coder.frequencies(counts[table_]), token_files._block_sizes(len(values), block)
    symbols = np.searchsorted(table_, values)
    words, each = range_coder.encode_blocks(symbols, sizes, freq)
    return symbols, words, each, sizes, freq


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9) | st.integers(0, 60000), min_size=1, max_size=300), st.integers(1, 64))
def test_coder_round_trip(values, block):
    symbols, words, each, sizes, freq = coded(values, block)
    assert (range_coder.decode_blocks(words, each, sizes, freq) == symbols).all()


def test_blocks_decode_alone_and_repeats_shrink():
    draws = np.random.default_rng(0)
    values = np.tile(draws.integers(0, 3000, 400), 40)
    symbols, words, each, sizes, freq = coded(values, 2000)
    at = int(each[:3].sum())
    alone = range_coder.decode_blocks(words[at : at + each[3]], each[3:4], sizes[3:4], freq)
    assert (alone == symbols[6000:8000]).all()
    assert 32 * len(words) / len(values) < 6  # 11.5 bits without the predictions


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbéÉ'sSİΣς.,!1 \n ́\u0085\x1c☃<|>endoftext"), max_size=30))
def test_ids_are_the_library_s(text):
    ids, offsets = token_files.load(token_files.default_tokenizer()).encode(pa.array([text, "", text]))
    assert ids[: offsets[1]].tolist() == library_ids(text) and offsets[1] == offsets[2]


@pytest.mark.parametrize("text", ["<|endoftext|> a <|ENDOFTEXT|>, b", "it's, It'S. 3.14,5 x.,y.", "ΑΣ. ΑΣ", "word,.,.", "..., ,", "straße Çà l'été ÷ naïve × ø", "a\u0301b ab\u0301 a b"])
def test_special_cases(text):
    ids, _ = token_files.load(token_files.default_tokenizer()).encode(pa.array([text]))
    assert ids.tolist() == library_ids(text)


def test_plain_words_go_to_the_model_alone():
    class Library:
        """Takes marks and odd words only."""

        def __init__(self, whole):
            self.whole, self.model = whole, whole.model

        def encode_batch_fast(self, texts, **options):
            assert not any(x.isalpha() for x in texts)
            return self.whole.encode_batch_fast(texts, **options)

    encoder, text = token_files.Encoder(token_files.default_tokenizer()), "Plain words, thththed words. relyha 3.14 x., plain"
    encoder.library = Library(encoder.library)
    ids, _ = encoder.encode(pa.array([text]))
    assert ids.tolist() == library_ids(text)


def test_stems_and_marks():
    words = [b"The", b"the.", b"the", b"word,.,", b"...", b".", b"3.14,", b"<|X|>.", "caf\u00e9,".encode(), b"Z,", b""]
    stem, mark, distinct = token_files._stems(pa.array(words, pa.large_binary()))
    assert [(distinct[a], distinct[b]) for a, b in zip(stem, mark)] == [
        (b"the", b""), (b"the", b"."), (b"the", b""), (b"word", b",.,"), (b"...", b""), (b".", b""), (b"3.14,", b""), (b"<|X|>.", b""),
        ("caf\u00e9,".encode(), b""), (b"z", b","), (b"", b"")]
    assert len(set(distinct)) == len(distinct)


def brute(rows):
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library_ids(text) + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_tables(spark):
    rows = [(i, f"Document {i % 7}, it's text. " * (i % 5), "", 1) for i in range(60)] + [(None, "first", None, None), (99, None, "", 1), (98, "", "", 1), (97, "long " * 9000, "", 1), (7, rows_7 := "same", "", 1), (7, rows_7, "", 2)]
    rows = [r for r in rows if r[0] != 7 or r[1] == "same"]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, token_files.token_round_trip(df).collect()), key=str) == brute(rows)
    small = token_files.token_round_trip(df.repartition(3), segment_ids=50, file_ids=100)
    assert sorted(map(tuple, small.collect()), key=str) == brute(rows)
    assert token_files.token_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_is_found(tmp_path):
    import pyarrow.fs as pafs

    data = bytearray(token_files.MAGIC + token_files.write_segment([1, None], np.array([3, 2]), np.array([5, 9, 2, 7, 2], np.int32)))
    (tmp_path / "good").write_bytes(data)
    data[-5] ^= 0x80
    (tmp_path / "bad").write_bytes(data)
    fs = pafs.LocalFileSystem()
    (doc_ids, lengths, ids), = token_files.read_file(fs, str(tmp_path / "good"))
    assert doc_ids == [1, None] and ids.tolist() == [5, 9, 2, 7, 2]
    with pytest.raises(ValueError):
        list(token_files.read_file(fs, str(tmp_path / "bad")))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op3_token_files"](spark, FOLDER).collect()), key=str) == brute(rows)
