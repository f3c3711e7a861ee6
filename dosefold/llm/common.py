"""What several corpus operators share: stored tables, word codes of Arrow texts, files in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosefold.session import scratch_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Groups for per-bucket ranks; grows with the shuffle partitions the session sets for its data."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Give each row (distinct in `keys`) a distinct integer: its rank by `keys` in a hash bucket, interleaved.

    The result depends on the rows alone, so a retried task repeats it, and no
    task sorts more than one bucket.
    """
    from pyspark.sql import Window

    n = buckets(df.sparkSession)
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(n)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)).cast("long")
    return spread.withColumn(name, (rank - 1) * n + F.col("_bucket")).drop("_bucket")


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """`batch` in slices of about `limit` bytes of `column`, one row at least: bounds what numpy holds at once."""
    texts = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def plain(array) -> pa.Array:
    """A null-free large string array; null counts as the empty text.

    Always a copy whose offsets begin at 0: some string kernels misread a slice whose offsets don't.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    filled = pc.fill_null(array.cast(pa.large_string()), "")
    return pa.concat_arrays([filled, pa.array([], pa.large_string())])


def word_dictionary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: offsets by text, a code for each word, the distinct words (and perhaps the empty one, without a code)."""
    parts = pc.ascii_split_whitespace(plain(texts))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().cast(pa.large_binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    empty = pc.index(flat.dictionary, b"").as_py()
    if empty >= 0:  # a text that begins or ends with white space has an empty part there
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, flat.dictionary


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The same with the words as a list."""
    offsets, codes, words = word_dictionary(texts)
    return offsets, codes.astype(np.int64), words.to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of `n` values; shorter by n - 1 than its input."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
    return mix(out + np.uint64(n))


def file_system(uri: str):
    """(file system, path) of a folder or file in the shared folder."""
    import pyarrow.fs as pafs

    if "://" not in uri and uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)
