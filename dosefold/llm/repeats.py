"""Suffix-array dedup: every byte that lies in a repeated string of `LENGTH` bytes goes.

A string ("window") of LENGTH bytes is told by its anchor: the least hash among
its substrings of half that length, leftmost first. Equal windows have equal
anchors at equal places, so only windows of one anchor are ever compared.

1. Prefix polynomial hashes give every substring's hash; consecutive windows of
   one anchor make a run, known by the anchor's hash and the hash of all its bytes.
2. Runs whose anchor comes once are unique. A run whose bytes come twice is
   repeated as a whole; both are counts by key. Runs that share the key are held
   against each other by SHA-256 of their bytes before they count as equal.
3. The others, at the borders of matches, are compared in tasks: the suffixes
   from their anchors are mergesorted, two suffixes compared by binary search
   for their common extension on prefix hashes, and the extensions to the right
   (from the sorted order) and to the left (by hash) tell which windows repeat.
   Extensions are verified byte by byte; a collision sends its group to a plain
   comparison.

The runs of an anchor with very many different ones are not compared in a task:
their single windows are counted by SHA-256, so no group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosefold.llm.common import mix, plain, slices, stored

LENGTH = 400
PIECE = 4 << 20
#: Different runs of one anchor over which their windows are counted one by one, and the parts of one digest in the join with the counts.
HOT, SALTS = 512, 8
#: A key of more than 1 / SHARE of all rows (so there are fewer than SHARE of them), and of LEAST rows, is dealt to PARTS tasks.
SHARE, LEAST, PARTS = 1000, 10_000, 64

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_values = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


class Powers:
    """Powers of BASE and of its inverse, as many as were ever needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            base = np.full(n, U(BASE))
            back = np.full(n, U(pow(BASE, -1, 2**64)))
            base[0] = back[0] = U(1)
            cls.up, cls.down = np.multiply.accumulate(base), np.multiply.accumulate(back)


class Hashed:
    """Prefix polynomial hashes of a byte array."""

    def __init__(self, data: np.ndarray):
        Powers.need(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_values[data] * Powers.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * Powers.down[start]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, place of the anchor in the first window, anchor's hash, hash of all bytes) of each run.

    The texts are data[starts[i]:ends[i]]; no window crosses a text's end.
    """
    half = length // 2
    sizes = np.maximum(ends - starts - length + 1, 0)
    if not sizes.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashed = Hashed(data)
    grams = mix(hashed.of(np.arange(len(data) - half + 1), half))
    packed = (grams & ~U((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(packed, length - half + 1) & U((1 << 24) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), sizes)
    window = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at = anchor[window]
    new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(owner) != 0)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    begin, at = window[first], at[first]
    whole = mix(hashed.of(begin, count - 1 + length) + count.astype(np.uint64))
    return owner[first], begin, count, at - begin, grams[at], whole


def _pieces(texts: pa.Array):
    """The bytes of all texts, and (row, start in the text, start, end in the bytes) of pieces of at most PIECE bytes; windows are shared by none."""
    texts = plain(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    found = []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        start = a
        while True:
            end = min(b, start + PIECE)
            found.append((row, start - a, start, end))
            if end == b:
                break
            start = end - LENGTH + 1
    return data, found


def _runs(batches: Iterator[pa.RecordBatch], bits: int = 64) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            data, found = _pieces(batch.column("text"))
            group = []
            for k, piece in enumerate(found):
                group.append(piece)
                if k + 1 == len(found) or found[k + 1][3] - group[0][2] > 2 * PIECE:
                    rows, inside, starts, ends = (np.array(x, np.int64) for x in zip(*group))
                    base = starts[0]
                    text, begin, count, place, key, content = runs(data[base : ends[-1]], starts - base, ends - base)
                    row, content = rows[text], content >> U(64 - bits)
                    columns = [batch.column("doc_id").take(pa.array(row)), batch.column("tag").take(pa.array(row)), pa.array(begin + base - starts[text] + inside[text]),
                               pa.array(count, pa.int32()), pa.array(place, pa.int32()), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "begin", "windows", "place", "anchor", "content"])
                    group = []


# --- comparison of runs ----------------------------------------------------


class Suffixes:
    """Suffixes of one byte array, compared by hash."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size, self.hashed = data, start, size, Hashed(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes a and b: binary search on the hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        sa, sb = self.start[a], self.start[b]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = self.hashed.of(sa, mid) == self.hashed.of(sb, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.extension(a, b)
        at_end = n >= np.minimum(self.size[a], self.size[b])
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[a] + n, last)], self.data[np.minimum(self.start[b] + n, last)]
        return np.where(at_end, self.size[a] < self.size[b], x < y)

    def mergesorted(self, group: np.ndarray) -> np.ndarray:
        """Places of the suffixes sorted by group (given in rising order), then by bytes: all merges of one width in step."""
        n = len(group)
        order, first = np.arange(n), np.searchsorted(group, group, "left")
        size = np.searchsorted(group, group, "right") - first
        inside, width = np.arange(n) - first, 1
        while len(size) and width < size.max():
            block = inside // width
            own_start = block * width
            other = np.where(block % 2 == 0, own_start + width, own_start - width)
            low = np.minimum(other, size)
            end = np.minimum(other + width, size)
            begin, right = low.copy(), block % 2 == 1
            act = np.flatnonzero(low < end)
            while len(act):  # number of the sibling block's suffixes that go before
                mid = (low[act] + end[act]) // 2
                rival, mine = order[first[act] + mid], order[act]
                before = np.where(right[act], ~self.less(mine, rival), self.less(rival, mine))
                low[act[before]] = mid[before] + 1
                end[act[~before]] = mid[~before]
                act = act[low[act] < end[act]]
            target = first + np.minimum(own_start, begin) + (inside - own_start) + (low - begin)
            target = np.where((begin >= size) & ~right, first + inside, target)
            merged = np.empty(n, np.int64)
            merged[target] = order
            order, width = merged, 2 * width
        return order


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return bool((data[np.repeat(a, n) + inside] == data[np.repeat(b, n) + inside]).all())


def repeated(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, place: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(run, first, last) for stretches of windows of a run that another run of its group holds too.

    Run i's windows start at begin[i] .. begin[i] + windows[i] - 1 of `data`, its anchor at begin[i] + place[i]; groups rise.
    """
    anchor, most = begin + place, place
    least = place - windows + 1  # bytes before the anchor, from the last window to the first
    made = Suffixes(data, anchor, length - least)
    order = made.mergesorted(group)
    a, b = order[:-1], order[1:]
    together = group[a] == group[b]
    common = np.where(together, made.extension(a, b), 0)
    if not _equal_bytes(data, anchor[a], anchor[b], common):
        return plainly_repeated(data, begin, windows, group, length)
    n = len(begin)
    flags = np.zeros((length - length // 2 + 1, n), bool)
    partner, depth = np.full(n, -1), np.zeros(n, np.int64)
    checks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    in_order_least, in_order_most, in_order_anchor = least[order], most[order], anchor[order]
    for x in range(int(max(least.min(initial=0), 0)), int(most.max(initial=-1)) + 1):
        block = np.concatenate([[0], np.cumsum(~together | (common < length - x))])
        live = np.flatnonzero((in_order_least <= x) & (in_order_most >= x))
        if len(live) < 2:
            continue
        block = block[live]
        left = made.hashed.of(in_order_anchor[live] - x, x)
        by = np.lexsort((left, block))
        same = (block[by][1:] == block[by][:-1]) & (left[by][1:] == left[by][:-1])
        if not same.any():
            continue
        head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(by)), 0))
        later = np.flatnonzero(head != np.arange(len(by)))
        who, whom = order[live[by[later]]], order[live[by[head[later]]]]
        flags[x, who] = flags[x, whom] = True
        moved = who[(partner[who] >= 0) & (partner[who] != whom)]
        checks.append((moved, partner[moved], depth[moved]))
        partner[who], depth[who] = whom, x
    ended = np.flatnonzero(partner >= 0)
    checks.append((ended, partner[ended], depth[ended]))
    who, whom, depths = (np.concatenate(x) for x in zip(*checks))
    if not _equal_bytes(data, anchor[who] - depths, anchor[whom] - depths, depths):
        return plainly_repeated(data, begin, windows, group, length)
    edge = np.diff(np.pad(flags, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    run_a, low = np.nonzero(edge.T == 1)
    _, high = np.nonzero(edge.T == -1)
    return list(zip(run_a.tolist(), (place[run_a] - (high - 1)).tolist(), (place[run_a] - low).tolist()))


def plainly_repeated(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """The same by comparing the windows themselves: for groups in which hashes collided."""
    text, seen = data.tobytes(), {}
    for k, (b, n, g) in enumerate(zip(begin.tolist(), windows.tolist(), group.tolist())):
        for w in range(n):
            seen.setdefault((g, text[b + w : b + w + length]), []).append((k, w))
    return [(k, w, w) for found in seen.values() if len({k for k, _ in found}) > 1 for k, w in found]


# --- tasks -----------------------------------------------------------------

NEEDED = "array<struct<begin:bigint,windows:int,place:int,anchor:bigint,content:bigint,role:int>>"
OPEN, WITNESS, WHOLE = 0, 1, 2  # role of a run: to be compared; compared as a witness, itself repeated; repeated


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs to be compared in tasks, of anchors with at most HOT different runs."""
    names = ["key", "doc_id", "tag", "begin", "windows", "place", "role", "data"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for whole in batches:
        for batch in slices(whole, "text"):
            rows: list[tuple] = []
            for doc_id, tag, text, needed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "needed"))):
                data = (text or "").encode()
                for r in needed:
                    if r["role"] < WHOLE:
                        begin, windows = r["begin"], r["windows"]
                        rows.append((r["anchor"], doc_id, tag, begin, windows, r["place"], r["role"], data[begin : begin + windows - 1 + LENGTH]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, content, proof) of the runs that count as repeated: a part of the SHA-256 of their bytes."""
    from hashlib import sha256

    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            needed = batch.column("needed")
            flat = needed.flatten()
            names = ["begin", "windows", "anchor", "content", "role"]
            begin, windows, anchor, content, role = (flat.field(n).to_numpy(zero_copy_only=False) for n in names)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(needed.offsets.to_numpy()))
            asked = np.flatnonzero(role % 10 != OPEN)
            proofs, text, at = [], b"", -1
            for k, b, n in zip(owner[asked].tolist(), begin[asked].tolist(), (windows[asked] - 1 + LENGTH).tolist()):
                if k != at:
                    text, at = memoryview((batch.column("text")[k].as_py() or "").encode()), k
                proofs.append(sha256(text[b : b + n]).digest()[:16])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[asked]), pa.array(content[asked]), pa.array(proofs, pa.binary())], ["anchor", "content", "proof"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, begin, open, digest) of each window of the runs of the other anchors: equal bytes have one anchor at one place."""
    from hashlib import sha256

    names = ["doc_id", "tag", "begin", "open", "digest"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for whole in batches:
        for batch in slices(whole, "text"):
            rows: list[tuple] = []
            for doc_id, tag, text, needed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "needed"))):
                data = memoryview((text or "").encode())
                for r in needed:
                    if r["role"] in (10 + OPEN, 10 + WITNESS):
                        is_open = r["role"] == 10 + OPEN
                        rows += [(doc_id, tag, b, is_open, sha256(data[b : b + LENGTH]).digest()) for b in range(r["begin"], r["begin"] + r["windows"])]
                    if len(rows) >= 20000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


FOUND = ["doc_id", "tag", "begin", "end"]


def _compare_rows(rows: list[dict]) -> pa.RecordBatch:
    sizes = np.array([len(r["data"]) for r in rows], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8)
    windows, place = (np.array([r[c] for r in rows], np.int64) for c in ("windows", "place"))
    keys = np.array([r["key"] for r in rows], np.int64)
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    out = [(rows[k]["doc_id"], rows[k]["tag"], rows[k]["begin"] + first, rows[k]["begin"] + last + LENGTH)
           for k, first, last in repeated(data, begin, windows, place, group) if rows[k]["role"] == OPEN]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))], FOUND)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole groups are compared together, many small ones at once."""
    held: list[dict] = []
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            held += whole.slice(start, 2000).to_pylist()
            if len(held) >= 8000:
                cut = len(held)
                while cut and held[cut - 1]["key"] == held[-1]["key"]:
                    cut -= 1
                if cut:
                    yield _compare_rows(held[:cut])
                    held = held[cut:]
    if held:
        yield _compare_rows(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for whole in batches:
        for batch in slices(whole, "text"):
            out = []
            for doc_id, tag, text, needed, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "needed", "found"))):
                data = (text or "").encode()
                spans = [(r["begin"], r["begin"] + r["windows"] - 1 + LENGTH) for r in needed if r["role"] % 10 != OPEN]
                spans += [(f["begin"], f["end"]) for f in found or ()]
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join(kept) + data[at:]
                out.append((doc_id, tag, len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), merged, rest))
            columns = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "tag", "n_removed", "n_spans", "kept_sha256", "spans", "kept_bytes"])


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tag"] == right["tag"])


def _dealt(df: DataFrame, hot: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """`df` with `part`: by `spread` for the rows of hot keys, 0 for the others. Fewer than SHARE keys are hot."""
    marked = df.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    return marked.withColumn("part", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")


def _in_parts(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with the rows of hot keys in every part, the others in part 0."""
    marked = df.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    every, one = F.sequence(F.lit(0), F.lit(PARTS - 1)), F.array(F.lit(0))
    return marked.withColumn("part", F.explode(F.when(F.col("_hot").isNotNull(), every).otherwise(one))).drop("_hot")


def repeats_cut(docs: DataFrame, content_bits: int = 64) -> DataFrame:
    """(doc_id, tag, n_removed, n_spans, kept_sha256, spans, kept_bytes) of the documents that hold a candidate; `tag` is a hash of the text.

    `content_bits` of the hash of a run's bytes are used; fewer change the cost, not the result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    found = stored(texts.mapInArrow(partial(_runs, bits=content_bits), "doc_id long, tag long, begin long, windows int, place int, anchor long, content long"), "runs")
    limit = max(LEAST, found.count() // SHARE)
    twice = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    hot = stored(twice.where(F.col("n") > limit), "hot")
    candidates = _dealt(found, hot, ["anchor"], ["doc_id", "tag", "begin"]).join(_in_parts(twice.select("anchor"), hot, ["anchor"]), ["anchor", "part"])
    candidates = stored(candidates.drop("part"), "candidates")
    contents = candidates.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "tag", "begin")).alias("witness"))
    anchors = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"))
    contents = _dealt(contents, hot, ["anchor"], ["content"]).join(_in_parts(anchors, hot, ["anchor"]), ["anchor", "part"]).drop("part")
    contents, key = stored(contents, "contents"), ["anchor", "content"]
    copied = stored(contents.where(F.col("copies") > limit), "copied")
    judged = _dealt(candidates, copied, key, ["doc_id", "tag", "begin"]).join(_in_parts(contents, copied, key), [*key, "part"])
    is_witness = F.struct("doc_id", "tag", "begin").eqNullSafe(F.col("witness"))
    # a run whose anchor has one content only is repeated, and no witness is needed
    role = F.when(F.col("copies") == 1, F.lit(OPEN)).when(is_witness & (F.col("different") > 1), F.lit(WITNESS)).otherwise(F.lit(WHOLE))
    role = (role + F.when(F.col("different") > HOT, F.lit(10)).otherwise(F.lit(0))).cast("int")

    def with_roles(judged: DataFrame, role) -> DataFrame:
        needed = judged.select("doc_id", "tag", F.struct("begin", "windows", "place", "anchor", "content", role.alias("role")).alias("run"))
        by_doc = needed.groupBy("doc_id", "tag").agg(F.collect_list("run").cast(NEEDED).alias("needed"))  # a document's own runs
        return stored(texts.join(by_doc, _same(texts, by_doc)).select(texts["doc_id"], texts["tag"], "text", "needed"), "touched")

    touched = with_roles(judged, role)
    proofs = touched.mapInArrow(_proofs, "anchor long, content long, proof binary")
    unlike = proofs.groupBy(*key).agg(F.min("proof").alias("low"), F.max("proof").alias("high")).where("low <> high")
    collided = stored(unlike.select("anchor").distinct(), "collided")
    if not collided.isEmpty():  # hashes of different runs met: the windows of these anchors are counted one by one
        apart = judged.join(collided.withColumn("_apart", F.lit(True)), "anchor", "left")
        touched = with_roles(apart, F.when(F.col("_apart").isNotNull(), F.lit(10 + OPEN)).otherwise(role).cast("int"))
    held = touched.where(f"exists(needed, r -> r.role < {WHOLE})").mapInArrow(_bytes, "key long, doc_id long, tag long, begin long, windows int, place int, role int, data binary")
    compared = held.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "doc_id long, tag long, begin long, end long")
    hot = touched.where(f"exists(needed, r -> r.role IN ({10 + OPEN}, {10 + WITNESS}))").mapInArrow(
        _windows, "doc_id long, tag long, begin long, open boolean, digest binary")
    again = hot.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    counted = hot.where("open").withColumn("salt", F.pmod(F.xxhash64("doc_id", "tag", "begin"), F.lit(SALTS)).cast("int")).join(
        again, ["digest", "salt"], "left_semi").select("doc_id", "tag", "begin", (F.col("begin") + LENGTH).alias("end"))
    spans = compared.unionByName(counted).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    joined = touched.join(spans, _same(touched, spans), "left").select(touched["doc_id"], touched["tag"], "text", "needed", "found")
    return joined.mapInArrow(_cut, "doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept_bytes binary")


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty; texts under LENGTH bytes lose nothing. Rows
    with one doc_id are documents of their own: a row that comes twice is
    repeated as a whole, if it is long enough.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("tag"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha")
    )
    cut = repeats_cut(docs).select("doc_id", "tag", "n_removed", "n_spans", "kept_sha256").dropDuplicates(["doc_id", "tag"])
    return every.join(cut, _same(every, cut), "left").select(
        every["doc_id"], "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
