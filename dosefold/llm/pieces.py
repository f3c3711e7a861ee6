"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text byte by byte. At each byte its state and the output
links behind it name every piece that ends there; each relaxes the best score
of the position. Bytes that no piece covers become byte pieces, at a penalty.
As no piece holds a space mark after another character, texts fall apart before
space marks; equal parts of a batch are encoded once, all of them in step.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dosefold.llm.common import plain, slices

MARK = "▁"
LONG = 256


class Pieces:
    """Pieces, scores, the automaton; `split` tells if texts may be cut before space marks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.full(256, model.unk_id(), np.int32)
        plain_pieces = []
        self.text = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain_pieces.append((piece.encode(), i, model.get_score(i)))
                self.text[i] = piece.replace(MARK, " ").encode()
        self.build(plain_pieces)

    def build(self, pieces: list[tuple[bytes, int, float]]) -> None:
        self.penalty = min((s for *_, s in pieces), default=0.0) - 10.0
        self.split = all(set(p.decode()) == {MARK} for p, *_ in pieces if MARK in p.decode()[1:])
        children: list[dict[int, int]] = [{}]
        depth, end = [0], [-1]
        for k, (piece, *_) in enumerate(pieces):
            at = 0
            for byte in piece:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    end.append(-1)
                at = children[at][byte]
            end[at] = k
        n = len(children)
        goto, fail = np.zeros((n, 256), np.int32), np.zeros(n, np.int32)
        self.link = np.zeros(n, np.int32)  # nearest shorter suffix that is a piece
        terminal = np.array(end) >= 0
        for node in np.argsort(depth, kind="stable").tolist():  # parents and failures come first
            if node:
                goto[node] = goto[fail[node]]
                self.link[node] = fail[node] if terminal[fail[node]] else self.link[fail[node]]
            for byte, child in children[node].items():
                fail[child] = goto[fail[node], byte] if node else 0
                goto[node, byte] = child
        self.goto = goto
        self.first = np.where(terminal, np.arange(n), self.link).astype(np.int32)  # longest piece that ends at a state
        known = [pieces[k] if k >= 0 else (b"", -1, 0.0) for k in end]
        self.length = np.array([len(p) for p, *_ in known], np.int64)
        self.ids = np.array([i for _, i, _ in known], np.int32)
        self.score = np.array([s for *_, s in known], np.float64)

    # --- one long part ---

    def encode_long(self, data: bytes) -> list[int]:
        best, back, kind = [0.0] * (len(data) + 1), [0] * (len(data) + 1), [0] * (len(data) + 1)
        state, goto, first, link, length, score, ids = 0, self.goto, self.first, self.link, self.length, self.score, self.ids
        for j, byte in enumerate(data):
            state = int(goto[state, byte])
            top, step, token = float("-inf"), 1, -1
            t = int(first[state])
            while t:
                value = best[j + 1 - int(length[t])] + float(score[t])
                if value > top:
                    top, step, token = value, int(length[t]), int(ids[t])
                t = int(link[t])
            value = best[j] + (0.0 if byte & 0xC0 == 0x80 else self.penalty)
            if value > top:
                top, step, token = value, 1, int(self.byte_ids[byte])
            best[j + 1], back[j + 1], kind[j + 1] = top, step, token
        out, at = [], len(data)
        while at:
            out.append(kind[at])
            at -= back[at]
        return out[::-1]

    # --- many short parts in step ---

    def _encode_group(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in order, number for each part)."""
        w = len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, w)
        width = int(sizes.max(initial=0))
        data = np.zeros((w, width), np.uint8)
        data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
        best = np.full((width + 1, w), -np.inf)
        best[0] = 0.0
        back, kind = np.ones((width + 1, w), np.int64), np.zeros((width + 1, w), np.int32)
        state, every = np.zeros(w, np.int32), np.arange(w)
        for j in range(width):
            byte = data[:, j]
            state = self.goto[state, byte]
            top, step, token = np.full(w, -np.inf), np.ones(w, np.int64), np.zeros(w, np.int32)
            t = self.first[state]
            who = np.flatnonzero(t)
            t = t[who]
            while len(who):
                span = self.length[t]
                value = best[j + 1 - span, who] + self.score[t]
                better = value > top[who]
                hit = who[better]
                top[hit], step[hit], token[hit] = value[better], span[better], self.ids[t[better]]
                t = self.link[t]
                left = t > 0
                who, t = who[left], t[left]
            value = best[j] + np.where(byte & 0xC0 == 0x80, 0.0, self.penalty)
            better = value > top
            best[j + 1] = np.where(better, value, top)
            back[j + 1] = np.where(better, 1, step)
            kind[j + 1] = np.where(better, self.byte_ids[byte], token)
        at, owners, tokens = sizes.copy(), [], []
        who = every[at > 0]
        while len(who):
            tokens.append(kind[at[who], who])
            owners.append(who)
            at[who] -= back[at[who], who]
            who = who[at[who] > 0]
        if not owners:
            return np.empty(0, np.int32), np.zeros(w, np.int64)
        owner, token = np.concatenate(owners[::-1]), np.concatenate(tokens[::-1])
        order = np.argsort(owner, kind="stable")
        return token[order], np.bincount(owner, minlength=w)

    def encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one after the other, number of ids of each part)."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        counts, found = np.zeros(len(parts), np.int64), [np.empty(0, np.int32)] * 0
        pieces: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(sizes > LONG).tolist():
            pieces[k] = np.array(self.encode_long(parts[k]), np.int32)
            counts[k] = len(pieces[k])
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(sizes[short], kind="stable")]
        groups = []
        for start in range(0, len(short), 4096):
            chosen = short[start : start + 4096]
            ids, n = self._encode_group([parts[k] for k in chosen.tolist()])
            counts[chosen] = n
            groups.append((chosen, ids, n))
        starts = np.cumsum(counts) - counts
        found = np.empty(int(counts.sum()), np.int32)
        for k, ids in pieces.items():
            found[starts[k] : starts[k] + len(ids)] = ids
        for chosen, ids, n in groups:
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            found[np.repeat(starts[chosen], n) + inside] = ids
        return found, counts

    # --- texts ---

    def parts_of(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked) if self.split else [marked]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets by text); an empty text has no ids."""
        texts = plain(texts)
        odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.match_substring(texts, MARK))
        odd = odd.to_numpy(zero_copy_only=False) if self.split else np.ones(len(texts), bool)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        usual = pc.if_else(pa.array(odd | empty), pa.scalar("", pa.large_string()), texts)
        cut = pc.split_pattern(usual, " ")
        counts = np.diff(cut.offsets.to_numpy())
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [(MARK + x).encode() for x in coded.dictionary.to_pylist()]
        special: dict[int, list[int]] = {}
        seen: dict[str, int] = {}
        for k in np.flatnonzero(odd & ~empty).tolist():
            own = []
            for part in self.parts_of(texts[k].as_py()):
                if part not in seen:
                    seen[part] = len(parts)
                    parts.append(part.encode())
                own.append(seen[part])
            special[k] = own
        if special or empty.any():
            rows, at = [], 0
            for k, n in enumerate(counts.tolist()):
                rows.append(np.array(special[k], np.int64) if k in special else codes[at : at + (0 if empty[k] else n)])
                at += n
            counts = np.array([len(r) for r in rows], np.int64)
            codes = np.concatenate(rows) if rows else codes
        ids, sizes = self.encode_parts(parts)
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        places = np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))
        by_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids[places], by_text

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text: pieces one after the other, space marks as spaces, without the first space."""
        text = self.text
        out = [b"".join([text[i] for i in ids[a:b].tolist()]) for a, b in zip(offsets[:-1], offsets[1:])]
        return [x[1:] if x[:1] == b" " else x for x in out]


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The automaton of a model file, built once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row; a null text counts as empty and has no ids."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                ids, offsets = load(path).encode(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids count as none."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = load(path).decode(np.concatenate(lists) if lists else np.empty(0, np.int32), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode(errors="replace") for t in texts], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), decoded, round_trip.

    `decoded` is the text made again from the ids; `round_trip` says whether it
    equals the input. It does but for texts that hold the space mark itself,
    which come back with spaces. Of equal scores the longest last piece wins. A null
    text counts as empty: no ids, and the empty text again. Repeated rows give
    equal rows.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                pieces, given = load(path), plain(batch.column("text"))
                ids, offsets = pieces.encode(given)
                texts = pa.array([t.decode(errors="replace") for t in pieces.decode(ids, offsets)], pa.large_string())
                data = ids.astype("<u4")
                sums = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
                columns = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64()), texts.cast(pa.string()), pc.equal(texts, given)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "decoded", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded string, round_trip boolean")
