"""Adaptive context-mixing range coder for blocks of integers, many blocks in step.

Symbols are places in a table of the numbers that occur. Three predictions make
the distribution of the next symbol: order 0 is the table's frequencies; orders
1 and 2 each name one symbol, the one that last proved right after the last one
or two symbols. How much each is trusted is learnt: for every confidence of a
prediction there is a running chance that it is right. The coder narrows an
interval of 64 bits; where the interval has shrunk below 32 bits, its upper word
is settled (an interval across a border is cut there) and goes out.

Every block starts with empty predictions and a fresh interval, so each can be
read alone. numpy works on one symbol of all blocks at once.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
TOTAL_BITS, TABLE_BITS = 24, 18
TOTAL = 1 << TOTAL_BITS
ONE, TWO = 9, 10  # bits of the order-1 and order-2 tables of a block
STATES = 8
LEARN_EVERY = 4  # symbols between two updates of the chances
LOW32 = U(0xFFFFFFFF)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**TABLE_BITS, one at least, near to the given counts."""
    total, n = 1 << TABLE_BITS, len(counts)
    if n > total // 2:
        raise ValueError("too many different numbers for one table")
    out = 1 + (counts.astype(np.float64) * ((total - n) / counts.sum())).astype(np.int64)
    out[np.argmax(counts)] += total - out.sum()
    return out


class Model:
    """The predictions of `lanes` blocks; calls may pass the first few lanes only, if the others have ended."""

    def __init__(self, freq: np.ndarray, lanes: int):
        self.cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.int64)
        self.before = np.concatenate([[0], self.cum])  # the start of a prediction's symbol
        self.base1, self.base2 = np.arange(lanes) << ONE, np.arange(lanes) << TWO
        self.base_state = np.arange(lanes) * STATES
        # a prediction is (symbol + 1) * 8 + confidence, 0 for none
        self.table1, self.table2 = np.zeros(lanes << ONE, np.int32), np.zeros(lanes << TWO, np.int32)
        start = np.arange(STATES) * 5000 + 4000  # of 65536
        start[0] = 0  # no prediction
        self.chance1, self.chance2 = np.tile(start, lanes), np.tile(start, lanes)
        self.last, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step = 0

    def predict(self, m: int) -> None:
        mixed = (self.last[:m] * 0x9E3779B1) & 0xFFFFFFFF
        self.at1 = self.base1[:m] + (mixed >> (32 - ONE))
        self.at2 = self.base2[:m] + ((((mixed ^ (self.mixed[:m] >> 7)) * 0x2545F491) & 0xFFFFFFFF) >> (32 - TWO))
        self.mixed[:m] = mixed
        # one width of integers throughout: numpy is slow on mixed ones
        self.e1, self.e2 = self.table1.take(self.at1).astype(np.int64), self.table2.take(self.at2).astype(np.int64)
        self.n1, self.n2 = self.e1 & 7, self.e2 & 7
        self.c1, self.c2 = self.e1 >> 3, self.e2 >> 3  # symbol + 1
        self.s1, self.s2 = self.base_state[:m] + self.n1, self.base_state[:m] + self.n2
        self.p1, self.p2 = self.chance1.take(self.s1), self.chance2.take(self.s2)
        room = TOTAL - (TOTAL >> 5)  # order 0 keeps 1/32 at least
        self.w2 = self.p2 * (room >> 16)
        left = room - self.w2
        self.w1 = (self.p1 * left) >> 16
        self.w0 = left - self.w1 + (TOTAL >> 5)

    def interval(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of symbol `s` in the mixed distribution."""
        behind = s + 1
        low = (self.cum.take(s) * self.w0) >> TABLE_BITS
        width = ((self.cum.take(behind) * self.w0) >> TABLE_BITS) - low
        self.hit1, self.hit2 = self.c1 == behind, self.c2 == behind
        low += self.w1 * (self.c1 < behind)
        low += self.w2 * (self.c2 < behind)
        width += self.w1 * self.hit1
        width += self.w2 * self.hit2
        return low, width

    def symbol(self, target: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """The symbol whose interval holds `target`."""
        # predictions stand before or in the target's place, or behind it: take away the weight of those before
        swap = self.c1 > self.c2
        a, b = np.where(swap, self.c2, self.c1), np.where(swap, self.c1, self.c2)
        wa, wb = np.where(swap, self.w2, self.w1), np.where(swap, self.w1, self.w2)
        low_a, low_b = (self.before.take(a) * self.w0) >> TABLE_BITS, (self.before.take(b) * self.w0) >> TABLE_BITS
        rest = target - np.minimum(wa, np.maximum(target - low_a, 0))
        rest -= np.minimum(wb, np.maximum(rest - low_b, 0))
        return inverse.take((((rest + 1) << TABLE_BITS) - 1) // self.w0).astype(np.int64)

    def update(self, s: np.ndarray) -> None:
        """Learn `s`; interval(s) was called before."""
        hit1, hit2 = self.hit1, self.hit2
        if self.step % LEARN_EVERY == 0:
            p1, p2 = self.p1, self.p2
            self.chance2[self.s2] = p2 + ((65000 * hit2 - p2) >> 4) * (self.n2 > 0)
            self.chance1[self.s1] = p1 + ((65000 * hit1 - p1) >> 4) * ((self.n1 > 0) & ~hit2)
        self.step += 1
        new = (s << 3) + 9  # this symbol, seen once
        for table, at, e, n, hit in ((self.table1, self.at1, self.e1, self.n1, hit1), (self.table2, self.at2, self.e2, self.n2, hit2)):
            value = np.where(hit, np.minimum(e + 1, e | 7), np.where(n < 2, new, e - (n >> 1)))
            table[at] = value.astype(np.int32)
        self.last[: len(s)] = s


def _settle(low: np.ndarray, span: np.ndarray, m: int) -> np.ndarray:
    """Lanes whose interval is short: cut at a border of 32 bits and widened; their upper words leave `low`."""
    out = np.flatnonzero(span[:m] <= LOW32)
    if len(out):
        left = U(1 << 32) - (low[out] & LOW32)
        span[out] = np.minimum(span[out], left) << U(32)
    return out


def encode_blocks(symbols: np.ndarray, sizes: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of `sizes` symbols, one after the other, coded: (all words, words of each block). `sizes` must not rise."""
    lanes = len(sizes)
    at, model = np.cumsum(sizes) - sizes, Model(freq, lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    owners, words = [], []
    for m, steps in _phases(sizes):
        for _ in range(steps):
            s = symbols.take(at[:m])
            at[:m] += 1
            model.predict(m)
            start, width = model.interval(s)
            unit = span[:m] >> U(TOTAL_BITS)
            low[:m] += unit * start.view(U)
            span[:m] = unit * width.view(U)
            out = _settle(low, span, m)
            if len(out):
                owners.append(out)
                words.append((low[out] >> U(32)).astype(np.uint32))
                low[out] <<= U(32)
            model.update(s)
    every = np.arange(lanes)
    owners += [every, every]
    words += [(low >> U(32)).astype(np.uint32), (low & LOW32).astype(np.uint32)]
    owner, word = np.concatenate(owners), np.concatenate(words)
    order = np.argsort(owner.astype(np.uint16) if lanes <= 1 << 16 else owner, kind="stable")
    return word[order], np.bincount(owner, minlength=lanes)


def decode_blocks(words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The symbols of the blocks that encode_blocks coded."""
    lanes = len(sizes)
    to, model = np.cumsum(sizes) - sizes, Model(freq, lanes)
    inverse = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    at = np.cumsum(counts) - counts
    words = np.concatenate([words, np.zeros(2, np.uint32)]).astype(U)
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    code = (words[at] << U(32)) | words[at + 1]
    at = at + 2
    symbols = np.zeros(int(sizes.sum()), np.int64)
    for m, steps in _phases(sizes):
        for _ in range(steps):
            model.predict(m)
            unit = span[:m] >> U(TOTAL_BITS)
            target = np.minimum((code[:m] - low[:m]) // unit, U(TOTAL - 1)).view(np.int64)
            s = model.symbol(target, inverse)
            start, width = model.interval(s)
            symbols[to[:m]] = s
            to[:m] += 1
            low[:m] += unit * start.view(U)
            span[:m] = unit * width.view(U)
            out = _settle(low, span, m)
            if len(out):
                low[out] <<= U(32)
                code[out] = (code[out] << U(32)) | words.take(at[out], mode="clip")
                at[out] += 1
            model.update(s)
    return symbols


def _phases(sizes: np.ndarray) -> list[tuple[int, int]]:
    """(blocks that still run, steps) from the longest blocks' start to their end."""
    ends = np.unique(sizes[sizes > 0])
    return [(int((sizes >= end).sum()), int(end - before)) for before, end in zip([0, *ends[:-1]], ends)]
