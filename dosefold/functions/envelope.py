"""Lower envelope of parabolas along grid lines, many lines at a time.

A line is a sorted list of sites at integer places, each with a height h and an
id; the value at a place is the least h + ((place - at) * step)^2. One walk over the
sites keeps the parabolas that are lowest somewhere, one walk over the places
reads them off: the cost is linear in sites plus places. Places where several
parabolas meet compare all of them, so that ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of the padded tables that one walk holds at most (a longer line counts alone).
CELLS = 1 << 20
#: Border between parabolas that count as met at a place, in places.
NEAR = 1e-9


def lowest(at: np.ndarray, h: np.ndarray, ids: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray):
    """(height, id) at the places `low` .. `high` of each line, padded to the right.

    `at`, `h` and `ids` have a row per line, of which the first `n` entries count, sorted by `at`.
    """
    lines, width = at.shape
    kept = np.zeros((lines, width), np.int64)
    border = np.full((lines, width + 1), np.inf)  # border[k]: where the kth kept parabola begins to be the lowest
    border[:, 0] = -np.inf
    top = np.zeros(lines, np.int64)
    square = step * step
    for p in range(1, width):
        rows = np.flatnonzero(p < n)
        while len(rows):
            v = kept[rows, top[rows]]
            a, b = at[rows, v], at[rows, p]
            s = (a + b) / 2 + (h[rows, p] - h[rows, v]) / (2 * square[rows] * (b - a))
            begin = border[rows, top[rows]]
            hidden = s < begin - NEAR
            stay = rows[~hidden]
            top[stay] += 1
            kept[stay, top[stay]] = p
            border[stay, top[stay]] = np.maximum(s, begin)[~hidden]
            rows = rows[hidden]
            top[rows] -= 1
    border[np.arange(lines), top + 1] = np.inf
    places = int((high - low).max()) + 1
    height, who = np.empty((lines, places)), np.empty((lines, places), np.int64)
    at_line, first = np.arange(lines), np.zeros(lines, np.int64)

    def there(rows: np.ndarray, k: np.ndarray, place: np.ndarray):
        v = kept[rows, k]
        away = (place - at[rows, v]) * step[rows]
        return h[rows, v] + away * away, ids[rows, v]

    for j in range(places):
        place = low + j
        rows = at_line
        while True:
            rows = rows[border[rows, first[rows] + 1] < place[rows] - NEAR]
            if not len(rows):
                break
            first[rows] += 1
        height[:, j], who[:, j] = there(at_line, first, place)
        k, rows = first + 1, at_line
        while True:
            rows = rows[(k[rows] <= top[rows]) & (border[rows, k[rows]] <= place[rows] + NEAR)]
            if not len(rows):
                break
            value, name = there(rows, k[rows], place[rows])
            lower = (value < height[rows, j]) | ((value == height[rows, j]) & (name < who[rows, j]))
            height[rows[lower], j], who[rows[lower], j] = value[lower], name[lower]
            k[rows] += 1
    return height, who


def along_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow`: column `line` (structs at, h, id) becomes `near` (structs h, id at low .. high); low, high and step go."""
    for whole in batches:
        sizes = pc.list_value_length(whole.column("line")).to_numpy(zero_copy_only=False).astype(np.int64)
        lows, highs = (whole.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
        longest = np.maximum(sizes, highs - lows + 1)
        start = 0
        while start < whole.num_rows:
            end = start + 1
            widest = longest[start]
            while end < whole.num_rows and max(widest, longest[end]) * (end + 1 - start) <= CELLS:
                widest = max(widest, longest[end])
                end += 1
            batch, n = whole.slice(start, end - start), sizes[start:end]
            flat = batch.column("line").flatten()
            at, h, ids = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            line = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((at, line))
            column = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
            tables = []
            for values, kind in ((at, np.float64), (h, np.float64), (ids, np.int64)):
                padded = np.zeros((len(n), int(n.max())), kind)
                padded[line, column] = values[order]
                tables.append(padded)
            low, high = lows[start:end], highs[start:end]
            height, who = lowest(*tables, n, low, high, batch.column("step").to_numpy().astype(np.float64))
            filled = np.arange(height.shape[1]) <= (high - low)[:, None]
            ends = np.concatenate([[0], np.cumsum(high - low + 1)])
            parts = pa.StructArray.from_arrays([pa.array(height[filled]), pa.array(who[filled])], ["h", "id"])
            near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
            rest = [c for c in whole.schema.names if c not in ("line", "low", "high", "step")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), near], [*rest, "near"])
            start = end
