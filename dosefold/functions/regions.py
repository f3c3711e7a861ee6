"""Connected parts of small graphs inside tasks, for the regions of masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def smallest_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `n` nodes the smallest node it is connected with by edges a - b."""
    parent = np.arange(n)
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low < high
        if not open_.any():
            return parent
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def touching(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows with a common column; runs sorted by row, then first column."""
    width = int(last.max()) + 2 if len(last) else 2
    start = np.searchsorted(row * width + last, (row + 1) * width + first)
    end = np.searchsorted(row * width + first, (row + 1) * width + last, side="right")
    n = np.maximum(end - start, 0)
    a = np.repeat(np.arange(len(row)), n)
    return a, np.repeat(start - np.cumsum(n) + n, n) + np.arange(len(a))


def label_slice(slice_: pa.Table) -> pa.Table:
    """Runs of one slice (iy, x1, x2, node) with `label`, the smallest node of their part of the slice."""
    table = slice_.sort_by([("iy", "ascending"), ("x1", "ascending")])
    row, first, last, node = (table.column(c).to_numpy().astype(np.int64) for c in ("iy", "x1", "x2", "node"))
    a, b = touching(row - row.min(), first - first.min(), last - first.min())
    return table.append_column("label", pa.array(node[smallest_members(len(row), a, b)]))


def merge_labels(edges: pa.Table) -> pa.Table:
    """Each end of the edges `a` - `b` with the smallest label it is connected with; other columns are the group's."""
    a, b = (edges.column(c).to_numpy() for c in ("a", "b"))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    found = nodes[smallest_members(len(nodes), place[: len(a)], place[len(a) :])]
    rest = {c: pa.repeat(edges.column(c)[0], len(nodes)) for c in edges.column_names if c not in ("a", "b")}
    return pa.table({**rest, "label": pa.array(nodes), "root": pa.array(found)})
