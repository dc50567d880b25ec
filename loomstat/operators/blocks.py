"""Rows in few large blocks of cells, so that a row is sent to blocks, not to each cell that it can reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows of a block, about; blocks if there are so few rows that they would be small: one for each FEW rows, at most LEAST of them.
BLOCK, FEW, LEAST = 32_768, 2048, 12
#: Rows of each side that are compared at once.
TILE = 2048


def blocks_of(cells: dict[int, int], block: int = BLOCK) -> dict[int, int]:
    """The block of each cell (cell -> rows): the largest cells first, each to the block of the fewest rows. A cell is in one block; what is larger than a block is split by row later."""
    n = sum(cells.values())
    held = [0] * max(1, -(-n // block), min(LEAST, n // FEW))
    out = {}
    for cell, rows in sorted(cells.items(), key=lambda c: (-c[1], c[0])):
        out[cell] = held.index(min(held))
        held[out[cell]] += rows
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row to each pivot; the error is below 1e-6 of the largest length."""
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def slack(x: np.ndarray, pivots: np.ndarray) -> float:
    """By how much bounds from distances() must be widened to be sure."""
    return 1e-6 * (1 + float(np.sqrt(max((x**2).sum(1).max(initial=0), (pivots**2).sum(1).max(initial=0)))))


def tiles(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows, TILE at once in the order of their cells, and the cells among them."""
    order = np.argsort(cell, kind="stable")
    for t in range(0, len(order), TILE):
        yield order[t : t + TILE], np.unique(cell[order[t : t + TILE]])
