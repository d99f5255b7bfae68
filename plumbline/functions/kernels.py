"""Small numpy helpers that run inside Python tasks.

The module travels with the tasks that use it, so that executors need not have
this package installed.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TILE = 2_000_000


def exact_ks_p(d: float, n1: int, n2: int) -> float:
    """P(D >= d) for two samples without ties, over all orders of the values.

    ``stay[i]`` is the share of the orders of i first-sample and s - i
    second-sample values whose distribution gap never reached d.
    """
    i = np.arange(n1 + 1)
    gap = round(d * n1 * n2) - 0.5
    stay = np.zeros(n1 + 1)
    stay[0] = 1.0
    for s in range(1, n1 + n2 + 1):
        j = s - i
        grown = stay * j / s
        grown[1:] += stay[:-1] * i[1:] / s
        inside = (j >= 0) & (j <= n2) & (np.abs(i * n2 - j * n1) < gap)
        stay = np.where(inside, grown, 0.0)
    return float(min(1.0, max(0.0, 1.0 - stay[n1])))


def chi_square_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution."""
    if dof <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return min(1.0, h * scale)


def distances(recipients: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Scaled Euclidean distances; infinite where no column is shared."""
    n_columns = recipients.shape[1]
    total = np.zeros((len(recipients), len(donors)))
    shared = np.zeros_like(total)
    for j in range(n_columns):
        gap = recipients[:, j, None] - donors[None, :, j]
        known = ~np.isnan(gap)
        total += np.where(known, gap * gap, 0.0)
        shared += known
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(total * n_columns / shared), np.inf)


def nearest_in_block(k: int, n_columns: int):
    """A function for one (recipients, donors) pair of pandas tables."""
    features = [f"f{i}" for i in range(n_columns)]

    def search(recipients: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(recipients) and len(donors):
            donors = donors.sort_values("id", kind="stable")
            grid = donors[features].to_numpy(dtype=float)
            ids, values = donors["id"].to_numpy(), donors["value"].to_numpy(dtype=float)
            wanted = recipients[features].to_numpy(dtype=float)
            names = recipients["id"].to_numpy()
            tile = max(1, _TILE // len(donors))
            for start in range(0, len(wanted), tile):
                d = distances(wanted[start : start + tile], grid)
                limit = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                row, at = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                # Donors are in order of their id, so equal distances stay in that order.
                order = np.lexsort((at, d[row, at], row))
                row, at = row[order], at[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, at = row[kept], at[kept]
                parts.append(pd.DataFrame({
                    "id": names[start + row], "distance": d[row, at], "donor": ids[at], "value": values[at]}))
        return pd.concat(parts) if parts else pd.DataFrame({"id": [], "distance": [], "donor": [], "value": []})

    return search


_CLOSE = 1 - 1e-9


class Cells:
    """Rows parted into cells by cuts along several columns, each cell with its bounding box.

    A row without the column of a cut goes to a branch of its own where the sample had such rows, else to the lower one. The tree
    is fitted on a sample; boxes come from all rows, so a bound is never above the least distance to any row of the cell.
    """

    def __init__(self, sample: np.ndarray, leaves: int, usable: list[int], least: int = 16):
        self.n_columns = sample.shape[1]
        self.usable, self.least = usable, least
        self.nodes: list[tuple[int, float, int, int, int]] = []  # column, cut, below, above, without; column -1: a cell
        self.n_cells = 0
        self._grow(sample, leaves)

    def _grow(self, rows: np.ndarray, share: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, self.n_cells, -1, -1))
        cut = self._cut(rows) if share > 1 and len(rows) >= self.least else None
        if cut is None:
            self.n_cells += 1
            return at
        column, value = cut
        x = rows[:, column]
        parts = [rows[x <= value], rows[x > value], rows[np.isnan(x)]]
        shares = [max(1, round(share * len(p) / len(rows))) for p in parts]
        children = [self._grow(p, s) if len(p) else -1 for p, s in zip(parts, shares)]
        self.nodes[at] = (column, value, *children)
        return at

    def _cut(self, rows: np.ndarray) -> tuple[int, float] | None:
        """The median of the column along which the rows spread most."""
        best = None
        for column in self.usable:
            known = rows[:, column][~np.isnan(rows[:, column])]
            if len(known) > 1 and known.min() < known.max():
                spread = known.var() * len(known) / len(rows)
                if best is None or spread > best[0]:
                    value = float(np.median(known))
                    best = spread, column, value if value < known.max() else float(known[known < known.max()].max())
        return best[1:] if best else None

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out, stack = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            column, value, below, above, without = self.nodes[node]
            if column < 0:
                out[at] = below
                continue
            x = rows[at, column]
            unknown = np.isnan(x)
            under = x <= value
            if without >= 0:
                stack.append((without, at[unknown]))
            else:
                under |= unknown
            stack.append((below, at[under]))
            stack.append((above, at[~under & ~unknown]))
        return out

    def set_boxes(self, low: np.ndarray, high: np.ndarray, known: np.ndarray, rows: np.ndarray) -> None:
        """Per cell: least and largest value, number of known values by column, and number of rows."""
        shape = (len(self.nodes), self.n_columns)
        self.low, self.high = np.full(shape, np.nan), np.full(shape, np.nan)
        self.known, self.rows = np.zeros(shape, np.int64), np.zeros(len(self.nodes), np.int64)
        for node in range(len(self.nodes) - 1, -1, -1):
            column, _, *children = self.nodes[node]
            if column < 0:
                cell = children[0]
                self.low[node], self.high[node], self.known[node], self.rows[node] = low[cell], high[cell], known[cell], rows[cell]
                continue
            for child in children:
                if child >= 0 and self.rows[child]:
                    self.low[node] = np.fmin(self.low[node], self.low[child])
                    self.high[node] = np.fmax(self.high[node], self.high[child])
                    self.known[node] += self.known[child]
                    self.rows[node] += self.rows[child]

    def bound(self, rows: np.ndarray, node: int) -> np.ndarray:
        """No row of the node is nearer than this; infinite where no column is shared.

        A column that only some of the node's rows have counts if it lowers the mean squared gap.
        """
        if not self.rows[node]:
            return np.full(len(rows), np.inf)
        gap = np.maximum(np.maximum(self.low[node] - rows, rows - self.high[node]), 0.0) ** 2
        usable = ~np.isnan(gap)
        always = self.known[node] == self.rows[node]
        total = np.where(usable & always, gap, 0.0).sum(axis=1)
        n = (usable & always).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(n > 0, total / n, np.inf)
            some = np.sort(np.where(usable, gap, np.inf)[:, ~always], axis=1)
            for t in range(some.shape[1]):
                total, n = total + some[:, t], n + 1
                least = np.fmin(least, total / n)
        return np.sqrt(least * self.n_columns) * _CLOSE

    def within(self, rows: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the row, cell, bound) of all cells that may hold a row at most ``radius`` away."""
        found, stack = [], [(0, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            b = self.bound(rows[at], node)
            near = np.isfinite(b) & (b <= radius[at])
            at, b = at[near], b[near]
            if not len(at):
                continue
            column, _, *children = self.nodes[node]
            if column < 0:
                found.append((at, np.full(len(at), children[0], np.int32), b))
            else:
                stack += [(child, at) for child in children if child >= 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def following(self, rows: np.ndarray, radius: np.ndarray, seen: np.ndarray, limit: int, step: int) -> tuple[np.ndarray, ...]:
        """(index of the row, cell, seen by then): the cells each row searches next, nearest bounds first.

        ``seen`` counts the cells searched so far besides the home cell. The first ``limit`` cells come in steps; a row with a radius
        then takes all that are left, and is done (-1). A row without a radius takes ``step`` more.
        """
        at, cell, b = self.within(rows, np.where(np.isnan(radius), np.inf, radius))
        away = cell != self.home(rows)[at]
        at, cell, b = at[away], cell[away], b[away]
        order = np.lexsort((cell, b, at))
        at, cell = at[order], cell[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        count = np.bincount(at, minlength=len(rows))
        last = np.where(np.isnan(radius), seen + step, np.where(seen < limit, limit, count))
        then = np.where(last >= count, -1, last)
        asked = (rank >= seen[at]) & (rank < last[at])
        return at[asked], cell[asked], then[at[asked]]
