"""A hierarchical Pitman-Yor language model over characters, and perplexities under it.

A context of up to ORDER - 1 characters is a restaurant; its parent is the context without the
oldest character.  A restaurant's customers are the counts of its dishes (at the deepest level those of the
corpus, above it the tables of its children), and its tables are sampled by Gibbs: all customers
of one dish in one restaurant leave and are seated again, one after the other, by the Chinese-restaurant rule
given the other dishes and the parent's probabilities.  The new seating is accepted by the Metropolis-Hastings
ratio of that block; where the number of customers has changed since, because children were seated anew, it is taken as it is.
Levels are swept from the deepest up, all dishes of a level at once.  Discounts are drawn from a grid by an approximate likelihood and predictive probabilities are
averaged over the sweeps after burn-in.

Counts are gathered from every character of every text by a distributed aggregation; the model that comes out of it
has at most SIZE ** ORDER cells whatever the corpus, so it is sampled on the driver and sent
to all executors as one table of log probabilities.

Defined cases: null and empty texts have no characters and a null perplexity; with an empty corpus all
characters are equally likely; repeated rows count as often as they occur; extra columns are ignored; the
random generator is seeded, so equal counts give equal models.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import chars, vec

ORDER = 4
SWEEPS, BURN_IN = 8, 3
DISCOUNTS = (0.1, 0.3, 0.5, 0.65, 0.8, 0.9)
STRENGTH = 1.0


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive arrays, by Stirling's series after a shift by eight."""
    x = np.asarray(x, float)
    low = x < 8
    shift = np.where(low, x, 1.0)
    product = np.ones_like(x)
    for k in range(8):
        product *= shift + k
    y = np.where(low, x + 8, x)
    z = 1 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return series - np.where(low, np.log(product), 0.0)


Seating = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


#: Cells that are fewer are seated one by one, as array operations would cost more.
_FEW = 12


def seat(n: np.ndarray, base: np.ndarray, step: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, Seating]:
    """Seats n customers of a dish in each restaurant: (tables, stretches of customers between new tables).

    With t tables of the dish, a new one has weight ``base + step * t`` and the old ones i - d t together after
    i customers.  A stretch is (restaurant, tables, customers before, customers after).  The next customers of all cells that have
    more are seated together.
    """
    order = np.argsort(-n, kind="stable")
    left = np.asarray(n)[order]
    tables = np.ones(len(n), np.int64)
    weight, by, taken = (base + step)[order], step[order], np.full(len(n), float(d))
    cells, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, most = 1, int(left[0]) if len(left) else 0
    while i < most:
        # Cells with more than i customers come first.
        m = len(left) - int(np.searchsorted(left[::-1], i, "right"))
        if m < _FEW:
            break
        w = weight[:m]
        new = np.flatnonzero(rng.random(m) * (w + (i - taken[:m])) < w)
        if len(new):
            tables[new] += 1
            weight[new] += by[new]
            taken[new] += d
            cells.append(new)
            at.append(np.full(len(new), i))
        i += 1
    for c in range(len(left) - int(np.searchsorted(left[::-1], i, "right")) if i < most else 0):
        w, s, k, opened = float(weight[c]), float(by[c]), float(taken[c]), []
        for j, u in enumerate(rng.random(int(left[c]) - i).tolist(), i):
            if u * (w + j - k) < w:
                w, k = w + s, k + d
                opened.append(j)
        tables[c] += len(opened)
        cells.append(np.full(len(opened), c))
        at.append(np.array(opened, np.int64))
    cell, at = np.concatenate(cells), np.concatenate(at) + 1
    # A stretch ends where a table opens; the last one ends with the customers.
    by_cell = np.argsort(cell, kind="stable")
    cell, stop = cell[by_cell], at[by_cell]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    begin = np.where(first, 1, np.concatenate(([1], stop[:-1])))
    starts = np.flatnonzero(first)
    rank = np.arange(len(cell)) - np.repeat(starts, np.diff(np.append(starts, len(cell)))) + 1
    last = np.ones(len(n), np.int64)
    last[cell] = stop
    rest = np.flatnonzero(left > last)
    t = np.empty(len(n), np.int64)
    t[order] = tables
    return t, (order[np.concatenate((cell, rest))], np.concatenate((rank, tables[rest])), np.concatenate((begin, last[rest])).astype(float), np.concatenate((stop, left[rest])).astype(float))


def log_weight(seating: Seating, n_cells: int, base: np.ndarray, step: np.ndarray, d: float) -> np.ndarray:
    """The sum of the logs of the totals that seating divides by: the ratio, up to a constant, of a seating's posterior to its chance of being proposed."""
    cell, t, lo, hi = seating
    x = base[cell] + step[cell] * t - d * t
    return np.bincount(cell, lgamma(hi + x) - lgamma(lo + x), n_cells)


class Model:
    """Levels 0 to ORDER - 1; level k has the cells (context of k characters, character) as sorted numbers."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = ORDER, size: int = chars.SIZE, seed: int = 1):
        self.order, self.size = order, size
        self.rng = np.random.default_rng(seed)
        by = np.argsort(grams, kind="stable")
        self.cells = [np.zeros(0, np.int64)] * order
        self.cells[-1] = np.asarray(grams, np.int64)[by]
        for k in range(order - 2, -1, -1):
            self.cells[k] = np.unique(self.cells[k + 1] % size ** (k + 1))
        self.up = [None, *(np.searchsorted(self.cells[k - 1], self.cells[k] % size**k) for k in range(1, order))]
        self.rooms, self.room = [], []
        for k in range(order):
            rooms, room = np.unique(self.cells[k] // size, return_inverse=True)
            self.rooms.append(rooms)
            self.room.append(room)
        self.n: list[np.ndarray] = [np.zeros(0, np.int64)] * order
        self.n[-1] = np.asarray(counts, np.int64)[by]
        self.t: list[np.ndarray] = [np.zeros(0, np.int64)] * order
        self.seating: list[Seating | None] = [None] * order
        self.seated: list[np.ndarray | None] = [None] * order
        self.d = [0.5] * order
        for k in range(order - 1, -1, -1):
            self.t[k] = np.minimum(self.n[k], 1)
            if k:
                self.n[k - 1] = np.bincount(self.up[k], self.t[k], len(self.cells[k - 1])).astype(np.int64)

    def base(self, k: int) -> np.ndarray:
        """The parent's probability of each cell's dish, for the cells of level k."""
        p = np.full(len(self.cells[0]), 1 / self.size)
        for level in range(k):
            p = self.predict(level, p)
            p = p[self.up[level + 1]]
        return p

    def predict(self, k: int, parent: np.ndarray) -> np.ndarray:
        n, t, room, d = self.n[k], self.t[k], self.room[k], self.d[k]
        all_n = np.bincount(room, n, len(self.rooms[k]))[room]
        all_t = np.bincount(room, t, len(self.rooms[k]))[room]
        return (n - d * t + (STRENGTH + d * all_t) * parent) / (STRENGTH + all_n)

    def sweep(self) -> list[float]:
        """One Gibbs sweep from the deepest level up; returns the accepted share of each level."""
        accepted = []
        for k in range(self.order - 1, -1, -1):
            parent = self.base(k)
            d = self.d[k] = self._discount(k)
            all_t = np.bincount(self.room[k], self.t[k], len(self.rooms[k]))[self.room[k]]
            others = all_t - self.t[k]
            base, step = (STRENGTH + d * others) * parent, d * parent
            new, seating = seat(self.n[k], base, step, d, self.rng)
            if self.seating[k] is None:
                take = np.ones(len(new), bool)
            else:
                ratio = log_weight(seating, len(new), base, step, d) - log_weight(self.seating[k], len(new), base, step, d)
                take = (np.log(self.rng.random(len(new))) < ratio) | (self.seated[k] != self.n[k])
                seating = tuple(np.concatenate((x[take[seating[0]]], y[~take[self.seating[k][0]]])) for x, y in zip(seating, self.seating[k]))
            self.t[k] = np.where(take, new, self.t[k])
            self.seating[k], self.seated[k] = seating, self.n[k].copy()
            accepted.append(float(take.mean()) if len(take) else 1.0)
            if k:
                self.n[k - 1] = np.bincount(self.up[k], self.t[k], len(self.cells[k - 1])).astype(np.int64)
        return accepted[::-1]

    def _discount(self, k: int) -> float:
        """A discount drawn from the grid by the likelihood of the level's table counts (Ewens-Pitman, tables of each room)."""
        n, n_rooms = np.unique(np.bincount(self.room[k], self.n[k], len(self.rooms[k])), return_counts=True)
        t, t_rooms = np.unique(np.bincount(self.room[k], self.t[k], len(self.rooms[k])), return_counts=True)
        # Cells whose tables have one customer each add nothing.
        some = self.n[k] > self.t[k]
        tables = self.t[k][some]
        mean = self.n[k][some] / tables
        logs = []
        for d in DISCOUNTS:
            rooms = ((t * math.log(d) + lgamma(STRENGTH / d + t) - lgamma(np.full(1, STRENGTH / d))) * t_rooms).sum() - ((lgamma(STRENGTH + n) - lgamma(np.full(1, STRENGTH))) * n_rooms).sum()
            logs.append(rooms + (tables * (lgamma(mean - d) - lgamma(np.full(1, 1 - d)))).sum())
        p = np.exp(np.array(logs) - max(logs))
        return float(self.rng.choice(DISCOUNTS, p=p / p.sum()))

    def table(self) -> np.ndarray:
        """Predictive probabilities of every context and character under the present seating: size ** order of them."""
        p = np.full(self.size, 1 / self.size)
        for k in range(self.order):
            wide = np.tile(p.reshape(1, -1), (self.size, 1)).reshape(-1) if k else p
            contexts = self.size**k
            n = np.zeros(contexts * self.size)
            t = np.zeros(contexts * self.size)
            n[self.cells[k]], t[self.cells[k]] = self.n[k], self.t[k]
            n, t, wide = (x.reshape(contexts, self.size) for x in (n, t, wide))
            d = self.d[k]
            p = ((n - d * t + (STRENGTH + d * t.sum(1, keepdims=True)) * wide) / (STRENGTH + n.sum(1, keepdims=True))).reshape(-1)
        return p


def train(grams: np.ndarray, counts: np.ndarray, order: int = ORDER, size: int = chars.SIZE, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 1) -> np.ndarray:
    """Natural logs of the averaged predictive probabilities, size ** order as float32."""
    model = Model(grams, counts, order, size, seed)
    total = np.zeros(size**order)
    for s in range(sweeps):
        model.sweep()
        if s >= burn_in:
            total += model.table()
    return np.log(total / (sweeps - burn_in)).astype(np.float32)


def learn(docs: DataFrame, **options) -> np.ndarray:
    rows = chars.count(docs, ORDER).toPandas()
    return train(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), **options)


def score(docs: DataFrame, logs: np.ndarray, order: int = ORDER) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity): of every row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        for batch in batches:
            for a, b in vec.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                code, rows = chars.codes(*vec.buffers(part.column(1)))
                each = shared.value[chars.ngrams(code, rows, order)].astype(np.float64) if len(code) else np.zeros(0)
                run_ = np.concatenate(([0.0], np.cumsum(each)))
                n = np.diff(rows)
                total = run_[rows[1:]] - run_[rows[:-1]]
                with np.errstate(invalid="ignore", divide="ignore"):
                    perplexity = np.exp(-total / n)
                yield pa.record_batch([part.column(0), pa.array(n.astype(np.int32)), pa.array(total, mask=n == 0), pa.array(perplexity, mask=n == 0)], names=["doc_id", "n_symbols", "log_prob", "perplexity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_symbols int, log_prob double, perplexity double")
