"""One solver for a whole grid of multinomial logistic routers.

All configurations share the rows and differ in their weights and penalties, so
their coefficients are stacked side by side and one pass over the data gives the
losses, gradients and curvatures of all of them: a task multiplies its rows with
the stacked matrix, and the partial sums are added up part by part by other tasks,
so that the driver is sent each total once, however many tasks there were.  Each
configuration then takes a step of its own on the driver, where only coefficients,
their history and the sums of a pass live (features x classes x configurations
numbers, as large as the models themselves, and half of ``BLOCK`` squared a
configuration), and the curvature of one configuration at a time.  The number of
passes is that of the slowest configuration and not their sum; no configuration's
steps depend on another one.

The curvature is the exact matrix of second derivatives of the features with the
greatest squares, up to ``BLOCK`` coefficients, and the diagonal of the others.
While all features fit, steps are Newton's, of which about a dozen are needed
however alike features are; beyond that, a quasi-Newton history corrects it.

A configuration minimizes the weighted sum of losses plus half the squared
coefficients over C, divided by the sum of weights.  Intercepts are not penalized.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of rows that are multiplied at once, to bound a task's memory.
ENTRIES = 1 << 16
#: Coefficients of a configuration whose second derivatives are all known, and pairs of entries that are summed at once.
BLOCK, PAIRS = 1024, 1 << 18
#: Numbers of a sum that one task adds up, small enough to come to the driver with the task's own message.
PART = 1 << 16
#: Steps that the rest of the curvature is estimated from; the driver keeps two arrays of the size of a model for each.
MEMORY = 20
#: Fixed values of the step search: sufficient decrease and curvature (strong Wolfe conditions).
DECREASE, CURVATURE = 1e-4, 0.9


def sparse_rows(features: DataFrame, label_place: Column, *keep: str) -> DataFrame:
    """(y, places, values, keep...): the entries of the ``features`` vectors that are not 0; ``label_place`` is the class number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for vector in batch.column("features").to_pylist():
                value = np.array(vector["values"], dtype=float)
                # A dense vector has no list of places.
                place = np.arange(len(value)) if vector["indices"] is None else np.array(vector["indices"], dtype=np.int64)
                places.append(place[value != 0])
                values.append(value[value != 0])
            rest = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=[*names, "places", "values"])

    rows = features.select(label_place.cast("int").alias("y"), *keep, "features")
    names = ["y", *keep]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, places array<int>, values array<double>")


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch in portions: row range, place and value of the entries, and the row of each."""
    places, values = batch.column("places"), batch.column("values")
    offsets = places.offsets.to_numpy()
    place, value = places.values.to_numpy(), values.values.to_numpy()
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ENTRIES, side="right")) - 1)
        last = min(last, first + ENTRIES, batch.num_rows)
        part = slice(offsets[first], offsets[last])
        row = np.repeat(np.arange(last - first), np.diff(offsets[first:last + 1]))
        yield slice(first, last), place[part], value[part], row
        first = last


def _scores(coefficients: np.ndarray, n: int, place: np.ndarray, value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rows times a (features + 1, columns) matrix whose last row holds the intercepts."""
    out = np.tile(coefficients[-1], (n, 1))
    if len(row):
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[begins]] += np.add.reduceat(coefficients[place] * value[:, None], begins, axis=0)
    return out


def _pairs(place: np.ndarray, value: np.ndarray, row: np.ndarray, n: int, heavy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, product, row) of all pairs of entries that stand in one row: cells of the upper half of a ``heavy`` x ``heavy`` square, the intercept last."""
    size = len(heavy) + 1
    at = np.searchsorted(heavy, place)
    kept = np.flatnonzero(heavy[np.minimum(at, len(heavy) - 1)] == place) if len(heavy) else np.zeros(0, np.int64)
    # Entries of a row by rising place, with its intercept at the end.
    order = np.lexsort((np.r_[at[kept], np.full(n, size - 1)], np.r_[row[kept], np.arange(n)]))
    at, value, row = np.r_[at[kept], np.full(n, size - 1)][order], np.r_[value[kept], np.ones(n)][order], np.r_[row[kept], np.arange(n)][order]
    # Each entry meets itself and what follows it in its row.
    ahead = np.searchsorted(row, row, side="right") - np.arange(len(row))
    ends, first = np.cumsum(ahead), 0
    while first < len(row):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PAIRS, side="right")))
        own = ahead[first:last]
        left = np.repeat(np.arange(first, last), own)
        right = left + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        yield at[left] * size + at[right], value[left] * value[right], row[left]
        first = last


def _loss_and_gradient(coefficients: np.ndarray, weights: np.ndarray, classes: int, batches: Iterator[pa.RecordBatch],
                       heavy: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, ...]:
    """One array: the gradient, and a last row with each configuration's loss in the column of its first class.

    With the places of ``heavy`` features there are two more: the sums of squares times p (1 - p) by feature and column, and of products
    of heavy features (upper half, intercept last) times p q for each configuration and pair of classes.
    """
    width, columns = coefficients.shape
    configs = columns // classes
    total = np.zeros((width + 1, columns))
    if heavy is not None:
        two = [(c, d) for c in range(classes) for d in range(c + 1, classes)]
        squares, products = np.zeros((width, columns)), np.zeros((configs, len(two), (len(heavy) + 1) ** 2))
    for batch in batches:
        label = batch.column("y").to_numpy()
        for rows, place, value, row in _batches(batch):
            y = label[rows]
            n = len(y)
            score = _scores(coefficients, n, place, value, row).reshape(n, configs, classes)
            score -= score.max(axis=2, keepdims=True)
            odds = np.exp(score)
            sums = odds.sum(axis=2, keepdims=True)
            own = weights[:, y].T
            total[-1, ::classes] += (own * (np.log(sums[:, :, 0]) - score[np.arange(n), :, y])).sum(axis=0)
            odds /= sums
            if heavy is not None:
                bend = (odds * (1 - odds) * own[:, :, None]).reshape(n, columns)
                squares[-1] += bend.sum(axis=0)
                _add_by_place(squares, place, value * value, bend, row)
                mixed = [[own[:, i] * odds[:, i, c] * odds[:, i, d] for c, d in two] for i in range(configs)]
                for cell, product, at in _pairs(place, value, row, n, heavy):
                    for i in range(configs):
                        for j in range(len(two)):
                            products[i, j] += np.bincount(cell, product * mixed[i][j][at], products.shape[2])
            odds[np.arange(n), :, y] -= 1
            pull = (odds * own[:, :, None]).reshape(n, columns)
            total[-2] += pull.sum(axis=0)
            _add_by_place(total, place, value, pull, row)
    if heavy is None:
        return total
    return total, squares, products[:, :, np.flatnonzero(np.triu(np.ones((len(heavy) + 1,) * 2)).ravel())]


def _add_by_place(total: np.ndarray, place: np.ndarray, value: np.ndarray, pull: np.ndarray, row: np.ndarray) -> None:
    """Adds each entry's value times its row of ``pull`` to the row of ``total`` at its place."""
    if len(place):
        order = np.argsort(place, kind="stable")
        begins = np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]])
        total[place[order][begins]] += np.add.reduceat(pull[row[order]] * value[order][:, None], begins, axis=0)


class Curvature:
    """Second derivatives of one configuration: all of the heavy features and the intercept, and the diagonal of the others."""

    def __init__(self, squares: np.ndarray, products: np.ndarray, heavy: np.ndarray, penalty: float):
        self.shape, k = squares.shape, squares.shape[1]
        self.places = np.r_[heavy, self.shape[0] - 1]
        self.exact = len(self.places) == self.shape[0]
        self.diagonal = squares + penalty
        self.products, self.penalty = products, penalty

    @property
    def block(self) -> np.ndarray:
        """The matrix, made anew each time: of all configurations only one stands in memory."""
        size, k = len(self.places), self.shape[1]
        upper = np.triu_indices(size)
        block = np.zeros((size, k, size, k))
        for sums, (c, d) in zip(self.products, ((c, d) for c in range(k) for d in range(c + 1, k))):
            whole = np.zeros((size, size))
            whole[upper] = sums
            whole += np.triu(whole, 1).T
            block[:, c, :, d] = block[:, d, :, c] = -whole
            block[:, c, :, c] += whole
            block[:, d, :, d] += whole
        flat = block.reshape(size * k, size * k)
        flat[np.diag_indices(size * k)] += np.r_[np.full((size - 1) * k, self.penalty), np.full(k, 1e-14)]
        # Adding one number to all intercepts changes no loss, and no gradient points there.
        block[-1, :, -1, :] += 1.0
        return block

    def solve(self, q: np.ndarray) -> np.ndarray:
        q = q.reshape(self.shape)
        out = q / self.diagonal
        rows = q[self.places]
        try:
            out[self.places] = np.linalg.solve(self.block.reshape(rows.size, rows.size), rows.ravel()).reshape(rows.shape)
        except np.linalg.LinAlgError:
            pass  # the diagonal alone
        return out.ravel()


class _Descent:
    """The steps of one configuration: Newton's, or limited-memory BFGS around a partial curvature, with a strong Wolfe search, one trial per pass."""

    def __init__(self, size: int, tol: float):
        self.tol, self.x, self.f, self.g = tol, np.zeros(size), None, None
        self.history: list[tuple[np.ndarray, np.ndarray]] = []
        self.trial, self.done = self.x, False

    def _direction(self, curvature: Curvature) -> np.ndarray:
        q, alphas = self.g.copy(), []
        for s, y in reversed(self.history):
            alpha = s @ q / (s @ y)
            q -= alpha * y
            alphas.append(alpha)
        q = curvature.solve(q)
        for (s, y), alpha in zip(self.history, reversed(alphas)):
            q += (alpha - y @ q / (s @ y)) * s
        return -q

    def _start(self, curvature: Curvature) -> None:
        if np.abs(self.g).max(initial=0.0) <= self.tol:
            self.done = True
            return
        self.d = self._direction(curvature)
        self.slope = self.g @ self.d
        if self.slope >= 0:
            self.history.clear()
            self.d = -self.g
            self.slope = self.g @ self.d
        self.low, self.high, self.step = 0.0, np.inf, 1.0
        self.searched = 0
        self.trial = self.x + self.step * self.d

    def take(self, f: float, g: np.ndarray, curvature: Curvature) -> None:
        """Loss, gradient and curvature at ``trial``; sets the next one."""
        if self.f is None:
            self.f, self.g = f, g
            return self._start(curvature)
        slope = g @ self.d
        self.searched += 1
        # Near the minimum, losses differ by less than their rounding: then the slope decides alone.
        flat = abs(f - self.f) <= 1e-13 * abs(self.f)
        if (f > self.f + DECREASE * self.step * self.slope and not flat) or slope > CURVATURE * abs(self.slope):
            self.high = self.step
        elif slope < CURVATURE * self.slope:
            self.low = self.step
        else:
            return self._accept(f, g, curvature)
        if self.searched >= 40:
            # No step is left between the bounds that rounding can tell apart.
            self.done = True
            return None
        self.step = (self.low + self.high) / 2 if np.isfinite(self.high) else 2 * self.low
        self.trial = self.x + self.step * self.d
        return None

    def _accept(self, f: float, g: np.ndarray, curvature: Curvature) -> None:
        s, y = self.trial - self.x, g - self.g
        if s @ y > 1e-300 and not curvature.exact:
            self.history = [*self.history[1 - MEMORY:], (s, y)]
        self.x, self.f, self.g = self.trial, f, g
        self._start(curvature)


@dataclass
class Grid:
    """Fitted models: ``coefficients`` of shape (configurations, features + 1, classes), the last row being the intercepts."""

    classes: list[str]
    coefficients: np.ndarray
    passes: int = 0
    #: The greatest entry of each configuration's gradient, per unit of weight.
    gradients: list[float] = field(default_factory=list)

    def predictions(self, rows: DataFrame, gold: str) -> DataFrame:
        """(place, gold, predicted_label, n): how often each configuration predicts a class, by the gold label; one pass."""
        held = rows.sparkSession.sparkContext.broadcast(np.concatenate(list(self.coefficients), axis=1))
        names, configs = np.array(self.classes, dtype=object), len(self.coefficients)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label = np.array(batch.column(gold).to_pylist(), dtype=object)
                for part, place, value, row in _batches(batch):
                    y = label[part]
                    best = _scores(held.value, len(y), place, value, row).reshape(len(y), configs, len(names)).argmax(axis=2)
                    for config in range(configs):
                        yield pa.RecordBatch.from_pydict({
                            "place": pa.array(np.full(len(y), config, np.int32)), gold: pa.array(y, pa.string()),
                            "predicted_label": pa.array(names[best[:, config]], pa.string()),
                        })

        each = rows.select("places", "values", gold).mapInArrow(run, f"place int, {gold} string, predicted_label string")
        return each.groupBy("place", gold, "predicted_label").agg(F.count("*").alias("n"))


def _added(rows: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The total of ``sums``, an array of ``size`` numbers from each task; parts of it are added up by a task each, and the driver gets each number once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sums(batches)
        for part, first in enumerate(range(0, size, PART)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([whole[first:first + PART].tobytes()], pa.binary())})

    sent = rows.mapInArrow(run, "part int, sums binary").rdd.map(lambda r: (r["part"], np.frombuffer(r["sums"])))
    parts = dict(sent.reduceByKey(np.add, -(-size // PART)).collect())
    return np.concatenate([parts[part] for part in range(len(parts))])


def heavy_places(rows: DataFrame, width: int, most: int) -> np.ndarray:
    """The places of up to ``most`` features, those with the greatest sums of squares, in rising order."""
    if width <= most:
        return np.arange(width)

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros(width)
        for batch in batches:
            for _, place, value, _ in _batches(batch):
                sums += np.bincount(place, value * value, width)
        return sums

    return np.sort(np.argsort(-_added(rows, squares, width), kind="stable")[:most])


def fit_grid(rows: DataFrame, counts: dict[str, int], classes: list[str], width: int, grid, tol: float = 1e-9, max_passes: int = 2000) -> Grid:
    """All models of ``grid`` (``C`` and ``class_weight`` each) on ``sparse_rows``, whose ``y`` counts ``classes``.

    ``counts`` has the rows of each class (all above 0) and ``width`` the number of
    features.  A model is done when no entry of its gradient, per unit of
    weight, is over ``tol``.
    """
    n, k = sum(counts.values()), len(classes)
    own = np.array([counts[c] for c in classes], dtype=float)
    weights = np.array([n / (k * own) if config["class_weight"] == "balanced" else np.ones(k) for config in grid])
    totals = weights @ own
    weights = weights / totals[:, None]
    penalty = np.array([1.0 / (config["C"] * total) for config, total in zip(grid, totals)])
    descents = [_Descent((width + 1) * k, tol) for _ in grid]
    heavy = heavy_places(rows, width, max(0, BLOCK // k - 1))
    cells = (len(heavy) + 1) * (len(heavy) + 2) // 2 * (k * (k - 1) // 2)
    size = (2 * width + 3) * k + cells
    context = rows.sparkSession.sparkContext
    passes = 0
    while passes < max_passes:
        active = [i for i, d in enumerate(descents) if not d.done]
        if not active:
            break
        passes += 1
        stacked = np.concatenate([descents[i].trial.reshape(width + 1, k) for i in active], axis=1)
        held = context.broadcast((stacked, weights[active]))

        def told(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            coefficients, own = held.value
            return np.concatenate([x.ravel() for x in _loss_and_gradient(coefficients, own, k, batches, heavy)])

        added = _added(rows, told, size * len(active))
        # Also on the driver, where what is only unpersisted stays until garbage is collected.
        held.destroy()
        sums, squares, products = np.split(added, np.cumsum([(width + 2) * stacked.shape[1], (width + 1) * stacked.shape[1]]))
        sums, squares, products = sums.reshape(width + 2, -1), squares.reshape(width + 1, -1), products.reshape(len(active), -1, cells // max(1, k * (k - 1) // 2))
        for j, i in enumerate(active):
            d = descents[i]
            x = d.trial.reshape(width + 1, k)
            gradient = sums[:-1, j * k:(j + 1) * k].copy()
            gradient[:-1] += penalty[i] * x[:-1]
            bend = Curvature(squares[:, j * k:(j + 1) * k], products[j], heavy, penalty[i])
            d.take(float(sums[-1, j * k]) + penalty[i] / 2 * float((x[:-1] ** 2).sum()), gradient.ravel(), bend)
    return Grid(list(classes), np.stack([d.x.reshape(width + 1, k) for d in descents]), passes, [float(np.abs(d.g).max()) for d in descents])
