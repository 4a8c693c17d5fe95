"""Cross-fitting from one encoded table: encodings of all folds side by side, ridge from moment matrices.

Every row carries, for each fold, the features it has in that fold's job: as a
training row its encodings come from the other inner folds, as a held-out row
from all training rows. The table is written once; a job filters it. Ridge fits
need no job of their own: one pass sums the products of features and target
for all folds, and every penalty is solved from those small matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.encode import category
from terrace.operators.folds import hash_fold
from terrace.operators.order import fold_quantiles
from terrace.operators.skew import attach
from terrace.session import compiled_methods, durable

INNER, INNER_SEED = 5, 4242


@dataclass
class Encoded:
    """The written table, its folds, and the training medians of each fold.

    Columns: the rows' own ones, ``_y``, ``_inner`` and one array over the
    folds per category, ``_te_<name>``.
    """

    data: DataFrame
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    fold: str
    folds: int
    medians: list[dict[str, float]]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *[f"{c}_te" for c in self.categorical]]

    def columns(self, k: int) -> list[Column]:
        """The features of fold ``k``'s job as expressions over the table."""
        return [*[number(c, self.medians[k - 1][c]) for c in self.numeric], *[F.get(f"_te_{c}", F.lit(k - 1)) for c in self.categorical]]

    def view(self, k: int) -> DataFrame:
        """All rows with the features they have in fold ``k``'s job; missing numbers are the training median."""
        filled = {c: number(c, self.medians[k - 1][c]) for c in self.numeric}
        return self.data.withColumns({f"_orig_{c}": F.col(c) for c in self.numeric}).withColumns(
            {**filled, **{f"{c}_te": F.get(f"_te_{c}", F.lit(k - 1)) for c in self.categorical}})

    def train(self, k: int) -> DataFrame:
        return self.view(k).where((F.col(self.fold) != k) & F.col("_y").isNotNull())

    def held(self, k: int) -> DataFrame:
        return self.view(k).where(F.col(self.fold) == k)


def number(c: str, missing: float) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(missing))


def merged(cells: Column) -> Column:
    """Count, mean and sum of squared deviations of some (n, m, v) cells; nothing is subtracted but means."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))

    def add(t: Column, c: Column) -> Column:
        n, gap = t["n"] + c["n"], c["m"] - t["m"]
        share = F.when(n > 0, c["n"] / n).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), (t["m"] + gap * share).alias("m"), (t["d"] + c["n"] * c["v"] + gap * gap * t["n"] * share).alias("d"))

    return F.aggregate(cells, zero, add)


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shrunk(total: Column, job: Column) -> Column:
    """Empirical-Bayes mean of a category; that of all rows where the category has none."""
    share = job["var"] * total["n"]
    weight = share / (share + total["d"] / total["n"])
    return F.when((total["n"] > 0) & (job["var"] > 0), weight * total["m"] + (1 - weight) * job["mean"]).otherwise(job["mean"])


def overall_moments(cells: list, fold: int, inner: int) -> tuple[float, float]:
    """Mean and variance of the target outside a fold, and outside an inner fold (0: none)."""
    some = [(c.n, c.m, c.v) for c in sorted(cells) if c.f != fold and c.i != inner and c.n]
    n = sum(c[0] for c in some)
    if not n:
        return 0.0, 0.0
    mean = sum(c[0] * c[1] for c in some) / n
    return mean, sum(c[0] * (c[2] + (c[1] - mean) ** 2) for c in some) / n


def with_fold_encodings(df: DataFrame, column: str, fold: str, folds: int, overall: list) -> DataFrame:
    """``_te_<column>``: the row's encoding in each fold's job, from one aggregate per (category, fold, inner fold)."""
    cell = [F.count("_y").alias("n"), F.coalesce(F.avg("_y"), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop("_y"), F.lit(0.0)).alias("v")]
    tagged = df.withColumn("_category", category(column))
    cells = tagged.groupBy("_category", F.col(fold).alias("f"), F.col("_inner").alias("i")).agg(*cell, F.count(F.lit(1)).alias("rows"))
    # folds x INNER cells a category at most, in a fixed order so that sums round alike.
    listed = cells.groupBy("_category").agg(F.sort_array(F.collect_list(F.struct("f", "i", "n", "m", "v"))).alias("_cells"), F.sum("rows").alias("_rows"))

    # Entry 0 of a fold is for its held-out rows, entry j for training rows of inner fold j.
    jobs = []
    for k in range(1, folds + 1):
        for j in (0, *range(1, INNER + 1)):
            mean, var = overall_moments(overall, k, j)
            jobs.append(F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"), F.lit(mean).alias("mean"), F.lit(var).alias("var")))

    def value(job: Column) -> Column:
        others = F.filter("_cells", lambda c: (c["f"] != job["k"]) & (c["i"] != job["j"]))
        return bind(merged(others), lambda total: shrunk(total, job))

    joined = attach(tagged, listed.select("_category", F.transform(F.array(*jobs), value).alias("_values"), "_rows"), ["_category"], "_rows")
    # Plain expressions: a lambda over the folds would be interpreted row by row.
    own = F.array(*[F.get("_values", F.lit(k * (INNER + 1)) + F.when(F.col(fold) == k + 1, 0).otherwise(F.col("_inner"))) for k in range(folds)])
    return joined.withColumn(f"_te_{column}", own).drop("_category", "_values", "_rows")


def fold_medians(df: DataFrame, columns: tuple[str, ...], fold: str, folds: int) -> list[dict[str, float]]:
    """Training medians of each fold; missing and not-a-number values play no part, an empty column gives 0."""
    if not columns:
        return [{} for _ in range(folds)]
    known = df.where(F.col("_y").isNotNull())
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])).alias("e")
    found = fold_quantiles(known.select(F.col(fold).alias("fold"), entries).select("fold", "e.*"), ["at"], "value", {"m": 0.5}, "fold", folds, "k")
    at = {(r.k, r.at): r.m for r in found.collect()}
    return [{c: float(at.get((k, i)) or 0.0) for i, c in enumerate(columns)} for k in range(1, folds + 1)]


def encode_folds(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...], y: Column, row_id: str, fold: str = "fold", folds: int = 5) -> Encoded:
    """Write the rows once with the target and the encodings of every fold's job."""
    base = df.withColumns({"_y": y, "_inner": hash_fold(F.col(row_id), INNER, INNER_SEED)})
    if categorical:
        base = durable(base)
        overall = base.groupBy(F.col(fold).alias("f"), F.col("_inner").alias("i")).agg(
            F.count("_y").alias("n"), F.coalesce(F.avg("_y"), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop("_y"), F.lit(0.0)).alias("v")).collect()
    table = base
    for c in categorical:
        table = with_fold_encodings(table, c, fold, folds, overall)
    # The joins of all categories make one stage.
    with compiled_methods(df.sparkSession):
        table = durable(table)
    return Encoded(table, tuple(numeric), tuple(categorical), fold, folds, fold_medians(table, tuple(numeric), fold, folds))


# --- moment matrices -------------------------------------------------------


def moments(df: DataFrame, columns: list[str], cells: Column, shifts: dict[str, float] | None = None) -> dict[int, np.ndarray]:
    """Sums of products of ``(1, columns)`` per cell, each cell number of a row counting once.

    ``cells`` is an array of cell numbers. ``shifts`` are taken off first, so
    that large offsets leave the small differences their digits. The driver
    gets one small matrix a cell.
    """
    off = np.array([(shifts or {}).get(c, 0.0) for c in columns])
    ready = df.select(cells.alias("cells"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.column_stack([np.ones(batch.num_rows), *[batch.column(n).to_numpy(zero_copy_only=False) - o for n, o in zip(names, off, strict=True)]])
            lists = batch.column("cells")
            which, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(z)), np.asarray(lists.value_lengths()))
            for cell in np.unique(which):
                part = z[at[which == cell]]
                sums[int(cell)] = sums.get(int(cell), 0) + part.T @ part
        size = len(names) + 1
        out = [(cell, i, j, float(m[i, j])) for cell, m in sums.items() for i in range(size) for j in range(i, size)]
        columns_out = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns_out[0], pa.int32()), pa.array(columns_out[1], pa.int32()), pa.array(columns_out[2], pa.int32()), pa.array(columns_out[3], pa.float64())], names=["cell", "i", "j", "value"])

    summed = ready.mapInArrow(run, "cell int, i int, j int, value double").groupBy("cell", "i", "j").agg(F.sum("value").alias("value"))
    found: dict[int, np.ndarray] = {}
    for r in summed.collect():
        m = found.setdefault(r.cell, np.zeros((len(columns) + 1, len(columns) + 1)))
        m[r.i, r.j] = m[r.j, r.i] = r.value
    return found


@dataclass(frozen=True)
class Linear:
    """A linear model on raw columns, and the size of its errors where it was judged."""

    intercept: float
    weights: tuple[float, ...]

    def value(self, columns: list[Column]) -> Column:
        total = F.lit(self.intercept)
        for w, c in zip(self.weights, columns, strict=True):
            total = total + F.lit(w) * c
        return total


def ridge_from_moments(m: np.ndarray, alpha: float, standardize: bool = False) -> Linear:
    """Least squares with ``alpha`` on the squared weights, of the last column on the others, intercept free.

    ``alpha`` belongs to the sum of squared errors; with ``standardize`` it acts
    on the weights of columns scaled to unit sample deviation. Columns without
    spread get no weight.
    """
    n, p = m[0, 0], len(m) - 2
    if not n:
        return Linear(0.0, (0.0,) * p)
    mean = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred)[:p], 0.0) / max(n - 1, 1))
    size = np.sqrt(np.maximum(np.diag(m)[1 : p + 1], 0.0) / n)
    used = spread > 1e-12 * np.maximum(size, 1e-300)
    scale = np.where(used, spread if standardize else 1.0, 1.0)
    a = (centred[:p, :p] / np.outer(scale, scale))[np.ix_(used, used)]
    b = (centred[:p, p] / scale)[used]
    weights = np.zeros(p)
    weights[used] = np.linalg.lstsq(a + alpha * np.eye(len(a)), b, rcond=None)[0] / scale[used]
    return Linear(float(mean[p] - weights @ mean[:p]), tuple(float(w) for w in weights))


def squared_error(m: np.ndarray, model: Linear) -> float:
    """Sum of squared errors of a linear model over the rows of a moment matrix."""
    v = np.array([model.intercept, *model.weights, -1.0])
    return max(float(v @ m @ v), 0.0)


def unshifted(model: Linear, shifts: list[float]) -> Linear:
    """The model for columns from which nothing is taken off; the last shift is the target's."""
    return Linear(model.intercept + shifts[-1] - sum(w * s for w, s in zip(model.weights, shifts[:-1], strict=True)), model.weights)


#: Errors this close, relatively, are equal. Penalties of the stack: 25 from 0.001 to 1000, evenly in the exponent.
SAME = 1e-9
STACK_ALPHAS = tuple(10.0 ** (-3 + i / 4) for i in range(25))


@dataclass(frozen=True)
class Chosen:
    """The penalty that won in one outer fold, its model, and the inner error of every penalty."""

    fold: int
    alpha: float
    model: Linear
    rmse: dict[float, float]


def choose_penalties(m: dict[int, np.ndarray], folds: int, inner: int, alphas: tuple[float, ...], shifts: list[float]) -> list[Chosen]:
    """Inner cross-validation of all penalties in each outer fold, from (outer, inner) cells alone.

    Cell ``fold * inner + j`` holds the rows of an outer fold and inner fold
    ``j`` (from 0). A training set is a sum of cells; no row is read again.
    Errors that differ by rounding only go to the smaller penalty.
    """
    size = next(iter(m.values())).shape[0] if m else 2
    none = np.zeros((size, size))
    cell = lambda f, j: m.get(f * inner + j, none)
    result = []
    for k in range(1, folds + 1):
        parts = [sum((cell(f, j) for f in range(1, folds + 1) if f != k), none) for j in range(inner)]
        whole = sum(parts, none)
        rmse = {}
        for alpha in alphas:
            left = [squared_error(part, ridge_from_moments(whole - part, alpha)) for part in parts]
            rmse[alpha] = math.sqrt(sum(left) / whole[0, 0]) if whole[0, 0] else 0.0
        least = min(rmse.values())
        best = min(a for a in alphas if rmse[a] <= least * (1 + SAME))
        result.append(Chosen(k, best, unshifted(ridge_from_moments(whole, best), shifts), rmse))
    return result


def nested_stack(
    wide: DataFrame, columns: list[str], row_id: str, actual: str = "actual", fold: str = "fold", folds: int = 5, inner: int = 4,
    alphas: tuple[float, ...] = STACK_ALPHAS, seed: int = 99,
) -> tuple[DataFrame, DataFrame]:
    """Ridge stack of out-of-fold predictions, its penalty chosen inside each outer fold.

    Returns every row with ``stacked`` from the fit that never saw its fold,
    and a report ``fold, alpha, rmse, chosen`` over all penalties. One pass
    over the rows, one aggregate per (outer, inner) cell. Rows whose target or
    a prediction is missing teach nothing; a missing prediction leaves
    ``stacked`` missing.
    """
    whole = wide.where(" and ".join(f"{c} is not null and not isnan({c})" for c in [*columns, actual]))
    means = whole.agg(*[F.avg(c).alias(c) for c in [*columns, actual]]).first()
    shifts = [float(means[c] or 0.0) for c in [*columns, actual]]
    number_of = F.col(fold) * F.lit(inner) + hash_fold(F.col(row_id), inner, seed) - 1
    m = moments(whole, [*columns, actual], F.array(number_of.cast("int")), dict(zip([*columns, actual], shifts, strict=True)))
    chosen = choose_penalties(m, folds, inner, alphas, shifts)
    value = F.coalesce(*[F.when(F.col(fold) == c.fold, c.model.value([F.col(n) for n in columns])) for c in chosen])
    rows = [(c.fold, float(a), float(c.rmse[a]), int(a == c.alpha)) for c in chosen for a in alphas]
    report = wide.sparkSession.createDataFrame(rows, "fold int, alpha double, rmse double, chosen int")
    return wide.withColumn("stacked", value), report


@dataclass(frozen=True)
class FoldBlocks:
    """Training rows of all folds as matrices: ``(1, features, target)``, with a fold's shifts taken off the last two.

    A row's encodings differ by fold, so a batch carries the features of all
    folds and each fold takes its own.
    """

    ready: DataFrame
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: list[dict[str, float]]
    centre: float

    @property
    def shifts(self) -> list[list[float]]:
        return [[*[m[c] for c in self.numeric], *[self.centre] * len(self.categorical), self.centre] for m in self.medians]

    def reader(self) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]:
        """For tasks: the folds (from 1) of a batch with their blocks."""
        numeric, categorical, medians, centre = self.numeric, self.categorical, self.medians, self.centre

        def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            own, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
            raw = [batch.column(f"n{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(numeric))]
            for k in range(1, len(medians) + 1):
                rows = own != k
                # A missing number is the median, and the median is what comes off.
                z = [np.ones(int(rows.sum()))]
                z += [np.nan_to_num(c[rows] - medians[k - 1][name], nan=0.0) for c, name in zip(raw, numeric, strict=True)]
                z += [batch.column(f"t{i}_{k}").to_numpy(zero_copy_only=False)[rows] - centre for i in range(len(categorical))]
                yield k, np.column_stack([*z, y[rows] - centre])

        return blocks


def fold_blocks(encoded: Encoded) -> FoldBlocks:
    flat = {f"n{i}": F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for i, c in enumerate(encoded.numeric)}
    flat |= {f"t{i}_{k}": F.get(f"_te_{c}", F.lit(k - 1)) for i, c in enumerate(encoded.categorical) for k in range(1, encoded.folds + 1)}
    ready = encoded.data.where(F.col("_y").isNotNull()).select(F.col(encoded.fold).cast("int").alias("fold"), F.col("_y").cast("double").alias("y"), *[c.alias(n) for n, c in flat.items()])
    centre = float(ready.agg(F.avg("y")).first()[0] or 0.0)
    return FoldBlocks(ready, tuple(encoded.numeric), tuple(encoded.categorical), encoded.medians, centre)


def summed_blocks(ready: DataFrame, count: int, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """``count`` square matrices to which ``add`` adds every batch, summed over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, size, size))
        for batch in batches:
            if batch.num_rows:
                add(batch, sums)
        k, i, j = np.indices(sums.shape).reshape(3, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(j), pa.array(sums.ravel())], names=["k", "i", "j", "value"])

    found = np.zeros((count, size, size))
    for r in ready.mapInArrow(run, "k int, i int, j int, value double").groupBy("k", "i", "j").agg(F.sum("value").alias("value")).collect():
        found[r.k, r.i, r.j] = r.value
    return found


def fold_moments(encoded: Encoded) -> list[tuple[np.ndarray, list[float]]]:
    """Moments of features and target over each fold's training rows, with the shifts taken off; one pass for all folds."""
    source = fold_blocks(encoded)
    blocks = source.reader()

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        for k, block in blocks(batch):
            sums[k - 1] += block.T @ block

    found = summed_blocks(source.ready, encoded.folds, len(encoded.features) + 2, add)
    return list(zip(found, source.shifts, strict=True))


#: Models with a log link have settled when their logs move by less than this, as a root mean square.
SETTLED, ROUNDS = 1e-6, 100


def tweedie_models(encoded: Encoded, powers: dict[str, float]) -> dict[str, list[Linear]]:
    """Tweedie regressions with a log link, one a fold for each named variance power; ``exp`` of the model is the mean.

    Iteratively reweighted least squares, all models in one pass a round: a
    round needs one weighted moment matrix a model. Ends when all have settled.
    """
    source = fold_blocks(encoded)
    blocks, centre, p = source.reader(), source.centre, len(encoded.features)
    keys = [(name, k) for name in powers for k in range(1, encoded.folds + 1)]
    models: dict[tuple[str, int], Linear] = {}
    waiting = list(keys)
    for _ in range(ROUNDS):
        at = {key: i for i, key in enumerate(waiting)}
        # Plain arrays: tasks need not know this module.
        now = {key: np.array([models[key].intercept, *models[key].weights]) if key in models else None for key in waiting}

        def add(batch: pa.RecordBatch, sums: np.ndarray, at=at, now=now) -> None:
            for k, block in blocks(batch):
                x, y = block[:, :-1], block[:, -1] + centre
                if (y < 0).any():
                    raise ValueError("a Tweedie target must not be negative")
                for name, power in powers.items():
                    if (name, k) not in at:
                        continue
                    line = now[(name, k)]
                    eta = np.log(np.where(y > 0, y, 0.1)) if line is None else np.clip(x @ line, -300.0, 300.0)
                    mean = np.exp(eta)
                    z = np.column_stack([x, eta + (y - mean) / mean])
                    sums[at[(name, k)]] += (z * (mean ** (2.0 - power))[:, None]).T @ z

        found = summed_blocks(source.ready, len(waiting), p + 2, add)
        left = []
        for key, m in zip(waiting, found, strict=True):
            models[key] = ridge_from_moments(m, 0.0, standardize=True)
            moved = None if now[key] is None else np.array([models[key].intercept, *models[key].weights]) - now[key]
            if m[0, 0] and (moved is None or moved @ m[:-1, :-1] @ moved > SETTLED**2 * m[0, 0]):
                left.append(key)
        waiting = left
        if not waiting:
            break
    else:
        raise RuntimeError(f"{waiting} did not settle in {ROUNDS} rounds")
    return {name: [unshifted(models[(name, k)], [*source.shifts[k - 1][:-1], 0.0]) for k in range(1, encoded.folds + 1)] for name in powers}


def ridge_models(encoded: Encoded, penalties: dict[str, float]) -> dict[str, list[Linear]]:
    """For each named penalty (averaged over rows, on standardised features), one model a fold."""
    ready = fold_moments(encoded)
    return {name: [unshifted(ridge_from_moments(m, penalty * m[0, 0], standardize=True), s) for m, s in ready] for name, penalty in penalties.items()}


#: Total prices from predictions of a target form, in NumPy; sizes are known numbers.
TOTALS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "unit": lambda value, size: value * size,
    "direct": lambda value, size: value,
    "log_unit": lambda value, size: np.expm1(value) * size,
    "log_price": lambda value, size: np.expm1(value),
}


def held_out_sums(encoded: Encoded, models: dict[str, list[Linear]], target: str, price: str, size: str) -> list[tuple]:
    """``name, fold, n, squared, absolute, total, total_squared`` of many linear models on their held-out rows, in one pass.

    Sums of squared and absolute price errors and of prices; a batch of rows
    is one matrix product for all models. Rows without price, size or
    prediction do not count.
    """
    names, folds, p = list(models), encoded.folds, len(encoded.numeric)
    medians = np.array([[m[c] for c in encoded.numeric] for m in encoded.medians]).reshape(folds, p)
    weights = np.array([[models[n][k].weights for n in names] for k in range(folds)])
    intercepts = np.array([[models[n][k].intercept for n in names] for k in range(folds)])
    total_of = TOTALS[target]
    columns = {f"n{i}": F.col(c).cast("double") for i, c in enumerate(encoded.numeric)}
    columns |= {f"t{i}": F.get(f"_te_{c}", F.col(encoded.fold) - 1) for i, c in enumerate(encoded.categorical)}
    ready = encoded.data.select(F.col(encoded.fold).cast("int").alias("fold"), F.col(price).cast("double").alias("price"), F.col(size).cast("double").alias("size"), *[c.alias(n) for n, c in columns.items()])
    labels = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, len(names), 5))
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, actual, area = (batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("fold", "price", "size"))
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in labels])
            for k in range(folds):
                rows = fold == k + 1
                own = x[rows]
                own[:, :p] = np.where(np.isnan(own[:, :p]), medians[k], own[:, :p])
                value = np.maximum(total_of(own @ weights[k].T + intercepts[k], area[rows][:, None]), 0.0)
                error = value - actual[rows][:, None]
                known = np.isfinite(error)
                error, price_of = np.where(known, error, 0.0), np.where(known, actual[rows][:, None], 0.0)
                sums[k] += np.stack([known.sum(axis=0), (error**2).sum(axis=0), np.abs(error).sum(axis=0), price_of.sum(axis=0), (price_of**2).sum(axis=0)], axis=1)
        k, i, j = np.indices(sums.shape).reshape(3, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(j), pa.array(sums.ravel())], names=["k", "i", "j", "value"])

    found = np.zeros((folds, len(names), 5))
    for r in ready.mapInArrow(run, "k int, i int, j int, value double").groupBy("k", "i", "j").agg(F.sum("value").alias("value")).collect():
        found[r.k, r.i, r.j] = r.value
    return [(name, k + 1, int(found[k, i, 0]), *map(float, found[k, i, 1:])) for k in range(folds) for i, name in enumerate(names)]


def smearing_by_fold(encoded: Encoded, models: list[Linear]) -> list[float]:
    """Mean of exp(residual) over each fold's training rows, all folds in one pass."""
    known = F.col("_y").isNotNull()
    wanted = [F.avg(F.when(known & (F.col(encoded.fold) != k), F.exp(F.col("_y") - m.value(encoded.columns(k))))).alias(f"s{k}") for k, m in enumerate(models, 1)]
    one = encoded.data.agg(*wanted).first()
    return [float(one[f"s{k}"] or 1.0) for k in range(1, encoded.folds + 1)]


def coefficients(encoded: Encoded, models: list[Linear]) -> DataFrame:
    """``fold, feature, coefficient`` of one linear model a fold, the intercept as a feature of its own."""
    rows = [(k, name, value) for k, m in enumerate(models, 1) for name, value in zip(["intercept", *encoded.features], [m.intercept, *m.weights], strict=True)]
    return encoded.data.sparkSession.createDataFrame(rows, "fold int, feature string, coefficient double")
