"""Mixing documents to target weights of domains they belong to in part."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from terrace.llm.common import body, map_batches, text_slices, words_of, written

#: Labelled rows that training looks at (about).
TRAINING_ROWS = 8_000
#: Hashed word features.
WIDTH = 1024
#: Texts that are described at once, however short; bounds their dense features.
SLICE_ROWS = 2048
#: Pull of the rates towards one at first and at last, and the gap of a domain in shares of the mix that counts as met.
RIDGE, LEAST_RIDGE, CLOSE = 1e-3, 1e-10, 1e-4


def word_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of damped hashed word counts, and the words of each text."""
    hashes, owner = words_of(texts)
    n = len(texts)
    cells = owner.astype(np.int64) * WIDTH + (hashes % np.uint64(WIDTH)).astype(np.int64)
    x = np.log1p(np.bincount(cells, minlength=n * WIDTH).reshape(n, WIDTH))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12), np.bincount(owner, minlength=n)


@dataclass
class DomainModel:
    """Multinomial logistic weights; ``prior`` serves texts without words."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    prior: np.ndarray

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        x, tokens = word_features(texts)
        z = x @ self.weights.T + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        p[tokens == 0] = self.prior
        return p, tokens


def fit_domains(docs: DataFrame, labelled: DataFrame, limit: int = TRAINING_ROWS) -> DomainModel:
    """Learns domain posteriors from ``labelled`` (``doc_id, domain``), about ``limit`` rows chosen by a hash of the id.

    Null domains don't teach; of several domains of one id the first by order
    counts. All labelled domains are told apart; they are a short list. Without
    a labelled document every text has the domains' shares of the labels.
    """
    usable = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
    sizes = usable.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").collect()
    domains = sorted(r.domain for r in sizes)
    if len(domains) < 2:
        return DomainModel(domains or ["all"], np.zeros((1, WIDTH)), np.zeros(1), np.ones(1))
    total = sum(r.n for r in sizes)
    prior = np.array([next(r.n for r in sizes if r.domain == d) for d in domains]) / total
    share = min(1.0, limit / total)
    chosen = usable.where(F.col("domain").isin(domains) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000))
    place = F.array_position(F.lit(domains), F.col("domain")).cast("double") - 1
    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", place.alias("label"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch, rows=SLICE_ROWS):
                part = batch.slice(start, end - start)
                x, _ = word_features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "found"])

    table = written(map_batches(rows, describe, "label double, found array<double>"), "domain-training")
    if table.isEmpty():
        # No labelled document has a row: the shares of the labels are all that is known.
        return DomainModel(domains, np.zeros((len(domains), WIDTH)), np.log(prior), prior)
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=50).fit(table.select("label", array_to_vector("found").alias("features")))
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    # A domain without a sampled row has no weights of its own.
    missing = len(domains) - len(bias)
    return DomainModel(domains, np.vstack([weights, np.zeros((missing, WIDTH))]), np.concatenate([bias, np.full(missing, -30.0)]), prior)


def memberships(docs: DataFrame, model: DomainModel, carried: str) -> DataFrame:
    """The column ``carried``, then ``tokens`` and ``share`` (posterior of each domain), where the text is read.

    A carried struct brings its own ``text``, so texts go to the worker once.
    """
    kind = docs.schema[carried].dataType
    inside = isinstance(kind, StructType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(carried)
            both = pa.RecordBatch.from_arrays([rows, rows.field("text") if inside else batch.column("text")], [carried, "text"])
            for start, end in text_slices(both, rows=SLICE_ROWS):
                part = both.slice(start, end - start)
                p, tokens = model.posteriors(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(carried), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], [carried, "tokens", "share"])

    out = StructType([StructField(carried, kind), StructField("tokens", LongType()), StructField("share", ArrayType(DoubleType()))])
    return map_batches(docs.select(carried) if inside else docs.select(carried, body().alias("text")), score, out)


@dataclass
class Fit:
    """Steps of one number per domain, from which every rate follows, and what is left of each target (got - wanted, in shares of the mix)."""

    steps: list[list[float]]
    gaps: dict[str, float]


def rates_after(fit: Fit, least: float) -> Column:
    """``rate``: one, less the gradient of each step in turn, projected to ``least`` and above."""
    start = F.struct(F.lit(1.0).alias("rate"))
    if not fit.steps:
        return start

    def step(at: Column, told: Column) -> Column:
        slope = F.aggregate(F.zip_with("share", told, lambda p, r: F.coalesce(p * r, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
        return F.struct(F.greatest(F.lit(float(least)), at["rate"] - slope).alias("rate"))

    return F.aggregate(F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in fit.steps]), start, step)


def measured(parts: DataFrame, k: int, steps: list[np.ndarray], least: float) -> tuple[float, np.ndarray, np.ndarray]:
    """One distributed sum: the documents' part of the last step's dual loss, the tokens of each domain after it, and the curvature (documents above ``least``)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 + k + k * k)
        for batch in batches:
            weight = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
            share = batch.column("share").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rate = np.ones(len(weight))
            for step in steps[:-1]:
                rate = np.maximum(least, rate - share @ step)
            slope = share @ steps[-1]
            above = np.maximum(0.0, rate - slope - least)
            free = share[above > 0]
            out[0] += weight @ (above * above / 2 - least * slope)
            out[1 : k + 1] += (weight * (least + above)) @ share
            out[k + 1 :] += (free.T @ (weight[above > 0, None] * free)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["sums"])

    rows = map_batches(parts.select("tokens", "share"), sums, "sums array<double>").select(F.posexplode("sums").alias("at", "part"))
    out = np.zeros(1 + k + k * k)
    for r in rows.groupBy("at").agg(F.sum("part").alias("part")).collect():
        out[r["at"]] = r["part"]
    return out[0], out[1 : k + 1], out[k + 1 :].reshape(k, k)


def fit_rates(parts: DataFrame, domains: list[str], targets: dict[str, float] | None, budget: float | None, least: float, close: float = CLOSE, least_ridge: float = RIDGE) -> Fit:
    """Projected-gradient least squares over all documents.

    The loss is the squared gap between the expected and the wanted tokens of
    each domain, relative to the tokens it has, and a small pull of the rates
    towards one. A document's gradient depends on its posteriors and on one
    number per domain: its rate is the projection of one less the sum of all
    moves, so only that sum is kept, and a move is one distributed sum. Moves
    are scaled by the curvature of the documents that the bound doesn't hold,
    and halved until the loss falls; they end when the projected gradient is a
    tenth of ``close``. While targets are missed, a further step follows, with
    a tenth of the pull and towards the rates of the step before, down to
    ``least_ridge`` (by default there is one step). The fit ends with the first step that comes within
    ``close`` of the least gap, so targets that can't be met don't heap the
    mix on few documents. The gaps are returned.
    """
    k = len(domains)
    held = [F.sum(F.col("tokens") * F.get("share", F.lit(i))).alias(f"s{i}") for i in range(k)]
    row = parts.agg(F.sum("tokens").alias("all"), *held).first()
    if not row["all"]:
        return Fit([], {})
    have = np.array([row[f"s{i}"] for i in range(k)]) / row["all"]
    want = np.array([max(0.0, (targets or {}).get(d, 0.0 if targets else 1.0)) for d in domains])
    want = np.where(have > 1e-9, want, 0.0)
    if want.sum() == 0:
        return Fit([], {})
    want /= want.sum()
    scale = budget if budget is not None else float(max(h / w for h, w in zip(have, want, strict=True) if w > 0))
    want *= scale
    floor = np.maximum(have, 1e-9)

    def at(point: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        loss, got, curve = measured(parts, k, [*steps, point], least)
        return point, loss / row["all"] + want @ point, got / row["all"] - want, curve / row["all"]

    ridge = RIDGE
    steps: list[np.ndarray] = []
    gaps: list[np.ndarray] = []
    while True:
        now = at(np.zeros(k))
        while True:
            point, loss, gap, curve = now
            slope = gap - ridge * floor * point
            if np.abs(slope).max() < 0.1 * close * scale:
                break
            loss += ridge / 2 * floor @ point**2
            step = np.linalg.solve(curve + ridge * np.diag(floor), slope)
            gain, size = slope @ step, 1.0
            # Below this the gain is lost in the rounding of the loss.
            while size * gain > 1e-13 * (1 + abs(loss)):
                trial = at(point + size * step)
                if trial[1] + ridge / 2 * floor @ trial[0] ** 2 <= loss - 0.1 * size * gain:
                    break
                size /= 2
            else:
                break
            now = trial
        steps.append(point)
        gaps.append(gap)
        if np.abs(gap).max() < close * scale or ridge <= least_ridge:
            break
        ridge /= 10
    worst = [np.abs(g).max() for g in gaps]
    last = next(i for i, w in enumerate(worst) if w < close * scale or w <= min(worst) + close * scale)
    return Fit([p.tolist() for p in steps[: last + 1]], dict(zip(domains, (gaps[last] / scale).tolist(), strict=True)))


def meeting_rates(parts: DataFrame, domains: list[str], targets: dict[str, float] | None, budget: float | None, least: float) -> Fit:
    """The fit with a pull that shrinks until all targets are met; warns of those that no rates meet or no label names."""
    unknown = sorted(set(targets or {}) - set(domains))
    if unknown:
        warnings.warn(f"mixing: no label teaches these domains of the targets, the others share their part: {unknown}", stacklevel=3)
    fit = fit_rates(parts, domains, targets, budget, least, least_ridge=LEAST_RIDGE)
    missed = {d: round(g, 5) for d, g in fit.gaps.items() if abs(g) >= CLOSE}
    if missed:
        warnings.warn(f"mixing: targets missed by these shares of the mix: {missed}", stacklevel=3)
    return fit


def copies(rate: Column, key: Column) -> Column:
    """The rate as a whole number that has it as its mean: a hash of the document decides on the fraction."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = 1.0, least: float = 0.0) -> DataFrame:
    """``doc_id, n_tokens, domain, share, rate, copies``, one row per input row.

    ``domain`` is the likeliest one, ``share`` its posterior. ``budget`` is the
    wanted size of the mix in sizes of the input; without one it is the least
    at which no domain shrinks. Without ``targets`` all domains weigh alike; a
    domain that no text belongs to, or that ``targets`` leaves out, gets none.
    Targets that no rates meet are warned of, with the gaps left.

    Null and empty texts have no tokens; their posteriors are the domains'
    shares of the labels. Repeated rows and null ids are rated like others;
    other columns are ignored; an empty table gives none.
    """
    model = fit_domains(docs, labelled)
    parts = written(memberships(docs, model, "doc_id"), "memberships")
    fit = meeting_rates(parts, model.domains, targets, budget, least)
    rated = parts.withColumn("rate", rates_after(fit, least)["rate"])
    top = F.array_max("share")
    return rated.select(
        "doc_id", F.col("tokens").alias("n_tokens"), F.get(F.lit(model.domains), F.array_position("share", top).cast("int") - 1).alias("domain"),
        top.alias("share"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"),
    )


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, least: float = 1.0) -> DataFrame:
    """The documents, each as often as its rate says, with all their columns. By default none goes.

    Texts are read and scored once: whole rows are written beside their
    posteriors, of which the fit reads the posteriors only.
    """
    model = fit_domains(docs, labelled)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    parts = written(memberships(rows, model, "_row"), "memberships")
    fit = meeting_rates(parts, model.domains, targets, budget, least)
    rated = parts.withColumn("_n", copies(rates_after(fit, least)["rate"], F.col("_row.doc_id")))
    return rated.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")
