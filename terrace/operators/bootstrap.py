"""Paired bootstrap intervals without moving rows.

Each row gets a Poisson(1) weight per draw, computed from its own key, so the
draws do not depend on partitioning or retries. A partition returns one line of
sums per draw; the shuffle carries ``partitions x draws`` lines, whatever the
number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("w", "cand_sq", "ref_sq", "abs_delta", "tail_w", "tail_cand_sq", "tail_ref_sq")
#: Draws and keys of one block: its numbers stay in the processor's cache.
DRAW_BLOCK = 128
KEY_BLOCK = 1024
ROW_BLOCK = 8192
POISSON_STEPS = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(16)])
#: Count for each 16-bit number: a Poisson(1) variable in steps of 1/65536, so that one mixed word serves four draws.
POISSON_TABLE = np.searchsorted(POISSON_STEPS, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.float64)
#: The numbers from which on the count is one more: comparing with all of them is faster than looking up.
POISSON_EDGES = np.flatnonzero(np.diff(POISSON_TABLE)).astype(np.uint16) + np.uint16(1)
LANES = 4


class Weights:
    """Keys x draws matrices of Poisson(1) counts from a 64-bit integer mix, made in place in one set of buffers."""

    def __init__(self, keys: int, draws: int) -> None:
        words = draws // LANES + 2
        self.x, self.y = np.empty((keys, words), np.uint64), np.empty((keys, words), np.uint64)
        self.count, self.over = np.empty((keys, words * LANES), np.uint8), np.empty((keys, words * LANES), bool)
        self.found = np.empty((keys, words * LANES))

    def of(self, row_key: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
        """``draws`` are numbers in a row; the next call overwrites the result."""
        n, words = len(row_key), np.arange(int(draws[0]) // LANES, int(draws[-1]) // LANES + 1, dtype=np.uint64)
        # Buffers of another width would not be in one piece.
        x, y = (b.reshape(-1)[: n * len(words)].reshape(n, len(words)) for b in (self.x, self.y))
        count, over, found = (b.reshape(-1)[: n * len(words) * LANES].reshape(n, -1) for b in (self.count, self.over, self.found))
        with np.errstate(over="ignore"):
            start = row_key.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)
            np.add(start[:, None], ((words + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[None, :], out=x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                np.bitwise_xor(x, np.right_shift(x, np.uint64(shift), out=y), out=x)
                np.multiply(x, np.uint64(factor), out=x)
            np.bitwise_xor(x, np.right_shift(x, np.uint64(31), out=y), out=x)
        lanes = x.astype("<u8", copy=False).view("<u2")
        count[...] = 0
        for edge in POISSON_EDGES:
            np.greater_equal(lanes, edge, out=over)
            np.add(count, over.view(np.uint8), out=count)
        found[...] = count
        first = int(draws[0]) % LANES
        return found[:, first : first + len(draws)]


def poisson_weights(row_key: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Rows x draws matrix of Poisson(1) counts; ``draws`` are numbers in a row."""
    if not len(draws) or not len(row_key):
        return np.zeros((len(row_key), len(draws)))
    return Weights(len(row_key), len(draws)).of(row_key, draws, seed)


def _by_key(at: np.ndarray, values: np.ndarray, keys: int) -> np.ndarray:
    """Sums of the columns by key."""
    return np.stack([np.bincount(at, weights=v, minlength=keys) for v in values])


def _partial_sums(by: list[str], draws: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        weights = Weights(KEY_BLOCK, DRAW_BLOCK)
        for batch in batches:
            for start in range(0, len(batch), ROW_BLOCK):
                block = batch.iloc[start:start + ROW_BLOCK].reset_index(drop=True)
                groups = block.groupby(by, dropna=False).indices if by else {(): np.arange(len(block))}
                tail = block["is_tail"].to_numpy(float)
                cand, ref = block["cand_sq"].to_numpy(float), block["ref_sq"].to_numpy(float)
                values = np.stack([np.ones(len(block)), cand, ref, block["abs_delta"].to_numpy(float), tail, tail * cand, tail * ref])
                keys, at = np.unique(block["row_key"].to_numpy(), return_inverse=True)
                sums = {key if isinstance(key, tuple) else (key,): rows for key, rows in groups.items()}
                for key in sums:
                    totals.setdefault(key, np.zeros((len(SUMS), draws)))
                # Groups that share a row share its weights: those with most of the keys are lines of one product.
                full = [key for key, rows in sums.items() if 2 * len(rows) >= len(keys)]
                lines = np.vstack([np.empty((0, len(keys))), *[_by_key(at[sums[key]], values[:4, sums[key]], len(keys)) for key in full]])
                                # The tail is few rows, and its lines are zero elsewhere.
                parts = [(key, slice(0, 4), rows) for key, rows in sums.items() if key not in full] + [(key, slice(4, 7), rows[values[4, rows] != 0]) for key, rows in sums.items()]
                few = [(key, cut, rows[np.argsort(at[rows], kind="stable")]) for key, cut, rows in parts if len(rows)]
                for low in range(0, len(keys), KEY_BLOCK):
                    high = min(low + KEY_BLOCK, len(keys))
                    spans = [(key, cut, rows[slice(*np.searchsorted(at[rows], (low, high)))]) for key, cut, rows in few]
                    for first in range(0, draws, DRAW_BLOCK):
                        span = slice(first, min(first + DRAW_BLOCK, draws))
                        drawn = weights.of(keys[low:high], np.arange(span.start, span.stop), seed)
                        product = lines[:, low:high] @ drawn
                        for i, key in enumerate(full):
                            totals[key][:4, span] += product[4 * i : 4 * i + 4]
                        for key, cut, rows in spans:
                            if len(rows):
                                totals[key][cut, span] += values[cut, rows] @ drawn[at[rows] - low]
        for key, sums in totals.items():
            out = pd.DataFrame(sums.T, columns=list(SUMS))
            out.insert(0, "draw", np.arange(draws))
            for name, value in zip(by, key):
                out[name] = value
            yield out[[*by, "draw", *SUMS]]

    return run


def paired_bootstrap(
    pairs: DataFrame, row_id: str, by: list[str] | None = None, draws: int = 5000, seed: int = 42
) -> DataFrame:
    """Candidate minus reference: points, 95% intervals, zero-inside flags, P(better).

    ``pairs`` holds ``actual``, ``candidate``, ``reference`` and optionally
    ``is_tail``; tail RMSE is resampled within the tail. Negative is better.
    """
    by = by or []
    tail = F.col("is_tail").cast("int") if "is_tail" in pairs.columns else F.lit(0)
    c, r = F.col("candidate") - F.col("actual"), F.col("reference") - F.col("actual")
    slim = pairs.select(
        *by, F.xxhash64(F.col(row_id)).alias("row_key"), (c * c).alias("cand_sq"), (r * r).alias("ref_sq"),
        (F.abs(c) - F.abs(r)).alias("abs_delta"), tail.alias("is_tail"),
    )
    kinds = dict(pairs.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "draw long", *[f"{s} double" for s in SUMS]])
    per_draw = (
        slim.mapInPandas(_partial_sums(by, draws, seed), schema)
        .groupBy(*by, "draw").agg(*[F.sum(s).alias(s) for s in SUMS])
        .where("w > 0")
        .select(
            *by,
            (F.sqrt(F.col("cand_sq") / F.col("w")) - F.sqrt(F.col("ref_sq") / F.col("w"))).alias("d_rmse"),
            (F.col("abs_delta") / F.col("w")).alias("d_mae"),
            F.when(F.col("tail_w") > 0, F.sqrt(F.col("tail_cand_sq") / F.col("tail_w")) - F.sqrt(F.col("tail_ref_sq") / F.col("tail_w"))).alias("d_tail"),
        )
    )
    # At most `draws` values per group reach these percentiles.
    pieces = [F.count(F.lit(1)).alias("draws")]
    for m in ("rmse", "mae", "tail"):
        pieces += [
            F.percentile(f"d_{m}", F.lit(0.025)).alias(f"{m}_ci_lower"), F.percentile(f"d_{m}", F.lit(0.975)).alias(f"{m}_ci_upper"),
            F.percentile(f"d_{m}", F.lit(0.5)).alias(f"{m}_median_difference"),
            F.avg((F.col(f"d_{m}") < 0).cast("int")).alias(f"{m}_p_better"),
        ]
    intervals = per_draw.groupBy(*by).agg(*pieces)
    for m in ("rmse", "mae", "tail"):
        intervals = intervals.withColumn(
            f"{m}_zero_inside", ((F.col(f"{m}_ci_lower") <= 0) & (F.col(f"{m}_ci_upper") >= 0)).cast("int")
        )
    points = paired_difference(pairs, by)
    return points.join(intervals, by) if by else points.crossJoin(intervals)


def paired_difference(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact point differences of RMSE, MAE and tail RMSE."""
    by = by or []
    tail = F.col("is_tail") == 1 if "is_tail" in pairs.columns else F.lit(False)
    c, r = F.col("candidate") - F.col("actual"), F.col("reference") - F.col("actual")
    return pairs.groupBy(*by).agg(
        (F.sqrt(F.avg(c * c)) - F.sqrt(F.avg(r * r))).alias("rmse_difference"),
        F.avg(F.abs(c) - F.abs(r)).alias("mae_difference"),
        (F.sqrt(F.avg(F.when(tail, c * c))) - F.sqrt(F.avg(F.when(tail, r * r)))).alias("tail_difference"),
    )


def pair_models(scored: DataFrame, row_id: str, candidate: str, references: list[str]) -> DataFrame:
    """Candidate and each reference side by side: one row per id and reference."""
    models = [candidate, *references]
    one = scored.where(F.col("model").isin(*models)).groupBy(row_id).agg(
        F.max("actual").alias("actual"), *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(f"_p_{i}") for i, m in enumerate(models)]
    )
    entries = F.array(*[F.struct(F.lit(m).alias("reference_model"), F.col(f"_p_{i + 1}").alias("reference")) for i, m in enumerate(references)])
    return one.withColumn("_e", F.explode(entries)).select(
        row_id, "actual", F.col("_p_0").alias("candidate"), "_e.reference_model", "_e.reference"
    )
