"""Hard-negative mining over an inverted multi-index of two half-space codebooks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import map_batches, written
from terrace.llm.vectors import Shape, binary, matrix, shape_of, unpacked

#: Rows that the codebooks are fitted on (the first by a hash of the id); every row is indexed.
SAMPLE = 16_384
#: Codewords of each half: so many that a cell holds about ``CELL_ROWS`` rows, within these limits.
CODEWORDS = (8, 256)
CELL_ROWS = 256
#: Rows of a slot, the part of a cell that one search step compares; larger cells have several.
SLOT_ROWS = 2048
#: Rows that the first round of a search visits for each anchor, and the factor from round to round.
FIRST_ROWS, GROWTH = 4096, 16
#: Bytes of vectors in one packed row.
BLOB = 1 << 14
#: Hits that a task holds before it reduces them to the best, and passes them on if that doesn't help.
HELD = 200_000
ENDLESS = 1 << 62
SEED = 7_331


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves and, for each cell that has rows, their number and the radius in each half."""

    shape: Shape
    half: int
    books: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray
    counts: np.ndarray
    radii: np.ndarray

    @property
    def words(self) -> int:
        return len(self.books[0])


def codebook(x: np.ndarray, words: int, steps: int = 10) -> np.ndarray:
    """Lloyd's codewords of some rows, from spread-out first ones; a codeword that loses its rows stays where it is."""
    rng = np.random.default_rng(SEED)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[rng.permutation(len(x))[:words]]
    for _ in range(steps):
        at = nearest_word(x, centres)[0]
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_word(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest codeword of each row, and the distance to it."""
    at = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1))


def fit_codebooks(rows: DataFrame, shape: Shape, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow().column("x").combine_chunks()
    x = matrix(picked, shape.dim).astype(float)
    words = int(np.clip(round((shape.rows / CELL_ROWS) ** 0.5), *CODEWORDS))
    half = shape.dim // 2
    return codebook(x[:, :half], words), codebook(x[:, half:], words)


def assigned(rows: DataFrame, shape: Shape, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Every row with its cell and its distance to the cell's codeword in each half, vectors packed."""
    dim, kind, half, words = shape.dim, shape.kind, shape.dim // 2, len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            left, far_left = nearest_word(x[:, :half].astype(float), books[0])
            right, far_right = nearest_word(x[:, half:].astype(float), books[1])
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("vec_id"), batch.column("label"), batch.column("anchor"), binary(x.astype(kind)),
                pa.array((left * words + right).astype(np.int32)), pa.array(far_left), pa.array(far_right),
            ], names=["row", "vec_id", "label", "anchor", "x", "cell", "far_left", "far_right"])

    schema = "row long, vec_id long, label long, anchor boolean, x binary, cell int, far_left double, far_right double"
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", "x")
    return map_batches(numbered, run, schema)


def indexed(rows: DataFrame, shape: Shape) -> tuple[DataFrame, Index]:
    books = fit_codebooks(rows, shape)
    table = written(assigned(rows, shape, books), "indexed")
    cells = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far_left").alias("l"), F.max("far_right").alias("r")).orderBy("cell").collect()  # 256 * 256 at most
    return table, Index(
        shape, shape.dim // 2, books, np.array([c.cell for c in cells], dtype=np.int64), np.array([c.n for c in cells], dtype=np.int64),
        np.array([(c.l, c.r) for c in cells]).reshape(len(cells), 2),
    )


PARTS = "cell int, slot int, query boolean, rows binary, ids binary, labels binary, x binary, windows binary"
NAMES = [p.split()[0] for p in PARTS.split(", ")]


def longs(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype=np.int64).tobytes()


def part(cells: list[int], slots: list[int], query: bool, blobs: list[tuple[bytes, ...]]) -> pa.RecordBatch:
    columns = [pa.array([b[i] for b in blobs], pa.binary()) for i in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(slots, pa.int32()), pa.array([query] * len(cells)), *columns], names=NAMES)


def blocks(table: DataFrame, index: Index) -> DataFrame:
    """The indexed rows as packed blocks of one slot each; a slot is a hash of the row number, so hot cells are dealt out."""
    dim, kind = index.shape.dim, index.shape.kind
    per_blob = max(1, BLOB // max(1, dim * np.dtype(kind).itemsize))
    slots_of = np.ones(index.words**2, dtype=np.int64)
    slots_of[index.cells] = -(-index.counts // SLOT_ROWS)

    def with_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            slot = (rows >> np.uint64(33)).astype(np.int64) % slots_of[batch.column("cell").to_numpy()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("cell", "row", "vec_id", "label", "x")], pa.array(slot.astype(np.int32))], names=["cell", "row", "vec_id", "label", "x", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, slot = (batch.column(n).to_numpy().astype(np.int64) for n in ("cell", "slot"))
            rows, ids, labels = (batch.column(n).to_numpy() for n in ("row", "vec_id", "label"))
            x = unpacked(batch.column("x"), dim, kind)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(slot) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(cell)]
            made = []
            for begin, end in zip(bounds, bounds[1:], strict=False):
                for i in range(begin, end, per_blob):
                    j = min(i + per_blob, end)
                    made.append((int(cell[i]), int(slot[i]), (longs(rows[i:j]), longs(ids[i:j]), longs(labels[i:j]), x[i:j].tobytes(), b"")))
            for i in range(0, len(made), 256):
                some = made[i : i + 256]
                yield part([m[0] for m in some], [m[1] for m in some], False, [m[2] for m in some])

    dealt = map_batches(table, with_slot, "cell int, row long, vec_id long, label long, x binary, slot int")
    ordered = dealt.repartition("cell", "slot").sortWithinPartitions("cell", "slot")
    return written(map_batches(ordered, run, PARTS), "blocks")


def cells_by_bound(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Multi-sequence heap: pairs of codewords by falling sum of their half bounds, one by one."""
    one, two = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    high, low = left[one].tolist(), right[two].tolist()
    one, two = one.tolist(), two.tolist()
    heap = [(-(high[0] + low[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, one[i], two[j]
        if j + 1 < len(low):
            heapq.heappush(heap, (-(high[i] + low[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(high):
            heapq.heappush(heap, (-(high[i + 1] + low[0]), i + 1, 0))


def visiting(anchors: DataFrame, index: Index, seen: int, budget: int) -> DataFrame:
    """Requests of one round: which anchors want which slots, with the score windows they still look for.

    Each anchor takes cells by falling bound, from the one after ``seen`` rows
    on, until ``budget`` rows are reached or no window is open: the bound is
    under the least score that could still enter one (a certificate, since
    later cells are bounded lower still). A cell whose own bounds, with its
    own radii, rule out every window is passed over.
    """
    dim, kind, half, words = index.shape.dim, index.shape.kind, index.half, index.words
    left_book, right_book = index.books
    row_of = np.full(words * words, -1)
    row_of[index.cells] = np.arange(len(index.cells))
    counts, radii = index.counts, index.radii
    widest = np.zeros((2, words))
    np.maximum.at(widest[0], index.cells // words, radii[:, 0])
    np.maximum.at(widest[1], index.cells % words, radii[:, 1])
    slots_of = (-(-counts // SLOT_ROWS)).tolist()
    numbers, where = counts.tolist(), row_of.tolist()
    far_left, far_right = radii[:, 0].tolist(), radii[:, 1].tolist()
    per_blob = max(1, BLOB // max(1, dim * np.dtype(kind).itemsize))
    # Room for rounding in the bounds.
    slack = 1e-9 * (1.0 + index.shape.squared) + 1e-3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, per_blob):
                batch = whole.slice(begin, per_blob)
                packed_x = unpacked(batch.column("x"), dim, kind)
                x = packed_x.astype(float)
                rows, ids, labels = (batch.column(n).to_numpy() for n in ("row", "vec_id", "label"))
                windows = windows_of(batch.column("windows"))
                sizes = np.sqrt((x[:, :half] ** 2).sum(axis=1)), np.sqrt((x[:, half:] ** 2).sum(axis=1))
                on_left, on_right = x[:, :half] @ left_book.T, x[:, half:] @ right_book.T
                # Codewords that hold no rows come last.
                up_left, up_right = on_left + np.outer(sizes[0], widest[0]), on_right + np.outer(sizes[1], widest[1])
                wanted: dict[int, list[int]] = {}
                for a in range(len(x)):
                    low, high = int(windows[a, :, 2].min()), int(windows[a, :, 3].max())
                    if low > high:
                        continue
                    met, size_left, size_right = 0, float(sizes[0][a]), float(sizes[1][a])
                    score_left, score_right = on_left[a].tolist(), on_right[a].tolist()
                    for bound, i, j in cells_by_bound(up_left[a], up_right[a]):
                        if met >= budget or bound + slack < low:
                            break
                        at = where[i * words + j]
                        if at < 0:
                            continue
                        met += numbers[at]
                        if met - numbers[at] < seen:
                            continue
                        middle, spread = score_left[i] + score_right[j], size_left * far_left[at] + size_right * far_right[at]
                        if middle + spread + slack >= low and middle - spread - slack <= high:
                            wanted.setdefault(at, []).append(a)
                made = []
                for at, who in wanted.items():
                    blob = longs(rows[who]), longs(ids[who]), longs(labels[who]), packed_x[who].tobytes(), longs(windows[who])
                    made.extend((int(index.cells[at]), slot, blob) for slot in range(slots_of[at]))
                    if len(made) >= 64:
                        yield part([m[0] for m in made], [m[1] for m in made], True, [m[2] for m in made])
                        made = []
                if made:
                    yield part([m[0] for m in made], [m[1] for m in made], True, [m[2] for m in made])

    return map_batches(anchors.select("row", "vec_id", "label", "x", "windows"), run, PARTS)


def windows_of(column: pa.Array) -> np.ndarray:
    """``(anchor, window, 4)``: number, low, least score of use, high; missing windows are empty ones."""
    lists = column.to_pylist()
    width = max((len(w or ()) for w in lists), default=0) or 1
    out = np.zeros((len(lists), width, 4), dtype=np.int64)
    out[:, :, 2], out[:, :, 3] = ENDLESS, -ENDLESS
    for i, some in enumerate(lists):
        for j, w in enumerate(some or ()):
            out[i, j] = w["window"], w["low"], max(w["low"], w["floor"] if w["floor"] is not None else w["low"]), w["high"]
    return out


HITS = "anchor long, window int, score long, vec_id long, row long"


def best_of(parts: list[np.ndarray], keep: int) -> np.ndarray:
    """The first ``keep`` hits of each anchor and window: higher scores first, then smaller ids."""
    hits = np.concatenate(parts) if parts else np.zeros((0, 5), dtype=np.int64)
    anchor, window, score, ids, row = hits.T
    order = np.lexsort((row, ids, -score, window, anchor))
    hits = hits[order]
    fresh = np.ones(len(hits), dtype=bool)
    fresh[1:] = (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1])
    begins = np.flatnonzero(fresh)
    rank = np.arange(len(hits)) - np.repeat(begins, np.diff([*begins, len(hits)]))
    return hits[rank < keep]


def inner(q: np.ndarray, x: np.ndarray, real: type) -> np.ndarray:
    """Exact integer inner products; beyond a long, its nearest value."""
    product = q.astype(real) @ x.astype(real).T
    if real is object:
        return np.array([[max(min(v, 2**63 - 1), -(2**63)) for v in line] for line in product.tolist()], dtype=np.int64).reshape(product.shape)
    return product


def compared(parts: DataFrame, shape: Shape, same_label: bool, keep: int) -> DataFrame:
    """Hits of the requests in the blocks of their slots; blocks come first in each slot."""
    dim, kind, real = shape.dim, shape.kind, shape.real

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block, closed, found, held = None, [], None, [], 0

        def out(hits: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(hits[:, i].astype(np.int32) if i == 1 else hits[:, i]) for i in range(5)]
            return pa.RecordBatch.from_arrays(columns, names=["anchor", "window", "score", "vec_id", "row"])

        for batch in batches:
            cells, slots, queries = (batch.column(n).to_pylist() for n in ("cell", "slot", "query"))
            for i in range(batch.num_rows):
                if (here := (cells[i], slots[i])) != place:
                    place, block, closed = here, [], None
                rows, ids, labels = (np.frombuffer(batch.column(n)[i].as_buffer(), dtype=np.int64) for n in ("rows", "ids", "labels"))
                x = np.frombuffer(batch.column("x")[i].as_buffer(), dtype=kind).reshape(len(rows), dim)
                if not queries[i]:
                    block.append((rows.copy(), ids.copy(), labels.copy(), x.copy()))
                    continue
                if closed is None:
                    closed = tuple(np.concatenate(c) for c in zip(*block, strict=True)) if block else ()
                if not closed:
                    continue
                windows = np.frombuffer(batch.column("windows")[i].as_buffer(), dtype=np.int64).reshape(len(rows), -1, 4)
                for hits in hits_in(closed, (rows, labels, x, windows), real, same_label, keep):
                    found.append(hits)
                    held += len(hits)
                if held > HELD:
                    found = [best_of(found, keep)]
                    held = len(found[0])
                    if held > HELD // 2:
                        yield out(found[0])
                        found, held = [], 0
        yield out(best_of(found, keep))

    return map_batches(parts, run, HITS)


def hits_in(block: tuple[np.ndarray, ...], asked: tuple[np.ndarray, ...], real: type, same_label: bool, keep: int) -> Iterator[np.ndarray]:
    """Per window, the best hits of each anchor in a block."""
    rows, ids, labels, x = block
    who, own_label, q, windows = asked
    scores = inner(q, x, real)
    fits = (own_label[:, None] == labels[None, :]) == same_label
    if same_label:
        fits &= who[:, None] != rows[None, :]
    fits &= (scores >= windows[:, :, 2].min(axis=1)[:, None]) & (scores <= windows[:, :, 3].max(axis=1)[:, None])
    a, r = np.nonzero(fits)
    s = scores[a, r].astype(np.int64)
    for w in range(windows.shape[1]):
        inside = (s >= windows[a, w, 2]) & (s <= windows[a, w, 3])
        if inside.any():
            ai, ri = a[inside], r[inside]
            yield best_of([np.column_stack([who[ai], windows[ai, w, 0], s[inside], ids[ri], rows[ri]])], keep)


def search(table: DataFrame, index: Index, anchors: DataFrame, windows: DataFrame, same_label: bool, keep: int) -> DataFrame:
    """The first ``keep`` rows of each window of each anchor, as ``anchor, window, score, vec_id, row, rank``.

    ``windows`` are rows ``row, window, low, high`` of score limits. Rounds
    visit more and more rows an anchor; after each, the last score of a full
    window is the least that is still of use. The last round has no budget
    left out, so what it doesn't visit is certified to hold no better row.
    """
    best = None
    order = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id", "row")
    seen, budget, last = 0, FIRST_ROWS, False
    while not last:
        last = budget >= index.shape.rows
        open_windows = windows.withColumn("floor", F.lit(None).cast("long"))
        if best is not None:
            floors = best.groupBy(F.col("anchor").alias("row"), "window").agg(F.when(F.count(F.lit(1)) >= keep, F.min("score")).alias("floor"))
            open_windows = windows.join(floors, ["row", "window"], "left")
        lists = open_windows.groupBy("row").agg(F.collect_list(F.struct("window", "low", "floor", "high")).alias("windows"))
        # Anchors of one cell stand together, so that their requests do.
        asking = anchors.join(lists, "row").repartitionByRange("cell", "row").sortWithinPartitions("cell", "row")
        requests = visiting(asking, index, seen, ENDLESS if last else budget)
        both = table.unionByName(requests).repartition("cell", "slot").sortWithinPartitions("cell", "slot", "query")
        hits = compared(both, index.shape, same_label, keep)
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        best = written(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep), "best")
        seen, budget = budget, budget * GROWTH
    return best


def limits(positive: str, low: int, high: int) -> tuple[Column, Column]:
    """Whole scores ``s`` with ``low * positive <= 100 * s <= high * positive``, for positive scores of 0 and more."""
    least = f"({positive} DIV 100) * {low} + ({positive} % 100 * {low} + 99) DIV 100"
    most = f"({positive} DIV 100) * {high} + ({positive} % 100 * {high}) DIV 100"
    return F.expr(least), F.expr(most)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``vec_id, label, x, anchor``.

    ``x`` holds whole numbers, ``anchor`` marks the queries. An anchor's
    positives are the best rows of its label other than itself; each positive
    asks for the best rows of other labels whose score is from ``low`` to
    ``high`` per cent of its own. Scores are exact inner products; higher ones
    come first, then smaller ids.

    The index is two codebooks, one a half of the space, fitted on ``SAMPLE``
    rows; all rows are in its cells. An anchor visits cells by the sum of
    their half bounds (product with the codeword plus length times radius)
    until the bound is under what its windows still need, so the result is
    exact. Where the vectors have no structure, bounds rule out little and
    most slots are compared, in blocks.

    Rows without id, label or vector take no part. Repeated rows are rows of
    their own: each is an anchor, and each may be the other's positive.
    Shorter vectors end in zeros, empty ones score 0. Anchors alone with
    their label, or whose windows are empty (negative positive scores), give
    no rows; nor does an empty table. Other columns play no part.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    shape = shape_of(rows)
    table, index = indexed(rows, shape)
    anchors = written(table.where("anchor").select("row", "vec_id", "label", "x", "cell"), "anchors")
    parts = blocks(table, index)
    anything = anchors.select("row", F.lit(0).alias("window"), F.lit(-ENDLESS).alias("low"), F.lit(ENDLESS).alias("high"))
    near = search(parts, index, anchors, anything, True, positives)
    least, most = limits("score", low, high)
    # Under a negative score the limits are the wrong way round: no row meets both.
    windows = near.where("score >= 0").select(F.col("anchor").alias("row"), F.col("rank").alias("window"), least.alias("low"), most.alias("high")).where("low <= high")
    found = search(parts, index, anchors, windows, False, negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    asked = near.select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(asked, ["anchor", "window"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )

