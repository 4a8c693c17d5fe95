"""Points of one block against those of another, in NumPy, as a task does it.

Points are halved along their widest side into cells of ``CELL`` points. Whole
cells are ruled out or counted by their boxes; only the cells that a radius
cuts, or that may hold a neighbour, are compared point by point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from terrace.functions.numeric import EARTH_RADIUS_KM

CELL = 32
#: Rounding of a dot product of two unit vectors, with room; closer cases are decided by the haversine.
ROUNDING = 4e-15


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


def haversine(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """As ``haversine_km``."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2.0) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2.0) ** 2
    return 2.0 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0)))


class Cells:
    """Points in cells of equal size with their boxes; ``members`` may end in the number of points, which is no point."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        depth = max(int(np.ceil(np.log2(max(n, 1) / CELL))), 0)
        self.padded = np.vstack([points, points[-1:]])
        groups = np.full((1, -(-n // (1 << depth)) << depth), n)
        groups[0, :n] = np.arange(n)
        for _ in range(depth):
            at = self.padded[groups]
            axis = np.ptp(at, axis=1).argmax(axis=1)
            order = np.take_along_axis(at, axis[:, None, None], 2)[:, :, 0].argsort(axis=1)
            groups = np.take_along_axis(groups, order, 1).reshape(2 * len(groups), -1)
        self.count, self.members = n, groups
        at = self.padded[groups]
        self.low, self.high = at.min(axis=1), at.max(axis=1)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distance of each cell's box from a box."""
        return (np.maximum(np.maximum(self.low - high, low - self.high), 0.0) ** 2).sum(axis=1)

    def greatest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (np.maximum(self.high - low, high - self.low) ** 2).sum(axis=1)


def counts_within(asks: tuple[np.ndarray, np.ndarray], refs: tuple[np.ndarray, np.ndarray], rows: np.ndarray, opened: np.ndarray, radii: list[float]) -> np.ndarray:
    """Reference rows within each radius of each point; a reference counts for the radii of the bits of its ``opened``."""
    found = np.zeros((len(asks[0]) + 1, len(radii)), np.int64)
    cells = Cells(on_sphere(*asks))
    ask_lat, ask_lon = (np.append(v, v[-1]) for v in asks)
    for bits in np.unique(opened):
        own = opened == bits
        lat, lon, n = refs[0][own], refs[1][own], np.append(rows[own], 0)
        others = Cells(on_sphere(lat, lon))
        lat, lon = np.append(lat, lat[-1]), np.append(lon, lon[-1])
        whole = n[others.members].sum(axis=1)
        for members, low, high in zip(cells.members, cells.low, cells.high, strict=True):
            near, far = others.least(low, high), others.greatest(low, high)
            points = cells.padded[members]
            for j, radius in enumerate(radii):
                if not int(bits) >> j & 1:
                    continue
                chord = 2.0 * np.sin(min(radius / (2.0 * EARTH_RADIUS_KM), np.pi / 2))
                slack = 1e-9 * chord + 1e-15
                inside = far <= max(chord - slack, 0.0) ** 2
                at = others.members[(near <= (chord + slack) ** 2) & ~inside].ravel()
                dots = points @ others.padded[at].T
                hit = dots >= 1.0 - chord * chord / 2.0
                p, q = np.nonzero(np.abs(dots - (1.0 - chord * chord / 2.0)) <= ROUNDING)
                if len(p):
                    hit[p, q] = haversine(ask_lat[members[p]], ask_lon[members[p]], lat[at[q]], lon[at[q]]) <= radius
                many = np.flatnonzero(n[at] != 1)
                found[members, j] += whole[inside].sum() + np.count_nonzero(hit, axis=1) + hit[:, many] @ (n[at[many]] - 1)
    return found[:-1]


def close_pairs(asks: np.ndarray, refs: np.ndarray, k: int, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of which each point's ``k`` nearest, and all as near as ``slack`` allows, are a part."""
    cells, others = Cells(asks), Cells(refs)
    first = min(-(-4 * k // CELL) + 1, len(others.members))

    def squares(points: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros((len(points), len(at)))
        for d in range(points.shape[1]):
            total += (points[:, d, None] - others.padded[at, d]) ** 2
        return np.where(at < others.count, total, np.inf)

    def farthest(found: np.ndarray) -> np.ndarray:
        kth = np.partition(found, k - 1, axis=1)[:, k - 1] if found.shape[1] >= k else np.full(len(found), np.inf)
        return (np.sqrt(kth) * (1 + 1e-9) + slack) ** 2

    for members, low, high in zip(cells.members, cells.low, cells.high, strict=True):
        points, near = cells.padded[members], others.least(low, high)
        start = np.argpartition(near, first - 1)[:first]
        limit = farthest(squares(points, others.members[start].ravel())).max()
        at = others.members[near <= limit].ravel()
        found = squares(points, at)
        p, q = np.nonzero((found <= farthest(found)[:, None]) & np.isfinite(found) & (members < cells.count)[:, None])
        yield members[p], at[q]


def nearest_lists(asks: pa.Table, refs: pa.Table, k: int, dims: tuple[str, ...], places: tuple[str, str] | None, apart: str | None, values: list[str]) -> pa.Array:
    """For each row of ``asks`` the ``k`` nearest of ``refs`` by distance, to nine places, and ``id``, as structs of distance and ``values``.

    With ``places`` (latitude and longitude) distances are great-circle
    kilometres, else Euclidean over ``dims``. Rows with one value of ``apart`` don't meet.
    """
    sides = [np.column_stack([t.column(c).to_numpy().astype(float) for c in dims]) for t in (asks, refs)]
    rank = np.empty(refs.num_rows, np.int64)
    rank[pc.sort_indices(refs.column("id")).to_numpy()] = np.arange(refs.num_rows)
    classes = [t.column(apart).to_numpy() if apart else np.zeros(t.num_rows) for t in (asks, refs)]
    pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for one in np.unique(classes[0]):
        mine, theirs = np.flatnonzero(classes[0] == one), np.flatnonzero(classes[1] != one) if apart else np.arange(refs.num_rows)
        if len(mine) and len(theirs):
            pairs += [(mine[p], theirs[q]) for p, q in close_pairs(sides[0][mine], sides[1][theirs], k, 1e-12 if places else 4e-9)]
    p, q = (np.concatenate(side) for side in zip(*pairs, strict=True))
    if places:
        a, b = ([t.column(c).to_numpy() for c in places] for t in (asks, refs))
        distance = haversine(a[0][p], a[1][p], b[0][q], b[1][q])
    else:
        distance = np.sqrt(((sides[0][p] - sides[1][q]) ** 2).sum(axis=1))
    distance = np.round(distance, 9)
    order = np.lexsort((rank[q], distance, p))
    p, q, distance = p[order], q[order], distance[order]
    keep = np.arange(len(p)) - np.searchsorted(p, p) < k
    p, q, distance = p[keep], q[keep], distance[keep]
    offsets = np.searchsorted(p, np.arange(asks.num_rows + 1)).astype(np.int32)
    taken = [refs.column(v).combine_chunks().take(pa.array(q)) for v in values]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(distance), *taken], ["distance_km", *values]))
