"""Blocks of the distance joins: point comparisons in NumPy, and blocks dealt over tasks."""

import numpy as np
import pandas as pd
import pyarrow as pa

from terrace.operators import geo, near


def city(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places around a centre, on the poles, at the date line, and many within a metre."""
    rng = np.random.default_rng(seed)
    lat, lon = 3 + rng.normal(0, 0.05, n), 101 + rng.normal(0, 0.05, n)
    lat[: n // 4], lon[: n // 4] = 3 + rng.random(n // 4) * 1e-7, 101 + rng.random(n // 4) * 1e-7
    lat[-4:], lon[-4:] = [90.0, 89.99, 0.0, 0.0], [0.0, 50.0, 180.0, -180.0]
    return lat, lon


def test_counts_within_equal_brute_force():
    asks, refs = city(300, 1), city(900, 2)
    rows, opened = np.random.default_rng(3).integers(1, 5, 900), np.tile([1, 2, 3], 300)
    distance = near.haversine(asks[0][:, None], asks[1][:, None], refs[0][None], refs[1][None])
    found = near.counts_within(asks, refs, rows, opened, [0.01, 5.0])
    for j, radius in enumerate([0.01, 5.0]):
        assert (found[:, j] == ((distance <= radius) * rows * (opened >> j & 1)).sum(axis=1)).all()


def test_nearest_lists_keep_ties_by_id_and_classes_apart():
    lat, lon = city(400, 5)
    lat, lon = np.round(lat, 2), np.round(lon, 2)
    classes = np.arange(400) % 3
    x, y, z = near.on_sphere(lat, lon).T
    rows = pa.table({"lat": lat, "lon": lon, "x": x, "y": y, "z": z, "fold": classes, "id": np.arange(400)[::-1]})
    found = near.nearest_lists(rows, rows, 7, ("x", "y", "z"), ("lat", "lon"), "fold", ["id"]).to_pylist()
    distance = np.round(near.haversine(lat[:, None], lon[:, None], lat[None], lon[None]), 9)
    ids = np.arange(400)[::-1]
    for i in range(400):
        others = np.flatnonzero(classes != classes[i])
        best = others[np.lexsort((ids[others], distance[i][others]))[:7]]
        assert [e["id"] for e in found[i]] == ids[best].tolist()


def test_radius_counts_deal_crowded_blocks_over_tasks(spark, monkeypatch):
    """More places within a metre than a block holds: queries and references are dealt over tasks, none is counted twice or lost."""
    monkeypatch.setattr(geo, "LEAF", 16)
    lat, lon = city(160, 7)
    df = spark.createDataFrame(pd.DataFrame({"listing_id": np.arange(160), "lat": lat, "lon": lon}))
    out = geo.radius_counts(df, df, "listing_id", radii=(1.0, 3.0), exclude_self=True).toPandas().set_index("listing_id").sort_index()
    distance = near.haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    for radius, name in ((1.0, "within_1km"), (3.0, "within_3km")):
        assert (out[name].to_numpy() == (distance <= radius).sum(axis=1) - 1).all()


def test_neighbours_of_other_folds_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(geo, "NEAR_LEAF", 16)
    lat, lon = city(120, 9)
    fold = np.arange(120) % 5 + 1
    df = spark.createDataFrame(pd.DataFrame({"listing_id": np.arange(120), "lat": lat, "lon": lon, "fold": fold}))
    out = geo.nearest(df, df, 6, "listing_id", apart="fold", classes=5).collect()
    distance = np.round(near.haversine(lat[:, None], lon[:, None], lat[None], lon[None]), 9)
    for row in out:
        others = np.flatnonzero(fold != row["fold"])
        best = others[np.lexsort((others, distance[row["listing_id"]][others]))[:6]]
        assert np.allclose([n["distance_km"] for n in row["neighbours"]], distance[row["listing_id"]][best], atol=1e-8)
