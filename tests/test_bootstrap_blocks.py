"""Bootstrap sums made in blocks of keys and draws."""

import numpy as np
import pandas as pd
import pytest

from terrace.operators import bootstrap


def test_weights_in_place_equal_the_table():
    keys, made = np.arange(40) * 7919, bootstrap.Weights(64, 32)
    whole = bootstrap.poisson_weights(keys, np.arange(50), 3)
    for first, last in ((0, 32), (5, 30), (32, 50)):
        assert (made.of(keys, np.arange(first, last), 3) == whole[:, first:last]).all()
    lanes = np.arange(1 << 16)
    assert (np.searchsorted(bootstrap.POISSON_EDGES, lanes, side="right") == bootstrap.POISSON_TABLE).all()
    assert bootstrap.poisson_weights(keys[:0], np.arange(5), 3).shape == (0, 5)


@pytest.mark.parametrize("groups", [2, 9])
def test_block_sums_equal_one_product(monkeypatch, groups):
    """Groups that share keys, small groups, repeated keys and blocks that cut them give the sums of the whole matrix."""
    monkeypatch.setattr(bootstrap, "KEY_BLOCK", 16)
    monkeypatch.setattr(bootstrap, "DRAW_BLOCK", 8)
    monkeypatch.setattr(bootstrap, "ROW_BLOCK", 70)
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"m": np.arange(200) % groups, "row_key": np.arange(200) // groups // 2, "cand_sq": rng.random(200), "ref_sq": rng.random(200),
                         "abs_delta": rng.normal(size=200), "is_tail": rng.integers(0, 2, 200)})
    out = pd.concat(bootstrap._partial_sums(["m"], 21, 5)(iter([rows[:90], rows[90:]]))).set_index(["m", "draw"])
    for m, own in rows.groupby("m"):
        weights = bootstrap.poisson_weights(own["row_key"].to_numpy(), np.arange(21), 5)
        tail = own["is_tail"].to_numpy()
        columns = np.column_stack([np.ones(len(own)), own["cand_sq"], own["ref_sq"], own["abs_delta"], tail, tail * own["cand_sq"], tail * own["ref_sq"]])
        assert np.allclose(out.loc[m][list(bootstrap.SUMS)].to_numpy(), weights.T @ columns)
