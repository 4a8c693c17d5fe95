"""Structure of the registered catalogue, and a few queries against their oracle."""

import os

import duckdb
import pytest

from terrace.plans.catalog import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["parse_places", "dedup_exact", "eda_state_type_median", "fold_retained_cv", "encode_target_oof", "eval_tail_segments", "components_compose"]


def test_names_line_up():
    assert set(all_oracles()) <= set(all_queries())
    assert len(all_oracles()) > 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    df = all_queries()[name](spark, FOLDER)
    result = con.sql(all_oracles()[name])
    assert sorted(df.columns) == sorted(result.columns)
    mine = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    at = [result.columns.index(c) for c in sorted(df.columns)]
    assert mine == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", ["eval_adjusted_r2", "eval_adoption_rule_sets"])
def test_predictor_counts_keep_to_their_query(spark, name):
    """Each of the two queries has its own predictor counts; neither replaces the other's."""
    test_query_matches_oracle(spark, name)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", ["rule_input", "gate_input"])
def test_models_are_compared_with_sums_made_once(spark, name):
    """Sums made twice may round differently, and the baseline would lose or win against itself."""
    from terrace.plans import evaluation_queries

    compared = getattr(evaluation_queries, name)(spark, FOLDER)
    assert not [f for f in compared.inputFiles() if "lineitem" in f]
