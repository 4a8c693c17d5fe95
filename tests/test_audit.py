"""Every audit rule on a literal row, with the evidence it leaves."""

import numpy as np
import pytest

from terrace.operators import audit, skew, textvec

SCHEMA = (
    "row_seq long, listing_id long, price double, property_size_sqft double, property_type string, bedroom double, bathroom double, "
    "parking_lot double, completion_year double, number_of_floors double, total_units double, description string"
)
PLAIN = (300000.0, 900.0, "House", 3.0, 2.0, 1.0, 2001.0, 10.0, 100.0, "a home")


def row(seq, listing=None, **changes):
    names = [part.split()[0] for part in SCHEMA.split(", ")][2:]
    # Prices differ, so rows are no repeats of one another unless told so.
    values = dict(zip(names, PLAIN, strict=True)) | {"price": 300000.0 + seq} | changes
    return (seq, seq if listing is None else listing, *[values[n] for n in names])


CASES = {
    "CRITICAL_INVALID_PRICE": (row(1, price=-5.0), ("price", -5.0, 0.0, None, None)),
    "CRITICAL_INVALID_PROPERTY_SIZE": (row(2, property_size_sqft=None), ("property_size_sqft", None, 0.0, None, None)),
    "IMPOSSIBLE_CORE_COUNT": (row(3, bathroom=2.5), ("bathroom", 2.5, 0.0, 20.0, None)),
    "OUTSIDE_BROAD_SIZE_DOMAIN": (row(4, property_size_sqft=30000.0), ("property_size_sqft", 30000.0, 100.0, 20000.0, None)),
    "MULTI_UNIT_BUNDLE_NOT_SINGLE_OBSERVATION": (
        row(5, description="Selling 2 units: 800 sqft at RM 400k, 900 sqft at RM 500k"), ("description", 2.0, None, 1.0, "selling 2 units")),
    "BEDROOM_COUNT_DESCRIPTION_CONTRADICTION": (row(6, bedroom=8.0, description="A 3-Bedroom home"), ("bedroom", 8.0, None, 7.0, "3-bedroom")),
    "BATHROOM_COUNT_CONFIGURATION_CONTRADICTION": (
        row(7, bedroom=2.0, bathroom=6.0, property_size_sqft=500.0, description="with 2 baths"), ("bathroom", 6.0, None, 5.0, "2 baths")),
    "ISOLATED_FLOOR_COUNT_NEEDS_REVIEW": (row(8, number_of_floors=90.0), ("number_of_floors", 90.0, None, 79.0, None)),
    "STRATA_TOTAL_UNITS_NEEDS_REVIEW": (row(9, property_type="Flat", total_units=3.0), ("total_units", 3.0, 4.0, 4999.0, None)),
    "UNSUPPORTED_HIGH_PARKING_COUNT": (row(10, parking_lot=5.0, description="4 car parks"), ("parking_lot", 5.0, None, 4.0, None)),
    "SINGLE_DESCRIPTION_SIZE_MISMATCH": (row(11, description="built up 990.5 sqft"), ("property_size_sqft", 900.0, 990.5 / 1.1, 990.5 / 0.9, None)),
    "OPTIONAL_COMPLETION_YEAR_NEEDS_REVIEW": (row(12, completion_year=1999.5), ("completion_year", 1999.5, 1900.0, 2030.0, None)),
    "OPTIONAL_FLOOR_OR_UNIT_DOMAIN_NEEDS_REVIEW": (row(13, total_units=0.0), ("total_units", 0.0, 1.0, 20000.0, None)),
}


@pytest.fixture(scope="module")
def audited(spark):
    repeats = [
        row(20, price=1e6), row(21, 20, price=1e6), row(22, price=1e6, description="A HOME"), row(23, price=1e6, description="another"),
        row(24, price=2e6, description=None), row(25, price=2e6, description=""),
    ]
    rows = [case[0] for case in CASES.values()] + repeats + [row(30)]
    return {r.row_seq: r for r in audit.validity_audit(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("rule", CASES)
def test_each_rule_fires_alone_and_tells_why(audited, rule):
    case, wanted = CASES[rule]
    found = audited[case[0]]
    assert found.rules_fired == [rule] and len(found.evidence) == 1
    entry = found.evidence[0]
    assert (entry.rule, entry.field, entry.value, entry.high, entry.span) == (rule, wanted[0], wanted[1], wanted[3], wanted[4])
    assert entry.low == (pytest.approx(wanted[2]) if wanted[2] is not None else None)
    assert found.validity_status == ("CLEARLY_INVALID" if rule in audit.INVALID_RULES else "SUSPICIOUS")


def test_repeats_have_a_group_and_a_text_mark(audited):
    assert [audited[i].repeat_group for i in range(20, 26)] == [20, 20, 20, 20, 24, 24]
    assert [audited[i].same_text for i in range(20, 26)] == [True, True, True, False, True, True]
    copy = audited[21]
    assert copy.rules_fired == ["EXACT_DUPLICATE_CANONICAL_ROW", "POSSIBLE_REPEAT_DIFFERENT_LISTING_ID"]
    assert [(e.field, e.value, e.high) for e in copy.evidence] == [("row_seq", 21.0, 20.0), ("listing_id", 4.0, 1.0)]
    assert "EXACT_DUPLICATE_CANONICAL_ROW" not in audited[22].rules_fired


def test_valid_rows_have_no_evidence(audited):
    calm = audited[30]
    assert (calm.validity_status, calm.evidence, calm.repeat_group, calm.same_text) == ("VALID", [], None, False)


def test_term_counts_by_hand(spark):
    """Repeats within a text count once as a document and in full as a total; empty and null texts count as documents."""
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, None), (4, "")], "i long, t string")
    found = {r.term: (r.df, r.total_count) for r in textvec.term_stats(docs, "t", min_df=1).collect()}
    assert found == {"red": (1, 2), "blue": (2, 2), "red red": (1, 1), "red blue": (1, 1)}
    weights = textvec.tfidf_rows(docs, "i", "t", textvec.term_stats(docs, "t", min_df=1))
    norms = {}
    for r in weights.collect():
        norms[r.i] = norms.get(r.i, 0.0) + r.weight**2
    assert norms == {1: pytest.approx(1.0), 2: pytest.approx(1.0)}
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_exploding_a_list_leaves_the_rules_to_one_place(spark):
    rows = [case[0] for case in CASES.values()] + [row(30)]
    listed = audit.validity_audit(spark.createDataFrame(rows, SCHEMA))
    entries = audit.exploded(listed.select("row_seq", "rules_fired"), "rules_fired", "rule")
    filters = [line for line in entries._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in line]
    # A filter in front of the generator would hold the rules' expressions once more.
    assert filters and not any("RLIKE" in line or "size(" in line for line in filters)
    assert sorted((r.row_seq, r.rule) for r in entries.collect()) == sorted((case[0][0], rule) for rule, case in CASES.items())


def test_svd_equals_the_dense_decomposition(spark):
    """Repeated ids and texts without terms count as rows; the parts of the variance come from the whole spectrum."""
    words = [f"w{i}x" for i in range(12)]
    docs = [(i, " ".join(words[(i * k + i // 3) % 12] for k in range(1, 6))) for i in range(40)] + [(7, "w1x w2x"), (90, ""), (None, "w3x w4x")]
    df = spark.createDataFrame(docs, "i long, t string")
    vocabulary = textvec.term_stats(df, "t", min_df=2)
    size = vocabulary.count()
    weights = textvec.tfidf_rows(df, "i", "t", vocabulary).collect()
    ids = sorted({r.i for r in weights}, key=lambda v: (v is None, v))
    dense = np.zeros((len(ids), size))
    for r in weights:
        dense[ids.index(r.i), r.term_index] = r.weight
    right = np.linalg.svd(dense, full_matrices=False)[2][:3]
    full = np.array([dense[ids.index(i)] if i is not None and i in ids else np.zeros(size) for i, _ in docs])
    expected = np.abs(full @ right.T)
    scores, ratio = textvec.text_svd(df, df, "i", "t", 3, min_df=2)
    found = sorted(np.abs([r.svd_01, r.svd_02, r.svd_03]).round(8).tolist() for r in scores.collect())
    assert np.allclose(found, sorted(expected.round(8).tolist()), atol=1e-7)
    shares = (full @ right.T).var(axis=0) / full.var(axis=0).sum()
    assert [r.explained_ratio for r in ratio.orderBy("component").collect()] == [pytest.approx(v) for v in shares]


def test_texts_are_cut_once(spark):
    """No inferred filter cuts the texts a second time, and the words are a column of their own."""
    docs = spark.createDataFrame([(1, "red red blue")], "i long, t string")
    vocabulary = textvec.term_stats(docs, "t", min_df=1)
    for df in (vocabulary, textvec.tfidf_rows(docs, "i", "t", spark.createDataFrame(vocabulary.collect(), vocabulary.schema))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_rows_are_written_with_one_digest(spark):
    """Digests of copies and texts are made of what is there, for repeated rows only."""
    rows = spark.createDataFrame([row(1), row(2)], SCHEMA)
    written = audit.digested(rows, "listing_id", "row_seq")
    assert written.columns == [*rows.columns, "_repeat_k"]
    assert all(name.endswith(".zstd.parquet") for name in written.inputFiles())


def test_marks_are_equal_where_rows_move(spark, monkeypatch):
    """Copies, equal texts and first rows by the shuffled join, with rows alone among them."""
    same = {"price": 1e6}
    listed = [row(1, **same), row(2, 1, **same), row(3, description="A HOME", **same), row(4, description="other", **same), *[row(i) for i in range(10, 40)]]
    wanted = {1: (4, 1, 2, 1, 3, 1), 2: (4, 1, 2, 1, 3, 1), 3: (4, 1, None, None, 3, 1), 4: (4, 1, None, None, None, None)}
    for limit in (0, 10**9):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
        marks = audit.duplicate_marks(audit.digested(spark.createDataFrame(listed, SCHEMA), "listing_id", "row_seq"), "listing_id", "row_seq")
        names = ("_repeat_size", "_repeat_first", "_exact_size", "_exact_first", "_same_size", "_same_first")
        found = {r.row_seq: tuple(r[n] for n in names) for r in marks.collect()}
        assert len(found) == 34 and all(found[i] == wanted.get(i, (None,) * 6) for i in found)
