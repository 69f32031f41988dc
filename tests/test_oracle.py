"""Registered queries against DuckDB on the small tables."""

import pytest
from oracle import compare

from motifspark.registry import load_all

QUERIES, ORACLES = load_all()
# Each of these trains a model; a few stand for all of them here, the driver checks every one.
TRAINING = {n for n in ORACLES if n[0] == "m" and n not in ("m01_stratified_split", "m02_rules", "m20_additive_matrix", "m21_always_allowed")} | {
    n for n in ORACLES if n[0] == "p" and n[1].isdigit()} | {n for n in ORACLES if n.startswith(("g06", "g07", "g08", "g09", "s10", "s11", "c14", "train_"))}
CHOSEN = {"train_conditional_matrices", "m04_rank_biserial", "p06_best_accuracy", "p07_weight_search", "p13_scored_peptide_table", "g07_top_k", "c14_specificity_weight_search"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - TRAINING | CHOSEN))
def test_matches_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf) is None


def test_every_query_has_a_name_of_its_area():
    assert len(QUERIES) > 100
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns and out.limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
