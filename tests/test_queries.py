import pytest

from tests.compare import connect, difference
from tidewheel.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Queries without SQL, and the tests that judge their rows.
JUDGED = {"rf_score", "gbt_score", "mlp_score", "global_scoring", "fuzzy_match", "boosted_score", "deep_forest_score", "mlp_batches_score", "tuned_forest_score"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], con) is None


def test_queries_without_sql_are_judged_elsewhere():
    """In test_scores, test_trees and test_training."""
    assert set(QUERIES) - set(ORACLES) == JUDGED
