from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check_oracles import compare, connect

SMALL = "/root/testdata/sf0.001"
# Fitted several times over in the tests of models already.
LONG = {
    "train_listings", "grid_search_boosted", "grid_search_evidence", "score_listings_boosted", "fit_gbt_tuned",
    "fit_gbt_tuned_age", "leaderboard",
}


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "car_age" in df.columns


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - LONG))
def test_query_equals_its_sql(spark, db, name):
    good, line = compare(spark, db, SMALL, name)
    assert good, line


def test_boosted_scores_follow_the_age(spark):
    scored = contract.queries()["score_listings_boosted"](spark, SMALL).toPandas()
    assert scored.prediction.notna().all()
    means = scored.groupby("car_age").prediction.mean()
    assert len(means) == 7 and means.iloc[0] > means.iloc[-1]


def test_random_forest_follows_the_age(spark):
    rows = contract.queries()["fit_random_forest_age"](spark, SMALL).orderBy("car_age").collect()
    prices = [r.prediction for r in rows]
    assert len(prices) == 7 and prices[0] > prices[-1]
