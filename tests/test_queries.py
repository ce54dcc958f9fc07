from __future__ import annotations

import pytest

from tests.oracle import SF, same
from tidewell.plans import registry

#: Series of the smallest tables are too short for change points.
LARGER = "/root/testdata/sf0.01"
#: Queries over 200 or 5,000 replicates that take most of a minute each; their operators are held against plain Python in test_operators.
LONG = {"angle_null_table", "exponential_intervals", "floor_intervals", "vector_intervals"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_says_what_its_sql_says(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - LONG))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, LARGER).count() > 0


def test_nulls_permute_every_layer_and_keep_the_tokens_of_the_drift(spark):
    found = {r.pair: r for r in registry.QUERIES["angle_null"](spark, SF).collect()}
    assert len(found) == 3 and all(r.null_std > 1e-6 and r.null_mean != r.observed for r in found.values())
    drift = registry.QUERIES["lexical_drift"](spark, SF).groupBy("lang").avg("js").collect()
    observed = {r.lang: r.observed for r in registry.QUERIES["drift_baseline"](spark, SF).collect()}
    assert all(abs(observed[r[0]] - r[1]) < 1e-4 for r in drift) and len(drift) == len(observed)
