"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from corpusflow.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    if name in ORACLES:
        oracle(df, ORACLES[name], SF)
    else:
        df.write.format("noop").mode("overwrite").save()
