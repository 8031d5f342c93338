"""Every query of the library against its SQL on the smallest tables; those without SQL must run twice to the same rows."""

import pytest

from tests.conftest import SF, duck, rows
from tremolo.plans import driver


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query(spark, name):
    got = driver.QUERIES[name](spark, SF).toPandas()
    want = duck(driver.ORACLES[name]) if name in driver.ORACLES else driver.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
