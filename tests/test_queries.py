import pytest

import harborline.plans.catalogue  # noqa: F401
from harborline.plans import registry
from tests.oracle import check

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_oracle(spark, name):
    if name in registry.ORACLES:
        check(spark, SF, registry.QUERIES[name], registry.ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0
