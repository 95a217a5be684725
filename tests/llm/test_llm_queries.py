"""The queries of this subpackage against their SQL, on whole tables."""

import pytest

from meshwright.llm.oracle import ORACLE
from meshwright.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLE[name])
