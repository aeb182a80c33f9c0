"""Every query of the subpackage that has SQL gives the SQL's rows."""

import pytest

from embertrail.llm import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_rows):
    assert same_rows(queries.queries()[name], ORACLES[name]) > 0


def test_names_cover_the_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
