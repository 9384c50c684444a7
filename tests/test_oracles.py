import pytest

from spanloom import catalog
from spanloom.queries import recon, studies
from tests.oracle import duck, rows_of, sql_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = rows_of(catalog.queries()[name](spark, SF))
    want = sql_rows(db, catalog.oracle_sql()[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


FIXED = recon.fixed_entries() | studies.fixed_entries()


@pytest.mark.parametrize("name", sorted(FIXED))
def test_stated_settings_equal_sql(spark, db, name):
    assert name not in catalog.queries()
    assert rows_of(FIXED[name].run(spark, SF)) == sql_rows(db, FIXED[name].sql)
