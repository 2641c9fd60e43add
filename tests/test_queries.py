"""A spread of registered queries against their SQL statements at the smallest scale."""

import pytest
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "cln4", "cln5", "cln_all", "agg1", "agg4", "agg6", "agg9", "win2_split", "win6_split", "win8", "gra3", "gra5a", "gra7", "gra14",
    "gra2", "gra5", "gra15_checks", "gra16_checks", "snk2_table", "str2", "set3", "vie2", "clu2", "rul_e", "run_full", "run_learned", "h22", "h91", "h98", "h163", "joi12", "sca9", "eva2", "eva8", "met4", "trn3", "str1", "flagship",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    import __spark_entry__ as entry

    ok, _, _, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_statement_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
