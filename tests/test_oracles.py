"""Every query against its SQL on the smallest tables."""

import importlib.util
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "compare.py")
_spec = importlib.util.spec_from_file_location("compare", _path)
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare.differences(ours, con.execute(entry.oracle_sql()[name]).df()) == []


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_labels_every_linked_parcel(spark):
    got = entry.entry(spark).toPandas()
    assert len(got) > 0 and set(got.columns) == {"parcelle_id", "cluster"}
    assert got["parcelle_id"].is_unique and got["cluster"].dropna().between(0, 7).all()
