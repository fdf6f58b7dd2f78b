"""Every registered query against its SQL on the same Parquet tables."""

import pytest

import __spark_entry__ as entry_points
import registered
from tests.harness import compare

registered.load()
QUERIES, ORACLES = registered.QUERIES, registered.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        said = compare(df, ORACLES[name], con)
        if said and said.startswith("the oracle has no rows"):
            assert df.isEmpty()
        else:
            assert said is None, said
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {r["o_orderstatus"] for r in rows} == {"F", "O", "P"}


def test_every_oracle_has_a_query():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(ORACLES) == set(QUERIES)


def test_a_sketch_profiles_every_column_of_the_largest_table(spark, sf):
    rows = QUERIES["column_profile_sketch_lines"](spark, sf).collect()
    assert sorted(r["column_name"] for r in rows) == sorted(spark.read.parquet(f"{sf}/lineitem.parquet").columns)
    assert all(r["within_error"] for r in rows)


def test_the_rest_is_there_without_the_text_part(monkeypatch):
    import sys

    whole = set(entry_points.queries())
    for name in [m for m in sys.modules if m.split(".")[0] == "corpus_pipeline" or m.startswith("tidelake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry_points.queries()) == set(QUERIES) <= whole
    assert set(entry_points.oracle_sql()) == set(ORACLES)
