"""Every core query with SQL gives the rows of the SQL; the others run and have a stable schema."""

import importlib

import pytest

from compare import same
from conftest import SF

CORE = [importlib.import_module(f"docloom.plans.{m}") for m in ("corpus", "q_text", "q_tables", "q_models")]
QUERIES = {n: f for m in CORE for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in CORE for n, s in m.ORACLES.items()}
#: Queries that may have no rows in the smallest tables.
EMPTY = ("rel13_same_name",)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    same(spark, duck, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns)) and (rows or name in EMPTY)
