"""What the driver relies on, and every array query against its SQL on the smallest tables."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from axisframe import queries

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
#: One of each family; the driver compares all of them.
COMPARED = ("revenue_by_flag", "ufunc_divide", "ufunc_int_floor_divide", "reduce_nanmax", "quantile_hazen", "histogram_edges", "lane_gradient", "scan_whole_axis", "unique_inverse", "array_pad_reflect", "einsum_gram", "linalg_inv", "create_linspace", "array_index_lists_apart", "array_place", "array_take_along_axis", "allclose", "ediff1d", "searchsorted_left")


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "axisframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                assert "llm" not in " ".join([*names, getattr(node, "module", None) or ""])


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = c.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    for c in columns:
        assert ((got[c].astype(object) == want[c].astype(object)) | (got[c].isna() & want[c].isna())).all(), c
