"""Every query with an SQL equivalent gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    for f in glob.glob(f"{SF}/*.parquet"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return duckdb.sql


def rows(pdf):
    text = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>", "nan") else f"{v:.9g}" if isinstance(v, float) else str(v)
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(text, r)) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sql, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
