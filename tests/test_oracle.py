"""Every registered query with an oracle against DuckDB on sf0.001 (the driver's
check, at the smallest scale). Rows-only queries must run and return rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HEAVY = {"two_step", "two_step_nonstop_kmeans", "experiment_grid", "k_selection", "calibrated_svm",
         "algorithm_comparison", "pn_baselines", "prior_threshold_grid", "nnpu_auto_prior", "prob_tagging"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


SQL = E.oracle_sql()
ALL = E.queries()


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


# the queries of the llm subpackage have their own tests
OWN = {n for n in ALL if n == "pipeline" or n[:2] == "op" and n[2].isdigit()}


@pytest.mark.parametrize("name", sorted(set(SQL) - OWN))
def test_query_matches_oracle(spark, con, name):
    sdf = ALL[name](spark, SF_SMALL)
    rel = con.sql(SQL[name])
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert stypes == dtypes
    got = _rows(sdf.toPandas())
    exp = _rows(rel.df())
    assert got[0] == exp[0]
    assert got[1] == exp[1]


@pytest.mark.parametrize("name", sorted(n for n in ALL if n not in SQL and n not in HEAVY | OWN))
def test_rows_only_query_runs(spark, name):
    assert ALL[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["vec_id", "mean_dist"]
    assert df.count() > 0
