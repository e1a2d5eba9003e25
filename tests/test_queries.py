"""Every query with SQL gives DuckDB's rows over the same tables."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from datadir import DATA
from cumulo import queries as Q

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (a, b))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    rows = Q.queries()[name](spark, DATA)
    same(duck.sql(Q.oracle_sql()[name]).df(), rows.toPandas())


@pytest.mark.parametrize("missing", ["cumulo.llm", "cumulo.llm.queries", "public_tokenizers"])
def test_entry_without_the_corpus_package(missing):
    """Where it is absent, or a module that it needs is, the other queries are as they are."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'chamfer_by_shape' in q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(s) <= set(q) and len(q) > 80"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and os.path.exists(DATA)
