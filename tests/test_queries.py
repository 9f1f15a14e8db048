import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from corpusloom.plans import registry  # noqa: E402

TABLES = "documents pages labels benchmark conversations embeddings".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, float) else v
    return columns, sorted([tuple(plain(v) for v in r) for r in frame[columns].astype(object).values.tolist()], key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_and_sql_agree(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows_of(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(con.execute(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
