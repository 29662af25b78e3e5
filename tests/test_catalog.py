import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows_of
from conftest import SF

TABLES = "events embeddings".split()
#: The training-data queries are compared in tests/llm.
OTHERS = [name for name in entry.queries() if name != "pipeline" and not name.startswith("op")]
CHECKED = sorted(set(entry.oracle_sql()) & set(OTHERS))
#: Queries of singular vectors and values themselves, and an adaptive run per source, which NumPy tests cover.
WITHOUT_SQL = {"subspace_energy", "model_params", "adaptive_by_source"}


def test_every_comparison_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(OTHERS) - set(CHECKED) == WITHOUT_SQL


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = entry.queries()[name](spark, SF)
    answer = db.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in answer.description], answer.fetchall())
    assert rows_of(frame.columns, frame.collect()) == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and rows[0].anomaly_score >= rows[-1].anomaly_score
