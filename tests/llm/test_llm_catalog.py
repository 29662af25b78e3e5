import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import TABLES, rows_of  # noqa: E402

from flowlake.llm import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = catalog.queries()[name](spark, SF)
    answer = db.execute(catalog.oracle_sql()[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of([d[0] for d in answer.description], answer.fetchall())
