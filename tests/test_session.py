from pathlib import Path

from flowlake.session import cut_lineage, temporary_tables


def folder(df):
    return Path(df.inputFiles()[0].split(":", 1)[1].replace("//", "/")).parent


def test_temporary_tables_go_and_those_that_outlive_them_stay(spark):
    before = folder(cut_lineage(spark.range(3), "before"))
    with temporary_tables(spark):
        outer = folder(cut_lineage(spark.range(3), "outer"))
        with temporary_tables(spark):
            inner = folder(cut_lineage(spark.range(3), "inner"))
            kept = cut_lineage(spark.range(3), "kept", outlives=True)
            lasting = folder(kept)
        assert outer.exists() and not inner.exists() and kept.count() == 3
        result = cut_lineage(kept, "result", outlives=True)
    assert not outer.exists() and not lasting.exists() and before.exists() and result.count() == 3


def test_tables_go_after_an_error(spark):
    try:
        with temporary_tables(spark):
            path = folder(cut_lineage(spark.range(1), "table"))
            raise ValueError
    except ValueError:
        assert not path.exists()
