import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators.quantiles import exact_quantiles, order_statistics, smallest_cut

PROBS = [0.0, 0.5, 0.92, 0.995, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    hot = F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.randn(5))
    return (spark.range(0, 6000, 1, 6).withColumns({
        "x": F.exp(F.randn(1) * 3), "hot": hot, "const": F.lit(2.0),
        "gaps": F.when(F.col("id") % 5 < 2, F.rand(2)), "none": F.lit(None).cast("double"),
        "g": F.when(F.col("id") % 10 == 0, None).otherwise(F.when(F.col("id") % 3 > 0, "big").otherwise("small")),
    }).persist())


@pytest.mark.parametrize("by", [None, "g"])
def test_search_equals_numpy(table, by):
    names = ["x", "hot", "const", "gaps", "none"]
    got = exact_quantiles(table, {n: (F.col(n), PROBS) for n in names}, by, rows=10 ** 9, small=60)
    frame = table.toPandas()
    groups = {None: frame} if by is None else {
        g: frame[frame.g == g] if g else frame[frame.g.isna()] for g in ("big", "small", None)}
    assert set(got) == set(groups)
    for g, part in groups.items():
        for n in names:
            values = part[n].dropna().astype(float)
            if len(values):
                np.testing.assert_allclose(got[g][n], np.quantile(values, PROBS), rtol=1e-12)
            else:
                assert got[g][n] == [None] * len(PROBS)


def test_small_path_equals_search(table):
    targets = {"x": (F.col("x"), PROBS), "hot": (F.col("hot"), PROBS)}
    plain, searched = (exact_quantiles(table, targets, "g", rows=r, small=100) for r in (1, 10 ** 9))
    for g in plain:
        for n in targets:
            np.testing.assert_allclose(plain[g][n], searched[g][n], rtol=1e-12)


def test_order_statistics_hit_every_rank(table):
    values = sorted(r[0] for r in table.select("x").collect())
    for rank in (0, 1, 17, 2999, 5998, 5999):
        found = order_statistics(table, {"x": F.col("x")}, {None: {"x": [rank]}}, {None: {"x": 6000}}, small=50)
        assert found[None]["x"][rank] == values[rank]


def test_smallest_cut_counts_exactly(table):
    totals = {r["g"]: r["n"] for r in table.groupBy("g").agg(F.count("*").alias("n")).collect()}
    cuts = smallest_cut(table, F.col("x"), {g: n // 4 for g, n in totals.items()}, totals, "g", small=50)
    for g, cut in cuts.items():
        part = table.filter(F.col("g").eqNullSafe(F.lit(g)))
        assert part.filter(F.col("x") <= cut).count() == totals[g] // 4
