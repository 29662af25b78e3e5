"""Exact order statistics and quantiles over data of any size.

``percentile`` keeps every distinct value of a group in one task, which is
fine for small tables only. Above ``SMALL_ROWS`` the functions here narrow a
bracket around the wanted ranks instead: a mergeable KLL sketch proposes the
bracket, the next scan counts exactly how many values lie below, on and inside
it, and only a bracket known to be small is gathered and sorted. The answer is
the exact order statistic: the sketch decides how fast, never what. Every scan
handles all columns and all groups at once and combines map-side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .params import GroupParams

SMALL_ROWS = 250_000
_SKETCH_SIZE = 1024
_SKETCH_ERROR = 0.005
_GRID = 512
_MERGE_FANOUT = 64
_MAX_SCANS = 40  # each scan narrows about a hundredfold, so a handful is normal

Groups = dict[object, dict[str, list[float | None]]]


@dataclass
class _Search:
    """One column of one group: neighbouring ranks still wanted and where they are."""

    ranks: list[int]
    inside: int                      # values strictly between low and high
    below: int = 0                   # values at or below low
    low: float = -math.inf
    high: float = math.inf
    margin: float = _SKETCH_ERROR
    grid: list[float] | None = None
    trial: tuple[float, float] = (-math.inf, math.inf)
    gather: bool = False
    found: dict[int, float] = field(default_factory=dict)

    @property
    def open_ranks(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]

    def propose(self, small: int) -> None:
        """Choose the bracket to count next and whether to gather its content."""
        ranks = self.open_ranks
        if self.grid is None:
            self.trial, self.gather = (self.low, self.high), True
            return
        first = (ranks[0] - self.below) / self.inside - self.margin
        last = (ranks[-1] + 1 - self.below) / self.inside + self.margin
        i = max(0, math.floor(first * _GRID))
        j = min(_GRID, math.ceil(last * _GRID))
        self.trial = (self.grid[i], self.grid[j])
        expected = self.inside * ((j - i) / _GRID + 2 * self.margin)
        self.gather = expected <= small

    def learn(self, lt_low: int, le_low: int, lt_high: int, le_high: int,
              values: dict[int, float], next_grid: list[float] | None) -> None:
        low, high = self.trial
        hit = [r for r in self.open_ranks if lt_low <= r < le_high]
        if len(hit) < len(self.open_ranks):     # sketch was off: look wider
            self.margin *= 4
            return
        for rank in hit:
            if rank < le_low:
                self.found[rank] = low
            elif rank >= lt_high:
                self.found[rank] = high
            elif self.gather:
                self.found[rank] = values[rank]
        self.low, self.high = low, high
        self.below, self.inside = le_low, lt_high - le_low
        self.grid, self.margin = next_grid, _SKETCH_ERROR


def _keys(by: str | None) -> list[str]:
    return [] if by is None else [by]


def _scan(df: DataFrame, by: str | None, counts: dict[str, str], sketches: dict[str, str],
          gathers: dict[str, str]) -> DataFrame:
    """Counts, sketches and gathered values of SQL expressions, in one scan.

    Tasks are merged in two levels, so that no reducer receives the partial
    sketches of all tasks of a large table at once.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % _MERGE_FANOUT)
    size = F.lit(_SKETCH_SIZE)
    partial = salted.groupBy(*_keys(by), "_salt").agg(
        F.count("*").alias("_rows"),
        *[F.expr(f"count_if({e})").alias(n) for n, e in counts.items()],
        *[F.kll_sketch_agg_double(F.expr(e), size).alias(n) for n, e in sketches.items()],
        *[F.expr(f"collect_list({e})").alias(n) for n, e in gathers.items()])
    return partial.groupBy(*_keys(by)).agg(
        F.sum("_rows").alias("_rows"),
        *[F.sum(f"`{n}`").alias(n) for n in counts],
        *[F.kll_merge_agg_double(f"`{n}`").alias(n) for n in sketches],
        *[F.flatten(F.collect_list(f"`{n}`")).alias(n) for n in gathers])


def _grid(sketch: str) -> Column:
    """Number of values in a sketch and their quantile grid."""
    n = F.kll_sketch_get_n_double(f"`{sketch}`")
    steps = F.lit([i / _GRID for i in range(_GRID + 1)])
    return F.struct(n.alias("n"), F.when(n > 0, F.kll_sketch_get_quantile_double(
        f"`{sketch}`", steps)).alias("grid")).alias(sketch)


def _first_grids(data: DataFrame, names: list[str], by: str | None) -> dict:
    """Per group and column: number of values and their quantile grid."""
    merged = _scan(data, by, {}, {f"s_{n}": f"`{n}`" for n in names}, {})
    rows = merged.select(*_keys(by), *[_grid(f"s_{n}") for n in names]).collect()
    return {row[by] if by else None:
            {n: (row[f"s_{n}"]["n"] or 0, row[f"s_{n}"]["grid"]) for n in names} for row in rows}


def order_statistics(df: DataFrame, columns: dict[str, Column],
                     ranks: dict[object, dict[str, list[int]]],
                     totals: dict[object, dict[str, int]],
                     by: str | None = None, small: int = SMALL_ROWS,
                     grids: dict | None = None) -> dict:
    """Exact values at the given 0-based ranks, per group and column.

    The ranks of one column must be neighbours. ``totals`` holds the number
    of non-null values, ``grids`` quantile grids if already known. Returns
    ``{group: {column: {rank: value}}}``.
    """
    names = list(columns)
    searches = {g: {n: _Search(sorted(set(r)), totals[g][n]) for n, r in by_name.items() if r}
                for g, by_name in ranks.items()}
    data = df.select(*_keys(by), *[c.cast("double").alias(n) for n, c in columns.items()])

    def open_searches():
        return [(g, n, s) for g, group in searches.items() for n, s in group.items() if s.open_ranks]

    if grids is None and any(s.inside > small for _, _, s in open_searches()):
        grids = _first_grids(data, names, by)
    for g, n, s in open_searches():
        s.grid = (grids or {}).get(g, {}).get(n, (0, None))[1]

    for _ in range(_MAX_SCANS):
        todo = open_searches()
        if not todo:
            break
        for _, _, s in todo:
            s.propose(small)
        params = GroupParams(by, {})
        for g, n, s in todo:
            wanted = {f"lo_{n}": s.trial[0], f"hi_{n}": s.trial[1],
                      f"gather_{n}": 1.0 if s.gather else 0.0}
            params.rows.setdefault(g, {}).update(wanted)
        joined, get = params.attach(data)
        active = {n for _, n, _ in todo}
        narrowed = sorted({n for _, n, s in todo if not s.gather})
        gathered = sorted({n for _, n, s in todo if s.gather})

        def inside(n: str, gather: int) -> str:
            return (f"CASE WHEN `{n}` > {get(f'lo_{n}')} AND `{n}` < {get(f'hi_{n}')} "
                    f"AND {get(f'gather_{n}')} = {gather} THEN `{n}` END")

        counts = {f"{x}_{n}": f"`{n}` {sign} {get(f'{side}_{n}')}" for n in names if n in active
                  for x, sign, side in (("a", "<", "lo"), ("b", "<=", "lo"), ("c", "<", "hi"), ("d", "<=", "hi"))}
        found = _scan(joined, by, counts, {f"s_{n}": inside(n, 0) for n in narrowed},
                      {f"v_{n}": inside(n, 1) for n in gathered})
        # Pick the wanted ranks out of the gathered values before they leave Spark.
        picks = GroupParams(by, {})
        wanted_ranks = sorted({i for _, _, s in todo for i in range(len(s.open_ranks))})
        for g, n, s in todo:
            picks.rows.setdefault(g, {}).update(
                {f"r{i}_{n}": float(r) for i, r in enumerate(s.open_ranks)})
        picked, rank_of = picks.attach(found)
        out = [F.col(f"`{c}`") for c in counts] + [_grid(f"s_{n}") for n in narrowed]
        for n in gathered:
            for i in wanted_ranks:
                index = f"CAST({rank_of(f'r{i}_{n}')} - `b_{n}` AS INT)"
                out.append(F.expr(f"CASE WHEN {index} BETWEEN 0 AND size(`v_{n}`) - 1 "
                                  f"THEN get(sort_array(`v_{n}`), {index}) END").alias(f"x{i}_{n}"))
        rows = {row[by] if by else None: row.asDict() for row in picked.select(*_keys(by), *out).collect()}
        for g, n, s in todo:
            row = rows[g]
            values = {r: row.get(f"x{i}_{n}") for i, r in enumerate(s.open_ranks)}
            sketch = None if s.gather else row[f"s_{n}"]
            s.learn(row[f"a_{n}"], row[f"b_{n}"], row[f"c_{n}"], row[f"d_{n}"], values,
                    sketch["grid"] if sketch else None)
    else:
        raise RuntimeError("rank search did not settle")
    return {g: {n: s.found for n, s in group.items()} for g, group in searches.items()}


def exact_quantiles(df: DataFrame, targets: dict[str, tuple[Column, list[float]]],
                    by: str | None = None, rows: int | None = None,
                    small: int = SMALL_ROWS) -> Groups:
    """Linearly interpolated quantiles per group: ``{group: {column: [values]}}``.

    ``rows`` is an upper bound of the table size; it is counted when absent.
    """
    if rows is None:
        rows = df.count()
    if rows <= small:
        exact = df.groupBy(*_keys(by)).agg(
            *[F.percentile(c, F.lit(list(probs))).alias(n) for n, (c, probs) in targets.items()])
        return {row[by] if by else None:
                {n: list(row[n]) if row[n] is not None else [None] * len(probs)
                 for n, (_, probs) in targets.items()} for row in exact.collect()}

    columns = {n: c for n, (c, _) in targets.items()}
    data = df.select(*_keys(by), *[c.cast("double").alias(n) for n, c in columns.items()])
    first = _first_grids(data, list(columns), by)
    sizes = {g: {n: grid[0] for n, grid in by_column.items()} for g, by_column in first.items()}
    # One search per column and probability: its ranks are neighbours.
    parts = {f"{n}@{i}": (n, p) for n, (_, probs) in targets.items() for i, p in enumerate(probs)}
    ranks, totals = {}, {}
    for g, by_column in sizes.items():
        totals[g] = {part: by_column[n] for part, (n, _) in parts.items()}
        ranks[g] = {}
        for part, (n, p) in parts.items():
            spot = (by_column[n] - 1) * p
            ranks[g][part] = [math.floor(spot), math.ceil(spot)] if by_column[n] else []
    grids = {g: {part: by_column[n] for part, (n, _) in parts.items()} for g, by_column in first.items()}
    found = order_statistics(data, {part: F.col(n) for part, (n, _) in parts.items()},
                             ranks, totals, by, small, grids)

    result: Groups = {g: {n: [] for n in targets} for g in sizes}
    for g, by_column in sizes.items():
        for part, (n, p) in parts.items():
            if not by_column[n]:
                result[g][n].append(None)
                continue
            spot = (by_column[n] - 1) * p
            a, b = found[g][part][math.floor(spot)], found[g][part][math.ceil(spot)]
            result[g][n].append(a if a == b else a + (b - a) * (spot - math.floor(spot)))
    return result


def smallest_cut(df: DataFrame, column: Column, wanted: dict[object, int],
                 totals: dict[object, int], by: str | None = None,
                 small: int = SMALL_ROWS) -> dict[object, float]:
    """Per group the ``wanted``-th smallest value, the cut of a distributed top-k filter."""
    ranks = {g: {"v": [min(k, totals[g]) - 1]} for g, k in wanted.items() if k > 0 and totals[g] > 0}
    if not ranks:
        return {}
    found = order_statistics(df, {"v": column}, ranks, {g: {"v": totals[g]} for g in ranks}, by, small)
    return {g: next(iter(values["v"].values())) for g, values in found.items()}
