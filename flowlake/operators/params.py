"""Small per-group parameter tables and how rows get at them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameter tables up to this size are broadcast; larger ones are left to the
# optimizer, which picks a shuffle join and splits skewed keys.
BROADCAST_BYTES = 128 << 20
# Tables up to this many rows are handed over by the driver instead of being written.
LOCAL_ROWS = 10_000


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in a hash table: eight a number, eighty a text, and its slot."""
    return 32 + sum(80 if kind == "string" else 8 if "<" not in kind else 1024 for _, kind in df.dtypes)


def small_or_written(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``df`` as a local table if it is short, else written out.

    Returns the table and whether its counted size allows a broadcast. At most
    ``LOCAL_ROWS + 1`` rows ever reach the driver as rows.
    """
    from ..session import cut_lineage

    head = df.limit(LOCAL_ROWS + 1).collect()
    if len(head) <= LOCAL_ROWS:
        return df.sparkSession.createDataFrame(head, df.schema), True
    written = cut_lineage(df, name)
    return written, written.count() * row_bytes(df) <= BROADCAST_BYTES


def sql_number(value: float | None) -> str:
    """A double as SQL text that parses back to the same bits."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if math.isinf(value) or math.isnan(value):
        return f"CAST('{value}' AS DOUBLE)"
    return f"{float(value)!r}D"


class GroupParams:
    """Scalars per group: literals without a group column, a join with one.

    The accessor returns SQL text, because the score formulas are long sums
    that are far cheaper to parse once than to assemble call by call.
    """

    def __init__(self, by: str | None, rows: dict[object, dict[str, float]]):
        self.by = by
        self.rows = rows

    def attach(self, df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
        """``df`` with the parameters at hand, and an accessor for each of them."""
        if self.by is None:
            values = self.rows.get(None, {})
            return df, lambda name: sql_number(values.get(name))
        names = sorted({n for values in self.rows.values() for n in values})
        data = [(key, *[values.get(n) for n in names]) for key, values in self.rows.items()]
        key_type = df.schema[self.by].dataType.simpleString()
        schema = ", ".join([f"_group {key_type}"] + [f"`_p_{n}` double" for n in names])
        table = df.sparkSession.createDataFrame(data, schema)
        if len(data) * row_bytes(table) <= BROADCAST_BYTES:
            table = F.broadcast(table)
        joined = df.join(table, df[self.by].eqNullSafe(table["_group"]), "left").drop("_group")
        known = set(names)
        return joined, lambda name: f"`_p_{name}`" if name in known else sql_number(None)

    @staticmethod
    def detach(df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.startswith("_p_")])
