"""Harmonise raw flow tables to the canonical schema.

Every step is a plan rewrite. The only data-dependent choice, the units of the
time columns, is made once per table by :func:`detect_units` from counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import (clip, median_is_above, median_side, number_or_zero, parse_number)
from ..functions.ports import port_of_service
from ..functions.text import (canonical_protocol, failed_state, infer_direction, normal_label,
                              parse_timestamp, slash_timestamp)
from ..schema import (CATEGORICAL_DEFAULTS, COLUMN_ALIASES, NUMERIC_COLUMNS, VOLUME_PAIRS)
from .params import small_or_written
from .positions import with_position

_GAP_COLUMNS = ["sinpkt", "dinpkt"]
_JITTER_COLUMNS = ["sjit", "djit"]
_FLAG_COUNTS = {
    "tcp_syn_ratio": "syn_flag_count",
    "tcp_ack_ratio": "ack_flag_count",
    "tcp_fin_ratio": "fin_flag_count",
}


def column_key(name: str) -> str:
    """Spelling-independent form of a column name."""
    return re.sub(r"[\W_]+", "", name.lower())


def _by_key(df: DataFrame) -> dict[str, str]:
    return {column_key(c): c for c in df.columns}


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _number(df: DataFrame, name: str, or_zero: bool = True) -> Column:
    is_text = dict(df.dtypes)[name] == "string"
    return (number_or_zero if or_zero else parse_number)(_quoted(name), is_text)


def standardize_columns(df: DataFrame, volume: str = "first") -> DataFrame:
    """Rename aliased columns to their canonical names.

    ``volume="first"`` takes the first counter spelling found as the volume.
    ``volume="sum"`` leaves forward/backward counters for :func:`add_volumes`.
    """
    present = _by_key(df)
    directional = {column_key(n) for pairs in VOLUME_PAIRS.values() for pair in pairs for n in pair}
    renames: dict[str, str] = {}
    for canonical, spellings in COLUMN_ALIASES.items():
        if canonical in df.columns:
            continue
        keys = [column_key(s) for s in spellings]
        if volume == "sum" and canonical in VOLUME_PAIRS:
            keys = [k for k in keys if k not in directional]
        found = next((present[k] for k in keys if k in present), None)
        if found is not None:
            renames[found] = canonical
    return df.select(*[_quoted(c).alias(renames.get(c, c)) for c in df.columns])


def add_volumes(df: DataFrame) -> DataFrame:
    """Packets and bytes as the sum of both directions, where still missing."""
    present = _by_key(df)
    for target, pairs in VOLUME_PAIRS.items():
        if target in df.columns:
            continue
        for pair in pairs:
            names = [present[column_key(n)] for n in pair if column_key(n) in present]
            if names:
                total = _number(df, names[0])
                for other in names[1:]:
                    total = total + _number(df, other)
                df = df.withColumn(target, total)
                break
    return df


@dataclass(frozen=True)
class UnitPlan:
    """Factors that bring the time columns of one table to seconds and milliseconds.

    A factor of 0 marks a gap or jitter column without any positive value.
    """

    factors: dict[str, float] = field(default_factory=dict)

    def apply(self, name: str, value: Column) -> Column:
        factor = self.factors.get(name, 1.0)
        if factor == 1.0:
            return value
        if factor == 0.0:
            return F.lit(0.0)
        return value * factor if factor > 1 else value / round(1 / factor)


class FileUnits:
    """Factors that differ from file to file, in columns that :func:`file_facts` names."""

    def __init__(self, names: list[str]):
        self.names = names

    def apply(self, name: str, value: Column) -> Column:
        if _unit(name) not in self.names:
            return value
        factor = F.col(_unit(name))
        return (F.when(factor == 0, 0.0).when(factor > 1, value * factor).when(factor < 1, value / F.round(1 / factor))
                .otherwise(value))


def _unit(name: str) -> str:
    return f"_unit_{name}"


def unit_factors(df: DataFrame) -> dict[str, Column]:
    """Aggregates that give the factor of every time column there is, by counting."""
    found: dict[str, Column] = {}
    for name, factor in (("duration_sec", 1e-6), ("inter_arrival_mean_ms", 1e-3), ("inter_arrival_std_ms", 1e-3)):
        if name in df.columns:
            above = median_is_above(median_side(F.abs(_number(df, name)), 1000.0), 1000.0)
            found[name] = F.when(above, factor).otherwise(1.0)
    for name in _GAP_COLUMNS + _JITTER_COLUMNS:
        if name in df.columns:
            value = _number(df, name)
            side = median_side(F.when(value > 0, value), 10.0, True)
            found[name] = F.when(side["n"] == 0, 0.0).when(median_is_above(side, 10.0, True), 1.0).otherwise(1000.0)
    return found


def detect_units(df: DataFrame) -> UnitPlan:
    """Decide the time units of a standardized table in one counting pass."""
    factors = unit_factors(df)
    if not factors:
        return UnitPlan()
    found = df.agg(*[c.alias(name) for name, c in factors.items()]).first().asDict()
    return UnitPlan({name: factor for name, factor in found.items() if factor != 1.0 or name in _GAP_COLUMNS + _JITTER_COLUMNS})


def file_facts(df: DataFrame, source: str, also: list[Column] | None = None) -> DataFrame:
    """All that is decided file by file, in one pass over a standardized table: units and the reading of dates."""
    facts = [c.cast("double").alias(_unit(name)) for name, c in unit_factors(df).items()]
    if dict(df.dtypes).get("timestamp") == "string":
        facts.append(_day_first().alias("_day_first"))
    return df.groupBy(source).agg(*(also or []), *(facts or [F.count(F.lit(1)).alias("_rows")]))


def scale_times(df: DataFrame, units: UnitPlan | FileUnits) -> DataFrame:
    """Duration in seconds, inter-arrival mean and deviation in milliseconds."""
    def scaled(name: str) -> Column:
        return units.apply(name, _number(df, name)) if name in df.columns else F.lit(0.0)

    def averaged(names: list[str], fallback: str) -> Column:
        given = [n for n in names if n in df.columns]
        if not given:
            return scaled(fallback)
        total = scaled(given[0])
        return (total + scaled(given[1])) / 2 if len(given) == 2 else total

    return df.withColumns({
        "duration_sec": scaled("duration_sec"),
        "inter_arrival_mean_ms": averaged(_GAP_COLUMNS, "inter_arrival_mean_ms"),
        "inter_arrival_std_ms": averaged(_JITTER_COLUMNS, "inter_arrival_std_ms"),
    })


def derive_missing(df: DataFrame) -> DataFrame:
    """Port from service, failures from state, ratios from flag counts."""
    new: dict[str, Column] = {}
    if "dst_port" not in df.columns and "service" in df.columns:
        new["dst_port"] = port_of_service(F.col("service"))
    if "failed_connections" not in df.columns and "state" in df.columns:
        new["failed_connections"] = failed_state(F.col("state"))
    packets = _number(df, "packets") if "packets" in df.columns else F.lit(0.0)
    for ratio, count in _FLAG_COUNTS.items():
        if ratio not in df.columns and count in df.columns:
            new[ratio] = _number(df, count) / F.greatest(packets, F.lit(1.0))
    return df.withColumns(new) if new else df


def fill_defaults(df: DataFrame, infer_flow_direction: bool = False) -> DataFrame:
    """Defaults for absent or null categorical columns.

    A null protocol stays null here: it is text of unknown content, not a
    missing column, and becomes OTHER. Ports are numbers, truncated; text that
    is no number becomes null; :func:`unusable_ports` finds it before.
    """
    new: dict[str, Column] = {}
    for name, default in CATEGORICAL_DEFAULTS.items():
        if name not in df.columns:
            new[name] = F.lit(default)
        elif name in ("src_port", "dst_port"):
            new[name] = F.when(_quoted(name).isNull(), F.lit(default)).otherwise(
                _number(df, name, or_zero=False).try_cast("int"))
        elif name != "protocol":
            new[name] = F.coalesce(_quoted(name).cast("string"), F.lit(default))
    if infer_flow_direction:
        address = {n: new[n] for n in ("src_ip", "dst_ip")}
        inferred = infer_direction(address["src_ip"], address["dst_ip"])
        new["direction"] = (F.coalesce(F.col("direction").cast("string"), inferred)
                            if "direction" in df.columns else inferred)
    return df.withColumns(new)


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Numeric columns as doubles: absent or unreadable cells are 0, then clamped."""
    bounds = {
        "packets": (0.0, None), "bytes": (0.0, None), "duration_sec": (1e-6, None),
        "inter_arrival_mean_ms": (0.0, 60000.0), "inter_arrival_std_ms": (0.0, 60000.0),
    }
    return df.withColumns({
        name: clip(_number(df, name) if name in df.columns else F.lit(0.0),
                   *bounds.get(name, (None, None)))
        for name in NUMERIC_COLUMNS
    })


def normalize_text(df: DataFrame, null_label: str = "nan",
                   label_fallback: str | None = None) -> DataFrame:
    new = {
        "protocol": canonical_protocol(F.col("protocol")),
        "direction": F.lower(F.col("direction")),
        "src_ip": F.col("src_ip").cast("string"),
        "dst_ip": F.col("dst_ip").cast("string"),
    }
    fallback = _by_key(df).get(column_key(label_fallback)) if label_fallback else None
    if "label" in df.columns:
        label = F.coalesce(F.col("label"), _quoted(fallback)) if fallback else F.col("label")
        new["label"] = normal_label(label, null_label)
    elif fallback:
        new["label"] = normal_label(_quoted(fallback), null_label)
    return df.withColumns(new)


def _with_facts(df: DataFrame, source: str, facts: DataFrame, names: list[str]) -> DataFrame:
    table, small = small_or_written(facts.select(source, *names), "files")
    return df.join(F.broadcast(table) if small else table, source, "left")


def _day_first() -> Column:
    """Aggregate: whether timestamps are read day-first, if that reading fits more of the rows."""
    month, day = (F.count(slash_timestamp(F.col("timestamp"), first)) for first in (False, True))
    return day > month


def parse_timestamps(df: DataFrame, order_by: list[Column] | None = None, base: str = "2026-04-20",
                     step_seconds: int = 5, source: str | None = None) -> DataFrame:
    """Timestamps, or evenly spaced ones in row order where the column is absent.

    ``source`` names the column of the file a row comes from: each file's spaced timestamps start anew, and day and month
    are told apart once per file, unless a column ``_day_first`` already says how. Without it the table counts as one file.
    """
    if "timestamp" in df.columns:
        dtype = dict(df.dtypes)["timestamp"]
        if dtype != "string":
            return df.withColumn("timestamp", parse_timestamp(F.col("timestamp"), dtype))
        if "_day_first" in df.columns:
            return df.withColumn("timestamp", parse_timestamp(F.col("timestamp"), dtype, F.col("_day_first")))
        if source:
            joined = _with_facts(df, source, df.groupBy(source).agg(_day_first().alias("_day_first")), ["_day_first"])
            return parse_timestamps(joined, source=source).drop("_day_first")
        return df.withColumn("timestamp", parse_timestamp(F.col("timestamp"), dtype, bool(df.agg(_day_first().alias("day")).first()["day"])))
    placed = with_position(df, order_by, "_position")
    if source:
        table, small = small_or_written(placed.groupBy(source).agg(F.min("_position").alias("_first")), "files")
        placed = (placed.join(F.broadcast(table) if small else table, source, "left")
                  .withColumn("_position", F.col("_position") - F.col("_first")).drop("_first"))
    start = F.lit(base).cast("timestamp")
    micros = F.unix_micros(start) + F.col("_position") * (step_seconds * 1_000_000)
    return placed.withColumn("timestamp", F.timestamp_micros(micros)).drop("_position")


def prepare_flows(df: DataFrame, units: UnitPlan | None = None, *, volume: str = "first",
                  infer_flow_direction: bool = False, null_label: str = "nan",
                  label_fallback: str | None = None, order_by: list[Column] | None = None,
                  source: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Raw flow table to canonical flow table.

    With ``source``, the column of the file a row comes from, units and the reading of dates are decided for each file;
    ``facts`` has them if they are known (:func:`file_facts`). Otherwise the table counts as one file.

    Ports that are no numbers become null here; :mod:`flowlake.sources.csv_flows`
    keeps files with such rows out, and fitting refuses them.

    The result is not sorted: consumers that need the time order
    (:mod:`flowlake.operators.positions`) establish it themselves.
    """
    named = standardize_columns(df, volume)
    if volume == "sum":
        named = add_volumes(named)
    known: list[str] = []
    if source:
        facts = facts if facts is not None else file_facts(named, source)
        known = [c for c in facts.columns if c == "_day_first" or c.startswith("_unit_")]
        named = _with_facts(named, source, facts, known)
    if units is None:
        units = FileUnits(known) if source else detect_units(named)
    timed = scale_times(parse_timestamps(named, order_by, source=source), units).drop(*known)
    filled = fill_defaults(derive_missing(timed), infer_flow_direction)
    return normalize_text(coerce_numbers(filled), null_label, label_fallback)


def unusable_ports(df: DataFrame) -> Column:
    """Whether a row of a standardized table has ports that are given but are no finite numbers."""
    bad = F.lit(False)
    for name in ("src_port", "dst_port"):
        if name in df.columns:
            value = _number(df, name, or_zero=False)
            finite = F.coalesce(F.abs(value) != F.lit(float("inf")), F.lit(False))
            bad = bad | (_quoted(name).isNotNull() & ~finite)
    return bad
