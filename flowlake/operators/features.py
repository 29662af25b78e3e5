"""Numeric flow features: the 20-d model vector and the 12-d encoder input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, number_or_zero
from ..functions.ports import context_key, service_name
from ..functions.text import literal_map
from ..schema import (ADMIN_PORTS, DIRECTION_ORDINALS, ENCODER_COLUMNS, ENCODER_NUMERIC_COLUMNS,
                      FEATURE_COLUMNS, PROTOCOL_ORDINALS, SERVICE_PORTS, WEB_PORTS)
from .params import GroupParams
from .quantiles import exact_quantiles

FEATURE_PREFIX = "f_"


def feature(name: str) -> Column:
    return F.col(FEATURE_PREFIX + name)


def _port_in(ports: list[int]) -> str:
    return f"dst_port IN ({', '.join(map(str, ports))})"


_DURATION, _PACKETS, _BYTES = "greatest(duration_sec, 0.001D)", "greatest(packets, 1D)", "greatest(bytes, 1D)"
_FEATURE_SQL = {
    "log_duration": f"log1p({_DURATION})",
    "log_packets": f"log1p({_PACKETS})",
    "log_bytes": f"log1p({_BYTES})",
    "bytes_per_packet": f"{_BYTES} / {_PACKETS}",
    "bytes_per_sec": f"log1p({_BYTES} / {_DURATION})",
    "packets_per_sec": f"log1p({_PACKETS} / {_DURATION})",
    "tcp_syn_ratio": "least(greatest(tcp_syn_ratio, 0D), 1D)",
    "tcp_ack_ratio": "least(greatest(tcp_ack_ratio, 0D), 1D)",
    "tcp_fin_ratio": "least(greatest(tcp_fin_ratio, 0D), 1D)",
    "log_inter_arrival_mean_ms": "log1p(greatest(inter_arrival_mean_ms, 0D))",
    "log_inter_arrival_std_ms": "log1p(greatest(inter_arrival_std_ms, 0D))",
    "failed_connections": "greatest(failed_connections, 0D)",
    "is_inbound": "direction = 'inbound'",
    "is_tcp": "protocol = 'TCP'",
    "is_udp": "protocol = 'UDP'",
    "is_icmp": "protocol = 'ICMP'",
    "is_other_proto": "protocol NOT IN ('TCP', 'UDP', 'ICMP')",
    "is_web_service": _port_in(WEB_PORTS),
    "is_admin_service": _port_in(ADMIN_PORTS),
    "is_uncommon_port": f"NOT ({_port_in(list(SERVICE_PORTS))})",
}


def feature_expressions() -> dict[str, Column]:
    """The 20 features in vector order, over canonical flow columns."""
    return {name: F.expr(f"CAST({_FEATURE_SQL[name]} AS DOUBLE)") for name in FEATURE_COLUMNS}


def add_features(flows: DataFrame) -> DataFrame:
    """Flows with one ``f_<name>`` column per feature."""
    return flows.withColumns({FEATURE_PREFIX + n: e for n, e in feature_expressions().items()})


def add_context_key(flows: DataFrame) -> DataFrame:
    return flows.withColumn(
        "context_key", context_key(F.col("protocol"), F.col("direction"), F.col("dst_port")))


def add_service(flows: DataFrame) -> DataFrame:
    return flows.withColumn("service", service_name(F.col("dst_port")))


def encoder_expressions(df: DataFrame) -> dict[str, Column]:
    """The 12 unscaled encoder inputs; absent columns count as zero."""
    types = dict(df.dtypes)
    values = {n: number_or_zero(F.col(n), types[n] == "string") if n in types else F.lit(0.0)
              for n in ENCODER_NUMERIC_COLUMNS}

    def ordinal(name: str, codes: dict[str, int], unknown: int) -> Column:
        if name not in types:
            return F.lit(0.0)
        return F.coalesce(literal_map(codes)[F.col(name)], F.lit(unknown)).cast("double")

    values["protocol_num"] = ordinal("protocol", PROTOCOL_ORDINALS, 3)
    values["direction_num"] = ordinal("direction", DIRECTION_ORDINALS, 0)
    return {n: values[n].cast("double") for n in ENCODER_COLUMNS}


def encoder_scaling(df: DataFrame, rows: int | None = None) -> dict[str, tuple[float, float]]:
    """Median and MAD of each encoder input; a vanishing MAD becomes 1."""
    inputs = df.select(*[e.alias(n) for n, e in encoder_expressions(df).items()])
    rows = inputs.count() if rows is None else rows
    medians = exact_quantiles(inputs, {n: (F.col(n), [0.5]) for n in ENCODER_COLUMNS}, rows=rows)[None]
    spread = {n: (F.abs(F.col(n) - F.lit(medians[n][0])), [0.5]) for n in ENCODER_COLUMNS}
    mads = exact_quantiles(inputs, spread, rows=rows)[None]
    return {n: (medians[n][0], mads[n][0] if mads[n][0] >= 1e-6 else 1.0) for n in ENCODER_COLUMNS}


def scaled_encoder_expressions(df: DataFrame, scaling: dict[str, tuple[float, float]],
                               limit: float = 10.0) -> dict[str, Column]:
    return {n: clip((e - F.lit(scaling[n][0])) / F.lit(scaling[n][1]), -limit, limit)
            for n, e in encoder_expressions(df).items()}


def robust_params(features: DataFrame, by: str | None = None, rows: int | None = None,
                  mad_floor: float = 1e-6) -> GroupParams:
    """Median and MAD of every feature per group, two aggregations in all.

    A zero MAD becomes ``mad_floor``.
    """
    rows = features.count() if rows is None else rows
    medians = exact_quantiles(features, {n: (feature(n), [0.5]) for n in FEATURE_COLUMNS}, by, rows)
    params = GroupParams(by, {g: {f"med_{n}": v[0] for n, v in m.items()} for g, m in medians.items()})
    joined, get = params.attach(features)
    spread = {n: (F.expr(f"abs({FEATURE_PREFIX}{n} - {get(f'med_{n}')})"), [0.5])
              for n in FEATURE_COLUMNS}
    for g, mads in exact_quantiles(joined, spread, by, rows).items():
        params.rows[g].update({f"mad_{n}": (v[0] if v[0] else mad_floor) for n, v in mads.items()})
    return params


def scaled_feature(name: str, get) -> str:
    """Robust z of one feature, as SQL text."""
    return f"(({FEATURE_PREFIX}{name} - {get(f'med_{name}')}) / {get(f'mad_{name}')})"
