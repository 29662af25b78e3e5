"""Protocol, label, direction and timestamp harmonisation."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (ATTACK_LABEL_SPELLINGS, FAILED_STATES, KNOWN_NORMAL_LABELS,
                      NORMAL_LABEL_SPELLINGS, NOT_ATTACK_LABELS, PRIVATE_IPV4_BLOCKS,
                      PROTOCOL_NAMES, PROTOCOL_NUMBERS)

# Tried in turn after the ISO form, in the reading that was decided for the file.
_MONTH_FIRST = ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy"]
_DAY_FIRST = ["d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy h:mm:ss a", "d/M/yyyy"]


def literal_map(values: dict) -> Column:
    """A small dictionary as a map literal."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def slash_timestamp(column: Column, day_first: bool) -> Column:
    """Timestamp of a cell such as 7/12/2017 8:59, in one of the two readings."""
    formats = _DAY_FIRST if day_first else _MONTH_FIRST
    return F.coalesce(*[F.try_to_timestamp(F.trim(column), F.lit(f)) for f in formats])


def parse_timestamp(column: Column, dtype: str = "string", day_first: Column | bool = False) -> Column:
    """Timestamp of a cell, null where it cannot be read.

    Bare numbers are nanoseconds since the epoch.
    """
    if dtype.startswith("timestamp") or dtype == "date":
        return column.cast("timestamp")
    if dtype != "string":
        return F.timestamp_micros((column.cast("double") / 1000).cast("long"))
    number = F.trim(column).try_cast("double")
    if isinstance(day_first, bool):
        slashes = slash_timestamp(column, day_first)
    else:
        slashes = F.when(day_first, slash_timestamp(column, True)).otherwise(slash_timestamp(column, False))
    return F.when(number.isNotNull(), F.timestamp_micros((number / 1000).cast("long"))
                  ).otherwise(F.coalesce(F.try_to_timestamp(column), slashes))


def canonical_protocol(column: Column) -> Column:
    """TCP, UDP, ICMP or OTHER; a null cell is OTHER."""
    text = F.upper(F.trim(column.cast("string")))
    named = literal_map({**PROTOCOL_NAMES, **PROTOCOL_NUMBERS})[text]
    prefixed = reduce(lambda chain, name: chain.when(text.startswith(name), name),
                      ["UDP", "ICMP"], F.when(text.startswith("TCP"), "TCP"))
    return F.coalesce(named, prefixed, F.lit("OTHER"))


def normal_label(column: Column, null_label: str = "nan") -> Column:
    """Label in one spelling; ``null_label`` is what a null cell becomes."""
    text = F.lower(F.trim(column.cast("string")))
    return (F.when(text.isNull(), null_label)
            .when(text.isin(NORMAL_LABEL_SPELLINGS), "normal")
            .when(text.isin(ATTACK_LABEL_SPELLINGS), "anomalous")
            .when(text == "", "unknown")
            .otherwise(text))


def is_known_normal(label: Column) -> Column:
    return F.coalesce(label.isin(KNOWN_NORMAL_LABELS), F.lit(False))


def is_known_attack(label: Column) -> Column:
    return F.coalesce(~label.isin(NOT_ATTACK_LABELS), F.lit(True))


def failed_state(column: Column) -> Column:
    return F.coalesce(F.upper(column).isin(FAILED_STATES), F.lit(False)).cast("double")


def _ipv4_number(address: Column) -> Column:
    octets = F.split(address, r"\.")
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    value = reduce(lambda acc, i: acc * 256 + octets[i].try_cast("long"), range(1, 4),
                   octets[0].try_cast("long"))
    return F.when(address.rlike(rf"^{octet}(\.{octet}){{3}}$"), value)


def is_private_address(address: Column) -> Column:
    """True/false for an IP address, null for anything else."""
    number = _ipv4_number(address)
    inside = F.lit(False)
    for block in PRIVATE_IPV4_BLOCKS:
        network = ipaddress.ip_network(block)
        inside = inside | number.between(int(network.network_address), int(network.broadcast_address))
    lower = F.lower(address)
    ipv6 = lower.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$")
    private6 = lower.rlike(r"^(f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|::1?$|::ffff:|2001:0?db8:|100::)")
    return F.when(number.isNotNull(), inside).when(ipv6, private6)


def infer_direction(src: Column, dst: Column) -> Column:
    inbound = ~is_private_address(src) & is_private_address(dst)
    return F.when(F.coalesce(inbound, F.lit(False)), "inbound").otherwise("outbound")
