"""Port and service lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SERVICE_NAME_PORTS, SERVICE_PORTS
from .text import literal_map


def service_name(port: Column) -> Column:
    return F.coalesce(literal_map(SERVICE_PORTS)[port], F.lit("other"))


def port_of_service(service: Column) -> Column:
    return F.coalesce(literal_map(SERVICE_NAME_PORTS)[F.lower(F.trim(service))], F.lit(0))


def port_band(port: Column) -> Column:
    return F.coalesce(
        literal_map(SERVICE_PORTS)[port],
        F.when(port < 1024, "system-other").when(port < 10000, "registered").otherwise("dynamic"))


def context_key(protocol: Column, direction: Column, port: Column) -> Column:
    return F.concat_ws("|", protocol, direction, port_band(port))
