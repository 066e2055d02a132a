"""String expressions: defaults, digests, cgroup paths, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def image_digest(image: Column) -> Column:
    """What follows the last "@"; without one: empty."""
    return F.when(F.instr(image, "@") > 0, F.substring_index(image, "@", -1)).otherwise("")


def strip_scheme(identifier: Column) -> Column:
    """What follows the first "://"; else all."""
    return F.regexp_replace(F.coalesce(identifier, F.lit("")), r"^.*?://", "")


# How paths of control groups name pods and containers.
POD_SLICE = r"pod([0-9a-fA-F_-]{32,36})\.slice"
CONTAINER_SCOPE = r"^(?:cri-containerd-|docker-|crio-)(.*)\.scope$"


def pod_uid_from_cgroup(path: Column) -> Column:
    raw = F.replace(F.regexp_extract(path, POD_SLICE, 1), F.lit("_"), F.lit("-"))
    dashed = F.concat_ws("-", *[F.substring(raw, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(F.length(raw) == 32, dashed).otherwise(raw)


def container_id_from_cgroup(path: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)/*$", 1), CONTAINER_SCOPE, 1)


def app_protocol(explicit: Column, port_name: Column) -> Column:
    """The explicit value (an empty one too), else the port's name where that names a protocol."""
    return F.coalesce(explicit, F.when(port_name.isin("http", "http2", "https", "grpc", "grpc-web"), port_name), F.lit(""))


def rfc3339(ns: Column) -> Column:
    """UTC time of nanoseconds since 1970 (a long, or a decimal beyond it) with as many digits of the second as it needs; null: empty."""
    whole, second = ns.cast("decimal(29,0)"), F.lit(1_000_000_000)
    rest = F.pmod(whole, second)
    seconds = ((whole - rest) / second).cast("long")
    head = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    head = F.ltrim(head, F.lit("+"))  # years of five digits
    digits = F.rtrim(F.lpad(rest.cast("string"), 9, "0"), F.lit("0"))
    return F.coalesce(F.concat(head, F.when(rest > 0, F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z")), F.lit(""))


def close_reason(reason: Column, fallback: str) -> Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(low.isin("fin", "rst", "timeout", "unknown"), low).when(low == "", fallback).otherwise("unknown")


def sni_hash(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.substring(F.sha2(F.lower(name), 256), 1, 16))


def list_hash(values: Column) -> Column:
    """The first 12 digits of SHA-256 over the comma-joined list; an empty list: zeros."""
    return F.when(F.size(values) > 0, F.substring(F.sha2(F.array_join(values, ","), 256), 1, 12)).otherwise("0" * 12)
