"""IP address, protocol and direction expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_H = r"[0-9a-fA-F]{1,4}"
#: Full and compressed forms, with an optional zone, and IPv4 tails.
IPV6 = rf"^(({_H}:){{7}}{_H}|({_H}:){{1,7}}:|({_H}:){{1,6}}:{_H}|({_H}:){{1,5}}(:{_H}){{1,2}}|({_H}:){{1,4}}(:{_H}){{1,3}}|({_H}:){{1,3}}(:{_H}){{1,4}}|({_H}:){{1,2}}(:{_H}){{1,5}}|{_H}:(:{_H}){{1,6}}|:((:{_H}){{1,7}}|:)|(({_H}:){{6}}|::({_H}:){{0,5}}|({_H}:){{1,5}}:|({_H}:){{1,4}}:{_H}:)[0-9.]+)(%[0-9A-Za-z]+)?$"


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    return F.coalesce(ip.contains(":") & ip.rlike(IPV6), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as an integer; null where it isn't IPv4."""
    part = lambda k: F.element_at(F.split(ip, r"\."), k).cast("long")
    return F.when(is_ipv4(ip), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def dotted_little_endian(number: Column) -> Column:
    """A 32-bit number whose lowest byte is the first octet."""
    octet = lambda k: F.shiftright(number, 8 * k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", *[octet(k) for k in range(4)])


def ip_family(src: Column, dst: Column) -> Column:
    """Of the first of both that is an address."""
    one = lambda ip: F.when(is_ipv4(ip), "ipv4").when(is_ipv6(ip), "ipv6")
    return F.coalesce(one(src), one(dst), F.lit("unknown"))


#: Loopback, private, link-local and multicast networks, and the two addresses of all zeros and all ones, of valid IPv4 texts.
INSIDE4 = r"^(10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|2(2[4-9]|3[0-9])\.|0\.0\.0\.0$|255\.255\.255\.255$)"
INSIDE6 = r"^(::|::1|0:0:0:0:0:0:0:[01]|f[cd][0-9a-f]{0,2}:.*|fe[89ab][0-9a-f]?:.*|ff[0-9a-f]{0,2}:.*)(%.*)?$"
MAPPED = r"^::ffff:([0-9.]+)$"


def is_loopback(ip: Column) -> Column:
    return F.coalesce((is_ipv4(ip) & ip.startswith("127.")) | F.lower(ip).isin("::1", "0:0:0:0:0:0:0:1"), F.lit(False))


def is_external(ip: Column) -> Column:
    """Global unicast and neither private, loopback nor link-local; what isn't an address is not external."""
    low = F.lower(ip)
    mapped = F.regexp_extract(low, MAPPED, 1)
    six = F.when(is_ipv4(mapped), ~mapped.rlike(INSIDE4)).otherwise(~low.rlike(INSIDE6))
    return F.coalesce(F.when(is_ipv4(ip), ~ip.rlike(INSIDE4)).when(is_ipv6(ip), six), F.lit(False))


def base_direction(src: Column, dst: Column) -> Column:
    parsed = (is_ipv4(src) | is_ipv6(src)) & (is_ipv4(dst) | is_ipv6(dst))
    return F.when(parsed & ((is_loopback(src) & is_loopback(dst)) | (src == dst)), "local").otherwise("unknown")


def direction(base: Column, src_external: Column, dst_external: Column) -> Column:
    known = F.when(base == "", "unknown").otherwise(F.coalesce(base, F.lit("unknown")))
    return F.when(base == "local", "local").when(src_external & ~dst_external, "ingress").when(dst_external & ~src_external, "egress").otherwise(known)


def protocol_or_tcp(protocol: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(protocol, F.lit("")), F.lit("tcp")))


def protocol_guess(protocol: Column, dst_port: Column) -> Column:
    tcp = F.lower(protocol) == "tcp"
    return F.when(tcp & dst_port.isin(443, 8443), "tls").when(tcp & dst_port.isin(80, 8080), "http").otherwise("unknown")


def is_tls_like(protocol: Column, dst_port: Column) -> Column:
    return F.coalesce((protocol_guess(protocol, dst_port) == "tls") | dst_port.isin(443, 8443), F.lit(False))
