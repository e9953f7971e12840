"""Address helpers: text -> sortable key, validity, private ranges, networks.

The key of an address is its 128 bits as 32 hexadecimal digits, IPv4 as IPv4-mapped
IPv6, so that keys sort as addresses do and both spellings of an IPv4 address are one.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
IPV4 = rf"^{_DOTTED}$"
IPV4_ANYWHERE = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
#: Hexadecimal groups and colons, the last two groups possibly dotted; how many groups is counted.
_IPV6_SHAPE = rf"^(?!.*:::)(?!:[^:])(?!.*[^:]:$)(?=.*:)([0-9a-f]{{0,4}}:)*([0-9a-f]{{0,4}}|{_DOTTED})$"
_MAPPED = "0" * 20 + "ffff"
#: Digits of a key that name the block in which addresses and ranges meet: /16 of IPv4, /112 of IPv6.
BLOCK_DIGITS = 28


def is_ipv4(col: Column) -> Column:
    return F.coalesce(col.rlike(IPV4), F.lit(False))


def is_ip(col: Column) -> Column:
    return ip_key(col).isNotNull()


def _hex_octets(dotted: Column) -> Column:
    octets = F.transform(F.split(dotted, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0"))
    return F.array_join(octets, "")


def _ipv6_key(text: Column) -> Column:
    dotted = F.regexp_extract(text, rf"({_DOTTED})$", 1)
    tail = _hex_octets(dotted)
    plain = F.when(dotted == "", text).otherwise(F.concat(
        F.substring(text, F.lit(1), F.length(text) - F.length(dotted)), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)))
    halves = F.split(plain, "::")

    def groups(half: Column) -> Column:
        return F.transform(F.filter(F.split(half, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

    left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    fits = ((F.size(halves) == 1) & (n == 8)) | ((F.size(halves) == 2) & (n <= 7))
    key = F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), 8 - n), F.array_join(right, ""))
    return F.when(text.rlike(_IPV6_SHAPE) & fits, key)


def ip_key(col: Column) -> Column:
    """The key of an IPv4 or IPv6 address, null for anything else."""
    return F.when(is_ipv4(col), F.concat(F.lit(_MAPPED), _hex_octets(col))).when(
        F.contains(col, F.lit(":")), _ipv6_key(F.lower(col)))


def number_key(number: Column) -> Column:
    """The key of an IPv4 address given as a number."""
    return F.concat(F.lit(_MAPPED), F.lpad(F.lower(F.hex(number.cast("bigint"))), 8, "0"))


def is_private(col: Column) -> Column:
    """Address ranges that have no public location."""
    return col.rlike(r"(?i)^((::ffff:)?(10\.|127\.|0\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)")


def cidr_bounds(entry: str) -> tuple[str, str] | None:
    """Inclusive keys of an address or network (driver side)."""
    try:
        net = ipaddress.ip_network(entry.strip(), strict=False)
    except ValueError:
        return None
    base = 0xFFFF << 32 if net.version == 4 else 0
    return f"{base + int(net.network_address):032x}", f"{base + int(net.broadcast_address):032x}"


def in_any_cidr(col: Column, entries: list[str]) -> Column:
    """Membership in a configured list of networks, as one predicate on the key.

    Meant for lists of a size one writes into a settings file; long lists are
    tables and go through ``enrich.join_ranges``.
    """
    merged: list[list[str]] = []
    for low, high in sorted(b for b in map(cidr_bounds, entries) if b):
        if merged and int(low, 16) <= int(merged[-1][1], 16) + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    if not merged:
        return F.lit(False)
    # One array element, so that the key is worked out once for all networks.
    inside = F.exists(F.array(ip_key(col)), lambda k: reduce(lambda a, b: a | b, [k.between(*m) for m in merged]))
    return F.coalesce(inside, F.lit(False))
