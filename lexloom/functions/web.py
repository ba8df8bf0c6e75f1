"""Addresses: which ones may be read, and which hosts they name."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: networks that are never read from
BLOCKED = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 100.64.0.0/10 ::1/128 fe80::/10 fc00::/7".split()
_NETWORKS = [ipaddress.ip_network(n) for n in BLOCKED]


def scheme(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_web(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != ""), F.lit(False))


def domain_of(entry: str) -> str:
    """The bare domain of an allow-list entry."""
    entry = entry.strip().lower()
    entry = entry.split("://", 1)[-1]
    return entry.split("/", 1)[0].lstrip(".")


def is_allowed(url: Column, entries: list[str]) -> Column:
    """Whether the url is https on one of the domains or below it."""
    domains = [d for d in map(domain_of, entries) if d]
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host(url) == d) | F.endswith(host(url), F.lit("." + d))
    return F.coalesce((scheme(url) == "https") & hit, F.lit(False))


_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FOUR = rf"{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}"


def _number(address: Column) -> Column:
    """An IPv4 address as a number."""
    parts = F.transform(F.split(address, r"\."), lambda p: p.cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p)


def _blocked_number(number: Column) -> Column:
    own = [n for n in _NETWORKS if n.version == 4]
    return reduce(Column.__or__, [number.between(int(n.network_address), int(n.broadcast_address)) for n in own])


def _blocked_groups(groups: Column) -> Column:
    """Whether eight 16-bit numbers are an IPv6 address in a blocked network, or hold an IPv4 one that is."""

    def inside(network: ipaddress.IPv6Network) -> Column:
        held = F.lit(True)
        for i in range(8):
            fixed = min(16, max(0, network.prefixlen - 16 * i))
            low = int(network.network_address) >> (112 - 16 * i) & 0xFFFF
            if fixed:
                held = held & F.get(groups, F.lit(i)).between(low, low + (1 << 16 - fixed) - 1)
        return held

    mapped = inside(ipaddress.IPv6Network("::ffff:0:0/96")) & _blocked_number(F.get(groups, F.lit(6)).cast("long") * 65536 + F.get(groups, F.lit(7)))
    return reduce(Column.__or__, [inside(n) for n in _NETWORKS if n.version == 6], mapped)


def is_blocked_address(address: Column | str) -> Column:
    """Whether an address lies in a blocked network; what is no address, and null, is blocked. Mapped addresses count
    as the address they hold. All in Spark's own functions."""
    text = F.lower(F.trim(F.col(address) if isinstance(address, str) else address))
    plain = F.regexp_replace(text, "%[^%]+$", "")
    # an IPv4 address at the end stands for two groups
    last = F.regexp_extract(plain, f"^.*:({_FOUR})$", 1)
    number = _number(F.when(last != "", last).otherwise("0.0.0.0"))
    pair = F.concat_ws(":", F.hex(F.shiftright(number, 16)), F.hex(number.bitwiseAND(0xFFFF)))
    whole = F.lower(F.when(last != "", F.concat(F.left(plain, F.length(plain) - F.length(last)), pair)).otherwise(plain))
    halves = F.split(whole, "::")
    half = lambda i: F.when(F.coalesce(F.get(halves, F.lit(i)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, F.lit(i)), ":"))
    groups = F.concat(half(0), half(1))
    written = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    valid = written & F.when(F.size(halves) == 1, F.size(groups) == 8).otherwise((F.size(halves) == 2) & (F.size(groups) <= 7))
    filled = F.concat(half(0), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(groups))), half(1))
    numbers = F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int"))
    four = text.rlike(f"^{_FOUR}$")
    six = F.when(F.contains(plain, F.lit(":")) & valid, _blocked_groups(numbers)).otherwise(True)
    return F.coalesce(F.when(four, _blocked_number(_number(F.when(four, text)))).otherwise(six), F.lit(True))


def escaped(query: Column) -> Column:
    return F.replace(F.url_encode(query), F.lit("+"), F.lit("%20"))
