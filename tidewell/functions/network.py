"""IPv4 addresses as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4_MAX = 2**32 - 1
_OCTET = "(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IPV4_PATTERN = f"^(?:::[fF]{{4}}:)?{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$"


def effective_ip(header_ip: Column, body_ip: Column, private_prefix: str = "192") -> Column:
    """The header address, or the one in the body when the header is private.

    A missing body address gives an empty string, and such rows are skipped by
    the callers.  Any header that starts with ``192`` counts as private; pass
    ``"192.168."`` for the strict reading.
    """
    return F.when(
        F.coalesce(header_ip, F.lit("")).startswith(private_prefix), F.coalesce(body_ip, F.lit(""))
    ).otherwise(F.coalesce(header_ip, F.lit("")))


def ip_to_int(ip: Column) -> Column:
    """Dotted IPv4 (also ``::ffff:a.b.c.d``) to a bigint, null when it is not one."""
    value = F.lit(0).cast("bigint")
    octets = F.split(F.substring_index(ip, ":", -1), "\\.")
    for position in range(4):
        value = value * 256 + F.get(octets, F.lit(position)).try_cast("bigint")
    return F.when(ip.rlike(IPV4_PATTERN), value)


def ip_status(ip: Column, has_address: Column) -> Column:
    """``blank``, ``invalid`` or ``ok``, given the text and whether it is an address."""
    return F.when(has_address, "ok").when(F.coalesce(ip, F.lit("")) == "", "blank").otherwise("invalid")
