"""Hostname rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions.text import WHITESPACE_CLASS, col, strip, strip_dots

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6() -> str:
    """RFC 4291 text forms: eight groups, or one `::` standing for one or more zero groups."""
    h = "[0-9a-fA-F]{1,4}"
    tail = f"(?:{h}:{h}|{IPV4})"
    forms = [f"(?:{h}:){{6}}{tail}"]
    for left in range(0, 8):
        head = f"(?:{h}(?::{h}){{{left - 1}}})" if left else ""
        room = 7 - left  # groups that may still follow the `::`
        if room >= 2:
            forms.append(f"{head}::(?:{h}:){{0,{room - 2}}}{tail}")
        if room >= 1:
            forms.append(f"{head}::{h}")
        forms.append(f"{head}::")
    return "(?:" + "|".join(forms) + ")(?:%[^%]+)?"


IPV6 = _ipv6()
IP_PATTERN = rf"^(?:{IPV4}|{IPV6})\z"
LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
HOST_PATTERN = rf"^{LABEL}(?:\.{LABEL})+\z"


def is_ip(host: Column | str) -> Column:
    # Anything with a digit or colon at the end may be an address; other hosts skip the long regex.
    h = col(host)
    return h.rlike(r"[0-9]\z|:") & h.rlike(IP_PATTERN)


def host_text(value: Column | str) -> Column:
    """A host in lower case, without outer white space and dots."""
    return strip_dots(F.lower(strip(col(value))))


def canonical_host(value: Column | str) -> Column:
    """Lower-case ASCII host without outer dots, or null when there is none."""
    return encoded_host(host_text(value))


def encoded_host(text: Column | str) -> Column:
    """The canonical host of a `host_text`.

    The text stands in every branch: where many rows are parsed it is a column of its own, so that it is computed once.
    """
    h = col(text)
    # Empty or over-long labels cannot be encoded for DNS; short hosts skip the label regex.
    bad_label = F.contains(h, F.lit("..")) | ((F.length(h) > 63) & h.rlike("[^.]{64}"))
    ascii_host = F.when(~bad_label, h)
    # IDNA only for the rare non-ASCII host; the call is lazy inside `when`.
    encoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h)
    host = (
        F.when(h.rlike(r"^[!-~]+\z"), ascii_host)  # nearly every host: printable ASCII
        .when(h.rlike(WHITESPACE_CLASS), F.lit(None))
        .when(h.rlike(r"[^\x00-\x7F]"), F.lower(strip_dots(encoded)))
        .otherwise(ascii_host)
    )
    return F.when(~h.isin(*V.EMPTY_LITERALS), F.nullif(host, F.lit("")))


def is_valid_host(host: Column | str) -> Column:
    h = col(host)
    named = (F.length(h) <= 253) & h.rlike(HOST_PATTERN)
    return F.coalesce(named | is_ip(h), F.lit(False))
