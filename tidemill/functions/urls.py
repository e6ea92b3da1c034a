"""URL columns: canonical forms, hosts, safety reasons, redirect parameters."""

from __future__ import annotations

from functools import reduce
from operator import or_
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.texts import bound

#: Parameters that name a click and not an article, for identity and for the first clean-up.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "fb_action_ids", "fb_action_types", "fb_ref", "fb_source"]
TRACKING_FIRST = TRACKING[:10]
#: Parameters that carry the target of a redirect, and ports that no source may use.
REDIRECTS = ["url", "u", "target", "redirect", "redirect_url", "dest", "to", "q"]
BLOCKED_PORTS = ["22", "25", "3306", "5432", "6379", "9200", "27017"]
#: Names of hosts that are this machine or serve its metadata.
LOCAL_HOSTS = ["localhost", "metadata", "metadata.google.internal", "metadata.internal", "instance-data", "instance-data.ec2.internal"]
#: Private IPv4 networks as (first address, bits), and prefixes of the text of private IPv6 addresses.
PRIVATE_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 16), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.0.0", 16), ("203.0.0.0", 16), ("100.64.0.0", 10), ("224.0.0.0", 3),
]
PRIVATE_V6 = ["fc", "fd", "fe8", "fe9", "fea", "feb", "ff"]
MAPPED = "0" * 20 + "ffff"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """Host in lower case, without www."""
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def parameters(url: Column, dropped: list[str], fold: bool) -> Column:
    """The query's parameters as an array of 'name=value', without the dropped names."""
    pairs = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1)) if fold else F.substring_index(p, "=", 1)
    return F.filter(pairs, lambda p: ~name(p).isin(dropped))


def rebuilt(url: Column, kept: Column, fragment: Column | None = None) -> Column:
    scheme, port = F.lower(part(url, "PROTOCOL")), F.regexp_extract(F.coalesce(part(url, "AUTHORITY"), F.lit("")), r":([0-9]+)$", 1)
    default = F.when(scheme == "http", "80").otherwise("443")
    shown = F.when((port == "") | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    parts = [scheme, F.lit("://"), F.lower(part(url, "HOST")), shown, path, query]
    return F.when(scheme.isin("http", "https") & part(url, "HOST").isNotNull(), F.concat(*parts, *([fragment] if fragment is not None else [])))


def canonical_url(url: Column) -> Column:
    """Identity of an article's URL: no fragment, tracking parameters or default port, parameters sorted; '' if unusable."""
    named = F.transform(parameters(url, TRACKING, True), lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), p.alias("pair")))
    return F.coalesce(rebuilt(url, F.transform(F.array_sort(named), lambda p: p["pair"])), F.lit(""))


def cleaned_url(url: Column) -> Column:
    """The first clean-up: no fragment, ten tracking names (case kept), the order kept; the text itself if it is no URL."""
    return F.coalesce(rebuilt(url, parameters(url, TRACKING_FIRST, False)), url)


def traced_url(url: Column) -> Column:
    """For links in prose: closing punctuation and ten tracking names go, the fragment stays."""
    bare = F.regexp_replace(url, r"[.,;:!?)\]}>]+$", "")
    mark = F.when(F.instr(bare, "#") > 0, F.concat(F.lit("#"), F.substring_index(bare, "#", -1))).otherwise("")
    return F.coalesce(rebuilt(bare, parameters(bare, TRACKING_FIRST, False), mark), bare)


def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link, strict=True)], dtype="object")


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute URL; only links without a scheme go to Python, in batches."""
    whole = link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.coalesce(F.when(whole, link), F.pandas_udf(_joined, T.StringType())(F.when(~whole, base), F.when(~whole, link)))


def host_text(url: Column) -> Column:
    """A URL's host as it is written, in lower case; addresses that are no names of hosts too."""
    return F.lower(F.regexp_extract(F.coalesce(part(url, "AUTHORITY"), F.lit("")), r"^(?:[^@]*@)*+(\[[^\]]*\]|[^:]*)", 1))


def numeral(text: Column) -> Column:
    """The number that a part of an IPv4 address stands for: hexadecimal behind 0x, octal behind 0, else decimal; null if it is none or beyond 32 bits."""
    digits = F.regexp_replace(text, "^(?:0x)?0*", "")
    number = F.when(text.rlike("^0x[0-9a-f]*\\z"), F.conv(digits, 16, 10)).when(text.rlike("^0[0-7]*\\z"), F.conv(digits, 8, 10)).when(text.rlike("^[1-9][0-9]*\\z"), text)
    return F.when(F.length(digits) <= 11, F.coalesce(F.nullif(number, F.lit("")), F.when(number.isNotNull() | text.rlike("^(?:0x)?0*\\z"), F.lit("0"))).cast("long"))


def ipv4_number(host: Column) -> Column:
    """The 32 bits of one to four parts, the last of which fills what is left; -1 if the host ends in a number but is no address, null if it is a name."""
    def of(parts: Column) -> Column:
        n = F.size(parts)
        last, front = F.get(parts, n - 1), F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
        room = F.pow(F.lit(256), 5 - n).cast("long")
        wrong = (n > 4) | last.isNull() | (last >= room) | F.exists(front, lambda x: x.isNull() | (x > 255))
        high = F.aggregate(front, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room
        return F.when(F.coalesce(wrong, F.lit(True)), F.lit(-1)).otherwise(high + last)

    bare = F.regexp_replace(host, r"\.\z", "")
    parts = F.transform(F.split(bare, r"\."), numeral)
    return F.when(bare.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\z"), bound(parts, of))


def ipv6_digits(text: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address without brackets, shortened, with an IPv4 one at its end or neither; null if it is none."""
    tail = F.regexp_extract(text, r"(?<=:)([0-9]{1,3}(?:\.[0-9]{1,3}){3})\z", 1)
    quad = F.lpad(F.lower(F.hex(ipv4_number(tail))), 8, "0")
    plain = F.when(tail == "", text).when(ipv4_number(tail) >= 0, F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4)))

    def of(t: Column) -> Column:
        groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
        left, right = groups(F.substring_index(t, "::", 1)), F.when(t.contains("::"), groups(F.substring_index(t, "::", -1))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        fits = F.when(t.contains("::"), missing >= 1).otherwise(missing == 0) & t.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7})?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7})?)?\z")
        padded = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(fits, F.concat(padded(left), F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), padded(right)))

    return bound(plain, of)


def address(host: Column) -> Column:
    """An address in any form as 32 hexadecimal digits, IPv4 ones as mapped; '' for what looks like an address and is none, null for a name."""
    inner = ipv6_digits(F.regexp_extract(host, r"^\[([^\]]*)\]\z", 1))
    four = ipv4_number(host)
    return F.when(host.startswith("["), F.coalesce(inner, F.lit(""))).when(four == -1, "").when(four.isNotNull(), F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(four)), 8, "0")))


def private_ranges() -> list[tuple[str, str]]:
    """(first, last) as 32 digits, by order of digits: mapped private networks, the unspecified and the loopback address, and the first groups whose text has a private prefix."""
    out = [("0" * 32, "0" * 31 + "1")]
    for first, bits in PRIVATE_V4:
        low = sum(int(x) << 8 * (3 - k) for k, x in enumerate(first.split(".")))
        out.append((f"{MAPPED}{low:08x}", f"{MAPPED}{low + (1 << 32 - bits) - 1:08x}"))
    for prefix in PRIVATE_V6:
        for more in range(5 - len(prefix)):
            out.append(((prefix + "0" * more).rjust(4, "0") + "0" * 28, (prefix + "f" * more).rjust(4, "0") + "f" * 28))
    return out


def private(digits: Column) -> Column:
    """Whether an address() lies in a private range."""
    return reduce(or_, (digits.between(low, high) for low, high in private_ranges()))


def unsafe_reason(url: Column) -> Column:
    """Why a URL may not be fetched; null if it may. Names need the resolver port besides, whose answers go through private(address())."""
    name, authority = host_text(url), F.coalesce(part(url, "AUTHORITY"), F.lit(""))

    def of(where: Column) -> Column:
        return (
            F.when(F.coalesce(where["name"], F.lit("")) == "", "invalid")
            .when(~F.coalesce(F.lower(part(url, "PROTOCOL")).isin("http", "https"), F.lit(False)), "scheme")
            .when(authority.contains("@"), "userinfo")
            .when(where["name"].isin(LOCAL_HOSTS) | where["name"].rlike(r"\.(?:local|internal|localhost)$"), "local_host")
            .when(F.regexp_extract(authority, r":([0-9]+)$", 1).isin(BLOCKED_PORTS), "port")
            .when(where["address"] == "", "invalid")
            .when(private(where["address"]), "private_address")
        )

    return bound(F.struct(name.alias("name"), address(name).alias("address")), of)


def unsafe_answers(addresses: Column) -> Column:
    """dns_private_or_empty if a name's resolved addresses (array<string>, IPv6 without brackets) are none or one of them is private or no address; else null."""
    digits = F.transform(addresses, lambda a: F.coalesce(F.when(a.contains(":"), ipv6_digits(F.lower(a))).otherwise(address(F.lower(a))), F.lit("")))
    return F.when(F.coalesce(F.size(addresses), F.lit(0)) < 1, "dns_private_or_empty").when(F.exists(digits, lambda d: (d == "") | private(d)), "dns_private_or_empty")


def unwrapped(url: Column, depth: int = 3) -> Column:
    """The target that a redirect parameter carries, up to depth levels."""
    carried = rf"[?&](?:{'|'.join(REDIRECTS)})=(https?(?:%3A|:)[^&#]*)"
    for _ in range(depth):
        url = bound(url, lambda u: F.coalesce(F.url_decode(F.nullif(F.regexp_extract(u, carried, 1), F.lit(""))), u))
    return url


def unsafe_target(url: Column) -> Column:
    """unsafe_reason() of a URL, else of what its redirect parameters lead to."""
    return bound(url, lambda u: F.coalesce(unsafe_reason(u), bound(unwrapped(u), unsafe_reason)))


def suffixes(name: Column) -> Column:
    """A host and its parent domains, for equality joins with lists of domains."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
