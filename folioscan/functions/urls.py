"""URL parts, link resolution and address classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host name in lower case, without user info, port or IPv6 brackets."""
    bare = F.regexp_replace(netloc(url), "^.*@", "")
    six = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(six != "", six).otherwise(F.regexp_replace(bare, ":[0-9]*$", "")))


def port(url: Column) -> Column:
    digits = F.regexp_extract(netloc(url), ":([0-9]+)$", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def without_dots(steps: Column) -> Column:
    """A path from its segments, "." and ".." applied; steps above the root are dropped, a final one leaves a folder."""
    none = F.expr("cast(array() as array<string>)")

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    left = F.aggregate(steps, none, step)
    tail = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(left) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(left, "/"), tail)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of a link: absolute, scheme-relative, root-relative, fragment or query only, and relative with
    any number of ./ and ../ steps."""
    target = F.regexp_extract(href, "^([^?#]*)", 1)
    rest = F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = F.split(F.regexp_replace(F.concat(folder, target), "^/", ""), "/")
    last = F.size(joined) - 1
    # empty middle segments of a relative link go, an empty last one is a folder
    relative = F.transform(joined, lambda s, i: F.when((s == "") & (i < last), F.lit(None)).otherwise(s))
    rooted = F.split(F.regexp_replace(target, "^/", ""), "/")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), without_dots(rooted), rest))
        .when(href.startswith("#"), F.concat(drop_fragment(base), href))
        .when(href.startswith("?"), F.concat(origin(base), path(base), href))
        .when(href == "", base)
        .otherwise(F.concat(origin(base), without_dots(F.array_compact(relative)), rest))
    )


def is_ipv4(text: Column) -> Column:
    return text.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")


def ipv4_number(text: Column) -> Column:
    octets = F.split(text, r"\.")
    weights = [16777216, 65536, 256, 1]
    return reduce(
        lambda a, b: a + b, [F.get(octets, F.lit(i)).try_cast("long") * w for i, w in enumerate(weights)]
    )


# fixed values: networks that are never fetched
BLOCKED_V4 = [
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4",
]
BLOCKED_V6_PATTERN = r"^(::1|(0{1,4}:){7}0{0,3}1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$"


def _v6_pattern() -> str:
    """Eight groups, or fewer around one "::"; the last two may be written as an IPv4 address."""
    group, four = "[0-9a-f]{1,4}", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}"
    ends = {1: group, 2: f"(?:{group}:{group}|{four})"}
    forms = [f"(?:{group}:){{6}}{ends[2]}"]
    for left in range(8):  # groups before "::", then up to as many after it as leave one out
        head = f"(?:{group}:){{{left - 1}}}{group}" if left else ""
        for right in range(8 - left):
            tail = "" if not right else group if right == 1 else f"(?:{group}:){{{right - 2}}}{ends[2]}"
            forms.append(f"{head}::{tail}")
    return "^(?:" + "|".join(forms) + ")$"


VALID_V6 = _v6_pattern()


def _in_network(number: Column, cidr: str) -> Column:
    base, bits = cidr.split("/")
    octets = [int(o) for o in base.split(".")]
    low = sum(o << (8 * (3 - i)) for i, o in enumerate(octets))
    return number.between(low, low + (1 << (32 - int(bits))) - 1)


def is_private_address(text: Column, networks: list[str] = BLOCKED_V4) -> Column:
    """True for private, loopback, link-local, multicast and reserved addresses, and for non-addresses."""
    # the number is bound once by the array lambda instead of being repeated for every network
    inside = F.exists(
        F.array(ipv4_number(text)), lambda n: reduce(lambda a, b: a | b, [_in_network(n, net) for net in networks])
    )
    six = F.lower(text).rlike(VALID_V6)
    return (
        F.when(is_ipv4(text), inside)
        .when(six, F.lower(text).rlike(BLOCKED_V6_PATTERN))
        .otherwise(F.lit(True))
    )


def site(url: Column) -> Column:
    """Scheme and authority; empty for text without them."""
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*", 0)


def client_ip(forwarded_for: Column, real_ip: Column, peer: Column) -> Column:
    first_hop = F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first_hop, F.lit("")), real_ip, peer, F.lit("unknown"))
