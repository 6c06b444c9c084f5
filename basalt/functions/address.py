"""IP addresses: parsing and canonical form, as column expressions without any UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_V4 = rf"^{_QUAD}\z"


def _v6() -> str:
    """All eight groups, or fewer around one gap; the last two may be dotted; a zone may follow."""
    ways = [rf"(?:{_GROUP}:){{6}}(?:{_GROUP}:{_GROUP}|{_QUAD})"]
    for left in range(8):
        head = rf"{_GROUP}(?::{_GROUP}){{{left - 1}}}" if left else ""
        right = 7 - left
        tails = [rf"(?:{_GROUP}:){{0,{right - 1}}}{_GROUP}"] * (right >= 1) + [rf"(?:{_GROUP}:){{0,{right - 2}}}{_QUAD}"] * (right >= 2)
        ways.append(f"{head}::" + (f"(?:{'|'.join(tails)})?" if tails else ""))
    return rf"^(?:{'|'.join(ways)})(?:%.+)?\z"


_V6 = _v6()


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once and named once in the plan however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


def is_v4(c: Column) -> Column:
    return c.rlike(_V4)


def is_v6(c: Column) -> Column:
    return c.rlike(_V6)


def is_address(c: Column) -> Column:
    return is_v4(c) | is_v6(c)


def _hex_tail(c: Column) -> Column:
    """An address whose last 32 bits are dotted gets them as two groups."""

    def groups(quad: Column) -> Column:
        pair = lambda i: F.lower(F.hex(quad[i].cast("int") * 256 + quad[i + 1].cast("int")))
        return F.concat(F.regexp_replace(c, rf"{_QUAD}\z", ""), pair(0), F.lit(":"), pair(2))

    return F.when(c.rlike(rf":{_QUAD}\z"), let(F.split(F.regexp_extract(c, rf"({_QUAD})\z", 1), r"\."), groups)).otherwise(c)


def _all_groups(plain: Column) -> Column:
    """The eight groups without leading zeros."""

    def filled(sides: Column) -> Column:
        parts = F.transform(sides, lambda s: F.filter(F.split(s, ":"), lambda g: g != ""))
        return let(
            parts,
            lambda p: F.concat(p[0], F.array_repeat(F.lit("0"), 8 - F.aggregate(p, F.lit(0), lambda a, s: a + F.size(s))), F.coalesce(F.get(p, F.lit(1)), F.array().cast("array<string>"))),
        )

    return F.transform(let(F.split(plain, "::", -1), filled), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def _shortened(full: Column) -> Column:
    """The first of the longest runs of zero groups, of two or more, becomes the gap."""
    out = None
    for k in range(8, 1, -1):
        run = rf"(?:^|:)0(?::0){{{k - 1}}}(?=:|\z)"
        gap = F.concat(F.regexp_extract(full, rf"^(.*?){run}", 1), F.lit("::"), F.regexp_replace(F.regexp_extract(full, rf"^.*?{run}(.*)\z", 1), "^:", ""))
        out = (F if out is None else out).when(full.rlike(run), gap)
    return out.otherwise(full)


def _canonical_v6(c: Column) -> Column:
    zone = F.regexp_extract(c, r"(%.+)\z", 1)
    plain = F.lower(_hex_tail(F.regexp_replace(c, r"%.+\z", "")))

    def spelled(g: Column) -> Column:
        number = lambda i: F.conv(g[i], 16, 10).cast("int")
        pair = lambda i: F.concat_ws(".", F.shiftright(number(i), 8).cast("string"), number(i).bitwiseAND(255).cast("string"))
        v4 = F.concat_ws(".", pair(6), pair(7))
        mapped = F.array_join(F.slice(g, 1, 6), ":") == "0:0:0:0:0:ffff"
        return F.when(mapped, v4).otherwise(F.concat(let(F.array_join(g, ":"), _shortened), zone))

    return let(_all_groups(plain), spelled)


def canonical(c: Column) -> Column:
    """The trimmed text; an address in its shortest form, an IPv4 address inside IPv6 as IPv4.

    Only texts with a colon can be IPv6; the others are left to generated code, which functions of arrays don't have.
    """
    return F.when(F.contains(c, F.lit(":")), let(trim(c), lambda t: F.when(is_v6(t), _canonical_v6(t)).otherwise(t))).otherwise(trim(c))
