"""Contact functions: phone and chat-id normal forms, keys, masks and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carda.functions.text import trim


def phone9(c: Column) -> Column:
    """Digits without country prefix, the last nine; shorter numbers stay as they are, none gives null."""
    d = F.regexp_replace(trim(c), "[^0-9]", "")
    d = F.when(d.startswith("0034"), F.substring(d, 5, 1000)).when(d.startswith("34") & (F.length(d) == 11), F.substring(d, 3, 1000)).otherwise(d)
    return F.nullif(F.when(F.length(d) < 9, d).otherwise(F.right(d, F.lit(9))), F.lit(""))


def phone_main(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9+]", ""), 1, 20)


def wechat_norm(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(trim(c)), r"(?U)\s+", ""), F.lit(""))


def contact_key(phone: Column, wechat: Column) -> Column:
    return F.when(phone.isNotNull() | wechat.isNotNull(), F.concat(F.coalesce(phone, F.lit("")), F.lit("|"), F.coalesce(wechat, F.lit(""))))


def phone_mask(c: Column) -> Column:
    d = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), 1, 3)
    return F.concat(F.when(d == "", F.lit("···")).otherwise(d), F.lit(" ·· ··"))


def contact_in_content(c: Column) -> Column:
    """Whether a text states a phone-like number or a chat id."""
    return c.rlike(r"\+?[0-9][0-9 ().-]{7,}") | c.rlike(r"(?iU)(微信|weixin|wechat|wx)\s*[:：]?\s*[A-Za-z0-9_-]{5,}")


def valid_phone(raw: Column) -> Column:
    return raw.rlike(r"^\+?[0-9 ().-]{9,20}$") & (F.length(phone_main(raw)) >= 9)


def ip_text(packed: Column) -> Column:
    """Dotted form of a packed IPv4 address; other lengths as colon-separated hex groups."""
    h = F.hex(packed)
    four = F.concat_ws(".", *[F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10) for i in range(4)])
    return F.when(F.length(h) == 8, four).when(h.isNotNull(), F.lower(F.array_join(F.regexp_extract_all(h, F.lit("(.{4})"), 1), ":")))


def ip_pack(text: Column) -> Column:
    """Packed bytes of an IPv4 or IPv6 address; four zero bytes where it does not parse."""
    part = F.split(text, r"\.")
    num = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("int")
    v4 = text.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
    for i in range(4):
        v4 = v4 & (num(i) <= 255)
    # groups before and after a double colon, which stands for the zeros between them
    halves = F.split(text, "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    head, tail = groups(1), groups(2)
    given = F.size(head) + F.size(tail)
    shape = text.rlike(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?$") & (F.length(text) > 0)
    v6 = shape & F.when(F.size(halves) == 2, given < 8).otherwise(given == 8)
    wide = lambda xs: F.array_join(F.transform(xs, lambda g: F.lpad(g, 4, "0")), "")
    full = F.concat(wide(head), F.repeat(F.lit("0000"), F.greatest(F.lit(0), F.lit(8) - given)), wide(tail))
    return F.unhex(F.when(v4, F.concat(*[F.lpad(F.hex(num(i)), 2, "0") for i in range(4)])).when(v6, full).otherwise(F.lit("00000000")))


def forwarded_ip(header: Column, peer: Column, trusted: bool) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split(header, ",")[0]), F.lit("")), peer) if trusted else peer


def safe_back(path: Column, default: str = "/") -> Column:
    """A path of this site to go back to: one leading slash, no second one, no backslash; else ``default``."""
    return F.when(path.rlike(r"^/(?!/)") & ~path.contains("\\"), path).otherwise(F.lit(default))
