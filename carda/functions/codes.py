"""Codes, clamps and labels."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper-case letters, lower-case letters and digits, without those easily taken for one another: i, l, o, 0 and 1.
ALPHABET = "".join(c for c in string.ascii_uppercase + string.ascii_lowercase + string.digits if c.lower() not in "ilo01")


def public_code(key: Column, salt: str, n: int = 10) -> Column:
    """A code of n symbols drawn from a salted hash of the key; deterministic, so that reruns agree."""
    h = F.sha2(F.concat(key.cast("string"), F.lit(":" + salt)), 256)
    byte = lambda i: F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int")
    return F.concat(*[F.substring(F.lit(ALPHABET), byte(i) % len(ALPHABET) + 1, F.lit(1)) for i in range(n)])


def dup_rate(dup: Column, new: Column) -> Column:
    total = dup + new
    return F.when(total > 0, F.concat(F.round(F.lit(100.0) * dup / total, 0).cast("int").cast("string"), F.lit("%"))).otherwise(F.lit("—"))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def labels(c: Column, names: dict[int, str], other: str = "") -> Column:
    """The label of a code; ``other`` for codes without one."""
    out = F.lit(other)
    for code, name in names.items():
        out = F.when(c == code, F.lit(name)).otherwise(out)
    return out
