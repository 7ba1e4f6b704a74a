"""Text functions of listings: normal form, bigrams, SimHash, content hash, content building, excerpts."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters trimmed from both ends of a field.
TRIM = " \t\n\r\x00\x0b"
_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0x3000])
_NARROW = "".join(chr(c - 0xFEE0) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]) + " "


def _kana() -> tuple[dict[str, str], str, str]:
    """Half-width kana to full-width, voiced pairs first, by the Unicode decompositions."""
    pairs, src, dst = {}, [], []
    for cp in range(0xFF66, 0xFF9E):
        full = unicodedata.normalize("NFKC", chr(cp))
        src.append(chr(cp))
        dst.append(full)
        for mark in "ﾞﾟ":
            joined = unicodedata.normalize("NFKC", chr(cp) + mark)
            if len(joined) == 1:
                pairs[chr(cp) + mark] = joined
    return pairs, "".join(src), "".join(dst)


_VOICED, _KANA_FROM, _KANA_TO = _kana()
_STRIP = r"[^\p{IsHan}\p{L}\p{N}]+"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM))


def text_normalize(c: Column) -> Column:
    """Half-width letters and digits, full-width kana, lower case, only letters and digits kept."""
    for mark in "ﾞﾟ":
        voiced = {h: f for h, f in _VOICED.items() if h[1] == mark}
        joined = F.transform(F.split(c, mark), lambda x: x)
        last = "".join(h[0] for h in voiced)
        c = F.when(
            c.contains(mark),
            F.aggregate(
                joined,
                F.lit(None).cast("string"),
                lambda acc, part: F.when(acc.isNull(), part).otherwise(
                    F.when(F.right(acc, F.lit(1)).isin(list(last)), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), F.translate(F.right(acc, F.lit(1)), last, "".join(voiced.values())), part)).otherwise(F.concat(acc, F.lit(mark), part))
                ),
            ),
        ).otherwise(c)
    c = F.regexp_replace(F.lower(F.translate(c, _WIDE + _KANA_FROM + "Σ", _NARROW + _KANA_TO + "σ")), _STRIP, "")
    return c


def normalize_py(s: str | None) -> str:
    """The Python twin of :func:`text_normalize`, with voiced half-width kana joined."""
    if not s:
        return ""
    for half, full in _VOICED.items():
        if half in s:
            s = s.replace(half, full)
    # a capital sigma has one small form, wherever it stands
    return _NOT_WORD.sub("", s.translate(_NARROW_MAP).replace("Σ", "σ").lower())


_NOT_WORD = re.compile(r"[\W_]+")
_NARROW_MAP = str.maketrans(_WIDE + _KANA_FROM, _NARROW + _KANA_TO)


def bigrams(norm: Column) -> Column:
    """Code-point bigrams of a normalised text; one character is its own gram, an empty text has none."""
    n = F.length(norm)
    return (
        F.when(norm.isNull() | (n == 0), F.array().cast("array<string>"))
        .when(n == 1, F.array(norm))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(norm, i, F.lit(2))))
    )


def hash64(c: Column) -> Column:
    """First eight bytes of the MD5, big-endian, as a signed bit pattern."""
    return F.conv(F.substring(F.md5(c), 1, 16), 16, -10).cast("long")


class _GramBits:
    """Signed bits of the grams seen so far, a row each; started anew when it has grown to ``limit`` rows."""

    def __init__(self, limit: int = 400_000) -> None:
        self.limit, self.at, self.rows = limit, {}, np.empty((4096, 64), np.int8)

    def votes(self, grams: list[str]) -> np.ndarray:
        if len(self.at) > self.limit:
            self.at.clear()
        at, idx = self.at, []
        for g in grams:
            k = at.get(g)
            if k is None:
                k = at[g] = len(at)
                if k == len(self.rows):
                    self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
                self.rows[k] = np.unpackbits(np.frombuffer(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:8], np.uint8)).astype(np.int8) * 2 - 1
            idx.append(k)
        return self.rows[idx].sum(axis=0, dtype=np.int64)


_GRAMS = _GramBits()


def simhash_py(text: str | None) -> int:
    """Signed 64-bit SimHash of a text: a bit is set where the weighted votes are positive; an empty text is 0."""
    s = normalize_py(text)
    if not s:
        return 0
    votes = _GRAMS.votes([s] if len(s) == 1 else [s[i : i + 2] for i in range(len(s) - 1)])
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)


def simhash64(c: Column) -> Column:
    """Arrow-batched SimHash; md5 of repeated bigrams is computed once per worker."""
    return F.pandas_udf(_simhash_series, "bigint")(c)


def _simhash_series(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash_py(t) for t in texts], dtype="int64")


def simhash_job(title: Column, company: Column, description: Column) -> Column:
    e = F.lit("")
    return simhash64(trim(F.concat_ws(" ", F.coalesce(title, e), F.coalesce(company, e), F.coalesce(description, e))))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def simhash_to_u64(c: Column) -> Column:
    return F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")


def content_hash(c: Column) -> Column:
    """SHA-256 of the lower-cased text without any white space."""
    return F.sha2(F.lower(F.regexp_replace(c, r"(?U)\s+", "")), 256)


def build_content(title: Column, company: Column, salary: Column, description: Column, empty: str = "（无正文）", limit: int = 1000) -> Column:
    """Lines of a posting: title, bracketed company, pay, description; a field equal to '0' counts as empty."""
    has = lambda c: c.isNotNull() & ~c.isin("", "0")
    body = trim(
        F.concat_ws(
            "\n",
            F.when(has(title), trim(title)),
            F.when(has(company), F.concat(F.lit("【"), trim(company), F.lit("】"))),
            F.when(has(salary), F.concat(F.lit("薪资："), trim(salary))),
            F.when(has(description), trim(description)),
        )
    )
    return F.substring(F.when(body == "", F.lit(empty)).otherwise(body), 1, limit)


def excerpt(c: Column, n: int) -> Column:
    """First non-empty line, trimmed, cut to n characters and an ellipsis."""
    line = trim(F.regexp_extract(c, r"^\n*([^\n]*)", 1))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def first_token(c: Column) -> Column:
    return F.split(c, " ")[0]


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, r"\n+"), lambda x: trim(x) != "")


def map_key(c: Column) -> Column:
    return F.lower(trim(c))


def search_key(c: Column) -> Column:
    """Case- and accent-insensitive comparison form."""
    from carda.functions.chars import fold_accents

    return fold_accents(F.lower(c))


def like_any_case(c: Column, pattern: str) -> Column:
    """``c LIKE '%pattern%'`` without regard to case and accents; % and _ in the pattern stay wildcards."""
    low = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", pattern.lower()))
    return search_key(c).like(f"%{low}%")
