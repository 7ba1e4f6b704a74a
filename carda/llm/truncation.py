"""Values cut at a field limit or in transfer.

A stack automaton reads every value from end to end over quotes, brackets, markup tags and escapes and says what is left
open at its end, whether a multi-byte character was broken, and whether the value ends with a terminator. Each source has
its own baseline of how many of its values end with a terminator, and how many leave something open: an open structure or
a missing terminator counts where the source hardly has them. Where the structure leaves it open (titles have no
terminators), two statistics decide: lengths a source's values pile up at, and how often text that reads like the value's
end really ends there.

Defined cases: null and empty values are not cut; a value of one character is judged like any other; the whole value
is read, however long; repeated rows are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carda.session import cut, sized_broadcast

#: Lengths of the end contexts, the longest with enough support decides.
CONTEXTS = (10, 6, 4)
_FLUSH = 4_000_000
_TERMINATORS = "。！？!?.…\n，,;；"
_FULL_STOPS, _GOES_ON = "。！？!?.\n", "，,;；、-（(【《&"
_PRIME = 0x9E3779B97F4A7C15
_OPEN, _CLOSE = "([{（【《「『“«¿¡", ")]}）】》」』”»?!"
_PAIR = dict(zip(_OPEN, _CLOSE))
_TOKENS = re.compile(r"[()\[\]{}（）【】《》「」『』“”«»¿¡?!]|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*>|</?[a-zA-Z][^<>\n]{0,40}$|&(?:#\w{0,6}|[a-zA-Z]{1,7})$|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|%(?:[0-9A-Fa-f])?$")
_ELLIPSIS = re.compile(r"(?:\.{2,}|…+)\s*$")
#: What a cut leaves of a broken multi-byte character.
_BROKEN = re.compile("[�\ud800-\udbff]+$")


def structure(text: str) -> int:
    """Bit flags of the automaton: 1 a bracket, quote or element is still open, 2 broken character, 4 ellipsis, 8 half markup
    or escape, 16 only an inverted mark is still open, which people often leave so."""
    flags, stack = 0, []
    if _BROKEN.search(text):
        flags |= 2
    if _ELLIPSIS.search(text):
        flags |= 4
    for m in _TOKENS.finditer(text):
        t = m[0]
        if t[0] == "<" and t[-1] == ">":
            if m[2]:
                if m[1]:
                    if m[2].lower() in stack:
                        while stack.pop() != m[2].lower():
                            pass
                elif not t.endswith("/>") and m[2].lower() not in ("br", "hr", "img", "input", "meta", "link"):
                    stack.append(m[2].lower())
        elif t[0] in "<&\\" or (t[0] == "%" and m.end() == len(text) and len(t) == 2):
            flags |= 8
        elif t in _PAIR:
            stack.append(_PAIR[t])
        elif t in stack:  # what was opened inside and never closed is given up
            while stack.pop() != t:
                pass
    if any(t not in "!?" for t in stack):
        flags |= 1
    elif stack:
        flags |= 16
    return flags


def _bare(text: str) -> str:
    """The value without what a cut leaves behind: broken characters and an ellipsis."""
    return _BROKEN.sub("", _ELLIPSIS.sub("", text))


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of all texts, digits taken as one, each text opened by enough zeros to fill any context."""
    pad = "\0" * max(CONTEXTS)
    joined = pad + pad.join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    cp[(cp >= 49) & (cp <= 57)] = 48
    cp[(cp >= 0xFF10) & (cp <= 0xFF19)] = 48
    return cp


def _hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters ending at each position from k-1 on."""
    h = np.full(len(cp) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(_PRIME) + cp[j : len(cp) - k + 1 + j]
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _context_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    enders = np.array(sorted(ord(c) for c in _TERMINATORS) + [0], dtype=np.uint64)
    waiting: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def flush() -> Iterator[pd.DataFrame]:
        for (src, k), parts in waiting.items():
            h, ended = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            bins, total = np.unique(h, return_counts=True)
            closed, times = np.unique(h[ended], return_counts=True)
            n = np.zeros(len(bins), np.int64)
            n[np.searchsorted(bins, closed)] = times
            yield pd.DataFrame({"src_table": src, "k": np.int32(k), "bin": bins, "total": total, "ended": n})
        waiting.clear()

    for pdf in batches:
        for src, part in pdf.groupby("src_table"):
            cp = _codes(part["text"].tolist())
            ends = np.isin(cp, enders)
            for k in CONTEXTS:
                inside = ~ends[k - 1 : -1]
                waiting.setdefault((src, k), []).append((_hashes(cp, k)[:-1][inside], ends[k:][inside]))
            held += len(cp)
        if held > _FLUSH:
            yield from flush()
            held = 0
    yield from flush()


def _tails(texts: pd.Series) -> pd.DataFrame:
    width = max(CONTEXTS)
    bares = [_bare(t) for t in texts]
    tails = [b[-width:] for b in bares]
    out = {
        "flags": [structure(t) for t in texts],
        "bare": [len(b) for b in bares],
        "bytes": [len(b.encode("utf-8", "surrogatepass")) for b in bares],
        "last": [0 if not b else 2 if b[-1] in _FULL_STOPS else 1 if b[-1] in _GOES_ON or (b[-1] == " " and b.rstrip()[-1:] in _GOES_ON) else 0 for b in bares],
    }
    if not tails:
        return pd.DataFrame({**out, "own": [], "bins": []})
    # whether the value's own end is among the counts
    out["own"] = [bool(b) and b[-1] not in _TERMINATORS for b in bares]
    cp = _codes(tails)
    at = np.cumsum([len(t) + width for t in tails]) - 1
    out["bins"] = list(np.stack([_hashes(cp, k)[at - k + 1] for k in CONTEXTS], axis=1))
    return pd.DataFrame(out)


def judge_truncation(values: DataFrame, min_support: int = 4, low: float = 0.08, at_limit: float = 0.45, usual: float = 0.9, rare: float = 0.02) -> DataFrame:
    """(src_table, row_id, source, text) -> (src_table, row_id, source, flags, ratio, limited, unclosed, unended, cut).

    ``unclosed``: a structure is open in a source of which at most a share of ``rare`` leaves one open. ``unended``: no
    terminator in a source of which a share of ``usual`` ends with one.
    """
    values = values.select("src_table", "row_id", "source", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    tail_udf = F.pandas_udf(_tails, "struct<flags:int,bare:int,bytes:int,last:int,own:boolean,bins:array<bigint>>")
    counts = values.select("src_table", "text").mapInPandas(_context_counts, "src_table string, k int, bin long, total long, ended long")
    counts = counts.groupBy("src_table", "k", "bin").agg(F.sum("total").alias("total"), F.sum("ended").alias("ended"))
    tails = cut(values.select("src_table", "row_id", "source", F.xxhash64("text").alias("copy"), tail_udf("text").alias("t")).select("src_table", "row_id", "source", "copy", "t.*"))
    distinct = tails.dropDuplicates(["src_table", "source", "copy"])
    base = distinct.groupBy("src_table", "source").agg(F.avg((F.col("last") == 2).cast("int")).alias("ended_share"), F.avg((F.col("flags").bitwiseAND(1) != 0).cast("int")).alias("open_share"))
    base = cut(base.withColumnRenamed("source", "s"))
    copies = tails.groupBy("src_table", "copy").agg(F.count("*").alias("copies"))
    # limits: lengths a source's values pile up at, in characters or bytes, with nothing much beyond
    lengths = tails.where("bare > 0").dropDuplicates(["src_table", "source", "copy"]).select("src_table", "source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("bare").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("x"))
    hist = lengths.groupBy("src_table", "source", "x.unit", "x.n").agg(F.count("*").alias("c"))
    per = Window.partitionBy("src_table", "source", "unit").orderBy("n")
    total = F.sum("c").over(Window.partitionBy("src_table", "source", "unit"))
    below = F.coalesce(F.sum("c").over(per.rangeBetween(-6, -1)), F.lit(0)) / 6.0
    above = F.coalesce(F.sum("c").over(per.rangeBetween(1, 6)), F.lit(0)) / 6.0
    beyond = F.coalesce(F.sum("c").over(per.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    near = hist.select("src_table", "source", "unit", "n", "c", below.alias("below"), above.alias("above"), beyond.alias("beyond"), total.alias("total"))
    share = F.lit(1.0) - F.least(F.lit(1.0), F.col("below") / F.col("c"))
    piled = (F.col("c") >= 8) & (((F.col("beyond") <= 0.002 * F.col("total")) & (share > 0.3)) | ((share > 0.9) & (F.col("c") > 8 * F.col("above"))))
    limits = near.where(piled).select("src_table", "source", "unit", "n", share.alias("share"))
    limits = cut(limits)
    by_char = limits.where("unit = 'chars'").select("src_table", F.col("source").alias("s"), F.col("n").alias("bare"), F.col("share").alias("char_share"))
    by_byte = limits.where("unit = 'bytes'").select("src_table", F.col("source").alias("s"), F.col("n").alias("bytes"), F.col("share").alias("byte_share"))
    contexts = tails.join(copies, ["src_table", "copy"]).select("src_table", "row_id", "own", "copies", F.posexplode("bins").alias("p", "bin")).withColumn("k", F.array(*[F.lit(k) for k in CONTEXTS])[F.col("p")])
    # a context that only the judged text and its copies hold decides nothing; copies are otherwise counted, since whole
    # values are repeated, too
    others = contexts.join(counts, ["src_table", "k", "bin"], "left").withColumn("rest", F.col("total") - F.when(F.col("own"), F.col("copies")).otherwise(0))
    seen = others.groupBy("src_table", "row_id").agg(
        F.max(F.when(F.col("rest") >= min_support, F.struct("k", (F.col("ended") / F.col("total")).alias("ratio"), "total"))).alias("best")
    )
    x = tails.join(seen, ["src_table", "row_id"], "left")
    x = x.join(by_char, (x.src_table == by_char.src_table) & x.source.eqNullSafe(by_char.s) & (x.bare == by_char.bare), "left").select(x["*"], "char_share", "best.ratio")
    x = x.join(by_byte, (x.src_table == by_byte.src_table) & x.source.eqNullSafe(by_byte.s) & (x.bytes == by_byte.bytes), "left").select(x["*"], "byte_share")
    share = F.coalesce(F.greatest("char_share", "byte_share"), F.lit(0.0))
    ratio = F.when(F.col("last") == 2, 1.0).when(F.col("last") == 1, 0.0).otherwise(F.coalesce("ratio", F.lit(0.5)))
    base = sized_broadcast(base.select(F.col("src_table").alias("st"), "s", "ended_share", "open_share"), base.count())  # a row a source
    x = x.join(base, (x.src_table == F.col("st")) & x.source.eqNullSafe(F.col("s")), "left")
    unclosed = (F.col("flags").bitwiseAND(1) != 0) & (F.col("open_share") <= rare) & (F.col("last") != 2)
    unended = (F.col("last") != 2) & (F.col("ended_share") >= usual)
    is_cut = (
        (F.col("flags").bitwiseAND(2) != 0)
        | (F.col("flags").bitwiseAND(8) != 0)
        | (ratio < low)
        | ((share > 0.4) & (ratio < at_limit))
        | ((share > 0.85) & (F.col("last") != 2))
        | ((F.col("flags").bitwiseAND(4) != 0) & (ratio < at_limit))
        | unclosed
        | (unended & (ratio < at_limit))
        | ((F.col("flags").bitwiseAND(17) != 0) & (ratio < at_limit))
    )
    return x.select("src_table", "row_id", "source", "flags", ratio.alias("ratio"), share.alias("limited"), unclosed.alias("unclosed"), unended.alias("unended"), is_cut.alias("cut"))


def listing_values(jobs: DataFrame, posts: DataFrame) -> DataFrame:
    """Job titles by source_site and post contents by origin."""
    a = jobs.select(F.lit("jobs_clean").alias("src_table"), F.col("id").alias("row_id"), F.col("source_site").alias("source"), F.col("title").alias("text"))
    b = posts.select(F.lit("posts").alias("src_table"), F.col("id").alias("row_id"), F.col("origin").alias("source"), F.col("content").alias("text"))
    return a.unionByName(b)


def truncation_rates(judged: DataFrame) -> DataFrame:
    """(src_table, source, rows, cut_rows, cut_share): how often each source truncates."""
    return judged.groupBy("src_table", "source").agg(F.count("*").alias("rows"), F.sum(F.col("cut").cast("int")).alias("cut_rows")).withColumn("cut_share", F.round(F.col("cut_rows") / F.col("rows"), 6))
