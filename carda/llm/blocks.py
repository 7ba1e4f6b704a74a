"""The main body of a web page: blocks of visible text labelled by a bidirectional LSTM in numpy.

A page becomes the sequence of its leaf blocks. Each block is a vector of its hashed tag path, its hashed words and a
few measures; the recurrent labeller reads the sequence in both directions and decides every block with the whole
document in view. The weights in ``blocks_model.npz`` are fitted by ``carda.llm.blocks_training``.

Defined cases: null, empty and tag-only pages have no blocks; a page of any length is one sequence; blocks whose text
is empty after removing white space do not exist; repeated page ids are
labelled each on its own; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Inline elements of HTML; every other element parts text into blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|title|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>|[^<]+|<", re.S | re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\bhidden\b|aria-hidden\s*=\s*[\"']?true", re.I)
_CLASS = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([A-Za-z][A-Za-z-]*)")
_SPACE = re.compile(r"\s+|[ 　​﻿]+")
_WORD = re.compile(r"[a-záéíóúñü]+|\d+|[^\sa-z0-9áéíóúñü]")

PATH_BUCKETS, WORD_BUCKETS, DIM, HIDDEN, MEASURES = 1024, 4096, 16, 32, 10


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


_word_hash = lru_cache(maxsize=262144)(_hash)


class Block:
    __slots__ = ("text", "path", "depth", "linked", "hidden")

    def __init__(self, text: str, path: tuple[str, ...], depth: int, linked: float, hidden: bool) -> None:
        self.text, self.path, self.depth, self.linked, self.hidden = text, path, depth, linked, hidden

    @property
    def squeezed(self) -> str:
        return _SPACE.sub("", self.text)


def leaf_blocks(page: str) -> list[Block]:
    """Stretches of text between block-level tags or line breaks, in document order."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # element, its label, whether hidden
    parts: list[str] = []
    link_chars = total_chars = 0
    in_link = 0

    def close() -> None:
        nonlocal link_chars, total_chars
        if parts:
            text = html_lib.unescape("".join(parts)) if total_chars else ""
            if text.strip():
                out.append(Block(text, tuple(s[1] for s in stack[-4:]), len(stack), link_chars / max(1, total_chars), any(s[2] for s in stack)))
            parts.clear()
        link_chars = total_chars = 0

    for m in _TOKEN.finditer(page):
        t = m[0]
        name = m[3]
        if name is None:
            if m[1] is not None:
                if m[1].lower() not in ("svg",):
                    close()
            elif t[0] != "<" or t == "<":
                parts.append(t)
                n = len(t.strip())
                total_chars += n
                if in_link:
                    link_chars += n
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = 0 if m[2] else 1
            continue
        close()
        if name in _VOID:
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            if name in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()
            attrs = m[4] or ""
            c = _CLASS.search(attrs)
            label = f"{name}.{c[1].lower()}" if c else name
            stack.append((name, label, bool(attrs) and bool(_HIDDEN.search(attrs))))
            in_link = 0
    close()
    return out


@lru_cache(maxsize=65536)
def _path_buckets(path: tuple[str, ...]) -> tuple[int, int, int]:
    return (_hash(">".join(path)) % PATH_BUCKETS, _hash(">".join(path[-2:])) % PATH_BUCKETS, _hash("1" + ">".join(x.partition(".")[0] for x in path)) % PATH_BUCKETS)


def _words_of(text: str) -> tuple[np.ndarray, float, float, float, float]:
    """Word and bigram buckets of a block, and its measures: size, stops, full stop at the end, share of digits."""
    low = text.lower()
    toks, digits = _WORD.findall(low), 0
    for i, x in enumerate(toks):
        if x[0].isdigit():
            digits += len(x)
            toks[i] = "0"
    grams = [_word_hash(x) % WORD_BUCKETS for x in toks]
    grams += [_word_hash(x + "_" + y) % WORD_BUCKETS for x, y in zip(toks, toks[1:])]
    size = len(low.strip())
    stops = sum(map(low.count, "。.，,;；"))
    return np.asarray(grams or [0], np.int32), math.log1p(size) / 6.0, min(1.0, stops / 8.0), float(low.rstrip().endswith(("。", ".", "！", "!"))), min(1.0, digits / max(1, size))


#: The furniture of a site is the same on every page.
_short_words = lru_cache(maxsize=65536)(_words_of)


def features(blocks: list[Block]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Path buckets (n, 3), word buckets per block, and measures (n, MEASURES)."""
    n = len(blocks)
    seen = Counter(b.path for b in blocks)
    words: list[np.ndarray] = []
    rows: list[tuple[float, ...]] = []
    for i, b in enumerate(blocks):
        grams, size, stops, ended, digits = (_short_words if len(b.text) <= 120 else _words_of)(b.text)
        words.append(grams)
        rows.append((size, b.linked, i / max(1, n - 1), float(b.hidden), stops, ended, digits, min(1.0, b.depth / 12.0), min(1.0, seen[b.path] / 12.0), 1.0))
    paths = np.array([_path_buckets(b.path) for b in blocks], np.int32).reshape(n, 3)
    return paths, words, np.array(rows, np.float32).reshape(n, MEASURES)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d = 2 * DIM + MEASURES
    m = {"path": r.normal(0, 0.1, (PATH_BUCKETS, DIM)), "word": r.normal(0, 0.1, (WORD_BUCKETS, DIM))}
    for way in "fb":
        m[f"W{way}"] = r.normal(0, 1 / np.sqrt(d + HIDDEN), (d + HIDDEN, 4 * HIDDEN))
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1.0
        m[f"c{way}"] = bias
    m["out"] = r.normal(0, 0.1, (2 * HIDDEN + d, 1))
    m["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in m.items()}


def inputs(model: dict[str, np.ndarray], feats: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Padded input (pages, steps, d) and mask (pages, steps)."""
    steps = max(len(f[1]) for f in feats)
    x = np.zeros((len(feats), steps, 2 * DIM + MEASURES), np.float32)
    mask = np.zeros((len(feats), steps), np.float32)
    for i, (paths, words, meas) in enumerate(feats):
        n = len(words)
        x[i, :n, :DIM] = model["path"][paths].mean(axis=1)
        flat = np.concatenate(words)
        starts = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1]))
        sums = np.add.reduceat(model["word"][flat], starts, axis=0)
        x[i, :n, DIM : 2 * DIM] = sums / np.asarray([len(w) for w in words], np.float32)[:, None]
        x[i, :n, 2 * DIM :] = meas
        mask[i, :n] = 1
    return x, mask


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, bias: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (pages, steps, HIDDEN) of one direction; padded steps carry the state through unchanged."""
    n, steps, d = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((n, steps, HIDDEN), np.float32)
    pre = x.reshape(-1, d) @ w[:d]
    pre = pre.reshape(n, steps, -1) + bias
    for t in range(steps):
        z = pre[:, t] + h @ w[d:]
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        k = mask[:, t : t + 1]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc, k))
        c = k * c2 + (1 - k) * c
        h = k * h2 + (1 - k) * h
        out[:, t] = h
    return out


def predict(model: dict[str, np.ndarray], feats: list) -> list[np.ndarray]:
    """Probability of belonging to the main body, for every block of every page."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(feats)
    order = sorted((i for i in range(len(feats)) if len(feats[i][1])), key=lambda i: len(feats[i][1]))
    for at in range(0, len(order), 128):
        ids = order[at : at + 128]
        x, mask = inputs(model, [feats[i] for i in ids])
        fwd = lstm(x, mask, model["Wf"], model["cf"])
        bwd = lstm(x[:, ::-1], mask[:, ::-1], model["Wb"], model["cb"])[:, ::-1]
        p = _sigmoid(np.concatenate([fwd, bwd, x], axis=2) @ model["out"] + model["bias"])[..., 0]
        for row, i in enumerate(ids):
            out[i] = p[row, : len(feats[i][1])]
    return out


def load_model() -> dict[str, np.ndarray]:
    import io
    import pkgutil

    raw = pkgutil.get_data("carda.llm", "blocks_model.npz")
    if raw is None:
        raise FileNotFoundError("blocks_model.npz; fit it with carda.llm.blocks_training")
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


MODEL_FILE = Path(__file__).with_name("blocks_model.npz")


def block_md5(squeezed: str) -> str:
    return hashlib.md5(squeezed.encode("utf-8", "surrogatepass")).hexdigest()


def main_blocks(pages: DataFrame, key: str = "id", markup: str = "raw_html", threshold: float = 0.5, once: bool = False) -> DataFrame:
    """(page_id, pos, block_md5, text): the blocks of each page's main body, in order; equal ones once a page if ``once``."""
    model = pages.sparkSession.sparkContext.broadcast(load_model())  # a fixed few hundred kB

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple[int, int, str, str]] = []
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                blocks = [leaf_blocks(h) for h in part["markup"]]
                probs = predict(model.value, [features(b) for b in blocks])
                for page, bs, ps in zip(part["page_id"], blocks, probs):
                    seen: set[str] = set()
                    for k, (b, p) in enumerate(zip(bs, ps)):
                        if p >= threshold and not b.hidden and (s := b.squeezed) and not (once and s in seen):
                            seen.add(s)
                            rows.append((page, k, block_md5(s), b.text.strip()))
            yield pd.DataFrame(rows, columns=["page_id", "pos", "block_md5", "text"])

    src = pages.select(F.col(key).alias("page_id"), F.col(markup).alias("markup")).where(F.col("markup").isNotNull())
    return src.mapInPandas(label, "page_id long, pos int, block_md5 string, text string")


def main_text(pages: DataFrame, key: str = "id", markup: str = "raw_html") -> DataFrame:
    """(page_id, text): the main body of each page, its blocks on lines of their own."""
    b = main_blocks(pages, key, markup)
    return b.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
